"""Attributes as they were known at an event's time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Node sizes as powers of two of microseconds, ascending: about 102 days and 815 days. Each further size sends every
#: event once more and saves nodes of long intervals only.
LEVELS = (43, 46)
#: Size tag of the node of all times from the horizon on; buckets of a hash by which entities without intervals drop out.
BEYOND, BUCKETS = 63, 1 << 16


def validity(known: DataFrame, entity: str, known_us: str, precedence: Sequence[Column], values: Sequence[str]) -> DataFrame:
    """Half-open intervals ``[__from, __to)`` in which one row of ``known`` is the leading one of its entity.

    At any time the rows known at or before it compete; the one with the greatest ``precedence`` (a sequence of
    columns, compared in order) leads. ``__to`` is null for the last interval. Rows with a null entity or time are
    left out. The window holds one entity; callers reduce its rows to as many as it has reporting periods first.
    """
    rank = F.struct(*precedence, *[F.col(v).alias(f"v_{v}") for v in values])
    rows = known.dropna(subset=[entity, known_us]).groupBy(F.col(entity).alias("__e"), F.col(known_us).alias("__from")).agg(F.max(rank).alias("__r"))
    order = Window.partitionBy("__e").orderBy("__from")
    rows = rows.withColumn("__best", F.max("__r").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.filter(F.col("__best").isNull() | (F.col("__r") > F.col("__best")))
    rows = rows.withColumn("__to", F.lead("__from").over(order))
    return rows.select("__e", "__from", "__to", *[F.col(f"__r.v_{v}").alias(v) for v in values])


def dyadic_nodes(start: Column, end: Column, levels: Sequence[int] = LEVELS) -> Column:
    """Nodes of sizes ``2 ** level`` that cover [start, end), as an array of ``node * 64 + level``.

    From the smallest size up: at both edges nodes of this size until the next larger one fits, whose whole nodes then
    cover the inside. Only the outermost nodes of the smallest size stick out. With all successive sizes there are at
    most two nodes of each but the largest.
    """
    run = lambda level, a, b: F.when(a < b, F.transform(F.sequence(a, b - 1), lambda x: x * 64 + F.lit(level))).otherwise(F.array().cast("array<bigint>"))
    low, high = F.shiftright(start, levels[0]), F.shiftright(end - 1, levels[0]) + 1
    parts = []
    for small, large in zip(levels, levels[1:]):
        by = large - small
        up, down = F.shiftright(low + ((1 << by) - 1), by), F.shiftright(high, by)
        inside = up < down
        parts += [run(small, low, F.when(inside, F.shiftleft(up, by)).otherwise(high)), run(small, F.when(inside, F.shiftleft(down, by)).otherwise(high), high)]
        low, high = F.when(inside, up).otherwise(F.lit(0).cast("long")), F.when(inside, down).otherwise(F.lit(0).cast("long"))
    return F.concat(*parts, run(levels[-1], low, high))


def known_at(events: DataFrame, intervals: DataFrame, entity: str, at_us: str, levels: Sequence[int] = LEVELS) -> DataFrame:
    """Each event with the interval of its entity that holds at its time: ``from <= at < to``.

    ``intervals`` come from :func:`validity` and don't overlap within an entity, so an event has at most one; events
    without one, or with a null entity or time, are left out. Each interval is decomposed into dyadic time nodes; each
    event is sent once per node size to the node that encloses it; the join is on equality of entity and node, and
    keeps exact matches only. An interval without end is decomposed up to a horizon, the start of the latest interval
    and the largest node after it; from there on it has one node, to which only events from there on go.

    Events of entities without intervals are dropped before they are multiplied, by a set of hash buckets that holds
    at most ``BUCKETS`` numbers. The join key spreads an entity over its nodes, so a hot entity becomes many keys, which
    adaptive execution splits further. ``intervals`` are read three times (horizon, buckets, join) and are best written
    before. Columns of both sides are kept (of equal names those of the intervals).
    """
    latest = intervals.agg(F.max("__from").alias("latest")).first()["latest"] or 0
    horizon = F.lit(((latest >> levels[-1]) + 2) << levels[-1])
    clash = [c for c in events.columns if c in intervals.columns]
    keyed = events.drop(*[c for c in clash if c not in (entity, at_us)]).dropna(subset=[entity, at_us])
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")
    there = intervals.select(bucket("__e").alias("__b")).distinct()  # BUCKETS numbers at most
    keyed = keyed.withColumn("__b", bucket(entity)).join(F.broadcast(there), "__b", "left_semi").drop("__b")
    enclosing = F.array(*[F.shiftright(F.col(at_us), k) * 64 + F.lit(k) for k in levels])
    beyond = F.array(F.lit(BEYOND).cast("long"))
    keyed = keyed.withColumn("__n", F.explode(F.when(F.col(at_us) < horizon, enclosing).otherwise(beyond)))
    nodes = dyadic_nodes(F.col("__from"), F.coalesce("__to", horizon), levels)
    nodes = F.when(F.col("__to").isNull(), F.concat(nodes, beyond)).otherwise(nodes)
    held = intervals.withColumn("__node", F.explode(nodes))
    on = (F.col(entity) == F.col("__e")) & (F.col("__n") == F.col("__node")) & (F.col(at_us) >= F.col("__from")) & (F.col("__to").isNull() | (F.col(at_us) < F.col("__to")))
    # Sizes after explode are underestimated, so the side to broadcast isn't left to the estimate: both are sorted.
    return keyed.join(held.hint("merge"), on).drop("__e", "__n", "__node", "__from", "__to")
