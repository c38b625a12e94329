"""Totals and averages over trailing periods, days without activity included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sums are kept as decimals of this type: a difference of two prefix sums is then exact, whatever lies before it.
EXACT = "decimal(38,6)"


def finite(value: Column) -> Column:
    """Null instead of NaN and infinite values."""
    value = value.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def latest_delivery(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row per ``keys``: the values of the row that is greatest by ``order`` (nulls come first).

    A partial aggregation before the shuffle, which is on all ``keys``: a key with many deliveries sends one row per
    input partition. Rows with a null key are left out.
    """
    kept = df.dropna(subset=list(keys))
    best = F.max(F.struct(*order, *[F.col(v).alias(f"__{v}") for v in values]))
    return kept.groupBy(*keys).agg(best.alias("__best")).select(*keys, *[F.col(f"__best.__{v}").alias(v) for v in values])


def trailing(df: DataFrame, entity: str, day: str, values: Sequence[str], windows: Sequence[int] = (7, 30)) -> DataFrame:
    """Per entity and calendar day, from its first to its last row: totals and averages of the trailing periods.

    ``df`` has one row per entity and day (see :func:`latest_delivery`). Per entity, prefix sums run over its rows;
    each row is carried forward to the day before the next one; a trailing total is the prefix at the day less the
    prefix ``n`` days earlier. Prefix sums are exact decimals with 6 digits after the point.

    Result: ``entity, day, has_row`` and for each value v and period n: ``v_total_n``, ``v_rows_n`` (rows with a value
    in the period) and ``v_avg_n``, the total over ``v_rows_n``, and ``v_daily_n``, the total over the calendar days
    of the period since the entity's first day. Null, NaN and infinite values count as no value; a period without
    values has total 0 and average null. Rows with a null entity or day are left out. Of clashing columns only those
    named are read.

    One shuffle by entity serves both windows. A window holds one entity's days, so at most as many rows as the
    calendar has days between its first and last row, however many rows were delivered for them.
    """
    df = df.dropna(subset=[entity, day]).select(F.col(entity).alias("__e"), F.col(day).cast("date").alias("__d"), *[finite(F.col(v)).alias(f"__v{k}") for k, v in enumerate(values)])
    rows = Window.partitionBy("__e").orderBy("__d")
    upto = rows.rowsBetween(Window.unboundedPreceding, 0)
    prefix: dict[str, Column] = {"__next": F.lead("__d").over(rows), "__first": F.min("__d").over(upto)}
    for k in range(len(values)):
        prefix[f"__s{k}"] = F.sum(F.coalesce(F.col(f"__v{k}").try_cast(EXACT), F.lit(0).cast(EXACT))).over(upto)
        prefix[f"__n{k}"] = F.count(f"__v{k}").over(upto)
    filled = df.select("__e", "__d", *[c.alias(n) for n, c in prefix.items()])
    end = F.coalesce(F.date_sub("__next", 1), F.col("__d"))
    filled = filled.withColumn("__day", F.explode(F.sequence("__d", end)))
    days = Window.partitionBy("__e").orderBy("__day")
    out = [F.col("__e").alias(entity), F.col("__day").alias(day), (F.col("__day") == F.col("__d")).alias("has_row")]
    ends = {}
    for k, _ in enumerate(values):
        for n in windows:
            ends[f"__s{k}_{n}"] = F.col(f"__s{k}") - F.coalesce(F.lag(f"__s{k}", n).over(days), F.lit(0).cast(EXACT))
            ends[f"__n{k}_{n}"] = F.col(f"__n{k}") - F.coalesce(F.lag(f"__n{k}", n).over(days), F.lit(0))
    filled = filled.select("*", *[c.alias(n) for n, c in ends.items()])
    for k, v in enumerate(values):
        for n in windows:
            total, count = F.col(f"__s{k}_{n}").cast("double"), F.col(f"__n{k}_{n}")
            out += [
                total.alias(f"{v}_total_{n}"),
                count.alias(f"{v}_rows_{n}"),
                (total / F.nullif(count, F.lit(0))).alias(f"{v}_avg_{n}"),
                (total / F.least(F.lit(n), F.datediff("__day", "__first") + 1)).alias(f"{v}_daily_{n}"),
            ]
    return filled.select(*out)
