"""Pairs of records of one entity that lie nearest in time, by a learned index."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Days of one time shard, and the bound of the index's error in positions.
SHARD_DAYS, ERROR = 730, 16


def fit_segments(keys: np.ndarray, error: int = ERROR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First keys, first positions and slopes of straight pieces that miss no key's position by more than ``error``.

    ``keys`` are strictly increasing. Greedy: a piece goes on while some slope through its first point keeps all its
    points within the bound.
    """
    starts, slopes = [], []
    at, n = 0, len(keys)
    while at < n:
        low, high, end, reach = np.zeros(0), np.zeros(0), at + 1, 256
        while end < n:  # slopes that keep the points so far within the bound, for as many points as it takes
            end = min(n, at + reach)
            run, rise = keys[at + 1 : end] - keys[at], np.arange(1, end - at)
            low, high = np.maximum.accumulate(np.maximum((rise - error) / run, 0.0)), np.minimum.accumulate((rise + error) / run)
            over = np.flatnonzero(low > high)
            if len(over):
                end = at + 1 + int(over[0])
                break
            reach *= 4
        last = end - at - 2
        starts.append(at)
        slopes.append((low[last] + high[last]) / 2 if last >= 0 else 0.0)
        at = end
    first = np.asarray(starts, dtype=np.int64)
    return keys[first] if len(first) else keys[:0], first, np.asarray(slopes)


def lower_bound(keys: np.ndarray, segments: tuple[np.ndarray, np.ndarray, np.ndarray], wanted: np.ndarray, error: int = ERROR) -> np.ndarray:
    """For each wanted value the number of keys below it, predicted by the segments and made exact by a local search."""
    n = len(keys)
    if not n:
        return np.zeros(len(wanted), dtype=np.int64)
    first_key, first_at, slope = segments
    piece = np.clip(np.searchsorted(first_key, wanted, side="right") - 1, 0, None)
    guess = first_at[piece] + np.maximum(0.0, slope[piece] * (wanted - first_key[piece]))
    limit = np.append(first_at[1:], n)[piece]
    guess = np.minimum(guess, limit).astype(np.int64)
    reach = error + 2
    low = np.clip(guess - reach, 0, n)
    steps = np.arange(2 * reach + 1)
    at = np.empty(len(wanted), dtype=np.int64)
    for begin in range(0, len(wanted), 8192):  # blocks bound the memory
        part = slice(begin, begin + 8192)
        window = low[part, None] + steps
        inside = window < n
        at[part] = low[part] + ((keys[np.minimum(window, n - 1)] < wanted[part, None]) & inside).sum(axis=1)
    missed = ((at > 0) & (keys[np.maximum(at - 1, 0)] >= wanted)) | ((at < n) & (keys[np.minimum(at, n - 1)] < wanted))
    if missed.any():  # rounding of the slope could miss by one; the answer stays exact
        at[missed] = np.searchsorted(keys, wanted[missed], side="left")
    return at


def _match(left: pd.DataFrame, right: pd.DataFrame, low: int, high: int) -> pd.DataFrame:
    names = pd.unique(pd.concat([left["e"], right["e"]], ignore_index=True))
    code = {e: i for i, e in enumerate(names)}
    both = np.concatenate([left["d"].to_numpy(np.int64), right["d"].to_numpy(np.int64)])
    origin = int(both.min()) - abs(low) - abs(high) - 1
    span = int(both.max()) - origin + abs(low) + abs(high) + 2
    key = right["e"].map(code).to_numpy(np.int64) * span + right["d"].to_numpy(np.int64) - origin
    order = np.argsort(key, kind="stable")
    keys, ids = key[order], right["i"].to_numpy(np.int64)[order]
    segments = fit_segments(keys)
    t = left["e"].map(code).to_numpy(np.int64) * span + left["d"].to_numpy(np.int64) - origin
    far, n = np.iinfo(np.int64).max, len(keys)
    after = np.minimum(at := lower_bound(keys, segments, t + max(low, 0)), n - 1)
    gap, place = np.where((at < n) & (keys[after] <= t + high), keys[after] - t, far), after
    if low < 0:
        before = np.maximum(at := lower_bound(keys, segments, t + min(high, 0) + 1) - 1, 0)
        back = np.where((at >= 0) & (keys[before] >= t + low), t - keys[before], far)
        better = (back < gap) | ((back == gap) & (ids[before] < ids[after]))
        gap, place = np.where(better, back, gap), np.where(better, before, place)
    ok = gap < far
    place = place[ok]
    return pd.DataFrame({"__e": left["e"].to_numpy()[ok], "__d": left["d"].to_numpy()[ok], "__i": ids[place], "__c": right["c"].to_numpy()[order][place]})


def nearest(
    left: DataFrame, right: DataFrame, entity: str, left_day: str, right_day: str, right_id: str, low: int, high: int,
    buckets: int | None = None, shard_days: int = SHARD_DAYS, carry: str | None = None,
) -> DataFrame:
    """Each row of ``left`` with the id of the row of ``right`` of its entity nearest in time.

    Days are day numbers or dates. Partners lie ``low`` to ``high`` days after the left day, both included (negative:
    before it); of equally near ones, and of several on one day, the smallest ``right_id`` counts. Rows without a
    partner, or with a null entity or day, are left out; all columns of ``left`` are kept and ``right_id`` is added
    (a column of that name in ``left`` is replaced), and so is ``carry``, a whole-numbered column of ``right`` without
    nulls, if one is named. Repeated left rows each get their partner.

    Both sides are first reduced to one row per entity and day, before and after the shuffle, so no key is hot. Then
    entities are hashed to buckets and time is cut into shards; right rows are copied to each shard whose left rows
    they can serve. In each shard an exact search runs on sorted keys (entity, day) behind a piecewise-linear index. A
    shard holds, for each of its entities, at most as many rows as it has days. ``buckets`` defaults to four times
    the shuffle partitions, the number that is raised with the data.
    """
    spark = left.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    number = lambda c, df: F.unix_date(c) if dict(df.dtypes)[c] == "date" else F.col(c)
    bucket = F.pmod(F.xxhash64("e"), F.lit(buckets)).cast("int")
    probes = left.select(F.col(entity).alias("e"), number(left_day, left).cast("int").alias("d")).dropna().distinct()
    probes = probes.withColumns({"b": bucket, "s": F.floor(F.col("d") / F.lit(shard_days)).cast("int")})
    base = right.select(F.col(entity).alias("e"), number(right_day, right).cast("int").alias("d"), F.col(right_id).cast("long").alias("i"), (F.col(carry) if carry else F.lit(0)).cast("long").alias("c"))
    base = base.dropna().groupBy("e", "d").agg(F.min(F.struct("i", "c")).alias("r")).select("e", "d", "r.i", "r.c")
    shards = F.sequence(F.floor((F.col("d") - F.lit(high)) / F.lit(shard_days)).cast("int"), F.floor((F.col("d") - F.lit(low)) / F.lit(shard_days)).cast("int"))
    base = base.withColumns({"b": bucket, "s": F.explode(shards)})

    def shard(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"__e": pd.Series(dtype=str), "__d": pd.Series(dtype="int32"), "__i": pd.Series(dtype="int64"), "__c": pd.Series(dtype="int64")})
        return _match(a, b, low, high)

    kind = left.schema[entity].dataType.simpleString()
    pairs = probes.groupBy("b", "s").cogroup(base.groupBy("b", "s")).applyInPandas(shard, f"__e {kind}, __d int, __i long, __c long")
    joined = left.drop(right_id, *[carry] if carry else []).withColumn("__day", number(left_day, left).cast("int"))
    joined = joined.join(pairs, (F.col(entity) == F.col("__e")) & (F.col("__day") == F.col("__d")))
    joined = joined.withColumn(right_id, F.col("__i"))
    return (joined.withColumn(carry, F.col("__c")) if carry else joined).drop("__e", "__d", "__i", "__c", "__day")
