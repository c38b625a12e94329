"""Readings that don't fit how their source otherwise behaves: spikes, stuck values, impossible values."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from statistics import median

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from almagest.operators.rolling import latest_delivery

#: Readings in a row of the profile matrix (a month of trading days); readings that a spike may last; readings from
#: which a run counts as stuck.
WIDTH, LONGEST_SPIKE, STUCK_RUN = 20, 3, 5
#: In units of a source's normal move: least size of a sparse entry to be examined, and of a deviation to be a spike.
CANDIDATE, FAR_OFF = 2.0, 6.0
#: Readings that go back from Python together.
TOGETHER = 100_000
#: Rounds, tolerance and growth of the penalty by which the matrices are parted: enough for what only proposes candidates.
COARSE = (200, 1e-3, 1.5)
#: Normal moves by which the levels before and after a spike may differ; weight of the moves near against all.
IN_LINE, NEAR = 6.0, 0.8
#: Least deviation in logs; share of unchanged readings, runs included, up to which a source counts as normally changing.
LEAST_LOG, SELDOM = 0.03, 0.4


def robust_pca(x: np.ndarray, rounds: int = 200, tolerance: float = 1e-5, growth: float = 1.1) -> tuple[np.ndarray, np.ndarray]:
    """Principal component pursuit: ``x`` as a low-rank matrix plus a sparse one (augmented Lagrangian method).

    Singular values are shrunk by the eigenvectors of the product of the narrow side, so a long matrix costs no more
    than a few small products per round.
    """
    if x.shape[0] < x.shape[1]:
        low, sparse = robust_pca(x.T, rounds, tolerance, growth)
        return low.T, sparse.T
    weight = 1.0 / np.sqrt(max(x.shape))
    norm = np.linalg.norm(x, 2) if x.size else 0.0
    sparse = np.zeros_like(x)
    if not norm > 0:
        return x.copy(), sparse
    dual = x / max(norm, np.abs(x).max() / weight)
    mu, size = 1.25 / norm, np.linalg.norm(x)
    for _ in range(rounds):
        part = x - sparse + dual / mu
        square, v = np.linalg.eigh(part.T @ part)
        keep = np.maximum(1 - 1 / (mu * np.sqrt(np.maximum(square, 1e-300))), 0)
        low = part @ ((v * keep) @ v.T)
        rest = x - low + dual / mu
        sparse = np.sign(rest) * np.maximum(np.abs(rest) - weight / mu, 0)
        gap = x - low - sparse
        dual += mu * gap
        mu *= growth
        if np.linalg.norm(gap) <= tolerance * size:
            break
    return low, sparse


def sparse_part(x: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """What robust principal components leave of a series of logs beside its normal, low-rank behaviour.

    The series is a matrix with a row for each ``WIDTH`` readings, a month's profile: the levels of the months and the
    ways through them are of low rank. Rows begin half a row later in a second matrix, so that no reading stands at
    the edge of both; the larger of the two entries counts. Rows are filled up from ``middle``, its running median.
    """
    n, centre = len(x), np.median(x)
    out = np.zeros(n)
    for skip in (0, WIDTH // 2):
        rows = -(-(n + skip) // WIDTH)
        filled = np.concatenate([np.full(skip, middle[0]), x, np.full(rows * WIDTH - n - skip, middle[-1])]) - centre
        _, sparse = robust_pca(filled.reshape(rows, WIDTH), *COARSE)
        out = np.maximum(out, np.abs(sparse.ravel()[skip : skip + n]))
    return out


def _running_median(x: np.ndarray, reach: int) -> np.ndarray:
    padded = np.pad(x, reach, mode="reflect") if len(x) > reach else np.pad(x, reach, mode="edge")
    return np.median(np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + 1), axis=1)


def normal_move(x: np.ndarray) -> np.ndarray:
    """At each reading the size of a normal move: a robust deviation of the changes, of all or, if more, of those near."""
    change = np.abs(np.diff(x))
    if not len(change):
        return np.full(len(x), np.inf)
    whole = 1.4826 * np.median(change)
    if whole == 0:  # moves of a few ticks only
        moved = change[change > 0]
        whole = np.median(moved) if len(moved) > 0.05 * len(change) else 0.0
    near = NEAR * 1.4826 * _running_median(np.append(change, change[-1]), 15)
    return np.maximum(whole, near)


def spike_profile(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a series of logs: its level without spikes, the deviation from it that is too far, and which readings are spikes.

    Robust principal components of the source's profile matrix take its normal behaviour out as low rank; what is left
    as sparse and large are the candidates (:func:`sparse_part`), and only these can be spikes. An exact check follows: a
    run of candidates is a spike if it is short, far from the level before and after, and these agree.
    """
    n = len(x)
    move = normal_move(x)
    far = np.maximum(FAR_OFF * move, LEAST_LOG)
    level, spike = x.copy(), np.zeros(n, dtype=bool)
    if n < 5:
        return level, far, spike
    unit = np.maximum(move, LEAST_LOG / FAR_OFF)
    candidate = sparse_part(x, _running_median(x, LONGEST_SPIKE + 1)) > CANDIDATE * unit
    values, limits, moves = x.tolist(), far.tolist(), move.tolist()
    edges = np.flatnonzero(np.diff(np.concatenate([[0], candidate.view(np.int8), [0]]))).tolist()
    for begin, end in zip(edges[::2], edges[1::2]):
        # A normal large move beside a spike may be a candidate too: every short run inside is examined.
        for a in range(begin, end):
            before = [values[i] for i in range(max(0, a - 3), a) if not spike[i]]
            if spike[a] or not before:
                continue
            lo, near_lo = median(before), before[-1]
            if not abs(values[a] - lo) > limits[a]:
                continue
            for b in range(min(a + LONGEST_SPIKE, end), a, -1):
                after = values[b : b + 3]
                if not after:
                    continue
                # The nearest readings must be in line too, else a neighbour of the run is off itself.
                hi, near_hi = median(after), after[0]
                off = [min(abs(values[i] - lo), abs(values[i] - hi)) for i in range(a, b)]
                line = max(IN_LINE * moves[a], 0.25 * min(off))
                if all(o > limits[a + k] for k, o in enumerate(off)) and max(abs(hi - lo), abs(near_hi - near_lo), abs(near_lo - lo), abs(near_hi - hi)) <= line:
                    spike[a:b] = True
                    level[a:b] = (near_lo + near_hi) / 2
                    break
    return level, far, spike


def stuck(value: np.ndarray, active: np.ndarray) -> np.ndarray:
    """Which readings repeat the one before, in a run of ``STUCK_RUN`` or more equal ones, all active.

    None are where the value doesn't normally change: of all pairs of successive active readings, those in runs
    included, more than the share ``SELDOM`` is equal. A pegged value lies still in many runs, long and short; judged on
    what lies outside its runs it could seem to move.
    """
    n = len(value)
    out = np.zeros(n, dtype=bool)
    if n < 2:
        return out
    pairs = np.zeros(n, dtype=bool)
    pairs[1:] = active[1:] & active[:-1] & np.isfinite(value[1:]) & np.isfinite(value[:-1])
    same = pairs.copy()
    same[1:] &= value[1:] == value[:-1]
    if same.sum() > SELDOM * pairs.sum():
        return out
    edges = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
    for begin, end in zip(edges[::2], edges[1::2]):
        if end - begin + 1 >= STUCK_RUN:
            out[begin:end] = True
    return out


def carried(x: np.ndarray, otherwise: float) -> np.ndarray:
    """``x`` with NaN replaced by the last value before, at the start by the first one after."""
    known = np.flatnonzero(~np.isnan(x))
    if not len(known):
        return np.full(len(x), otherwise)
    return x[known[np.maximum(np.searchsorted(known, np.arange(len(x)), side="right") - 1, 0)]]


def joined(parts: list[dict[str, np.ndarray]]) -> pd.DataFrame:
    return pd.DataFrame({c: np.concatenate([p[c] for p in parts]) for c in parts[0]})


def flag_series(
    df: DataFrame, entity: str, day: str, value: str, row_id: str, activity: str, order: Sequence[str], market: DataFrame
) -> DataFrame:
    """Rows of ``df`` whose ``value`` is impossible (zero or negative), a spike, or stuck; one row per ``row_id``.

    A source is an entity. Its normal behaviour is taken from the last delivery of each day (greatest ``order``), with
    the moves of ``market`` (``date``, ``level``) taken out; then each delivered row is judged by its own value. Null,
    NaN and infinite values are never flagged, nor rows with a null entity or day unless impossible. ``reason`` is
    'range', 'spike' or 'stuck'.

    One entity's days go to one task as one array: at most as many entries as its calendar has days, as deliveries of a
    day are reduced to one before the shuffle. Judging rows is a join on entity and day.
    """
    rows = df.select(F.col(row_id).alias("__id"), F.col(entity).alias("__e"), F.col(day).alias("__d"), F.col(value).cast("double").alias("__v"), F.col(activity).cast("double").alias("__a"), *[F.col(c).alias(f"__o{k}") for k, c in enumerate(order)])
    number = F.isnotnull("__v") & ~F.isnan("__v") & (F.abs("__v") < float("inf"))
    daily = latest_delivery(rows, ["__e", "__d"], [f"__o{k}" for k in range(len(order))], ["__v", "__a"])
    daily = daily.join(market.select(F.col("date").alias("__d"), F.col("level").cast("double").alias("__m")), "__d", "left")
    series = daily.groupBy("__e").agg(F.sort_array(F.collect_list(F.struct(F.unix_date("__d").alias("d"), "__v", "__a", "__m"))).alias("s"))
    series = series.select("__e", *[F.col(f"s.{c}").alias(c) for c in ("d", "__v", "__a", "__m")])

    def judged_source(e, d, v, a, m) -> dict[str, np.ndarray]:
        v, a, m = (np.array(x, dtype=np.float64) for x in (v, a, m))
        with np.errstate(all="ignore"):
            fits = np.isfinite(v) & (v > 0)
            logs = np.log(np.where(fits, v, 1.0))
            market_log = carried(np.log(np.where(m > 0, m, np.nan)), 0.0)
        level, far = np.full(len(v), np.nan), np.full(len(v), np.nan)
        if fits.any():
            low, limit, _ = spike_profile((logs - market_log)[fits])
            level[fits], far[fits] = low + market_log[fits], limit
            level, far = carried(level, np.nan), carried(far, np.nan)
        same = np.where(stuck(v, np.isfinite(a) & (a > 0)), v, np.nan)
        return {"__e": np.full(len(v), e, dtype=object), "__n": np.asarray(d), "__level": level, "__far": far, "__stuck": same}

    def profiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done, size = [], 0
        for batch in batches:
            for row in batch.itertuples(index=False, name=None):
                done.append(judged_source(*row))
                size += len(row[1])
                if size >= TOGETHER:
                    yield joined(done)
                    done, size = [], 0
        if done:
            yield joined(done)

    kind = rows.schema["__e"].dataType.simpleString()
    profile = series.mapInPandas(profiles, f"__e {kind}, __n int, __level double, __far double, __stuck double")
    impossible = rows.filter(number & (F.col("__v") <= 0)).select("__id", F.lit("range").alias("reason"))
    judged = rows.filter(number & (F.col("__v") > 0)).withColumn("__n", F.unix_date("__d")).join(profile, ["__e", "__n"])
    off = F.abs(F.log("__v") - F.col("__level")) > F.col("__far")
    judged = judged.withColumn("reason", F.when(off, "spike").when(F.col("__v") == F.col("__stuck"), "stuck")).filter("reason is not null")
    return impossible.unionByName(judged.select("__id", "reason")).withColumnRenamed("__id", row_id)


#: Largest and smallest number of new shares for one old that a split can have.
SPLIT_RATIO = 100.0
#: A payment this many times a robust deviation of logs, and at least this far in logs, from the others is too far off.
EVENT_FAR, EVENT_LEAST = 6.0, 0.8


def flag_events(df: DataFrame, entity: str, day: str, kind: str, value: str, row_id: str) -> DataFrame:
    """Rows of ``df`` of kind 'dividend' or 'split' whose value is no payment or ratio of that entity.

    Zero and negative values are; so are splits beyond ``SPLIT_RATIO`` either way, and dividends that lie far from
    the entity's other dividends: the robust principal component of its payments in logs is a profile that follows
    lasting raises, and an entry is far off by its sparse rest. Null, NaN and infinite values, other kinds and rows
    with a null kind are never flagged. Payments of one day are reduced to their distinct values before the shuffle.
    """
    rows = df.select(F.col(row_id).alias(row_id), F.col(entity).alias("__e"), F.unix_date(F.col(day).cast("date")).alias("__d"), F.lower(F.trim(F.col(kind))).alias("__k"), F.col(value).cast("double").alias("__v"))
    rows = rows.filter(F.col("__k").isin("dividend", "split") & F.isnotnull("__v") & ~F.isnan("__v") & (F.abs("__v") < float("inf")))
    plain = (F.col("__v") <= 0) | ((F.col("__k") == "split") & ((F.col("__v") > SPLIT_RATIO) | (F.col("__v") < 1 / SPLIT_RATIO)))
    paid = rows.filter((F.col("__k") == "dividend") & (F.col("__v") > 0)).dropna(subset=["__e", "__d"])
    series = paid.select("__e", "__d", "__v").distinct().groupBy("__e").agg(F.sort_array(F.collect_list(F.struct("__d", "__v"))).alias("s"))
    series = series.select("__e", F.col("s.__d").alias("d"), F.col("s.__v").alias("v"))

    def far_off(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for e, d, v in batch.itertuples(index=False, name=None):
                out = event_outliers(np.log(np.asarray(v, dtype=np.float64)))
                if out.any():
                    yield pd.DataFrame({"__e": e, "__d": np.asarray(d)[out], "__v": np.asarray(v)[out]})

    name = rows.schema["__e"].dataType.simpleString()
    wrong = series.mapInPandas(far_off, f"__e {name}, __d int, __v double")
    found = rows.filter((F.col("__k") == "dividend") & (F.col("__v") > 0)).join(wrong, ["__e", "__d", "__v"], "left_semi")
    return rows.filter(plain).select(row_id).unionByName(found.select(row_id))


def event_outliers(x: np.ndarray) -> np.ndarray:
    """Which of a sequence of logs of payments lie out of all proportion to the others."""
    n = len(x)
    if n < 3:
        return np.zeros(n, dtype=bool)
    reach = 4
    width = min(8, n)
    rows = -(-n // width)
    centred = x - np.median(x)
    _, sparse = robust_pca(np.append(centred, np.zeros(rows * width - n)).reshape(rows, width), *COARSE)
    candidate = np.abs(sparse.ravel()[:n]) > 0.25 * EVENT_LEAST
    good = x[~candidate] if (~candidate).sum() >= 3 else x
    out = np.zeros(n, dtype=bool)
    for i in np.flatnonzero(candidate):
        near = [j for j in range(max(0, i - reach), min(n, i + reach + 1)) if j != i]
        level = np.median(x[near])
        spread = 1.4826 * np.median(np.abs(x[near] - level))
        off = abs(x[i] - level)
        out[i] = off > max(EVENT_LEAST, EVENT_FAR * min(spread, 0.25)) and abs(x[i] - np.median(good)) > EVENT_LEAST
    return out
