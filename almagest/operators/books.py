"""Books over time: banded selection, no-trade bands, costs, drift within holding periods."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almagest.operators import models


def no_trade(targets: DataFrame, band: float = 0.02) -> DataFrame:
    """Each rebalance against the target before: small changes are not traded, the others are scaled to the total.

    Names in both with a change under ``band`` keep the earlier weight. If no name moves, all are scaled.
    """
    dates = targets.select("date").distinct().withColumn("next", F.lead("date").over(Window.orderBy("date")))  # one row per rebalance
    prev = targets.join(F.broadcast(dates), "date").select("ticker", F.col("next").alias("date"), F.col("weight").alias("prev")).filter("date is not null")
    both = targets.join(prev, ["date", "ticker"], "full").na.fill(0.0, ["weight", "prev"])
    stays = (F.col("weight") > 0) & (F.col("prev") > 0) & (F.abs(F.col("weight") - F.col("prev")) < band)
    d = Window.partitionBy("date")
    both = both.withColumn("stays", stays).withColumns(
        {"total": F.sum("weight").over(d), "kept": F.sum(F.when(F.col("stays"), F.col("prev")).otherwise(0.0)).over(d), "moved": F.sum(F.when(~F.col("stays"), F.col("weight")).otherwise(0.0)).over(d)}
    )
    scaled = F.when(F.col("moved") > 0, F.when(F.col("stays"), F.col("prev")).otherwise(F.col("weight") * (F.col("total") - F.col("kept")) / F.nullif("moved", F.lit(0.0))))
    held = F.coalesce(scaled, F.col("prev") * F.when(F.col("stays"), F.col("total") / F.nullif("kept", F.lit(0.0))).otherwise(0.0))
    return both.withColumn("held", held).filter((F.col("held") > 0) | (F.col("prev") > 0)).select("date", "ticker", "prev", "weight", "held")


def cost(change: Column, half_spread_bps: Column, amihud: Column, value: float, k: float = 1.0) -> Column:
    """Half the spread, and impact that grows with the square of the change, as a share of the book."""
    return F.abs(change) * half_spread_bps / 1e4 + k * amihud * value / 1e6 * change * change


def select_banded(rank: dict, group: dict, held: list, n: int = 15, exit_rank: int = 30, quota: int = 4) -> list:
    """Held names up to ``exit_rank`` in order of rank, then new ones from the best ``n``, then the next best; quotas hold."""
    by_rank = sorted(rank, key=rank.get)
    stay = [t for t in by_rank if t in set(held) and rank[t] <= exit_rank]
    wish = stay + [t for t in by_rank if rank[t] <= n and t not in set(stay)]
    wish += [t for t in by_rank if t not in set(wish)]
    picks, used = [], {}
    for t in wish:
        if len(picks) == n:
            break
        if group.get(t) == "all" or used.get(group.get(t), 0) < quota:
            picks.append(t)
            used[group.get(t)] = used.get(group.get(t), 0) + 1
    return picks


def within_reach(ranked: DataFrame, top: int, quota: int) -> DataFrame:
    """Rows of ``date, grp, rnk`` that a selection can take: up to rank ``top``, and the best ``quota`` of each group.

    Exact if no exit rank, number of names or swap pool is above ``top`` and no quota above ``quota``: beyond ``top``
    names enter by rank alone, so after ``quota`` better ones of their group. Group ``all`` has no quota and stays whole.
    """
    own = F.row_number().over(Window.partitionBy("date", "grp").orderBy("rnk"))
    free = F.coalesce(F.col("grp").cast("string") == "all", F.lit(False))
    return ranked.withColumn("__own", own).filter((F.col("rnk") <= top) | (F.col("__own") <= quota) | free).drop("__own")


def groups_of(part: pd.DataFrame) -> dict:
    """Group of each ticker; names without one are a group as well."""
    return dict(zip(part["ticker"], part["grp"].astype(object).where(part["grp"].notna(), None)))


def banded_books(candidates: DataFrame, scenarios: list[tuple[int, int, int, int]]) -> DataFrame:
    """Books of every scenario (its number, names, exit rank, quota of a group) over all dates, each from the one before.

    ``candidates`` has the ranked names of each date (``date, ticker, grp, rnk``), at least those ``within_reach``.
    A scenario is one sequential scan, so it is one group: dates times candidates. Scenarios run in parallel.
    """

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        out, held = [], []
        spec = group.iloc[0]
        for date, part in group.groupby("date", sort=True):
            held = select_banded(dict(zip(part["ticker"], part["rnk"])), groups_of(part), held, int(spec["n"]), int(spec["exit_rank"]), int(spec["quota"]))
            out += [(spec["scenario_id"], date, t, 1.0 / len(held)) for t in held]
        return pd.DataFrame(out, columns=["scenario_id", "date", "ticker", "weight"])

    kind = candidates.schema["ticker"].dataType.simpleString()
    names = ("scenario_id", "n", "exit_rank", "quota")
    listed = F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(names, s)]) for s in scenarios])
    return candidates.select("*", F.inline(listed)).groupBy("scenario_id").applyInPandas(scan, f"scenario_id int, date date, ticker {kind}, weight double")


def drift(returns: DataFrame, books: DataFrame) -> DataFrame:
    """Growth of each name since the start of its holding period, on each calendar day of the period.

    ``books`` has ``start_idx, end_idx, ticker, weight``; days after the start up to the end belong to the period. A
    missing return is zero. The book's value is one plus the sum of weight times growth less one; the rest is cash.
    """
    held = books.filter("end_idx > start_idx").withColumn("day_idx", F.explode(F.sequence(F.col("start_idx") + 1, F.col("end_idx"))))
    held = held.join(returns.select("ticker", "day_idx", "ret"), ["ticker", "day_idx"], "left")
    upto = Window.partitionBy("start_idx", "ticker").orderBy("day_idx").rowsBetween(Window.unboundedPreceding, 0)
    return held.withColumn("growth", F.product(1 + F.coalesce("ret", F.lit(0.0))).over(upto))


def forward_filter(x: np.ndarray, start: np.ndarray, move: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> np.ndarray:
    """Probability of the second of two states at each step, given the observations so far."""
    return models.filtered(x, start, move, mean, spread)[0][:, 1]
