"""Books carried through time under costs: many scenarios in one run, each one sequential scan of small rows.

What doesn't depend on the books before (features, scores, ranks, growth between rebalances, costs of a change) is
computed set-based for all dates and scenarios. Only selection and the no-trade band need the book before; they run
as one scan per scenario over the names within reach. Returns and costs by day are set-based again, and a last scan
over days carries the book's value, which scales impact.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almagest.operators import books, models
from almagest.session import checkpoint


@dataclass(frozen=True)
class Scenario:
    """One way to run the books. ``weights`` are of factors; with ``seed`` names are scored by a hash instead."""

    name: str
    weights: dict[str, float] = field(default_factory=dict)
    n: int = 15
    exit_rank: int = 30
    quota: int = 4
    keeps: bool = True  # held names within exit_rank stay before new ones enter
    band: float = 0.02
    lag: int = 1
    every: int = 4
    offset: int = 0
    beta_max: float = 0.0  # 0: no limit
    stress_cash: float = 0.0
    halve_in_panic: str = ""  # a factor whose weight is halved under panic
    flat_bps: float = 0.0  # 0: costs by tier and impact
    cost_times: float = 1.0
    noise: float = 0.0  # in standard deviations of the date's scores
    seed: int = -1
    at_open: bool = False  # trades at the day's open instead of its close
    strategy: Callable[[pd.DataFrame, dict], dict] | None = None  # rows of a signal day by rank, weights held: target weights


def equal_under_caps(near: np.ndarray, cap: float = 0.1, near_cap: float = 0.06) -> np.ndarray:
    """Equal weights, names near a report at most ``near_cap``, what that cuts shared by the others; sum 1."""
    n, k = len(near), int(near.sum())
    caps = np.where(near, near_cap, cap)
    if not n or caps.sum() < 1:
        return caps / max(caps.sum(), 1e-300)
    if 1 / n <= near_cap or not k:
        return np.full(n, 1 / n)
    return np.where(near, near_cap, (1 - near_cap * k) / max(n - k, 1))


def banded(before: dict, target: dict, band: float) -> dict:
    """``target`` without small trades: changes under ``band`` of names in both aren't made, the others give way."""
    if not band or not before:
        return target
    stay = {t: before[t] for t, w in target.items() if before.get(t, 0) > 0 and abs(w - before[t]) < band}
    total, kept = sum(target.values()), sum(stay.values())
    moving = sum(w for t, w in target.items() if t not in stay)
    if moving > 0 and total > kept:
        return {t: stay.get(t, w * (total - kept) / moving) for t, w in target.items()}
    mixed = {t: stay.get(t, w) for t, w in target.items()}
    return {t: w * total / sum(mixed.values()) for t, w in mixed.items()}


def normal_noise(seed: int, *keys: str) -> Column:
    """Standard normal numbers that depend on the seed and the keys only."""
    u = [(F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(k), *keys), 11) + 0.5) / F.lit(float(1 << 53)) for k in (1, 2)]
    return F.sqrt(-2 * F.log(u[0])) * F.cos(2 * np.pi * u[1])


def _on_step(s: Scenario) -> Callable[[Column], Column]:
    return lambda k: k * s.every + s.offset


def rebalances(days: DataFrame, scenarios: Sequence[Scenario], first_signal: Column) -> DataFrame:
    """Per scenario its rebalances: number ``k``, day, signal day, and the day of the next one (at the end the last day).

    ``days`` is one row of ``first``, the first day with signals, and ``last``. The first possible day always is one.
    """
    out = []
    for s in scenarios:
        start = (first_signal + s.lag).cast("long")
        low, high = (F.floor((d - s.offset) / F.lit(s.every)).cast("long") for d in (start + s.every - 1, F.col("last")))
        steps = F.when(low <= high, F.transform(F.sequence(low, high), _on_step(s))).otherwise(F.array().cast("array<bigint>"))
        out.append(F.struct(F.lit(s.name).alias("scenario"), F.lit(s.lag).alias("lag"), F.array_sort(F.array_union(F.array(start), steps)).alias("at")))
    rows = days.select("last", F.inline(F.array(*out))).filter(F.col("at")[0] <= F.col("last"))
    rows = rows.select("scenario", "lag", "last", "at", F.posexplode("at").alias("k", "day"))
    following = F.coalesce(F.try_element_at("at", F.col("k") + 2), F.col("last"))
    return rows.select("scenario", "k", "day", (F.col("day") - F.col("lag")).alias("signal"), following.alias("next"), (F.size("at") == F.col("k") + 1).alias("final"))


def carried_growth(returns: DataFrame) -> DataFrame:
    """``ticker, day_idx, grown, opened``: growth since the ticker's first row up to the day's close and up to its open.

    Days without a row carry the last close; missing returns are 0, and a missing ``overnight`` return (or none at all)
    makes the open the close before.
    """
    w = Window.partitionBy("ticker").orderBy("day_idx")
    overnight = F.coalesce("overnight", F.lit(0.0)) if "overnight" in returns.columns else F.lit(0.0)
    df = returns.select("ticker", "day_idx", F.product(1 + F.coalesce("ret", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("grown"), F.lead("day_idx").over(w).alias("__next"), overnight.alias("__on"))
    df = df.withColumn("opened", F.coalesce(F.lag("grown").over(w), F.lit(1.0)) * (1 + F.col("__on")))
    ends = returns.agg(F.max("day_idx").alias("__last"))  # one row
    df = df.join(F.broadcast(ends)).withColumn("__end", F.coalesce(F.col("__next") - 1, "__last"))
    df = df.select("ticker", F.col("day_idx").alias("__own"), F.explode(F.sequence("day_idx", "__end")).alias("day_idx"), "grown", "opened")
    return df.select("ticker", "day_idx", "grown", F.when(F.col("day_idx") == F.col("__own"), F.col("opened")).otherwise(F.col("grown")).alias("opened"))


def run(pool: DataFrame, returns: DataFrame, scenarios: Sequence[Scenario], book_value: float = 1e6, impact: float = 1.0) -> dict[str, DataFrame]:
    """Days and books of every scenario.

    ``pool`` has the names that may be held by signal day: ``ticker, day_idx, grp, beta, amihud, bps, near`` (a report is
    near), ``stress, panic`` and a z-score ``z_f`` for each factor of the scenarios. ``returns`` has ``ticker, day_idx,
    ret`` of all names and days (and ``overnight``, for scenarios that trade at the open); a missing return is 0. A book
    decided on day i - lag is traded at the close of day i and earns from day i + 1 on, or at its open and earns from
    there on, the old book up to it; it drifts in between. A change of weights costs half the spread and impact (k times
    amihud times the book's value times the square of the change), or ``flat_bps``; names that aren't in the pool
    pay the widest spread and the worst amihud of the day. The last day sells all.

    ``daily``: scenario, day_idx, ret, gross, turnover, cost. ``books``: scenario, day_idx, ticker, before, weight. Both
    are small: days, and names held, times scenarios. A scan's rows are its scenario's names within reach by day.
    """
    wanted = {s.name: s for s in scenarios}
    pool, grown = checkpoint(pool), checkpoint(carried_growth(returns))
    span = pool.agg(F.min("day_idx").alias("first")).join(returns.agg(F.max("day_idx").alias("last"))).filter("first is not null")  # one row
    turns = checkpoint(rebalances(span, scenarios, F.col("first")))  # a row per scenario and rebalance

    # Scores of each scenario on its signal days, and the ranks that decide.
    factors = sorted({f for s in scenarios for f in s.weights})
    spec = F.create_map(*[x for s in scenarios for x in (F.lit(s.name), F.struct(*[F.lit(float(s.weights.get(f, 0.0))).alias(f) for f in factors], F.lit(float(s.noise)).alias("noise"), F.lit(s.seed).alias("seed"), F.lit(s.halve_in_panic).alias("halved"), F.lit(max(s.n, s.exit_rank)).alias("top"), F.lit(s.quota).alias("quota"), F.lit(s.at_open).alias("at_open")))])
    rows = pool.join(F.broadcast(turns), F.col("day_idx") == F.col("signal")).withColumn("spec", F.element_at(spec, F.col("scenario")))
    weight = lambda f: F.col(f"spec.{f}") * F.when(F.col("panic") & (F.col("spec.halved") == f), 0.5).otherwise(1.0)
    score = sum((F.coalesce(F.col(f"z_{f}"), F.lit(0.0)) * weight(f) for f in factors), F.lit(0.0)) / sum((weight(f) for f in factors), F.lit(0.0)) if factors else F.lit(0.0)
    rows = rows.withColumn("score", F.when(F.col("spec.seed") >= 0, F.shiftrightunsigned(F.xxhash64("spec.seed", "ticker"), 11) / float(1 << 53)).otherwise(score))
    rows = rows.withColumn("spread", F.coalesce(F.stddev_samp("score").over(Window.partitionBy("scenario", "k")), F.lit(0.0)))
    rows = rows.withColumn("score", F.round(F.col("score") + F.col("spec.noise") * F.col("spread") * normal_noise(11, "ticker", "day_idx"), 9))
    by = Window.partitionBy("scenario", "k")
    rows = rows.withColumn("rnk", F.row_number().over(by.orderBy(F.desc("score"), "ticker"))).withColumn("own", F.row_number().over(Window.partitionBy("scenario", "k", "grp").orderBy("rnk")))
    free = F.coalesce(F.col("grp").cast("string") == "all", F.lit(False))
    rows = rows.filter((F.col("rnk") <= F.col("spec.top")) | (F.col("own") <= F.col("spec.quota")) | free)
    ends = [grown.select("ticker", F.col("day_idx").alias(d), F.struct("grown", "opened").alias(g)) for d, g in (("day", "g0"), ("next", "g1"))]
    opens = F.col("spec.at_open")
    bought = F.when(opens, F.col("g0.opened")).otherwise(F.col("g0.grown"))
    sold = F.when(opens & ~F.col("final"), F.col("g1.opened")).otherwise(F.col("g1.grown"))
    rows = rows.join(ends[0], ["ticker", "day"], "left").join(ends[1], ["ticker", "next"], "left").withColumn("growth", F.coalesce(sold / bought, F.lit(1.0)))
    # A rebalance without names to hold sells all, so each one has a row.
    rows = turns.select("scenario", "k", "day", "next", "final").join(rows.select("scenario", "k", "ticker", F.col("grp").cast("string").alias("grp"), "rnk", "beta", "near", "stress", "growth"), ["scenario", "k"], "left")

    def scan(part: pd.DataFrame) -> pd.DataFrame:
        s = wanted[part["scenario"].iloc[0]]
        held, out = {}, []
        for k, now in part.groupby("k", sort=True):
            day, end, final = int(now["day"].iloc[0]), int(now["next"].iloc[0]), bool(now["final"].iloc[0])
            now = now.dropna(subset=["ticker"]).sort_values("rnk").reset_index(drop=True)
            target = s.strategy(now, held) if s.strategy else choose(s, now, held)
            new = banded(held, target, s.band)
            out += [(s.name, k, day, end, t, held.get(t, 0.0), new.get(t, 0.0), False) for t in {**held, **new}]
            growth = dict(zip(now["ticker"], now["growth"]))
            value = 1 + sum(w * (growth[t] - 1) for t, w in new.items())
            held = {t: w * growth[t] / value for t, w in new.items()}
            if final:
                out += [(s.name, k, end, end, t, w, 0.0, True) for t, w in held.items()]
        return pd.DataFrame(out, columns=["scenario", "k", "day", "next", "ticker", "before", "weight", "exit"])

    kind = pool.schema["ticker"].dataType.simpleString()
    held = checkpoint(rows.groupBy("scenario").applyInPandas(scan, f"scenario string, k int, day long, next long, ticker {kind}, before double, weight double, exit boolean"))

    # Costs of the changes, as a part that is fixed and one per unit of the book's value.
    signal = turns.select("scenario", "k", F.col("signal").alias("day_idx"))
    worst = pool.groupBy("day_idx").agg(F.max("amihud").alias("worst"), F.max("bps").alias("widest"))
    prices = pool.select("day_idx", "ticker", "amihud", "bps")
    moved = held.join(F.broadcast(signal), ["scenario", "k"]).join(prices, ["day_idx", "ticker"], "left").join(F.broadcast(worst), "day_idx", "left")  # a row per day
    dw = F.abs(F.col("weight") - F.col("before"))
    flat = F.element_at(F.create_map(*[x for s in scenarios for x in (F.lit(s.name), F.struct(F.lit(float(s.flat_bps)).alias("bps"), F.lit(float(s.cost_times)).alias("times")))]), F.col("scenario"))
    spread_cost = dw * F.when(flat["bps"] > 0, flat["bps"]).otherwise(F.coalesce("bps", F.lit(20.0))) / 1e4 * flat["times"]
    impact_cost = F.when(flat["bps"] > 0, 0.0).otherwise(impact * F.coalesce("amihud", "worst", F.lit(0.0)) * book_value / 1e6 * dw * dw) * flat["times"]
    paid = moved.groupBy("scenario", "day", "exit").agg(F.sum(dw).alias("turnover"), F.sum(spread_cost).alias("fixed"), F.sum(impact_cost).alias("scaled"))
    paid = paid.groupBy("scenario", F.col("day").alias("day_idx")).agg(*[F.sum(F.when(F.col("exit") == e, F.col(c))).alias(f"{c}_{n}") for c in ("turnover", "fixed", "scaled") for e, n in ((False, "in"), (True, "out"))])

    # Value of each holding period by day, then days put one after the other. At the open a day can end one period
    # and begin another, and its returns are multiplied.
    opens = F.element_at(F.create_map(*[x for s in scenarios for x in (F.lit(s.name), F.lit(s.at_open))]), F.col("scenario"))
    days = held.filter("weight > 0").select("scenario", "k", "day", "next", "ticker", "weight", opens.alias("at_open")).join(F.broadcast(turns.select("scenario", "k", "final")), ["scenario", "k"])  # a row per rebalance
    first = F.when(F.col("at_open"), F.col("day")).otherwise(F.col("day") + 1)
    days = days.filter(first <= F.col("next")).withColumn("day_idx", F.explode(F.sequence(first, F.col("next"))))
    days = days.join(ends[0], ["ticker", "day"], "left").join(grown, ["ticker", "day_idx"], "left")
    price = F.when(F.col("at_open") & ~F.col("final") & (F.col("day_idx") == F.col("next")), F.col("opened")).otherwise(F.col("grown"))
    growth = F.coalesce(price / F.when(F.col("at_open"), F.col("g0.opened")).otherwise(F.col("g0.grown")), F.lit(1.0))
    value = days.groupBy("scenario", "k", "day_idx").agg((1 + F.sum(F.col("weight") * (growth - 1))).alias("value"))
    step = value.withColumn("step", F.col("value") / F.coalesce(F.lag("value").over(Window.partitionBy("scenario", "k").orderBy("day_idx")), F.lit(1.0)))
    gross = step.groupBy("scenario", "day_idx").agg((F.product("step") - 1).alias("gross"))
    every = turns.groupBy("scenario").agg(F.explode(F.sequence(F.min("day"), F.max("next"))).alias("day_idx"))
    joined = every.join(gross.select("scenario", "day_idx", "gross"), ["scenario", "day_idx"], "left").join(paid, ["scenario", "day_idx"], "left").na.fill(0.0)

    def by_day(part: pd.DataFrame) -> pd.DataFrame:
        part, value, rets, costs = part.sort_values("day_idx"), 1.0, [], []
        for r in part.itertuples(index=False):
            cost = r.fixed_in + r.scaled_in * value
            value *= 1 + r.gross - cost
            sold = r.fixed_out + r.scaled_out * value  # sold at the end, at the value that is then reached
            rets.append(r.gross - cost - sold)
            costs.append(cost + sold)
        return pd.DataFrame({"scenario": part["scenario"], "day_idx": part["day_idx"], "ret": rets, "gross": part["gross"], "turnover": part["turnover_in"] + part["turnover_out"], "cost": costs})

    daily = joined.groupBy("scenario").applyInPandas(by_day, "scenario string, day_idx long, ret double, gross double, turnover double, cost double")
    return {"daily": daily, "books": held.filter("not exit").select("scenario", F.col("day").alias("day_idx"), "ticker", "before", "weight")}


def choose(s: Scenario, now: pd.DataFrame, held: dict) -> dict:
    """Target weights of a scenario: names by rank, quotas and bands, capped equal weights, beta limit, cash in stress."""
    if now.empty:
        return {}
    at = {t: i for i, t in enumerate(now["ticker"])}
    group = now["grp"].astype(object).where(now["grp"].notna(), None).to_numpy()
    keep = [at[t] for t in held if t in at] if s.keeps else []
    exit_rank = s.exit_rank if s.keeps else s.n
    picks = books.select_banded(dict(enumerate(now["rnk"])), dict(enumerate(group)), keep, s.n, exit_rank, s.quota)
    near = now["near"].to_numpy(bool)
    weigh = lambda p: equal_under_caps(near[p])
    invested = 1 - s.stress_cash if s.stress_cash and bool(now["stress"].iloc[0]) else 1.0
    if s.beta_max:
        picks = models.beta_limited(picks, now["rnk"].to_numpy(), group, now["beta"].to_numpy(float), weigh, s.beta_max, invested, s.exit_rank, s.quota)
    names = now["ticker"].to_numpy()[picks]
    return dict(zip(names.tolist(), (weigh(picks) * invested).tolist()))


def summary(daily: DataFrame, per_year: float) -> DataFrame:
    """Per scenario: days, total and yearly return, volatility, Sharpe ratio, deepest fall, yearly turnover, cost, returns of 21 days."""
    w = Window.partitionBy("scenario").orderBy("day_idx")
    upto, roll = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(-20, 0)
    df = daily.withColumn("equity", F.product(1 + F.col("ret")).over(upto))
    df = df.withColumn("fall", F.col("equity") / F.max("equity").over(upto) - 1).withColumn("roll", F.when(F.count("*").over(roll) == 21, F.product(1 + F.col("ret")).over(roll) - 1))
    n, grown, vol = F.count("*"), F.product(1 + F.col("ret")), F.stddev_samp("ret") * per_year**0.5
    return df.groupBy("scenario").agg(
        n.alias("n_days"), (grown - 1).alias("total_return"), (F.pow(grown, F.lit(per_year) / n) - 1).alias("ann_return"), vol.alias("ann_vol"),
        F.coalesce(F.avg("ret") * per_year / F.nullif(vol, F.lit(0.0)), F.lit(0.0)).alias("sharpe"), F.abs(F.min("fall")).alias("max_drawdown"),
        (F.sum("turnover") * per_year / n).alias("turnover_per_year"), F.sum("cost").alias("cost_total"),
        F.percentile("roll", F.lit(0.5)).alias("roll21_median"), F.percentile("roll", F.lit(0.05)).alias("roll21_p05"),
        F.percentile("roll", F.lit(0.95)).alias("roll21_p95"), F.min("roll").alias("roll21_worst"),
    )

