"""Books through time on the weekly panel: backtests, scenario suites, decisions, replays, with the same in SQL."""

from __future__ import annotations

from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almagest.operators import backtest as bt
from almagest.operators import features as fx
from almagest.operators import models
from almagest.operators import series as sr
from almagest.plans import panel
from almagest.plans.panel import RETS, WEIGHTED, register, rounded

#: What a book is worth. The panel's prices are averages of random lines, which fall back after each rise, so books grow
#: a million-fold; only a tiny one stays small against what its names trade.
BOOK = 1e-9
#: A year of the weekly panel; spans of the regime's conditions in weeks (mean, volatility, history, year).
WEEKS = 52
SPANS = {"average": 40, "vol": 8, "history": 52, "year": 52}

# --- regime of the panel's own market

FLAGS = f"""mk0 as (select date, avg(ret) as ret from rets group by 1 having avg(ret) is not null),
mk1 as (select date, product(1 + ret) over (order by date) as close from mk0),
mk2 as (select *, close / lag(close) over (order by date) - 1 as ret, row_number() over (order by date) as day_no from mk1),
mk3 as (select *, case when count(close) over a >= 40 then close < avg(close) over a end as below_ma, case when count(ret) over v >= 8 then stddev_samp(ret) over v * sqrt(252.0::double) end as vol, close / lag(close, {SPANS['year']}) over (order by date) - 1 as ret_year from mk2
  window a as (order by date rows between 39 preceding and current row), v as (order by date rows between 7 preceding and current row)),
mk4 as (select x.date, count(y.vol) as seen, count_if(y.vol <= x.vol) as atmost from mk3 x join mk3 y on y.day_no <= x.day_no and y.vol is not null group by 1),
mk5 as (select mk3.*, case when vol is not null and seen >= 52 then atmost::double / seen > 0.8 end as high from mk3 left join mk4 using (date)),
flag as (select date, max((coalesce(below_ma, false) and coalesce(high, false))::int) over (order by date rows between 1 preceding and current row) = 1 as stress, coalesce(ret_year < 0, false) and coalesce(high, false) as panic from mk5)"""


def _flags(spark: SparkSession, folder: str, bars: DataFrame | None = None) -> DataFrame:
    """``date, stress, panic`` of the panel's equal-weight market; each bar is a weekly check."""
    market = fx.with_returns(panel._bars(spark, folder) if bars is None else bars).groupBy("date").agg(F.avg("ret").alias("ret")).filter("ret is not null")
    level = F.product(1 + F.col("ret")).over(Window.orderBy("date"))  # a row per week
    flags = sr.conditions(market.select(F.lit("market").alias("name"), "date", level.alias("close")), **SPANS)
    return sr.held_on(flags, "stress_raw", "stress").select("date", "stress", "panic")


@register(f"with {RETS}, {FLAGS} select * from flag")
def panel_flags(spark, folder):
    return _flags(spark, folder)


@register(
    f"with {WEIGHTED}, {FLAGS}, h as (select cast(ticker as varchar) as ticker, w.date, weight * case when stress then 0.75::double else 1.0::double end as weight from weighted w left join flag using (date)), c as (select 'CASHHOLDING' as ticker, date, round(1 - sum(weight), 10) as weight from h group by date) select ticker, date, round(weight, 6) as weight from h union all select ticker, date, round(weight, 6) from c where weight > 1e-9"
)
def cash_line(spark, folder):
    """Weights with a quarter in cash under stress, and the line of cash."""
    bars = panel._kept_bars(spark, folder)
    held = panel.weighted_of(panel._scored(spark, folder, bars)).join(F.broadcast(_flags(spark, folder, bars)), "date", "left")  # a row per date
    held = held.select(F.col("ticker").cast("string").alias("ticker"), "date", (F.col("weight") * F.when(F.col("stress"), 0.75).otherwise(1.0)).alias("weight"))
    cash = held.groupBy("date").agg(F.round(1 - F.sum("weight"), 10).alias("weight")).filter("weight > 1e-9").select(F.lit("CASHHOLDING").alias("ticker"), "date", "weight")
    return rounded(held.unionByName(cash), "weight")


# --- backtests


def _inputs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    bars = panel._kept_bars(spark, folder)
    scored = panel._scored(spark, folder, bars).withColumn("bps", panel.tier())
    pool = scored.join(F.broadcast(_flags(spark, folder, bars)), "date", "left")  # a row per date
    pool = pool.select("ticker", "day_idx", "grp", "beta", "amihud", "bps", (F.col("ticker") % 4 == 0).alias("near"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("stress", "panic")], *[f"z_{f}" for f in panel.FACTORS])
    return pool, fx.with_returns(bars).select("ticker", "day_idx", "ret")


PLAIN = bt.Scenario("plain", panel.FACTORS, keeps=False, band=0.0)
BASE = bt.Scenario("base", panel.FACTORS, beta_max=1.2, stress_cash=0.25)


def suite() -> list[bt.Scenario]:
    """The base and what is changed in turn: delay, costs, factors, regime, limits, size, timing, noise, chance."""
    changed = {
        "delay": {"lag": 2}, "cost_twice": {"cost_times": 2.0}, "cost_three_times": {"cost_times": 3.0}, "flat_10_bps": {"flat_bps": 10.0}, "no_band": {"band": 0.0},
        "any_beta": {"beta_max": 0.0}, "no_cash": {"stress_cash": 0.0}, "half_momentum_in_panic": {"halve_in_panic": "momentum"},
        "names_25": {"n": 25, "exit_rank": 50, "quota": 7}, "exit_15": {"exit_rank": 15}, "exit_60": {"exit_rank": 60}, "unheld": {"keeps": False},
        "every_2": {"every": 2}, "every_8": {"every": 8}, "one_later": {"offset": 1}, "noise_half": {"noise": 0.5}, "noise_full": {"noise": 1.0},
        **{f"without_{f}": {"weights": {g: w for g, w in panel.FACTORS.items() if g != f}} for f in panel.FACTORS},
        **{f"random_{k}": {"seed": k} for k in range(5)},
    }
    return [BASE, *[replace(BASE, name=name, **change) for name, change in changed.items()]]


PLAIN_SQL = f"""with recursive {WEIGHTED},
cells as (select w.ticker, cal.day_idx, weight from weighted w join cal using (date)),
span as (select min(day_idx) + 1 as lo, (select max(day_idx) from cal) as hi from liq join cal using (date)),
rb as (select day_idx as day, day_idx - 1 as signal, coalesce(lead(day_idx) over (order by day_idx), hi) as next from cal, span where day_idx >= lo and (day_idx = lo or day_idx % 4 = 0)),
cum as (select ticker, day_idx, product(1 + coalesce(ret, 0)) over (partition by ticker order by day_idx) as grown from rets),
hold as (select rb.day, rb.next, c.ticker, c.weight, x.grown as g0 from rb join cells c on c.day_idx = rb.signal asof join cum x on x.ticker = c.ticker and x.day_idx <= rb.day),
hd as (select *, unnest(generate_series(day + 1, next)) as d from hold where next > day),
hg as (select hd.*, coalesce(x.grown / g0, 1) as g from hd asof join cum x on x.ticker = hd.ticker and x.day_idx <= hd.d),
val as (select day, d, 1 + sum(weight * (g - 1)) as v from hg group by 1, 2),
gro as (select d, v / coalesce(lag(v) over (partition by day order by d), 1) - 1 as gross from val),
dri as (select hold.next as day, hold.day as from_day, hold.ticker, hold.weight * coalesce(hg.g, 1) / coalesce(val.v, 1) as w from hold left join hg on hg.day = hold.day and hg.ticker = hold.ticker and hg.d = hold.next left join val on val.day = hold.day and val.d = hold.next),
pairs as (select rb.day, rb.signal, coalesce(n.ticker, p.ticker) as ticker, abs(coalesce(n.weight, 0) - coalesce(p.w, 0)) as dw, false as leaves from (select day, ticker, weight from hold) n full join (select d.* from dri d join rb on rb.day = d.day where d.from_day < d.day) p on p.day = n.day and p.ticker = n.ticker join rb on rb.day = coalesce(n.day, p.day)
  union all select d.day, rb.signal, d.ticker, d.w, true from dri d join rb on rb.day = d.from_day and d.day = (select hi from span) where d.from_day = (select max(day) from rb)),
tr as (select ticker, day_idx, amihud, {panel.TIER_SQL} as bps, max(amihud) over (partition by date) as worst from liq join cal using (date)),
wt as (select day_idx, max(amihud) as worst from tr group by 1),
pd as (select p.day, leaves, sum(dw) as turnover, sum(dw * coalesce(bps, 20) / 1e4) as fixed, sum(coalesce(amihud, wt.worst, 0) * {BOOK} / 1e6 * dw * dw) as scaled from pairs p left join tr on tr.ticker = p.ticker and tr.day_idx = p.signal left join wt on wt.day_idx = p.signal group by 1, 2),
dd as (select day_idx as d, coalesce(gross, 0) as gross, coalesce(i.turnover, 0) as t_in, coalesce(i.fixed, 0) as f_in, coalesce(i.scaled, 0) as s_in, coalesce(o.turnover, 0) as t_out, coalesce(o.fixed, 0) as f_out, coalesce(o.scaled, 0) as s_out, row_number() over (order by day_idx) as i
  from cal left join gro on gro.d = day_idx left join pd i on i.day = day_idx and not i.leaves left join pd o on o.day = day_idx and o.leaves, span where day_idx >= lo),
run as (select d, i, gross, t_in + t_out as turnover, f_in + s_in as paid, 1 + gross - f_in - s_in as value, f_out + s_out * (1 + gross - f_in - s_in) as sold from dd where i = 1
  union all select n.d, n.i, n.gross, n.t_in + n.t_out, n.f_in + n.s_in * r.value, r.value * (1 + n.gross - n.f_in - n.s_in * r.value), n.f_out + n.s_out * r.value * (1 + n.gross - n.f_in - n.s_in * r.value) from run r join dd n on n.i = r.i + 1)
select 'plain' as scenario, d as day_idx, round(gross - paid - sold, 6) as ret, round(gross, 6) as gross, round(turnover, 6) as turnover, round(paid + sold, 6) as cost from run"""


@register(PLAIN_SQL)
def backtest_plain(spark, folder):
    """Day by day: the best 15 of each fourth week under quotas and caps, without memory, band or regime."""
    daily = bt.run(*_inputs(spark, folder), [PLAIN], BOOK)["daily"]
    return rounded(daily, "ret", "gross", "turnover", "cost")


@register()
def backtest_weekly(spark, folder):
    """Day by day: the base scenario, with bands, drift, no-trade band, beta limit, cash in stress, costs and the exit."""
    daily = bt.run(*_inputs(spark, folder), [BASE], BOOK)["daily"]
    return rounded(daily, "ret", "gross", "turnover", "cost")


@register()
def audit_suite(spark, folder):
    """Performance of every scenario, its beta and alpha on the panel's market, and its yearly gap to the base: one run."""
    pool, returns = _inputs(spark, folder)
    daily = bt.checkpoint(bt.run(pool, returns, suite(), BOOK)["daily"])
    market = F.broadcast(returns.groupBy("day_idx").agg(F.avg("ret").alias("m")).filter("m is not null"))  # a row per day
    beta = F.covar_samp("ret", "m") / F.nullif(F.var_samp("m"), F.lit(0.0))
    capm = daily.join(market, "day_idx").groupBy("scenario").agg(beta.alias("beta"), ((F.avg("ret") - beta * F.avg("m")) * WEEKS).alias("alpha_ann"))
    base = F.broadcast(daily.filter("scenario = 'base'").select("day_idx", F.col("ret").alias("base")))  # a row per day
    gap = daily.join(base, "day_idx").groupBy("scenario").agg((F.avg(F.col("ret") - F.col("base")) * WEEKS).alias("gap_ann"))
    out = bt.summary(daily, WEEKS).join(capm, "scenario", "left").join(gap, "scenario", "left")
    return rounded(out, *[c for c in out.columns if c not in ("scenario", "n_days")])


@register()
def sharpe_deflated(spark, folder):
    """How likely each scenario's Sharpe ratio is no luck, as one of as many trials as there are scenarios.

    The spread of the trials is that of the scenarios' own ratios (per bar); moments are those of samples.
    """
    daily = bt.run(*_inputs(spark, folder), suite(), BOOK)["daily"]
    n, g = F.col("n"), F.col("k")
    m = daily.groupBy("scenario").agg(F.count("*").alias("n"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"), F.skewness("ret").alias("s"), F.kurtosis("ret").alias("k")).filter("n > 3 and sd > 0")
    every = Window.partitionBy()  # a row per scenario
    m = m.withColumn("sharpe", F.col("mean") / F.col("sd")).withColumns({"trials": F.count("*").over(every), "spread": F.coalesce(F.stddev_samp("sharpe").over(every), F.lit(0.0))})
    skew = F.col("s") * F.sqrt(n * (n - 1)) / (n - 2)
    kurtosis = ((n + 1) * g + 6) * (n - 1) / ((n - 2) * (n - 3)) + 3

    @F.pandas_udf("double")
    def deflated(mean: pd.Series, sd: pd.Series, s: pd.Series, k: pd.Series, count: pd.Series, trials: pd.Series, spread: pd.Series) -> pd.Series:
        return pd.Series([round(models.deflated_sharpe(*row), 6) for row in zip(mean, sd, s, k, count, trials, spread)])

    return rounded(m.select("scenario", "n", "sharpe", "trials", deflated("mean", "sd", skew, kurtosis, "n", "trials", "spread").alias("probability")), "sharpe")


@register()
def cost_break_even(spark, folder):
    """At which multiple of the costs the base earns no more than the panel's market: a line through one, two and three times."""
    pool, returns = _inputs(spark, folder)
    runs = [BASE, replace(BASE, name="cost_twice", cost_times=2.0), replace(BASE, name="cost_three_times", cost_times=3.0)]
    daily = bt.run(pool, returns, runs, BOOK)["daily"]
    times = F.element_at(F.create_map(*[x for s in runs for x in (F.lit(s.name), F.lit(s.cost_times))]), F.col("scenario"))
    yearly = daily.groupBy("scenario").agg((F.avg("ret") * WEEKS).alias("ann")).withColumn("times", times)
    market = returns.groupBy("day_idx").agg(F.avg("ret").alias("m")).agg((F.avg("m") * WEEKS).alias("market"))  # one row
    line = yearly.agg(F.regr_slope("ann", "times").alias("slope"), F.regr_intercept("ann", "times").alias("start")).join(market)
    return rounded(line.select("start", "slope", "market", ((F.col("market") - F.col("start")) / F.nullif("slope", F.lit(0.0))).alias("break_even")), "start", "slope", "market", "break_even")
