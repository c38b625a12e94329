"""Decisions as records, their scores, books of fixed weights, books in past crises, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almagest.operators import features as fx
from almagest.operators import replay
from almagest.plans import extras, panel
from almagest.plans import reports as rp
from almagest.plans.backtests import FLAGS, _flags
from almagest.plans.panel import WEIGHTED, register, rounded
from almagest.session import checkpoint
from almagest.sources.tables import table

# --- records

TARGETS = f"""{WEIGHTED}, {FLAGS},
h0 as (select cast(ticker as varchar) as ticker, w.date, weight * case when stress then 0.75::double else 1.0::double end as weight, coalesce(stress, false) as stress from weighted w left join flag using (date)),
h1 as (select ticker, date, weight from h0 union all select * from (select 'CASHHOLDING', date, round(1 - sum(weight), 10) as weight from h0 group by date) where weight > 1e-9),
h2 as (select *, round(weight, 6) as r, round(sum(weight) over (partition by date) - sum(round(weight, 6)) over (partition by date), 6) as rest, row_number() over (partition by date order by round(weight, 6) desc, ticker) as n from h1),
tg as (select date, ticker, round(r + case when n = 1 then rest else 0 end, 6) as weight from h2)"""


def _targets(spark: SparkSession, folder: str, bars: DataFrame) -> DataFrame:
    """Target weights of every date with cash, to six digits: ``date, ticker, weight``."""
    flags = F.broadcast(_flags(spark, folder, bars))  # a row per date
    held = panel.weighted_of(panel._scored(spark, folder, bars)).select("date", F.col("ticker").cast("string").alias("ticker"), "weight").join(flags, "date", "left")
    held = held.withColumn("weight", F.col("weight") * F.when(F.col("stress"), 0.75).otherwise(1.0))
    return replay.six_digits(replay.with_cash(held))


def _records(spark: SparkSession, folder: str, bars: DataFrame) -> DataFrame:
    """A record for each bar from the first decision on: every fourth bar decides anew, the others hold."""
    days = fx.calendar(bars)
    decided = replay.holdings(_targets(spark, folder, bars)).join(F.broadcast(days), "date").filter("day_idx % 4 = 0").select(F.col("date").alias("decided_on"), "target_holdings")
    order = Window.orderBy("date")  # a row per bar
    df = days.join(decided, F.col("date") == F.col("decided_on"), "left")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"execution_date": F.lead("date").over(order), "decided_on": F.last("decided_on", ignorenulls=True).over(upto), "target_holdings": F.last("target_holdings", ignorenulls=True).over(upto)})
    action = F.when(F.col("decided_on") == F.col("date"), "rebalance").otherwise("hold")
    return df.filter("decided_on is not null").select(F.col("date").alias("data_through"), "decided_on", "execution_date", action.alias("action"), "target_holdings")


@register(
    f"""with {TARGETS}, rc as (select date, string_agg(ticker || ':' || printf('%.6f', weight), ',' order by ticker) as holdings, count(*) as names, round(sum(weight), 6) as total from tg join cal using (date) where day_idx % 4 = 0 group by 1),
d as (select cal.date as data_through, lead(cal.date) over (order by cal.date) as execution_date, max(rc.date) over (order by cal.date) as decided_on from cal left join rc using (date))
select 'weekly-' || strftime(data_through, '%Y-%m-%d') as decision_id, data_through, decided_on, execution_date, case when decided_on = data_through then 'rebalance' else 'hold' end as action, holdings, names, total from d join rc on rc.date = d.decided_on"""
)
def decision_records(spark, folder):
    """Decision records: what is known, decided, to be done and held, with cash, to a total of one."""
    df = _records(spark, folder, panel._kept_bars(spark, folder))
    line = F.array_join(F.transform("target_holdings", lambda h: F.concat(h["ticker"], F.lit(":"), F.format_string("%.6f", h["weight"]))), ",")
    total = F.round(F.aggregate("target_holdings", F.lit(0.0), lambda a, h: a + h["weight"]), 6)
    return df.select(F.concat(F.lit("weekly-"), F.date_format("data_through", "yyyy-MM-dd")).alias("decision_id"), "data_through", "decided_on", "execution_date", "action", line.alias("holdings"), F.size("target_holdings").cast("long").alias("names"), total.alias("total"))


@register()
def replay_score(spark, folder):
    """The records executed at the next bar's open, here the last close, and what each bar then earned, net of 10 basis points."""
    bars = panel._kept_bars(spark, folder)
    prices = bars.select(F.col("ticker").cast("string").alias("ticker"), "date", F.lit(None).cast("double").alias("open"), "close")
    return rounded(replay.score(checkpoint(_records(spark, folder, bars)), prices), "gross", "cost", "turnover", "net")


# --- daily prices

EVENT = rp.SPLITS + """,
ra as (select ticker, first_print as date, product(ratio) as ratio from fac where applied group by 1, 2),
er as (select p.ticker, p.date, close / prev * coalesce(ratio, 1) - 1 as ret from p left join ra on ra.ticker = p.ticker and ra.date = p.date)"""


def _event_returns(spark: SparkSession, folder: str) -> DataFrame:
    bars, factors = rp._split_inputs(spark, folder)
    return replay.event_returns(bars, factors.filter("applied"))


@register(f"with {EVENT} select ticker, date, round(ret, 6) as ret from er")
def event_returns(spark, folder):
    """Returns of unadjusted closes, corrected on the first print after a split that shows in them."""
    return rounded(_event_returns(spark, folder).select("ticker", "date", "ret"), "ret")


_OWN = extras.OWN20.removeprefix(f"with {rp.SPLITS}, ")
BOOKS = f"""with {EVENT}, {_OWN},
pick as (select ticker, 0.2::double as w from (select ticker, row_number() over (order by round(adv20 / 1e9, 6) desc, ticker) as k from own) where k <= 5),
ds as (select date from (select distinct date from index_daily) order by date desc limit 250),
ce as (select pick.ticker, w, ds.date, coalesce(er.ret, 0) as ret from pick cross join ds left join er on er.ticker = pick.ticker and er.date = ds.date),
gd as (select date, sum(w * ret) as gross from ce group by 1),
td as (select ce.date, any_value(gross) as gross, sum(abs(w - w * (1 + ret) / (1 + gross))) as turnover from ce join gd using (date) group by 1),
gn as (select date, sum(w * g) as v from (select *, product(1 + ret) over (partition by ticker order by date) as g from ce) group by 1),
tn as (select date, v / coalesce(lag(v) over (order by date), 1) - 1 as gross, 0.0::double as turnover from gn),
bo as (select 'daily' as rebalance, * from td union all select 'none', * from tn),
en as (select *, turnover + (date = min(date) over (partition by rebalance))::int + (date = max(date) over (partition by rebalance))::int as traded from bo),
rt as (select rebalance, date, gross - traded * 10 / 1e4 as ret, product(1 + gross - traded * 10 / 1e4) over (partition by rebalance order by date) as eq from en),
fa as (select *, eq / greatest(max(eq) over (partition by rebalance order by date), 1) - 1 as fall from rt)
select rebalance, count(*) as n_days, round(product(1 + ret) - 1, 6) as total_return, round(pow(product(1 + ret), 252.0 / count(*)) - 1, 6) as ann_return, round(stddev_samp(ret) * sqrt(252.0::double), 6) as ann_vol, round(avg(ret) * 252 / nullif(stddev_samp(ret) * sqrt(252.0::double), 0), 6) as sharpe, round(abs(min(fall)), 6) as max_drawdown from fa group by 1"""


@register(BOOKS)
def custom_backtest(spark, folder):
    """The five names of largest dollar volume in equal weights over the last 250 days, restored daily or left to drift, at 10 basis points."""
    own = extras._own_adv(spark, folder).select("ticker", F.round(F.col("adv20") / 1e9, 6).alias("a")).orderBy(F.desc("a"), "ticker").limit(5)
    weights = own.select("ticker", F.lit(0.2).alias("weight"))
    days = F.broadcast(table(spark, folder, "index_daily").select("date").distinct().orderBy(F.desc("date")).limit(250))
    returns = _event_returns(spark, folder)
    both = [replay.fixed_book(returns, weights, days, again, 10.0).withColumn("rebalance", F.lit(name)) for name, again in (("daily", True), ("none", False))]
    out = replay.metrics(both[0].unionByName(both[1]), 252.0, "rebalance")
    return rounded(out, *[c for c in out.columns if c not in ("rebalance", "n_days")])


# --- past crises

CRISES = [("first winter", "1995-11-01", "1996-02-28"), ("third summer", "1997-06-01", "1997-08-31"), ("late fall", "2000-09-01", "2000-11-30")]
SHOCKS = (-0.05, -0.1, -0.2)


@register(
    f"""with {WEIGHTED}, bk as (select ticker, weight, coalesce(beta, 1) as beta from weighted where date = (select max(date) from weighted)),
cr as (select name, (select max(date) from cal where date <= a) as a, (select max(date) from cal where date <= b) as b from (values {', '.join(f"('{n}', date '{a}', date '{b}')" for n, a, b in CRISES)}) as t(name, a, b)),
r as (select name, bk.ticker, weight, y.close / x.close - 1 as ret from cr cross join bk left join bars x on x.ticker = bk.ticker and x.date = cr.a left join bars y on y.ticker = bk.ticker and y.date = cr.b),
em as (select date, avg(ret) as ret from rets group by 1),
m as (select name, product(1 + ret) - 1 as market from cr join em on em.date > cr.a and em.date <= cr.b where ret is not null group by 1),
s as (select name, sum(case when ret is not null then weight * ret end) / nullif(sum(case when ret is not null then weight end), 0) * sum(weight) as book, coalesce(sum(case when ret is not null then weight end), 0) / sum(weight) as covered from r group by 1)
select name, round(book, 6) as book, round(market, 6) as market, round(covered, 6) as covered from s join m using (name)
union all select 'market ' || printf('%.0f', shock * 100) || ' %', round(shock * (select sum(weight * beta) from bk), 6), shock, 1.0::double from (select unnest([{', '.join(f'{x}::double' for x in SHOCKS)}]) as shock)"""
)
def crisis_replay(spark, folder):
    """The last book held through past windows, over the weight of names with prices then, and under shocks by its beta."""
    bars = panel._kept_bars(spark, folder)
    weighted = panel.weighted_of(panel._scored(spark, folder, bars)).select("date", "ticker", "weight", "beta")
    book = weighted.groupBy("date").agg(F.collect_list(F.struct("ticker", "weight", "beta")).alias("b")).agg(F.max_by("b", "date").alias("b")).select(F.inline("b"))
    book = book.withColumn("beta", F.coalesce("beta", F.lit(1.0)))
    returns = fx.with_returns(bars).select("ticker", "date", "close", "ret")
    days = returns.groupBy("date").agg(F.avg("ret").alias("ret"))  # a row per bar
    windows = spark.createDataFrame(CRISES, "name string, first string, last string").select("name", F.col("first").cast("date").alias("first"), F.col("last").cast("date").alias("last"))
    # The bars at or before both ends.
    near = days.join(F.broadcast(windows), F.col("date") <= F.col("last")).groupBy("name", "first").agg(F.max(F.when(F.col("date") <= F.col("first"), F.col("date"))).alias("a"), F.max("date").alias("b")).filter("a is not null")
    market = days.join(F.broadcast(near), (F.col("date") > F.col("a")) & (F.col("date") <= F.col("b"))).filter("ret is not null").groupBy("name").agg((F.product(1 + F.col("ret")) - 1).alias("market"))
    ends = near.select("name", F.inline(F.array(F.struct(F.lit("x").alias("side"), F.col("a").alias("date")), F.struct(F.lit("y").alias("side"), F.col("b").alias("date")))))
    closes = returns.join(F.broadcast(ends), "date").groupBy("name", "ticker").agg(F.max(F.when(F.col("side") == "x", F.col("close"))).alias("x"), F.max(F.when(F.col("side") == "y", F.col("close"))).alias("y"))
    cells = book.join(F.broadcast(near.select("name"))).join(closes, ["name", "ticker"], "left").withColumn("ret", F.col("y") / F.col("x") - 1)  # one book times windows
    have = F.sum(F.when(F.col("ret").isNotNull(), F.col("weight")))
    stats = cells.groupBy("name").agg((F.sum(F.col("weight") * F.col("ret")) / F.nullif(have, F.lit(0.0)) * F.sum("weight")).alias("book"), (F.coalesce(have, F.lit(0.0)) / F.sum("weight")).alias("covered"))
    past = stats.join(market, "name").select("name", "book", "market", "covered")
    shock = F.explode(F.array(*[F.lit(x) for x in SHOCKS]))
    beta = book.agg(F.sum(F.col("weight") * F.col("beta")).alias("beta")).select("beta", shock.alias("market"))
    named = F.concat(F.lit("market "), F.format_string("%.0f", F.col("market") * 100), F.lit(" %"))
    shocks = beta.select(named.alias("name"), (F.col("beta") * F.col("market")).alias("book"), "market", F.lit(1.0).alias("covered"))
    return rounded(past.unionByName(shocks), "book", "market", "covered")
