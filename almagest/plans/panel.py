"""Queries on weekly supplier bars and on the daily index, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almagest.operators import features as fx
from almagest.operators import series as sr
from almagest.session import checkpoint
from almagest.sources.tables import table

MIN_ADV, MIN_PRICE = 40000.0, 1000.0
FACTORS = {"momentum": 1.0, "low_risk": 1.0, "low_beta": 1.0, "size": 0.5}
QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Six digits. Values that can end in a 5 at the seventh are moved by 1e-9 first: engines round these differently."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- weekly bars

BARS = """wk as (select l_suppkey as ticker, date_trunc('week', l_shipdate)::date as date, sum(l_extendedprice::decimal(18,2))::double / sum(l_quantity) as close, sum(l_quantity) as volume from lineitem group by 1, 2),
cal as (select date, cast(row_number() over (order by date) - 1 as bigint) as day_idx from (select distinct date from wk)),
bars as (select ticker, date, day_idx, close, volume, close * volume as dv from wk join cal using (date))"""
RETS = BARS + """,
rets as (select *, close / max(close) over (partition by ticker order by day_idx range between 1 preceding and 1 preceding) - 1 as ret from bars)"""
FEAT = RETS + """,
mk as (select date, mkt, count(mkt) over y as mn, sum(mkt) over y as ms, sum(mkt * mkt) over y as mq from (select date, day_idx, avg(ret) as mkt from rets group by 1, 2) window y as (order by day_idx range between 252 preceding and current row)),
fw as (select r.*, mkt, mn, ms, mq, avg(dv) over w20 as adv20, stddev_samp(ret) over w21 * sqrt(252.0::double) as rv21, avg(abs(ret) / nullif(dv, 0)) over w21 * 1e6 as amihud,
  case when day_idx >= 252 then max(close) over (partition by ticker order by day_idx range between 21 preceding and 21 preceding) / max(close) over (partition by ticker order by day_idx range between 252 preceding and 252 preceding) - 1 end as momentum,
  count(ret) over y as bn, avg(ret) over y as br, sum(case when ret is not null then mkt end) over y as bm, sum(ret * mkt) over y as brm
  from rets r join mk using (date)
  window w20 as (partition by ticker order by day_idx range between 19 preceding and current row), w21 as (partition by ticker order by day_idx range between 20 preceding and current row), y as (partition by ticker order by day_idx range between 252 preceding and current row)),
feat as (select ticker, date, day_idx, close, volume, dv, ret, mkt, adv20, rv21, amihud, momentum, case when bn >= 126 then 0.67::double * (brm - br * bm) / nullif(mq - ms * ms / mn, 0) + 0.33::double end as beta from fw)"""
GROUPS = "grp as (select s_suppkey as ticker, n_regionkey as grp from supplier join nation on s_nationkey = n_nationkey)"
LIQ = FEAT + f""",
{GROUPS},
elig as (select *, quantile_cont(amihud, 0.9) over (partition by date) as lim from feat where adv20 >= {MIN_ADV} and close > {MIN_PRICE} and momentum is not null and amihud is not null),
liq as (select e.ticker, date, close, ret, adv20, rv21, amihud, momentum, beta, grp, -rv21 as low_risk, -beta as low_beta, ln(adv20) as size from elig e left join grp using (ticker) where amihud <= lim)"""


def _z_sql() -> str:
    winsor = ", ".join(f"case when {f} is not null then least(greatest({f}, quantile_cont({f}, 0.01) over (partition by date)), quantile_cont({f}, 0.99) over (partition by date)) end as x_{f}" for f in FACTORS)
    z = ", ".join(
        f"case when count(x_{f}) over g >= 5 then (x_{f} - avg(x_{f}) over g) / nullif(stddev_samp(x_{f}) over g, 0) else (x_{f} - avg(x_{f}) over d) / nullif(stddev_samp(x_{f}) over d, 0) end as r_{f}" for f in FACTORS
    )
    clip = ", ".join(f"case when r_{f} is not null then least(greatest(r_{f}, -3), 3) end as z_{f}" for f in FACTORS)
    score = " + ".join(f"coalesce(z_{f}, 0) * {w}::double" for f, w in FACTORS.items())
    return f""",
win as (select *, {winsor} from liq),
zr as (select *, {z} from win window g as (partition by date, grp), d as (partition by date)),
zs as (select *, {clip} from zr),
sc as (select *, ({score}) / {sum(FACTORS.values())}::double as score from zs)"""


SCORED = LIQ + _z_sql()
BOOK = SCORED + """,
b1 as (select *, row_number() over (partition by date, grp order by round(score, 9) desc, ticker) as gr from sc),
book as (select * from (select *, row_number() over (partition by date order by round(score, 9) desc, ticker) as rnk from b1 where gr <= 4) where rnk <= 15)"""
NEAR = "(ticker % 4 = 0)"
WEIGHTED = BOOK + f""",
wc as (select *, case when {NEAR} then 0.06::double else 0.1::double end as cap, {NEAR} as near from book),
wn as (select *, count(*) over d as n, count_if(near) over d as k, sum(cap) over d as room from wc window d as (partition by date)),
weighted as (select ticker, date, grp, score, rnk, close, beta, adv20, amihud, case when room < 1 then cap / room when 1.0::double / n <= 0.06 or k = 0 then 1.0::double / n when near then 0.06::double else (1 - 0.06::double * k) / (n - k) end as weight from wn)"""


def _bars(spark: SparkSession, folder: str) -> DataFrame:
    return fx.weekly_bars(table(spark, folder, "lineitem"))


def _kept_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Bars, written once for plans that use them in several places."""
    return checkpoint(_bars(spark, folder))


def _bars_ahead(spark: SparkSession, folder: str) -> DataFrame:
    """Bars with the return from the next bar to the fifth after it, ``fwd``, which all later steps carry along."""
    w = Window.partitionBy("ticker").orderBy("day_idx")
    lead = lambda k: F.max("close").over(w.rangeBetween(k, k))
    return _bars(spark, folder).withColumn("fwd", lead(5) / lead(1) - 1)


def _features(spark: SparkSession, folder: str, bars: DataFrame | None = None) -> DataFrame:
    return fx.features(_bars(spark, folder) if bars is None else bars)


def _groups(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("ticker"), F.col("n_regionkey").alias("grp"))


def _liquid(spark: SparkSession, folder: str, bars: DataFrame | None = None) -> DataFrame:
    pool = fx.liquid(_features(spark, folder, bars), MIN_ADV, MIN_PRICE).join(_groups(spark, folder), "ticker", "left")
    return pool.withColumns({"low_risk": -F.col("rv21"), "low_beta": -F.col("beta"), "size": F.log("adv20")})


def _scored(spark: SparkSession, folder: str, bars: DataFrame | None = None) -> DataFrame:
    # Ranks compare scores to nine digits, so that the order of a sum decides no tie.
    return fx.composite(_liquid(spark, folder, bars), FACTORS, "grp")


def _kept_scores(spark: SparkSession, folder: str, bars: DataFrame | None = None) -> DataFrame:
    """Scores of the liquid names with what books and costs need, written once for plans that use them several times."""
    columns = ["ticker", "date", "day_idx", "grp", "score", "close", "beta", "adv20", "amihud"]
    return checkpoint(_scored(spark, folder, bars).select(*columns, *[f"z_{f}" for f in FACTORS]))


def book_of(scored: DataFrame) -> DataFrame:
    return fx.unheld_book(scored.withColumn("score", F.round("score", 9)), "grp").withColumnRenamed("rank", "rnk")


def weighted_of(scored: DataFrame) -> DataFrame:
    return fx.capped_weights(book_of(scored), F.col("ticker") % 4 == 0)


def _book(spark: SparkSession, folder: str) -> DataFrame:
    return book_of(_scored(spark, folder))


def _weighted(spark: SparkSession, folder: str) -> DataFrame:
    return weighted_of(_scored(spark, folder))


def average_rank(value: str, *by: str) -> Column:
    """Rank of a value among the rows of ``by``; equal ones share the average of their ranks."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2.0


def average_rank_sql(value: str, by: str) -> str:
    return f"rank() over (partition by {by} order by {value}) + (count(*) over (partition by {by}, {value}) - 1) / 2.0::double"


@register(f"with {BARS} select ticker, date, day_idx, round(close + 1e-9, 6) as close, volume from bars")
def bars_weekly(spark, folder):
    return _bars(spark, folder).select("ticker", "date", "day_idx", F.round(F.col("close") + 1e-9, 6).alias("close"), "volume")


@register(f"with {RETS} select ticker, date, round(ret, 6) as ret from rets")
def ret_strict(spark, folder):
    return rounded(fx.with_returns(_bars(spark, folder)).select("ticker", "date", "ret"), "ret")


@register(f"with {FEAT} select ticker, date, round(momentum, 6) as momentum from feat where momentum is not null")
def mom_12_1(spark, folder):
    return rounded(_features(spark, folder).filter("momentum is not null").select("ticker", "date", "momentum"), "momentum")


@register(f"with {FEAT} select ticker, date, round(adv20 / 1e6 + 1e-9, 6) as adv20_m from feat")
def adv20(spark, folder):
    return _features(spark, folder).select("ticker", "date", F.round(F.col("adv20") / 1e6 + 1e-9, 6).alias("adv20_m"))


@register(f"with {FEAT} select ticker, date, round(amihud, 6) as amihud from feat")
def amihud(spark, folder):
    return rounded(_features(spark, folder).select("ticker", "date", "amihud"), "amihud")


@register(f"with {FEAT} select ticker, date, round(rv21, 6) as rv21 from feat")
def rv21(spark, folder):
    return rounded(_features(spark, folder).select("ticker", "date", "rv21"), "rv21")


@register(f"with {FEAT} select ticker, date, round(beta, 6) as beta from feat where beta is not null")
def beta_shrunk(spark, folder):
    return rounded(_features(spark, folder).filter("beta is not null").select("ticker", "date", "beta"), "beta")


@register(f"with {LIQ} select ticker, date, grp, round(momentum, 6) as momentum, round(amihud, 6) as amihud from liq")
def liquid_pool(spark, folder):
    return rounded(_liquid(spark, folder).select("ticker", "date", "grp", "momentum", "amihud"), "momentum", "amihud")


@register(f"with {FEAT} select date, count(*) as names, count_if(adv20 >= {MIN_ADV}) as with_adv, count_if(adv20 >= {MIN_ADV} and close > {MIN_PRICE}) as with_price, count_if(adv20 >= {MIN_ADV} and close > {MIN_PRICE} and momentum is not null) as with_momentum from feat group by 1")
def liquidity_funnel(spark, folder):
    a = F.col("adv20") >= MIN_ADV
    b = a & (F.col("close") > MIN_PRICE)
    return _features(spark, folder).groupBy("date").agg(F.count("*").alias("names"), F.count_if(a).alias("with_adv"), F.count_if(b).alias("with_price"), F.count_if(b & F.col("momentum").isNotNull()).alias("with_momentum"))


@register(f"with {FEAT}, l as (select ticker, adv20, close from feat where date = (select max(date) from feat) and adv20 >= {MIN_ADV}) select ticker, round(adv20 / 1e6, 6) as adv20_m, round(close + 1e-9, 6) as close from l order by round(adv20 / 1e6, 6) desc, ticker limit 20")
def screen_topn(spark, folder):
    """The 20 names of the last week with the largest dollar volume over 20 weeks; other weeks aren't read into bars."""
    lines = table(spark, folder, "lineitem")
    week = F.date_trunc("week", "l_shipdate").cast("date")
    weeks = lines.select(week.alias("date")).distinct().orderBy(F.desc("date")).limit(20)
    span = weeks.agg(F.min("date").alias("first"), F.max("date").alias("newest"))  # one row
    near = lines.join(F.broadcast(span), week >= F.col("first"))
    bars = near.groupBy(F.col("l_suppkey").alias("ticker"), week.alias("date"), "newest").agg((F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double") / F.sum("l_quantity")).alias("close"), F.sum("l_quantity").alias("volume"))
    at = F.col("date") == F.col("newest")
    last = bars.groupBy("ticker").agg(F.avg(F.col("close") * F.col("volume")).alias("adv20"), F.max(F.when(at, F.col("close"))).alias("close")).filter("close is not null")
    out = last.filter(F.col("adv20") >= MIN_ADV).select("ticker", F.round(F.col("adv20") / 1e6, 6).alias("adv20_m"), F.round(F.col("close") + 1e-9, 6).alias("close"))
    return out.orderBy(F.desc("adv20_m"), "ticker").limit(20)


@register(f"with {SCORED} select ticker, date, {', '.join(f'round(z_{f}, 6) as z_{f}' for f in FACTORS)} from sc")
def zscore_grouped(spark, folder):
    z = [f"z_{f}" for f in FACTORS]
    return rounded(_scored(spark, folder).select("ticker", "date", *z), *z)


@register(f"with {LIQ} select ticker, date, round((rank() over (partition by date order by momentum) + (count(*) over (partition by date, momentum) - 1) / 2.0::double) / count(momentum) over (partition by date), 6) as pct from liq")
def pct_rank_avg(spark, folder):
    d = Window.partitionBy("date")
    pct = (F.rank().over(d.orderBy("momentum")) + (F.count("*").over(Window.partitionBy("date", "momentum")) - 1) / 2.0) / F.count("momentum").over(d)
    return _liquid(spark, folder).select("ticker", "date", F.round(pct, 6).alias("pct"))


@register(f"with {SCORED} select ticker, date, grp, round(score, 6) as score from sc")
def composite(spark, folder):
    return rounded(_scored(spark, folder).select("ticker", "date", "grp", "score"), "score")


@register(f"with {SCORED}, r as (select ticker, date, score, row_number() over (partition by date order by round(score, 9) desc, ticker) as rnk from sc) select ticker, date, rnk, round(score, 6) as score from r where rnk <= 30")
def candidates_top30(spark, folder):
    rank = F.row_number().over(Window.partitionBy("date").orderBy(F.desc(F.round("score", 9)), "ticker"))
    return rounded(_scored(spark, folder).withColumn("rnk", rank).filter("rnk <= 30").select("ticker", "date", F.col("rnk").cast("long").alias("rnk"), "score"), "score")


@register(f"with {BOOK} select ticker, date, grp, rnk, round(score, 6) as score from book")
def book_unheld(spark, folder):
    return rounded(_book(spark, folder).select("ticker", "date", "grp", F.col("rnk").cast("long").alias("rnk"), "score"), "score")


@register(f"with {WEIGHTED} select ticker, date, round(weight, 6) as weight from weighted")
def weights_capped(spark, folder):
    return rounded(_weighted(spark, folder).select("ticker", "date", "weight"), "weight")


@register(f"with {LIQ} select ticker, date, round(1.0::double / count(*) over (partition by date), 6) as weight from liq")
def ew_benchmark(spark, folder):
    return _liquid(spark, folder).select("ticker", "date", F.round(1.0 / F.count("*").over(Window.partitionBy("date")), 6).alias("weight"))


@register(f"with {FEAT}, l as (select date, {', '.join(f'avg(({c} is not null)::int) as {c}' for c in ('ret', 'momentum', 'rv21', 'amihud', 'beta'))} from feat group by 1) select date, round(ret, 6) as ret, round(momentum, 6) as momentum, round(rv21, 6) as rv21, round(amihud, 6) as amihud, round(beta, 6) as beta from l")
def coverage(spark, folder):
    c = ("ret", "momentum", "rv21", "amihud", "beta")
    return rounded(_features(spark, folder).groupBy("date").agg(*[F.avg(F.col(x).isNotNull().cast("double")).alias(x) for x in c]), *c)


@register(f"with {WEIGHTED}, x as (select date, grp, sum(weight) as w, count(*) as names from weighted group by 1, 2) select date, grp, names, round(w, 6) as w from x")
def exposure(spark, folder):
    return rounded(_weighted(spark, folder).groupBy("date", "grp").agg(F.count("*").alias("names"), F.sum("weight").alias("w")), "w")


#: Half spreads in basis points of the upper, middle and lower third of liquid names by adv20; all others pay the last.
TIERS = (5.0, 10.0, 20.0)
TIER_SQL = f"case when adv20 >= quantile_cont(adv20, 2/3::double) over (partition by date) then {TIERS[0]}::double when adv20 >= quantile_cont(adv20, 1/3::double) over (partition by date) then {TIERS[1]}::double else {TIERS[2]}::double end"


def tier() -> Column:
    """Half spread of a row of liquid names, by the third its adv20 is in on its date."""
    third = F.percentile("adv20", F.array(F.lit(1 / 3), F.lit(2 / 3))).over(Window.partitionBy("date"))
    return F.when(F.col("adv20") >= third[1], TIERS[0]).when(F.col("adv20") >= third[0], TIERS[1]).otherwise(TIERS[2])


@register(f"with {LIQ}, t as (select ticker, date, {TIER_SQL} as bps from liq) select f.ticker, f.date, coalesce(t.bps, {TIERS[2]}::double) as half_spread_bps from feat f left join t on t.ticker = f.ticker and t.date = f.date")
def half_spread(spark, folder):
    # One pass: the thirds are taken over the rows of the date that are liquid.
    feat = fx.marked_liquid(_features(spark, folder), MIN_ADV, MIN_PRICE)
    third = F.percentile(F.when(F.col("liquid"), F.col("adv20")), F.array(F.lit(1 / 3), F.lit(2 / 3))).over(Window.partitionBy("date"))
    bps = F.when(F.col("liquid") & (F.col("adv20") >= third[1]), TIERS[0]).when(F.col("liquid") & (F.col("adv20") >= third[0]), TIERS[1]).otherwise(TIERS[2])
    return feat.select("ticker", "date", bps.alias("half_spread_bps"))


FORWARD = LIQ + """,
fwd as (select ticker, date, close_b / close_a - 1 as fwd from (select ticker, date, max(close) over (partition by ticker order by day_idx range between 1 following and 1 following) as close_a, max(close) over (partition by ticker order by day_idx range between 5 following and 5 following) as close_b from bars)),
ic as (select l.ticker, l.date, momentum, fwd from liq l join fwd f on f.ticker = l.ticker and f.date = l.date where fwd is not null),
al as (select l.ticker, l.date, momentum, -rv21 as low_risk, -beta as low_beta, ln(adv20) as size, fwd from feat l join fwd f on f.ticker = l.ticker and f.date = l.date where fwd is not null)"""


def _forward(spark, folder):
    return _liquid(spark, folder, _bars_ahead(spark, folder)).filter("fwd is not null")


def _forward_all(spark, folder):
    """Factors and returns ahead of all names, liquid or not."""
    feat = _features(spark, folder, _bars_ahead(spark, folder)).filter("fwd is not null")
    return feat.select("ticker", "date", "momentum", (-F.col("rv21")).alias("low_risk"), (-F.col("beta")).alias("low_beta"), F.log("adv20").alias("size"), "fwd")


@register(f"with {FORWARD} select ticker, date, round(fwd, 6) as fwd from ic")
def forward_returns(spark, folder):
    return rounded(_forward(spark, folder).select("ticker", "date", "fwd"), "fwd")


@register(
    f"""with {FORWARD}, rk as (select date, rank() over (partition by date order by momentum) + (count(*) over (partition by date, momentum) - 1) / 2.0::double as a, rank() over (partition by date order by fwd) + (count(*) over (partition by date, fwd) - 1) / 2.0::double as b from ic)
select date, count(*) as names, round(case when count(*) >= 2 then corr(a, b) end, 6) as ic from rk group by date having count(*) >= 20"""
)
def rank_ic(spark, folder):
    df = _forward(spark, folder).select("date", average_rank("momentum", "date").alias("a"), average_rank("fwd", "date").alias("b"))
    return df.groupBy("date").agg(F.count("*").alias("names"), F.round(F.corr("a", "b"), 6).alias("ic")).filter("names >= 20")


@register(
    f"""with {FORWARD}, n as (select *, row_number() over (partition by date order by size, ticker) as rn, count(*) over (partition by date) as n, count(distinct size) over (partition by date) as kinds from al where size is not null),
q as (select date, fwd, greatest(1, ceil(5.0::double * (rn - 1) / (n - 1) - 1e-9))::int as bucket from n where n >= 50 and kinds >= 5)
select date, bucket, count(*) as names, round(avg(fwd), 6) as fwd from q group by 1, 2"""
)
def quintiles(spark, folder):
    """Mean forward return of five buckets of all names by dollar volume, on dates with 50 names and five different values at least."""
    d = Window.partitionBy("date")
    ranked = d.orderBy("size", "ticker")
    df = _forward_all(spark, folder).filter("size is not null").withColumns({"rn": F.row_number().over(ranked), "kind": F.dense_rank().over(d.orderBy("size")), "n": F.count("*").over(d)})
    df = df.filter("n >= 50").withColumn("kinds", F.max("kind").over(d)).filter("kinds >= 5")
    bucket = F.greatest(F.lit(1), F.ceil(5.0 * (F.col("rn") - 1) / (F.col("n") - 1) - 1e-9).cast("int"))
    return df.groupBy("date", bucket.alias("bucket")).agg(F.count("*").alias("names"), F.round(F.avg("fwd"), 6).alias("fwd"))


YEAR_SQL = "pl as (select ticker, date, close / max(close) over (partition by ticker order by day_idx range between 252 preceding and 252 preceding) - 1 as plain from bars)"


@register(
    f"""with {SCORED}, {YEAR_SQL}, a as (select sc.date, sc.ticker, row_number() over (partition by sc.date order by round(score, 9) desc, sc.ticker) as x, row_number() over (partition by sc.date order by plain desc, sc.ticker) as y from sc join pl on pl.ticker = sc.ticker and pl.date = sc.date)
select date, count_if(x <= 15) as ours, count_if(x <= 15 and y <= 20) as overlap, min(case when x > 15 and y <= 20 then x end) as best_swap from a group by 1"""
)
def overlap_naive(spark, folder):
    """Names in both our best 15 and the best 20 by plain twelve-month return, and our rank of the best of the others."""
    d = Window.partitionBy("date")
    df = _scored(spark, folder).select("date", F.row_number().over(d.orderBy(F.desc(F.round("score", 9)), "ticker")).alias("x"), F.row_number().over(d.orderBy(F.desc("year_return"), "ticker")).alias("y"))
    swap = F.min(F.when(F.expr("x > 15 and y <= 20"), F.col("x"))).cast("long")
    return df.groupBy("date").agg(F.count_if(F.expr("x <= 15")).alias("ours"), F.count_if(F.expr("x <= 15 and y <= 20")).alias("overlap"), swap.alias("best_swap"))


# --- daily index

IDX = """i0 as (select index_name as name, date, close, close / lag(close) over (partition by index_name order by date) - 1 as ret, row_number() over (partition by index_name order by date) as day_no from index_daily),
i1 as (select *, case when count(close) over a >= 200 then close < avg(close) over a end as below_ma, case when count(ret) over v >= 21 then stddev_samp(ret) over v * sqrt(252.0::double) end as vol, close / lag(close, 252) over w - 1 as ret_year from i0
  window w as (partition by name order by date), a as (partition by name order by date rows between 199 preceding and current row), v as (partition by name order by date rows between 20 preceding and current row)),
i2 as (select x.name, x.date, count(y.vol) as seen, count_if(y.vol <= x.vol) as atmost from i1 x join i1 y on y.name = x.name and y.day_no <= x.day_no and y.vol is not null group by 1, 2),
cond as (select i1.*, case when i1.vol is not null and seen >= 252 then atmost::double / seen end as vol_pct from i1 left join i2 using (name, date)),
flags as (select *, coalesce(below_ma, false) and coalesce(vol_pct > 0.8, false) as stress_raw, coalesce(ret_year < 0, false) and coalesce(vol_pct > 0.8, false) as panic from cond),
weekly as (select * from flags qualify row_number() over (partition by name, date_trunc('week', date) order by date desc) = 1)"""


def _index(spark, folder):
    return table(spark, folder, "index_daily").select(F.col("index_name").alias("name"), "date", "close")


def _index_returns(spark, folder):
    return _index(spark, folder).withColumn("ret", F.col("close") / F.lag("close").over(sr.days()) - 1)


@register(f"with {IDX} select name, date, below_ma, round(vol, 6) as vol, round(vol_pct, 6) as vol_pct, round(ret_year, 6) as ret_year, stress_raw, panic from flags")
def regime_conditions(spark, folder):
    out = sr.conditions(_index(spark, folder)).select("name", "date", "below_ma", "vol", "vol_pct", "ret_year", "stress_raw", "panic")
    return rounded(out, "vol", "vol_pct", "ret_year")


@register(f"with {IDX} select name, date, stress_raw, max(stress_raw::int) over (partition by name order by date rows between 1 preceding and current row) = 1 as stress from weekly")
def stress_flags(spark, folder):
    return sr.held_on(sr.last_of_week(sr.conditions(_index(spark, folder))), "stress_raw", "stress").select("name", "date", "stress_raw", "stress")


@register(f"with {IDX} select name, date, round(close, 6) as close from weekly")
def weekly_last(spark, folder):
    return rounded(sr.last_of_week(_index(spark, folder)), "close")


@register(
    f"""with {IDX}, w as (select name, date, coalesce(vol_pct, 0) as p, row_number() over (partition by name order by date) as i from weekly),
c as (select *, count_if(p < 0.5) over (partition by name order by date rows between 1 preceding and current row) = 2 as calm from w)
select name, date, round(p, 6) as p, coalesce(max(case when p >= 0.8 then i end) over u, -1) > coalesce(max(case when calm then i end) over u, -1) as state from c window u as (partition by name order by date)"""
)
def hmm_hysteresis(spark, folder):
    weekly = sr.last_of_week(sr.conditions(_index(spark, folder))).select("name", "date", F.coalesce("vol_pct", F.lit(0.0)).alias("p"))
    return rounded(sr.dead_band(weekly, "p", "state", 0.8, 0.5), "p")


@register(
    """with d as (select distinct date, date_trunc('week', date)::date as week from index_daily), k as (select *, row_number() over (partition by week order by date) - 1 as k, count(*) over (partition by week) as n, dense_rank() over (order by week) - 1 as wn, min(date) over () as lo from d)
select week, date from k where k = least(1, n - 1) and wn % 2 = 0 and date > lo"""
)
def rebalance_days(spark, folder):
    return sr.rebalance_days(_index(spark, folder).select("date").distinct(), offset=1, every=2)


DRAW = """r as (select index_name as name, date, close / lag(close) over (partition by index_name order by date) - 1 as ret from index_daily),
e as (select *, product(1 + ret) over (partition by name order by date) as equity from r where ret is not null),
dd as (select *, equity / greatest(max(equity) over (partition by name order by date), 1) - 1 as drawdown from e)"""


@register(
    f"""with {DRAW}, g as (select *, count_if(drawdown >= -1e-12) over (partition by name order by date) as island, lead(date) over (partition by name order by date) as nx from dd),
x as (select name, min(date) as start, max(date) as "end", min(drawdown) as depth, arg_min(date, drawdown) as trough, count(*) as length, max(nx) filter (nx > date) as nx, count(nx) as known from g where drawdown < -1e-12 group by name, island)
select name, start, "end", round(depth, 6) as depth, trough, length, case when known = length then nx end as recovered, rank from (select *, row_number() over (partition by name order by depth, start) as rank from x) where rank <= 5"""
)
def drawdown_episodes(spark, folder):
    out = sr.episodes(sr.drawdowns(_index_returns(spark, folder).filter("ret is not null")))
    return rounded(out, "depth").withColumn("rank", F.col("rank").cast("long"))


@register(
    f"""with {DRAW}, p as (select *, case when count(*) over w >= 21 then product(1 + ret) over w - 1 end as roll from dd window w as (partition by name order by date rows between 20 preceding and current row))
select name, count(*) as n, round(product(1 + ret) - 1, 6) as total, round(pow(product(1 + ret), 252.0 / count(*)) - 1, 6) as annual, round(stddev_samp(ret) * sqrt(252.0::double), 6) as vol, round(avg(ret) * 252 / nullif(stddev_samp(ret) * sqrt(252.0::double), 0), 6) as sharpe,
round(min(drawdown), 6) as max_drawdown, round(quantile_cont(roll, 0.5), 6) as roll_median, round(quantile_cont(roll, 0.05), 6) as roll_p05, round(quantile_cont(roll, 0.95), 6) as roll_p95, round(min(roll), 6) as roll_worst from p group by name"""
)
def perf_metrics(spark, folder):
    out = sr.performance(_index_returns(spark, folder))
    return rounded(out, *[c for c in out.columns if c not in ("name", "n")])


CAPM = """r as (select index_name, date, close / lag(close) over (partition by index_name order by date) - 1 as ret from index_daily), j as (select date, max(case when index_name = 'SMALLCOMP' then ret end) as y, max(case when index_name = 'MKTCOMP' then ret end) as x from r group by date), k as (select * from j where x is not null and y is not null)"""


@register(f"with {CAPM} select count(*) as n, round(covar_samp(y, x) / var_samp(x), 6) as beta, round((avg(y) - covar_samp(y, x) / var_samp(x) * avg(x)) * 252, 6) as alpha, round(corr(y, x), 6) as corr from k")
def capm(spark, folder):
    r = _index_returns(spark, folder).filter("ret is not null").groupBy("date").pivot("name", ["SMALLCOMP", "MKTCOMP"]).agg(F.max("ret")).dropna()
    beta = F.covar_samp("SMALLCOMP", "MKTCOMP") / F.var_samp("MKTCOMP")
    return r.agg(F.count("*").alias("n"), F.round(beta, 6).alias("beta"), F.round((F.avg("SMALLCOMP") - beta * F.avg("MKTCOMP")) * 252, 6).alias("alpha"), F.round(F.corr("SMALLCOMP", "MKTCOMP"), 6).alias("corr"))


@register("with r as (select index_name as name, date, close / lag(close) over (partition by index_name order by date) - 1 as ret from index_daily) select name, year(date) as year, count(ret) as days, round(product(1 + ret) - 1, 6) as total from r where ret is not null group by 1, 2")
def year_returns(spark, folder):
    r = _index_returns(spark, folder).filter("ret is not null")
    return r.groupBy("name", F.year("date").cast("long").alias("year")).agg(F.count("ret").alias("days"), F.round(F.product(1 + F.col("ret")) - 1, 6).alias("total"))
