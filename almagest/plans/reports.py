"""Queries on quarterly reports, splits, books over time, statistics, clusters and events, with the same in SQL."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from almagest.operators import books, models, nearest, reports, rolling
from almagest.operators import features as fx
from almagest.operators import series as sr
from almagest.plans import panel
from almagest.plans.panel import FORWARD, QUERIES, SQL, WEIGHTED, register, rounded
from almagest.sources.tables import table

# --- quarterly reports of suppliers, made public by the first order of theirs

REPORTS = """q as (select l_suppkey as ticker, date_trunc('quarter', l_shipdate)::date as qd, sum(l_extendedprice::decimal(18,2))::double as sales, sum((l_extendedprice * l_tax)::decimal(18,4))::double as cost, sum(l_quantity) as qty from lineitem group by 1, 2),
rep as (select ticker, (qd + interval 3 month - interval 1 day)::date as pe, sales, cost, qty, (sales - cost) / qty as eps from q),
fil as (select distinct l_suppkey as ticker, o_orderdate::date as fd from lineitem join orders on l_orderkey = o_orderkey),
known as (select ticker, pe, coalesce(min(fd) + 1, pe + 60) as knowable, min(fd) as filed from (select r.ticker, r.pe, f.fd from rep r left join fil f on f.ticker = r.ticker and f.fd between r.pe + 6 and r.pe + 120) group by ticker, pe)"""


def _reports(spark: SparkSession, folder: str) -> DataFrame:
    quarter = F.date_trunc("quarter", "l_shipdate").cast("date")
    q = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("ticker"), quarter.alias("qd")).agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("sales"),
        F.sum((F.col("l_extendedprice") * F.col("l_tax")).cast("decimal(18,4)")).cast("double").alias("cost"),
        F.sum("l_quantity").alias("qty"),
    )
    pe = F.date_sub(F.add_months("qd", 3), 1)
    return q.select("ticker", pe.alias("pe"), "sales", "cost", "qty", ((F.col("sales") - F.col("cost")) / F.col("qty")).alias("eps"))


def _known(spark: SparkSession, folder: str, rep: DataFrame | None = None) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", F.col("l_suppkey").alias("ticker"))
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("fd"))
    filed = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("ticker", "fd").distinct().withColumn("filed", F.unix_date("fd"))
    rep = (_reports(spark, folder) if rep is None else rep).select("ticker", "pe")
    found = nearest.nearest(rep, filed, "ticker", "pe", "fd", "filed", 6, 120)
    filing = F.date_from_unix_date(F.col("filed").cast("int"))
    return rep.join(found, ["ticker", "pe"], "left").select("ticker", "pe", F.coalesce(F.date_add(filing, 1), F.date_add("pe", 60)).alias("knowable"), filing.alias("filed"))


@register(f"with {REPORTS} select ticker, pe, knowable, filed from known")
def asof_filing(spark, folder):
    return _known(spark, folder)


TTM = REPORTS + """,
ttm as (select *, case when count(*) over w = 4 and pe - min(pe) over w <= 300 and count(sales) over w = 4 then sum(sales) over w end as ttm_sales, case when count(*) over w = 4 and pe - min(pe) over w <= 300 and count(eps) over w = 4 then sum(eps) over w end as ttm_eps from rep window w as (partition by ticker order by pe rows between 3 preceding and current row))"""


@register(f"with {TTM} select ticker, pe, round(ttm_sales / 1e6 + 1e-9, 6) as ttm_sales_m, round(ttm_eps, 6) as ttm_eps from ttm")
def ttm(spark, folder):
    out = reports.trailing_year(_reports(spark, folder), ["sales", "eps"])
    return out.select("ticker", "pe", F.round(F.col("ttm_sales") / 1e6 + 1e-9, 6).alias("ttm_sales_m"), F.round("ttm_eps", 6).alias("ttm_eps"))


SUE = REPORTS + """,
df as (select *, case when pe - lag(pe, 4) over w between 330 and 400 then eps - lag(eps, 4) over w end as diff from rep window w as (partition by ticker order by pe)),
sue as (select ticker, pe, diff / nullif(case when count(diff) over p >= 4 then stddev_samp(diff) over p end, 0) as sue from df window p as (partition by ticker order by pe rows between 8 preceding and 1 preceding))"""


@register(f"with {SUE} select ticker, pe, round(sue, 6) as sue from sue")
def sue(spark, folder):
    return rounded(reports.surprise(_reports(spark, folder)).select("ticker", "pe", "sue"), "sue")


@register(
    f"""with {TTM}, {panel.BARS} select t.ticker, t.pe, round(greatest(ttm_eps, 0) / b.close, 6) as value_yield from ttm t join known k using (ticker, pe) join bars b on b.ticker = t.ticker and b.date = date_trunc('week', k.knowable)::date where ttm_eps is not null"""
)
def value_yield(spark, folder):
    t = reports.trailing_year(_reports(spark, folder), ["eps"]).filter("ttm_eps is not null").join(_known(spark, folder), ["ticker", "pe"])
    bars = fx.weekly_bars(table(spark, folder, "lineitem")).select("ticker", "date", "close")
    t = t.withColumn("date", F.date_trunc("week", "knowable").cast("date")).join(bars, ["ticker", "date"])
    return t.select("ticker", "pe", F.round(F.greatest("ttm_eps", F.lit(0.0)) / F.col("close"), 6).alias("value_yield"))


@register(
    f"""with {REPORTS}, p as (select ticker, pe, 1 - cost / sales as margin, sales / qty as price from rep),
r as (select ticker, pe, (rank() over (partition by pe order by round(margin, 9)) + (count(*) over (partition by pe, round(margin, 9)) - 1) / 2.0::double) / count(*) over (partition by pe) - 0.5 as a, (rank() over (partition by pe order by round(price, 9)) + (count(*) over (partition by pe, round(price, 9)) - 1) / 2.0::double) / count(*) over (partition by pe) - 0.5 as b from p)
select ticker, pe, round((a + b) / 2, 6) as quality from r"""
)
def quality_blend(spark, folder):
    rep = _reports(spark, folder).select("ticker", "pe", F.round(1 - F.col("cost") / F.col("sales"), 9).alias("margin"), F.round(F.col("sales") / F.col("qty"), 9).alias("price"))
    d = Window.partitionBy("pe")
    rank = lambda c: (F.rank().over(d.orderBy(c)) + (F.count("*").over(Window.partitionBy("pe", c)) - 1) / 2.0) / F.count("*").over(d) - 0.5
    return rep.select("ticker", "pe", F.round((rank("margin") + rank("price")) / 2, 6).alias("quality"))


# --- splits and sectors of the daily tables

SPLITS = """b0 as (select ticker, date, close, volume from stocks_daily where ticker is not null and date is not null qualify row_number() over (partition by ticker, date order by loaded_at desc nulls last, bar_id desc) = 1),
b as (select * from b0 where isfinite(close) and close > 0),
p as (select *, lag(close) over (partition by ticker order by date) as prev from b),
s as (select distinct ticker, ex_date, value as ratio from corporate_actions where kind = 'split' and value > 0 and isfinite(value)),
f as (select s.ticker, s.ex_date, s.ratio, p.date as first_print, p.close, p.prev from s join p on p.ticker = s.ticker and p.date >= s.ex_date qualify row_number() over (partition by s.ticker, s.ex_date, s.ratio order by p.date) = 1),
fac as (select ticker, ex_date, ratio, first_print, coalesce(abs(ln(ratio)) >= 0.05 and abs(ln(close / prev * ratio)) < 0.25, false) as applied from f)"""


def _split_inputs(spark, folder):
    bars = table(spark, folder, "stocks_daily").select("bar_id", "ticker", "date", "close", "volume", "loaded_at")
    bars = rolling.latest_delivery(bars, ["ticker", "date"], ["loaded_at", "bar_id"], ["close", "volume"])
    bars = bars.withColumn("close", rolling.finite(F.col("close"))).filter("close > 0")
    splits = table(spark, folder, "corporate_actions").filter("kind = 'split'").select("ticker", "ex_date", rolling.finite(F.col("value")).alias("ratio")).filter("ratio > 0").distinct()
    return bars, reports.split_factors(bars, splits)


@register(f"with {SPLITS} select ticker, ex_date, ratio, first_print, applied from fac")
def split_factors(spark, folder):
    return _split_inputs(spark, folder)[1]


@register(
    f"""with {SPLITS}, a as (select b.ticker, b.date, b.close, b.volume, coalesce(product(ratio), 1) as factor from b left join fac on fac.ticker = b.ticker and applied and first_print > b.date group by 1, 2, 3, 4)
select ticker, date, round(close / factor + 1e-9, 6) as close_adj, round(case when isfinite(volume) then volume end * factor + 1e-9, 6) as volume_adj from a"""
)
def split_adjust(spark, folder):
    out = reports.split_adjust(*_split_inputs(spark, folder))
    return out.select("ticker", "date", F.round(F.col("close_adj") + 1e-9, 6).alias("close_adj"), F.round(rolling.finite(F.col("volume_adj")) + 1e-9, 6).alias("volume_adj"))


_CASES = " ".join(f"when floor(try_cast(sic_code as double) / 100) between {a} and {b} then '{g}'" for a, b, g in reports.SECTORS)


@register(f"select ticker, case {_CASES} else 'other' end as sector, upper(trim(primary_exchange)) as exchange from reference_tickers")
def sector_groups(spark, folder):
    return table(spark, folder, "reference_tickers").select("ticker", reports.sector(F.col("sic_code")).alias("sector"), F.upper(F.trim("primary_exchange")).alias("exchange"))


PROFILED = {"stocks_daily": ("open", "close", "volume", "loaded_at"), "corporate_actions": ("ex_date", "kind", "value", "raw"), "fundamentals_actuals": ("revenue", "eps", "net_income", "loaded_at"), "report_calendar_us": ("filing_date", "acceptance_datetime", "period_end"), "reference_tickers": ("name", "sic_code", "primary_exchange", "market_cap")}
NUMBERS = ("open", "close", "volume", "value", "revenue", "eps", "net_income", "market_cap")
_GONE_SQL = lambda t, c: f"select '{t}' as table_name, '{c}' as column_name, count(*) as n, round(avg(({c} is null{f' or isnan({c})' if c in NUMBERS else ''})::int), 6) as null_share from {t}"


@register(" union all ".join(_GONE_SQL(t, c) for t, cs in PROFILED.items() for c in cs))
def null_profile(spark, folder):
    """Share of missing values of the columns of each table: one pass a table."""
    out = []
    for t, cs in PROFILED.items():
        gone = {c: F.col(c).isNull() | F.isnan(c) if c in NUMBERS else F.col(c).isNull() for c in cs}
        wide = table(spark, folder, t).agg(F.count("*").alias("n"), *[F.round(F.avg(g.cast("double")), 6).alias(c) for c, g in gone.items()])
        out.append(wide.select(F.lit(t).alias("table_name"), F.col("n"), F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_share")) for c in cs]))))
    return reduce(DataFrame.unionByName, out).select("table_name", "column_name", "n", "null_share")


DESCRIBED = [("stocks_daily", c) for c in ("open", "close", "volume")] + [("corporate_actions", "value"), ("fundamentals_actuals", "eps")]


@register(" union all ".join(f"select '{t}' as table_name, '{c}' as column_name, count(*) as n, round(min({c}), 6) as low, round(quantile_cont({c}, 0.25), 6) as p25, round(quantile_cont({c}, 0.5), 6) as p50, round(quantile_cont({c}, 0.75), 6) as p75, round(max({c}), 6) as high from {t} where isfinite({c})" for t, c in DESCRIBED))
def describe(spark, folder):
    """Range and quartiles of the finite values of number columns."""
    parts = []
    for t, c in DESCRIBED:
        x = table(spark, folder, t).select(rolling.finite(F.col(c)).alias("x")).filter("x is not null")
        q = F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        d = x.agg(F.count("*").alias("n"), F.min("x").alias("low"), q.alias("q"), F.max("x").alias("high"))
        parts.append(d.select(F.lit(t).alias("table_name"), F.lit(c).alias("column_name"), "n", F.round("low", 6).alias("low"), *[F.round(F.col("q")[k], 6).alias(f"p{p}") for k, p in enumerate((25, 50, 75))], F.round("high", 6).alias("high")))
    return reduce(DataFrame.unionByName, parts)


# --- books over time

BAND = WEIGHTED + """,
nd as (select date, lead(date) over (order by date) as nx from (select distinct date from weighted)),
pv as (select ticker, nx as date, weight as prev from weighted join nd using (date) where nx is not null),
fo as (select date, ticker, coalesce(w.weight, 0) as weight, coalesce(p.prev, 0) as prev from (select date, ticker, weight from weighted) w full join pv p using (date, ticker)),
st as (select *, weight > 0 and prev > 0 and abs(weight - prev) < 0.02 as stays from fo),
tt as (select *, sum(weight) over d as total, sum(case when stays then prev else 0 end) over d as kept, sum(case when not stays then weight else 0 end) over d as moved from st window d as (partition by date)),
nt as (select date, ticker, prev, weight, case when moved > 0 then case when stays then prev else weight * (total - kept) / moved end else case when stays then prev * total / nullif(kept, 0) else 0 end end as held from tt)"""


@register(f"with {BAND} select date, ticker, round(prev, 6) as prev, round(held, 6) as held from nt where held > 0 or prev > 0")
def no_trade(spark, folder):
    out = books.no_trade(panel._weighted(spark, folder).select("date", "ticker", "weight"))
    return rounded(out.select("date", "ticker", "prev", "held"), "prev", "held")


@register(
    f"""with {BAND}, tier as (select ticker, date, amihud, {panel.TIER_SQL} as bps from liq),
wd as (select date, max(amihud) as worst from liq group by 1),
x as (select nt.date, held - prev as dw, coalesce(bps, 20.0::double) as bps, coalesce(amihud, wd.worst) as amihud from nt join wd using (date) left join tier on tier.date = nt.date and tier.ticker = nt.ticker where held > 0 or prev > 0)
select date, round(sum(abs(dw)) , 6) as turnover, round(sum(abs(dw) * bps / 1e4 + amihud * 1e6 / 1e6 * dw * dw) / 1e3, 6) as cost_k from x group by 1"""
)
def trade_cost(spark, folder):
    scored = panel._kept_scores(spark, folder)
    tiers = scored.select("ticker", "date", "amihud", panel.tier().alias("bps"))
    worst = scored.groupBy("date").agg(F.max("amihud").alias("worst"))
    held = books.no_trade(panel.weighted_of(scored).select("date", "ticker", "weight"))
    x = held.join(F.broadcast(worst), "date").join(tiers, ["date", "ticker"], "left").withColumn("dw", F.col("held") - F.col("prev"))  # a row per date
    paid = books.cost(F.col("dw"), F.coalesce("bps", F.lit(panel.TIERS[2])), F.coalesce("amihud", "worst"), 1e6)
    return x.groupBy("date").agg(F.round(F.sum(F.abs("dw")), 6).alias("turnover"), F.round(F.sum(paid) / 1e3, 6).alias("cost_k"))


#: Weeks that a book is followed for; one starts each week, so books overlap.
HOLD = 4
DRIFT = WEIGHTED + """,
pd as (select date, day_idx as start_idx, least(day_idx + 4, max(day_idx) over ()) as end_idx from (select distinct date, day_idx from weighted join cal using (date))),
dy as (select w.ticker, start_idx, weight, unnest(generate_series(start_idx + 1, end_idx)) as day_idx from weighted w join pd using (date) where end_idx > start_idx),
gr as (select dy.*, product(1 + coalesce(ret, 0)) over (partition by start_idx, dy.ticker order by dy.day_idx) as growth from dy left join rets on rets.ticker = dy.ticker and rets.day_idx = dy.day_idx)"""


def _drift(spark, folder):
    """Growth of each name of every book over the weeks it is followed for, or as many as there are."""
    bars = panel._kept_bars(spark, folder)
    weighted = panel.weighted_of(panel._kept_scores(spark, folder, bars)).select("ticker", F.col("day_idx").alias("start_idx"), "weight")
    last = weighted.agg(F.max("start_idx").alias("last"))  # one row
    held = weighted.join(F.broadcast(last)).withColumn("end_idx", F.least(F.col("start_idx") + HOLD, "last")).drop("last")
    return books.drift(fx.with_returns(bars), held)


@register(f"with {DRIFT} select start_idx, day_idx, round(1 + sum(weight * (growth - 1)), 6) as value from gr group by 1, 2")
def drift_pnl(spark, folder):
    return _drift(spark, folder).groupBy("start_idx", "day_idx").agg(F.round(1 + F.sum(F.col("weight") * (F.col("growth") - 1)), 6).alias("value"))


@register(f"with {DRIFT}, l as (select * from gr qualify row_number() over (partition by start_idx, ticker order by day_idx desc) = 1) select ticker, count(*) as periods, round(sum(weight * (growth - 1)), 6) as contribution from l group by 1")
def contributions(spark, folder):
    last = _drift(spark, folder).groupBy("ticker", "start_idx").agg(F.max(F.struct("day_idx", "weight", "growth")).alias("g"))
    return last.groupBy("ticker").agg(F.count("*").alias("periods"), F.round(F.sum(F.col("g.weight") * (F.col("g.growth") - 1)), 6).alias("contribution"))


#: Scenarios of books: number, names, exit rank, quota of a group.
BANDED = [(1, 15, 30, 4), (2, 15, 15, 4), (3, 15, 60, 4), (4, 25, 50, 7)]


@register()
def backtest_banded(spark, folder):
    """Books of four scenarios with exit bands, each carried from date to date, and their value path by week."""
    bars = panel._kept_bars(spark, folder)
    ranked = panel._scored(spark, folder, bars).withColumn("rnk", F.row_number().over(Window.partitionBy("date").orderBy(F.desc(F.round("score", 9)), "ticker")))
    top, quota = max(max(n, leave) for _, n, leave, _ in BANDED), max(q for *_, q in BANDED)
    book = books.banded_books(books.within_reach(ranked.select("date", "ticker", "grp", "rnk"), top, quota), BANDED)
    w = Window.partitionBy("ticker").orderBy("day_idx")
    nxt = bars.select("ticker", "date", (F.max("close").over(w.rangeBetween(1, 1)) / F.col("close") - 1).alias("next_ret"))
    return book.join(nxt, ["ticker", "date"], "left").groupBy("scenario_id", "date").agg(F.count("*").alias("names"), F.round(F.sum(F.col("weight") * F.coalesce("next_ret", F.lit(0.0))), 6).alias("next_ret"))


# --- statistics


@register(
    f"""with {FORWARD}, rk as (select date, {panel.average_rank_sql("momentum", "date")} as a, {panel.average_rank_sql("fwd", "date")} as b from ic),
s as (select date, corr(a, b) as v from rk group by date having count(*) >= 20), n as (select row_number() over (order by date) as i, v - avg(v) over () as e, avg(v) over () as m, count(*) over () as n from s),
l as (select max(n) as n, max(m) as m, floor(4 * pow(max(n) / 100.0::double, 2.0 / 9))::int as lags from n),
g as (select y.i - x.i as k, sum(x.e * y.e) as c from n x join n y on y.i >= x.i and y.i - x.i <= 10 group by 1),
v as (select l.n, l.m, l.lags, sum(case when k = 0 then c when k <= lags then 2 * (1 - k / (lags + 1.0::double)) * c else 0 end) as s from g cross join l group by 1, 2, 3)
select n, lags, round(m, 6) as mean, case when n >= 10 then round(m / sqrt(s / n / n), 6) end as t from v"""
)
def newey_west(spark, folder):
    """Mean rank correlation and its t value with Bartlett weights. One row per date, so lags are one small window."""
    ic = panel._forward(spark, folder).select("date", panel.average_rank("momentum", "date").alias("a"), panel.average_rank("fwd", "date").alias("b"))
    ic = ic.groupBy("date").agg(F.count("*").alias("c"), F.corr("a", "b").alias("v")).filter("c >= 20")
    everything, order = Window.partitionBy(), Window.orderBy("date")
    e = ic.withColumns({"m": F.avg("v").over(everything), "n": F.count("*").over(everything)}).withColumn("e", F.col("v") - F.col("m")).withColumn("lags", F.floor(4 * F.pow(F.col("n") / 100.0, F.lit(2.0 / 9))).cast("int"))
    terms = F.col("e") * F.col("e")
    e = e.withColumns({f"e{k}": F.lag("e", k).over(order) for k in range(1, 11)})
    for k in range(1, 11):
        terms = terms + F.when(F.col("lags") >= k, 2 * (1 - k / (F.col("lags") + 1.0)) * F.coalesce(F.col("e") * F.col(f"e{k}"), F.lit(0.0))).otherwise(0.0)
    out = e.groupBy("n", "lags", "m").agg(F.sum(terms).alias("s"))
    return out.select("n", "lags", F.round("m", 6).alias("mean"), F.when(F.col("n") >= 10, F.round(F.col("m") / F.sqrt(F.col("s") / F.col("n") / F.col("n")), 6)).alias("t"))


def rand_index(pairs: DataFrame, by: str) -> DataFrame:
    """Adjusted Rand index of two groupings ``a`` and ``b`` for each ``by``, from the counts of their common cells."""
    cells = pairs.groupBy(by, "a", "b").agg(F.count("*").alias("n"))
    two = lambda c: F.sum(c * (c - 1) / 2.0)
    side = lambda c, out: cells.groupBy(by, c).agg(F.sum("n").alias("x")).groupBy(by).agg(two(F.col("x")).alias(out))
    t = cells.groupBy(by).agg(F.sum("n").alias("names"), two(F.col("n")).alias("ab")).join(side("a", "ra"), by).join(side("b", "rb"), by)
    chance = F.col("ra") * F.col("rb") / (F.col("names") * (F.col("names") - 1) / 2.0)
    return t.select(by, "names", ((F.col("ab") - chance) / F.nullif((F.col("ra") + F.col("rb")) / 2 - chance, F.lit(0.0))).alias("ari"))


@register(
    """with dim as (select vec_id, label, [embedding[k]::double for k in range(1, 9)] as x from embeddings),
g as (select label, vec_id, list_position(x, list_max(x)) as b from dim),
c as (select label as a, b, count(*) as n from g group by 1, 2), n as (select sum(n) as n from c),
t as (select (select sum(n * (n - 1) / 2.0::double) from c) as ab, (select sum(x * (x - 1) / 2.0::double) from (select sum(n) as x from c group by a)) as a, (select sum(x * (x - 1) / 2.0::double) from (select sum(n) as x from c group by b)) as b, n.n * (n.n - 1) / 2.0::double as p, n.n as names from n)
select names::bigint as names, round((ab - a * b / p) / nullif((a + b) / 2 - a * b / p, 0), 6) as ari from t"""
)
def adj_rand(spark, folder):
    """How the labels of vectors agree with the largest of their first eight coordinates (adjusted Rand index)."""
    first = F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double"))
    pairs = table(spark, folder, "embeddings").select(F.lit(1).alias("all"), F.col("label").alias("a"), F.array_position(first, F.array_max(first)).alias("b"))
    return rounded(rand_index(pairs, "all").select("names", "ari"), "ari")


#: Returns before 1 January of a year that a model of that year takes.
LEAST_HISTORY = 125


def _upto_year(spark, folder):
    """Each year of an index (``fit_year``) with the returns of all days up to its end."""
    r = panel._index_returns(spark, folder).filter("ret is not null and not isnan(ret)").select("name", "date", "ret", F.year("date").alias("year"))
    years = r.select("name", F.col("year").alias("fit_year")).distinct()
    return r.join(years, "name").filter("year <= fit_year")


@register()
def hmm_filter(spark, folder):
    """Probability of the volatile state of each index, by the forward recursion with models fitted walk-forward.

    The days of a year are filtered with the model of the days before it, over all days so far. A year with less than
    ``LEAST_HISTORY`` returns before it has no model, so its days have no row. One task per index and year.
    """

    def scan(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("date")
        x, own = part["ret"].to_numpy() * 100, (part["year"] == part["fit_year"]).to_numpy()
        if (~own).sum() < LEAST_HISTORY:
            return pd.DataFrame({"name": [], "date": [], "p_stress": []}, dtype=object)
        m = models.fit_two_states(x[~own])
        p = books.forward_filter(x, m["pi"], m["move"], m["mean"], m["sd"])
        return pd.DataFrame({"name": part["name"][own], "date": part["date"][own], "p_stress": p[own].round(6)})

    return _upto_year(spark, folder).groupBy("name", "fit_year").applyInPandas(scan, "name string, date date, p_stress double")


@register()
def bootstrap(spark, folder):
    """Stationary bootstrap of the mean daily return of each index: 2000 replicates, mean block 21 days.

    Replicates are spread over tasks; each draws from its own seed, so results don't depend on the partitioning.
    """
    series = panel._index_returns(spark, folder).filter("ret is not null").groupBy("name").agg(F.sort_array(F.collect_list(F.struct("date", "ret"))).alias("s")).select("name", F.col("s.ret").alias("r"))
    runs = series.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(1999)))).repartition("name", "run")

    def draw(batches):
        for batch in batches:
            means = []
            for r, run in zip(batch["r"], batch["run"]):
                r, rng = np.asarray(r), np.random.default_rng(int(run))
                n = len(r)
                jump = rng.random(n) < 1 / 21
                jump[0] = True
                starts = rng.integers(0, n, n)
                begin = np.maximum.accumulate(np.where(jump, np.arange(n), 0))
                means.append(r[(starts[begin] + np.arange(n) - begin) % n].mean())
            yield pd.DataFrame({"name": batch["name"], "mean": means})

    out = runs.mapInPandas(draw, "name string, mean double").groupBy("name")
    return out.agg(F.count("*").alias("runs"), F.round(F.percentile("mean", F.lit(0.05)), 8).alias("p05"), F.round(F.percentile("mean", F.lit(0.5)), 8).alias("p50"), F.round(F.percentile("mean", F.lit(0.95)), 8).alias("p95"))


PAIR = ("SMALLCOMP", "MKTCOMP")


def _pair(spark, folder):
    """Returns of the pair of indices on the days that both have, in order of date: one row, as all draws need all days."""
    r = panel._index_returns(spark, folder).filter("ret is not null and not isnan(ret)").groupBy("date").pivot("name", list(PAIR)).agg(F.max("ret")).dropna()
    days = r.agg(F.sort_array(F.collect_list(F.struct("date", *PAIR))).alias("s")).filter("size(s) > 0")
    return days.select(*[F.col(f"s.{n}").alias(c) for n, c in zip(PAIR, "ab")])


def _newey_west(x: np.ndarray) -> float:
    """Mean over its error with Bartlett weights; NaN for fewer than ten values."""
    n = len(x)
    if n < 10:
        return float("nan")
    e, lags = x - x.mean(), int(4 * (n / 100) ** (2 / 9))
    spread = e @ e + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1))
    return float(x.mean() / np.sqrt(spread / n / n)) if spread > 0 else float("nan")


@register()
def paired_bootstrap(spark, folder):
    """Yearly return gap of the pair by a stationary bootstrap of its daily gaps: 2000 replicates, mean block 21 days.

    A replicate takes both returns of a day together. ``p`` is the share of replicates with a gap of zero or less, ``t``
    the gap over its error with Bartlett weights.
    """
    pair = _pair(spark, folder)
    runs = pair.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(1999)))).repartition("run")

    def draw(batches):
        for batch in batches:
            means = []
            for a, b, run in zip(batch["a"], batch["b"], batch["run"]):
                gap, rng = np.asarray(a) - np.asarray(b), np.random.default_rng(int(run))
                n = len(gap)
                jump = rng.random(n) < 1 / 21
                jump[0] = True
                starts = rng.integers(0, n, n)
                begin = np.maximum.accumulate(np.where(jump, np.arange(n), 0))
                means.append(gap[(starts[begin] + np.arange(n) - begin) % n].mean())
            yield pd.DataFrame({"mean": means})

    def whole(batches):
        for batch in batches:
            gaps = [np.asarray(a) - np.asarray(b) for a, b in zip(batch["a"], batch["b"])]
            yield pd.DataFrame({"days": [len(g) for g in gaps], "gap": [g.mean() for g in gaps], "t": [_newey_west(g) for g in gaps]})

    drawn = runs.mapInPandas(draw, "mean double").agg(F.count("*").alias("runs"), F.avg((F.col("mean") <= 0).cast("double")).alias("p"), *[F.percentile("mean", F.lit(q / 100)).alias(f"p{q:02d}") for q in (5, 95)])
    out = pair.mapInPandas(whole, "days long, gap double, t double").join(drawn)  # one row each
    year = [F.round(F.col(c) * 252, 6).alias(c) for c in ("gap", "p05", "p95")]
    return out.select("days", "runs", year[0], F.round(F.nanvl("t", F.lit(None).cast("double")), 6).alias("t"), F.round("p", 6).alias("p"), *year[1:])


@register()
def kmeans(spark, folder):
    """Ten clusters of the embeddings by k-means, with the share of each cluster's commonest label."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    df = table(spark, folder, "embeddings").select("vec_id", "label", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=10, seed=7, maxIter=20).fit(df)
    cells = model.transform(df).groupBy("prediction", "label").agg(F.count("*").alias("n"))
    return cells.groupBy(F.col("prediction").alias("cluster")).agg(F.sum("n").alias("size"), F.round(F.max("n") / F.sum("n"), 6).alias("purity"))


# --- events


@register("select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def event_windows(spark, folder):
    """Hourly counts and totals per type."""
    df = table(spark, folder, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return df.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@register(
    """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minute then 0 else 1 end as fresh from events),
s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as sid from g)
select user_id, min(ts) as start, count(*) as n from s group by user_id, sid"""
)
def event_sessions(spark, folder):
    """Sessions of a user, ended by 30 minutes without an event."""
    df = table(spark, folder, "events").groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return df.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@register("select json_extract_string(props, '$.k') as k, count(*) as n, count(distinct user_id) as users from events group by 1")
def event_props(spark, folder):
    return table(spark, folder, "events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


__all__ = ["QUERIES", "SQL", "sr"]
