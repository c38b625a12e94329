"""More queries on the daily tables and the weekly panel, with the same in SQL where it can say it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from almagest.operators import books, clusters, models, reports
from almagest.operators import features as fx
from almagest.operators import series as sr
from almagest.plans import panel
from almagest.plans import reports as rp
from almagest.plans.panel import FORWARD, IDX, RETS, register, rounded
from almagest.plans.reports import SPLITS
from almagest.sources.tables import table

IR = "r as (select index_name as name, date, close / lag(close) over (partition by index_name order by date) - 1 as ret from index_daily)"
TABLES = ["stocks_daily", "corporate_actions", "reference_tickers", "index_daily", "fundamentals_actuals", "report_calendar_us", "decide_requests", "events", "lineitem", "orders"]


@register(" union all ".join(f"select '{t}' as table_name, count(*) as n from {t}" for t in TABLES))
def panel_catalog(spark, folder):
    counts = [table(spark, folder, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n") for t in TABLES]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@register("select date, lead(date) over (order by date) as next_date, row_number() over (partition by date_trunc('week', date) order by date) = 1 as first_of_week, row_number() over (partition by date_trunc('week', date) order by date desc) = 1 as last_of_week, cast(row_number() over (order by date) - 1 as bigint) as day_idx from (select distinct date from index_daily)")
def trading_calendar(spark, folder):
    week = Window.partitionBy(F.date_trunc("week", "date"))
    dates = fx.calendar(table(spark, folder, "index_daily"))
    return dates.select("date", F.lead("date").over(Window.orderBy("date")).alias("next_date"), (F.row_number().over(week.orderBy("date")) == 1).alias("first_of_week"), (F.row_number().over(week.orderBy(F.desc("date"))) == 1).alias("last_of_week"), "day_idx")


@register(f"with {IDX}, d as (select name, date from flags) select d.name, d.date, w.date as check_date, w.stress_raw as stress from d asof left join weekly w on w.name = d.name and w.date <= d.date")
def flags_asof(spark, folder):
    """The last weekly check at or before each day: a union in order of date, carried forward."""
    flags = sr.conditions(panel._index(spark, folder))
    weekly = sr.last_of_week(flags).select("name", "date", F.struct(F.col("date").alias("d"), "stress_raw").alias("c"))
    both = flags.select("name", "date").join(weekly, ["name", "date"], "left")
    last = F.last("c", ignorenulls=True).over(sr.days().rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("l", last).select("name", "date", F.col("l.d").alias("check_date"), F.col("l.stress_raw").alias("stress"))


@register(f"with {IDX}, x as (select name, date, stress_raw, lag(stress_raw) over (partition by name order by date) as before from weekly) select name, count(*) as checks, count_if(stress_raw) as flagged, count_if(before is not null and before <> stress_raw) as switches from x group by 1")
def regime_switches(spark, folder):
    weekly = sr.last_of_week(sr.conditions(panel._index(spark, folder))).withColumn("before", F.lag("stress_raw").over(sr.days()))
    return weekly.groupBy("name").agg(F.count("*").alias("checks"), F.count_if("stress_raw").alias("flagged"), F.count_if(F.col("before").isNotNull() & (F.col("before") != F.col("stress_raw"))).alias("switches"))


RANGES = [("first half", "2023-01-01", "2024-06-30"), ("second half", "2024-07-01", "2025-12-31"), ("spring 2024", "2024-03-01", "2024-05-31")]


@register(f"with {IR}, p as (select * from (values {', '.join(f'''('{n}', date '{a}', date '{b}')''' for n, a, b in RANGES)}) as t(period, lo, hi)) select name, period, count(ret) as n, round(product(1 + ret) - 1, 6) as total from r join p on date between lo and hi where ret is not null group by 1, 2")
def period_returns(spark, folder):
    named = F.filter(F.array(*[F.when(F.col("date").between(a, b), F.lit(n)) for n, a, b in RANGES]), lambda p: p.isNotNull())
    r = panel._index_returns(spark, folder).filter("ret is not null").withColumn("period", F.explode(named))
    return r.groupBy("name", "period").agg(F.count("ret").alias("n"), F.round(F.product(1 + F.col("ret")) - 1, 6).alias("total"))


@register(f"with {IR} select name, round(quantile_cont(ret, 0.05), 6) as p05, round(quantile_cont(ret, 0.25), 6) as p25, round(quantile_cont(ret, 0.5), 6) as p50, round(quantile_cont(ret, 0.75), 6) as p75, round(quantile_cont(ret, 0.95), 6) as p95, round(min(ret), 6) as worst, round(max(ret), 6) as best from r group by 1")
def return_distribution(spark, folder):
    r = panel._index_returns(spark, folder)
    return r.groupBy("name").agg(*[F.round(F.percentile("ret", F.lit(p / 100)), 6).alias(f"p{p:02d}") for p in (5, 25, 50, 75, 95)], F.round(F.min("ret"), 6).alias("worst"), F.round(F.max("ret"), 6).alias("best"))


@register(f"with {IR}, j as (select date, max(case when name = 'SMALLCOMP' then ret end) as y, max(case when name = 'MKTCOMP' then ret end) as x from r group by 1) select round(avg(case when x > 0 then y end) / avg(case when x > 0 then x end), 6) as up, round(avg(case when x < 0 then y end) / avg(case when x < 0 then x end), 6) as down, count_if(x > 0) as up_days, count_if(x < 0) as down_days from j where x is not null and y is not null")
def capture(spark, folder):
    r = panel._index_returns(spark, folder).filter("ret is not null").groupBy("date").pivot("name", ["SMALLCOMP", "MKTCOMP"]).agg(F.max("ret")).dropna()
    part = lambda c: F.avg(F.when(c, F.col("SMALLCOMP"))) / F.avg(F.when(c, F.col("MKTCOMP")))
    up, down = F.col("MKTCOMP") > 0, F.col("MKTCOMP") < 0
    return r.agg(F.round(part(up), 6).alias("up"), F.round(part(down), 6).alias("down"), F.count_if(up).alias("up_days"), F.count_if(down).alias("down_days"))


@register(
    f"""with {IR}, v as (select *, case when count(ret) over w >= 21 then stddev_samp(ret) over w end as vol from r window w as (partition by name order by date rows between 21 preceding and 1 preceding)),
t as (select *, quantile_cont(vol, 1/3::double) over (partition by name) as lo, quantile_cont(vol, 2/3::double) over (partition by name) as hi from v where vol is not null)
select name, case when vol <= lo then 'low' when vol <= hi then 'mid' else 'high' end as tercile, count(*) as n, round(avg(ret) * 252, 6) as mean from t group by 1, 2"""
)
def vol_terciles(spark, folder):
    w = sr.days().rowsBetween(-21, -1)
    v = panel._index_returns(spark, folder).withColumn("vol", sr.full(F.stddev_samp("ret").over(w), "ret", w, 21)).filter("vol is not null")
    name = Window.partitionBy("name")
    v = v.withColumns({"lo": F.percentile("vol", F.lit(1 / 3)).over(name), "hi": F.percentile("vol", F.lit(2 / 3)).over(name)})
    tercile = F.when(F.col("vol") <= F.col("lo"), "low").when(F.col("vol") <= F.col("hi"), "mid").otherwise("high")
    return v.groupBy("name", tercile.alias("tercile")).agg(F.count("*").alias("n"), F.round(F.avg("ret") * 252, 6).alias("mean"))


@register(f"with {IR} select name, year(date) * 100 + month(date) as month, round(product(1 + ret) - 1, 6) as total from r where ret is not null group by 1, 2")
def month_returns(spark, folder):
    r = panel._index_returns(spark, folder).filter("ret is not null")
    return r.groupBy("name", (F.year("date") * 100 + F.month("date")).cast("long").alias("month")).agg(F.round(F.product(1 + F.col("ret")) - 1, 6).alias("total"))


@register(f"with {IR}, y as (select unnest([2023, 2024, 2025]) as start_year) select name, start_year::bigint as start_year, round(pow(product(1 + ret), 252.0 / count(*)) - 1, 6) as annual from r join y on year(date) >= start_year where ret is not null group by 1, 2")
def start_years(spark, folder):
    r = panel._index_returns(spark, folder).filter("ret is not null")
    years = F.filter(F.array(*[F.lit(y).cast("long") for y in (2023, 2024, 2025)]), lambda y: y <= F.year("date"))
    r = r.withColumn("start_year", F.explode(years))
    return r.groupBy("name", "start_year").agg(F.round(F.pow(F.product(1 + F.col("ret")), 252.0 / F.count("*")) - 1, 6).alias("annual"))


@register(f"with {SPLITS}, a as (select b.ticker, b.date, coalesce(product(ratio), 1) as factor from b left join fac on fac.ticker = b.ticker and applied and first_print > b.date group by 1, 2), o as (select ticker, date, open from stocks_daily where ticker is not null and date is not null qualify row_number() over (partition by ticker, date order by loaded_at desc nulls last, bar_id desc) = 1) select ticker, date, round(open / factor + 1e-9, 6) as open_adj from a join o using (ticker, date)")
def open_adjust(spark, folder):
    from almagest.operators.rolling import latest_delivery

    adjusted = reports.split_adjust(*rp._split_inputs(spark, folder)).select("ticker", "date", "factor")
    bars = table(spark, folder, "stocks_daily").select("bar_id", "ticker", "date", "open", "loaded_at")
    opened = latest_delivery(bars, ["ticker", "date"], ["loaded_at", "bar_id"], ["open"])
    return adjusted.join(opened, ["ticker", "date"]).select("ticker", "date", F.round(F.col("open") / F.col("factor") + 1e-9, 6).alias("open_adj"))


OWN20 = f"""with {SPLITS}, n as (select *, row_number() over (partition by ticker order by date desc) as k from b), own as (select ticker, avg(close * volume) as adv20 from n where k <= 20 and isfinite(volume) group by 1)"""


def _own_adv(spark, folder):
    bars, _ = rp._split_inputs(spark, folder)
    last = bars.withColumn("k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))).filter("k <= 20")
    return last.filter(F.col("volume").isNotNull() & ~F.isnan("volume")).groupBy("ticker").agg(F.avg(F.col("close") * F.col("volume")).alias("adv20"))


@register(OWN20 + " select ticker, round(adv20 / 1e9, 6) as adv20_b, round(1/15::double, 6) as weight from own order by round(adv20 / 1e9, 6) desc, ticker limit 15")
def fallback_book(spark, folder):
    out = _own_adv(spark, folder).select("ticker", F.round(F.col("adv20") / 1e9, 6).alias("adv20_b"), F.lit(round(1 / 15, 6)).alias("weight"))
    return out.orderBy(F.desc("adv20_b"), "ticker").limit(15)


@register(OWN20 + f" select ticker, sector, round(adv20 / 1e9, 6) as adv20_b from own join (select ticker, case {rp._CASES} else 'other' end as sector from reference_tickers) using (ticker) where adv20 >= 1e7 and sector like '%financ%' order by round(adv20 / 1e9, 6) desc, ticker limit 50")
def screen_sector(spark, folder):
    named = table(spark, folder, "reference_tickers").select("ticker", reports.sector(F.col("sic_code")).alias("sector")).filter(F.col("sector").contains("financ"))
    out = _own_adv(spark, folder).filter("adv20 >= 1e7").join(named, "ticker").select("ticker", "sector", F.round(F.col("adv20") / 1e9, 6).alias("adv20_b"))
    return out.orderBy(F.desc("adv20_b"), "ticker").limit(50)


@register("select r_name, n_name, count(*) as suppliers, round(sum(s_acctbal::decimal(18,2))::double, 2) as balance from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup(r_name, n_name)")
def supplier_rollup(spark, folder):
    s = table(spark, folder, "supplier").join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return s.rollup("r_name", "n_name").agg(F.count("*").alias("suppliers"), F.round(F.sum(F.col("s_acctbal").cast("decimal(18,2)")).cast("double"), 2).alias("balance"))


@register(
    f"""with {RETS}, {panel.GROUPS}, gm as (select date, grp, avg(ret) as gret from rets join grp using (ticker) where ret is not null group by 1, 2),
c as (select r.ticker, g.grp, count(*) as n, case when count(*) >= 60 then corr(ret, gret) end as corr from rets r join gm g using (date) where ret is not null group by 1, 2)
select ticker, grp, n, round(corr, 6) as corr from c where corr is not null qualify row_number() over (partition by ticker order by round(corr, 9) desc, grp) = 1"""
)
def assign_leftovers(spark, folder):
    """The group whose mean return a ticker follows most; five groups, so dates times five per ticker at most."""
    r = fx.with_returns(panel._bars(spark, folder)).filter("ret is not null").select("ticker", "date", "ret")
    means = r.join(panel._groups(spark, folder), "ticker").groupBy("date", "grp").agg(F.avg("ret").alias("gret"))
    c = r.join(means, "date").groupBy("ticker", "grp").agg(F.count("*").alias("n"), F.corr("ret", "gret").alias("corr")).filter("n >= 60 and corr is not null")
    best = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc(F.round("corr", 9)), "grp"))
    return c.withColumn("k", best).filter("k = 1").select("ticker", "grp", "n", F.round("corr", 6).alias("corr"))


FIELDS = ("momentum", "low_risk", "low_beta", "size")


@register(
    f"""with {FORWARD}, f as (select l.ticker, l.date, low_risk, low_beta, size, i.momentum, fwd from liq l join ic i using (ticker, date)),
u as (unpivot f on {', '.join(FIELDS)} into name factor value v),
rk as (select date, factor, {panel.average_rank_sql("v", "date, factor")} as a, {panel.average_rank_sql("fwd", "date, factor")} as b from u where v is not null),
d as (select date, factor, corr(a, b) as ic from rk group by 1, 2 having count(*) >= 20)
select factor, count(ic) as dates, round(avg(ic), 6) as ic, round(avg((ic > 1e-9)::int), 6) as hit from d group by 1"""
)
def factor_ic(spark, folder):
    u = panel._forward(spark, folder).unpivot(["ticker", "date", "fwd"], list(FIELDS), "factor", "v").filter("v is not null")
    rk = u.select("date", "factor", panel.average_rank("v", "date", "factor").alias("a"), panel.average_rank("fwd", "date", "factor").alias("b"))
    ic = rk.groupBy("date", "factor").agg(F.count("*").alias("n"), F.corr("a", "b").alias("ic")).filter("n >= 20")
    return ic.groupBy("factor").agg(F.count("ic").alias("dates"), F.round(F.avg("ic"), 6).alias("ic"), F.round(F.avg((F.col("ic") > 1e-9).cast("double")), 6).alias("hit"))


@register()
def hmm_fit(spark, folder):
    """Two-state model of each index by expectation maximisation, for each year fitted on the days before it begins."""

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part[part["year"] < part["fit_year"]].sort_values("date")
        if len(part) < rp.LEAST_HISTORY:
            return pd.DataFrame({"name": [], "fit_year": [], "calm_sd": [], "stress_sd": [], "stay_calm": [], "stay_stress": []}, dtype=object)
        p = models.fit_two_states(part["ret"].to_numpy() * 100)
        row = {"name": part["name"].iloc[0], "fit_year": part["fit_year"].iloc[0], "calm_sd": p["sd"][0], "stress_sd": p["sd"][1], "stay_calm": p["move"][0, 0], "stay_stress": p["move"][1, 1]}
        return pd.DataFrame([row]).round(6)

    return rp._upto_year(spark, folder).groupBy("name", "fit_year").applyInPandas(fit, "name string, fit_year int, calm_sd double, stress_sd double, stay_calm double, stay_stress double")


@register()
def monte_carlo(spark, folder):
    """Compounded returns of 21 days drawn in blocks of mean length 5 from each index: 20,000 paths over tasks."""
    series = panel._index_returns(spark, folder).filter("ret is not null").groupBy("name").agg(F.sort_array(F.collect_list(F.struct("date", "ret"))).alias("s")).select("name", F.col("s.ret").alias("r"))
    runs = series.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(199)))).repartition("name", "run")

    def draw(batches):
        for batch in batches:
            for name, r, run in zip(batch["name"], batch["r"], batch["run"]):
                r, rng = np.asarray(r), np.random.default_rng(int(run))
                jump = rng.random((100, 21)) < 0.2
                jump[:, 0] = True
                begin = np.maximum.accumulate(np.where(jump, np.arange(21), 0), axis=1)
                start = np.take_along_axis(rng.integers(0, len(r), (100, 21)), begin, axis=1)
                yield pd.DataFrame({"name": name, "total": np.prod(1 + r[(start + np.arange(21) - begin) % len(r)], axis=1) - 1})

    out = runs.mapInPandas(draw, "name string, total double").groupBy("name")
    return out.agg(F.count("*").alias("paths"), *[F.round(F.percentile("total", F.lit(p / 100)), 6).alias(f"p{p:02d}") for p in (5, 50, 95)], F.round(F.avg((F.col("total") < 0).cast("double")), 6).alias("loss"))


@register()
def joint_monte_carlo(spark, folder):
    """Compounded returns of the pair over 21 days, drawn together in blocks of mean length 5: 20,000 paths over tasks."""
    runs = rp._pair(spark, folder).withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(199)))).repartition("run")

    def draw(batches):
        for batch in batches:
            for a, b, run in zip(batch["a"], batch["b"], batch["run"]):
                a, b, rng = np.asarray(a), np.asarray(b), np.random.default_rng(int(run))
                jump = rng.random((100, 21)) < 0.2
                jump[:, 0] = True
                begin = np.maximum.accumulate(np.where(jump, np.arange(21), 0), axis=1)
                start = np.take_along_axis(rng.integers(0, len(a), (100, 21)), begin, axis=1)
                at = (start + np.arange(21) - begin) % len(a)
                yield pd.DataFrame({"own": np.prod(1 + a[at], axis=1) - 1, "index": np.prod(1 + b[at], axis=1) - 1})

    out = runs.mapInPandas(draw, "own double, index double")
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    own, ahead = F.col("own"), F.col("own") - F.col("index")
    return out.agg(
        F.count("*").alias("paths"), *[F.round(F.percentile("own", F.lit(p / 100)), 6).alias(f"p{p:02d}") for p in (5, 50, 95)],
        share(own < 0).alias("loss"), share(own > F.col("index")).alias("beats"), share(own < -0.05).alias("loss_over_5"), share(ahead < -0.03).alias("trails_by_3"),
    )


@register()
def beta_capped(spark, folder):
    """Unheld books of all dates with high-beta names swapped until the book's beta is at most 1.05."""
    rank = F.row_number().over(Window.partitionBy("date").orderBy(F.desc(F.round("score", 9)), "ticker"))
    ranked = panel._scored(spark, folder).withColumn("rnk", rank).select("date", "ticker", "grp", "rnk", "beta")
    pool, quota = 30, 4  # as in the selection and the swaps below

    def swap(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("rnk").reset_index(drop=True)
        rank, group, beta = part["rnk"].to_numpy(), part["grp"].astype(object).to_numpy(), part["beta"].to_numpy(float)
        book = books.select_banded(dict(zip(part.index, rank)), books.groups_of(part.assign(ticker=part.index)), [], quota=quota)
        equal = lambda picks: np.full(len(picks), 1 / max(1, len(picks)))
        picks = models.beta_limited(book, rank, group, beta, equal, limit=1.05, pool=pool, quota=quota)
        return pd.DataFrame({"date": part["date"].iloc[0], "ticker": part["ticker"].to_numpy()[picks], "beta": np.nan_to_num(beta[picks], nan=1.0)})

    out = books.within_reach(ranked, pool, quota).groupBy("date").applyInPandas(swap, "date date, ticker long, beta double")
    return rounded(out, "beta")


@register()
def consensus_clusters(spark, folder):
    """Groups of suppliers whose weekly returns go together, per fit year: three windows, twenty seeds, then linkage.

    Suppliers trade in about two of three pairs of successive weeks, hence the coverage; the rest are leftovers.
    """
    r = fx.with_returns(panel._bars(spark, folder)).select("ticker", "date", "day_idx", "ret")
    return clusters.consensus(r, k=5, seeds=20, windows=[100, 200, 350], components=4, coverage=0.6, least=15, min_days=60)


@register(
    """with l as (select vec_id as ticker, 0 as run, label from embeddings union all select vec_id, 1, vec_id % 7 from embeddings)
select x.ticker as a, y.ticker as b, count(*) as together, 2::bigint as both from l x join l y on x.run = y.run and x.label = y.label and x.ticker < y.ticker group by 1, 2"""
)
def coassign(spark, folder):
    """In how many of two groupings each pair of vectors is together; pairs that never are have no row."""
    runs = F.array(F.struct(F.lit(0).alias("run"), F.col("label").cast("long").alias("label")), F.struct(F.lit(1).alias("run"), (F.col("vec_id") % 7).alias("label")))
    labels = table(spark, folder, "embeddings").select(F.col("vec_id").alias("ticker"), F.inline(runs))
    return clusters.coassign(labels, []).filter("a < b")


# --- decisions and scenarios

SCEN = FORWARD + panel._z_sql().replace("from liq)", "from liq)", 1)
_DROPS = [("base", None), *[(f"without {f}", f) for f in panel.FACTORS]]


def _scenario_sql() -> str:
    one = lambda drop: " + ".join(f"coalesce(z_{f}, 0) * {0.0 if f == drop else w}::double" for f, w in panel.FACTORS.items())
    parts = " union all ".join(f"select '{n}' as scenario, ticker, date, grp, ({one(drop)}) as s from zs" for n, drop in _DROPS)
    return f"""with {SCEN}, x as ({parts}),
a as (select *, row_number() over (partition by scenario, date, grp order by round(s, 9) desc, ticker) as gr from x),
b as (select * from (select *, row_number() over (partition by scenario, date order by round(s, 9) desc, ticker) as rk from a where gr <= 4) where rk <= 15)
select scenario, count(*) as holdings, count(fwd) as known, round(avg(fwd), 6) as fwd from b left join ic using (ticker, date) group by 1"""


@register(_scenario_sql())
def drop_one_scenarios(spark, folder):
    """Unheld books with each factor left out in turn: scenarios are rows, so all run in one pass."""
    z = panel._scored(spark, folder, panel._bars_ahead(spark, folder))
    score = lambda drop: sum((F.coalesce(F.col(f"z_{f}"), F.lit(0.0)) * (0.0 if f == drop else w) for f, w in panel.FACTORS.items()), F.lit(0.0))
    rows = z.select("ticker", "date", "grp", "fwd", F.inline(F.array(*[F.struct(F.lit(n).alias("scenario"), F.round(score(drop), 9).alias("s")) for n, drop in _DROPS])))
    own, all_ = Window.partitionBy("scenario", "date", "grp"), Window.partitionBy("scenario", "date")
    best = (F.desc("s"), "ticker")
    book = rows.withColumn("gr", F.row_number().over(own.orderBy(*best))).filter("gr <= 4").withColumn("rk", F.row_number().over(all_.orderBy(*best))).filter("rk <= 15")
    return book.groupBy("scenario").agg(F.count("*").alias("holdings"), F.count("fwd").alias("known"), F.round(F.avg("fwd"), 6).alias("fwd"))


@register(
    f"""with {FORWARD}, s as (select unnest([0, 1, 2, 3, 4]) as seed),
x as (select seed, ticker, date, row_number() over (partition by seed, date order by md5(seed::varchar || '-' || ticker::varchar)) as rk from liq cross join s)
select seed, count(*) as holdings, round(avg(fwd), 6) as fwd from x left join ic using (ticker, date) where rk <= 15 group by 1"""
)
def random_books(spark, folder):
    """Books of names by a hash of seed and ticker, so a name keeps its place from date to date."""
    seeds = F.explode(F.array(*[F.lit(k) for k in range(5)]))
    rows = panel._liquid(spark, folder, panel._bars_ahead(spark, folder)).select("ticker", "date", "fwd", seeds.alias("seed"))
    key = F.md5(F.concat_ws("-", F.col("seed").cast("string"), F.col("ticker").cast("string")))
    rows = rows.withColumn("rk", F.row_number().over(Window.partitionBy("seed", "date").orderBy(key))).filter("rk <= 15")
    return rows.groupBy("seed").agg(F.count("*").alias("holdings"), F.round(F.avg("fwd"), 6).alias("fwd"))


@register(
    f"""with {panel.WEIGHTED}, c as (select date, lead(date) over (order by date) as nx from cal), top as (select date, arg_min(ticker, rnk) as best, count(*) as holdings, sum(weight) as invested from weighted group by 1)
select top.date as decided_on, c.nx as execution_date, best, holdings, round(invested, 6) as invested from top join c using (date)"""
)
def decisions(spark, folder):
    """One record per decision date: the day it executes, its best name, the number of holdings and what is invested."""
    bars = panel._bars(spark, folder)
    days = fx.calendar(bars).withColumn("execution_date", F.lead("date").over(Window.orderBy("date")))  # a row per date
    book = panel._weighted(spark, folder).groupBy("date").agg(F.min_by("ticker", "rnk").alias("best"), F.count("*").alias("holdings"), F.round(F.sum("weight"), 6).alias("invested"))
    return book.join(F.broadcast(days), "date").select(F.col("date").alias("decided_on"), "execution_date", "best", "holdings", "invested")


FILL = SPLITS + """, o as (select ticker, date, open from stocks_daily where ticker is not null and date is not null qualify row_number() over (partition by ticker, date order by loaded_at desc nulls last, bar_id desc) = 1),
x as (select p.ticker, p.date, o.open / p.prev - 1 as overnight, p.close / o.open - 1 as intraday from p join o using (ticker, date) where o.open > 0 and isfinite(o.open))"""


@register(f"with {FILL} select ticker, count(overnight) as n, round(median(overnight), 6) as overnight, round(median(intraday), 6) as intraday from x group by 1")
def open_fills(spark, folder):
    """Per ticker the median return overnight, earned by the old book, and from open to close, earned by the new one."""
    from almagest.operators.rolling import finite, latest_delivery

    bars = table(spark, folder, "stocks_daily").select("bar_id", "ticker", "date", "open", "close", "loaded_at")
    bars = latest_delivery(bars, ["ticker", "date"], ["loaded_at", "bar_id"], ["open", "close"])
    bars = bars.withColumns({"close": finite(F.col("close")), "open": finite(F.col("open"))}).filter("close > 0")
    x = bars.withColumn("overnight", F.col("open") / F.lag("close").over(Window.partitionBy("ticker").orderBy("date")) - 1).filter("open > 0")
    return x.groupBy("ticker").agg(F.count("overnight").alias("n"), F.round(F.percentile("overnight", F.lit(0.5)), 6).alias("overnight"), F.round(F.percentile(F.col("close") / F.col("open") - 1, F.lit(0.5)), 6).alias("intraday"))


@register(
    f"""with {rp.DRIFT}, l as (select * from gr qualify row_number() over (partition by start_idx, ticker order by day_idx desc) = 1),
c as (select ticker, sum(weight * (growth - 1)) as v from l group by 1), r as (select *, row_number() over (order by round(v, 9) desc, ticker) as k from c)
select round(sum(v), 6) as total, round(sum(case when k > 3 then v end), 6) as without_best, count(*) as names from r"""
)
def without_best(spark, folder):
    """What the books earned in all, and without the three names that contributed most."""
    last = rp._drift(spark, folder).groupBy("ticker", "start_idx").agg(F.max(F.struct("day_idx", "weight", "growth")).alias("g"))
    c = last.groupBy("ticker").agg(F.sum(F.col("g.weight") * (F.col("g.growth") - 1)).alias("v"))
    best = c.orderBy(F.desc(F.round("v", 9)), "ticker").limit(3).select("ticker", F.lit(True).alias("best"))
    both = c.join(F.broadcast(best), "ticker", "left")  # three rows
    return both.agg(F.round(F.sum("v"), 6).alias("total"), F.round(F.sum(F.when(F.col("best").isNull(), F.col("v"))), 6).alias("without_best"), F.count("*").alias("names"))


@register(f"with {rp.REPORTS} select count(*) as periods, count(filed) as filed, round(quantile_cont(knowable - pe, 0.5), 6) as p50, round(quantile_cont(knowable - pe, 0.95), 6) as p95, round(avg((filed is null)::int), 6) as by_default from known")
def report_lags(spark, folder):
    """How long after its end a period became known, and the share that did so by default only."""
    k = rp._known(spark, folder).withColumn("lag", F.datediff("knowable", "pe"))
    return k.agg(F.count("*").alias("periods"), F.count("filed").alias("filed"), F.round(F.percentile("lag", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("lag", F.lit(0.95)), 6).alias("p95"), F.round(F.avg(F.col("filed").isNull().cast("double")), 6).alias("by_default"))


@register(
    """with d as (select distinct date, date_trunc('week', date)::date as week from index_daily), s as (select date from d qualify row_number() over (partition by week order by date desc) = 1)
select date, count(*) as rows_there, count(distinct ticker) as tickers from stocks_daily where date in (select date from s) group by 1"""
)
def signal_day_rows(spark, folder):
    """Rows of signal days only: a semi join on the last day of each week."""
    dates = sr.last_of_week(panel._index(spark, folder)).select("date").distinct()
    rows = table(spark, folder, "stocks_daily").select("ticker", "date").join(dates, "date", "left_semi")
    return rows.groupBy("date").agg(F.count("*").alias("rows_there"), F.countDistinct("ticker").alias("tickers"))
