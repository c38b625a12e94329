"""Studies of factors, books, regimes, reports and groups, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from almagest.operators import features as fx
from almagest.operators import reports
from almagest.operators import series as sr
from almagest.operators.calendar import days_to_next
from almagest.plans import diagnostics, panel
from almagest.plans import reports as rp
from almagest.plans.panel import FEAT, IDX, LIQ, RETS, WEIGHTED, register, rounded
from almagest.session import checkpoint
from almagest.sources.tables import table

# --- factors


@register(
    f"""with {diagnostics.BUCKETS}, b2 as (select *, greatest(1, ceil(10.0::double * (rn - 1) / (n - 1) - 1e-9))::int as decile from n where n >= 50),
p as (select factor, date, corr(a, b) as ic, avg(case when decile = 10 then fwd end) - avg(case when decile = 1 then fwd end) as spread from b2 group by 1, 2)
select factor, count(*) as dates, round(avg(ic), 6) as ic, round(avg(ic) / nullif(stddev_samp(ic), 0) * sqrt(count(*)), 6) as ic_t, round(avg(spread), 6) as decile_spread from p group by 1"""
)
def feature_screen(spark, folder):
    """Every number column of the panel against the return ahead: mean rank correlation, its t, and the outer deciles' gap."""
    u = panel._forward_all(spark, folder).unpivot(["ticker", "date", "fwd"], list(diagnostics.FIELDS), "factor", "v").filter("v is not null")
    d = Window.partitionBy("factor", "date")
    u = u.withColumns({"rn": F.row_number().over(d.orderBy("v", "ticker")), "n": F.count("*").over(d), "a": panel.average_rank("v", "factor", "date"), "b": panel.average_rank("fwd", "factor", "date")}).filter("n >= 50")
    u = u.withColumn("decile", F.greatest(F.lit(1), F.ceil(10.0 * (F.col("rn") - 1) / (F.col("n") - 1) - 1e-9).cast("int")))
    p = u.groupBy("factor", "date").agg(F.corr("a", "b").alias("ic"), (F.avg(F.when(F.col("decile") == 10, F.col("fwd"))) - F.avg(F.when(F.col("decile") == 1, F.col("fwd")))).alias("spread"))
    t = F.avg("ic") / F.nullif(F.stddev_samp("ic"), F.lit(0.0)) * F.sqrt(F.count("*"))
    return rounded(p.groupBy("factor").agg(F.count("*").alias("dates"), F.avg("ic").alias("ic"), t.alias("ic_t"), F.avg("spread").alias("decile_spread")), "ic", "ic_t", "decile_spread")


@register(
    f"""with {panel.FORWARD}{panel._z_sql().replace('from liq)', 'from liq)', 1)}, z as (select ticker, date, {', '.join(f'z_{f}' for f in panel.FACTORS)}, score as z_composite from sc),
u as (unpivot z on {', '.join(f'z_{f}' for f in panel.FACTORS)}, z_composite into name factor value v), j as (select u.*, i.fwd from u join ic i using (ticker, date) where v is not null),
r as (select *, {panel.average_rank_sql('round(v, 9)', 'factor, date')} as a, {panel.average_rank_sql('fwd', 'factor, date')} as b, row_number() over (partition by factor, date order by round(v, 9), ticker) as rn, count(*) over (partition by factor, date) as n from j),
q as (select *, greatest(1, ceil(5.0::double * (rn - 1) / (n - 1) - 1e-9))::int as q from r where n >= 20),
d as (select factor, date, corr(a, b) as ic, avg(case when q = 5 then fwd end) - avg(case when q = 1 then fwd end) as spread from q group by 1, 2)
select factor, count(*) as dates, round(avg(ic), 6) as mean_ic, round(avg((round(ic, 9) > 0)::int), 6) as hit_rate, round(avg(spread) * 52, 6) as q5_q1_ann from d group by 1"""
)
def ic_test(spark, folder):
    """Rank correlation and outer quintiles of each factor's z-score and of the composite among liquid names."""
    z = [f"z_{f}" for f in panel.FACTORS]
    scored = panel._scored(spark, folder, panel._bars_ahead(spark, folder)).select("ticker", "date", "fwd", *z, F.col("score").alias("z_composite"))
    u = scored.filter("fwd is not null").unpivot(["ticker", "date", "fwd"], [*z, "z_composite"], "factor", "v").filter("v is not null").withColumn("v", F.round("v", 9))
    d = Window.partitionBy("factor", "date")
    u = u.withColumns({"a": panel.average_rank("v", "factor", "date"), "b": panel.average_rank("fwd", "factor", "date"), "rn": F.row_number().over(d.orderBy("v", "ticker")), "n": F.count("*").over(d)}).filter("n >= 20")
    u = u.withColumn("q", F.greatest(F.lit(1), F.ceil(5.0 * (F.col("rn") - 1) / (F.col("n") - 1) - 1e-9).cast("int")))
    p = u.groupBy("factor", "date").agg(F.corr("a", "b").alias("ic"), (F.avg(F.when(F.col("q") == 5, F.col("fwd"))) - F.avg(F.when(F.col("q") == 1, F.col("fwd")))).alias("spread"))
    out = p.groupBy("factor").agg(F.count("*").alias("dates"), F.avg("ic").alias("mean_ic"), F.avg((F.round("ic", 9) > 0).cast("double")).alias("hit_rate"), (F.avg("spread") * 52).alias("q5_q1_ann"))
    return rounded(out, "mean_ic", "hit_rate", "q5_q1_ann")


@register(
    f"""with {FEAT}, m as (select date, avg(ret) as given from rets where ticker % 3 = 0 group by 1),
j as (select f.ticker, f.date, f.day_idx, f.ret, m.given, f.mkt from feat f join m using (date)),
w as (select *, count(given) over y as n, count(*) over y as days from (select distinct date, day_idx, given, mkt from j) window y as (order by day_idx range between 252 preceding and current row)),
k as (select date, case when n::double / days > 0.9 then coalesce(given, 0) else mkt end as used, n::double / days > 0.9 as has from w)
select date, has as given_used, round(used, 6) as market from k"""
)
def market_given(spark, folder):
    """The market that betas are taken against: one that is given (here the mean of every third name) where it covers more
    than nine tenths of the year's bars, else the mean of all."""
    r = fx.with_returns(panel._bars(spark, folder))
    daily = r.groupBy("date", "day_idx").agg(F.avg("ret").alias("mkt"), F.avg(F.when(F.col("ticker") % 3 == 0, F.col("ret"))).alias("given"))
    return rounded(fx.market_or_given(daily, "given").select("date", "given_used", "market"), "market")


@register(
    f"""with {FEAT} select ticker, date, round(-ln((mk.rv / sqrt(52.0::double)) / nullif(rv21 / sqrt(252.0::double), 0)), 6) as premium from feat join (select date, stddev_samp(mkt) over (order by day_idx range between 20 preceding and current row) * sqrt(52.0::double) as rv from (select distinct date, day_idx, mkt from fw)) mk using (date) where rv21 > 0 and mk.rv > 0"""
)
def vol_premium(spark, folder):
    """Minus the log of expected over realised volatility; the market's own stands for what options expect."""
    feat = panel._features(spark, folder)
    w = Window.orderBy("day_idx").rangeBetween(-20, 0)  # a row per date
    implied = feat.groupBy("date", "day_idx").agg(F.max("mkt").alias("mkt")).select("date", F.stddev_samp("mkt").over(w).alias("rv"))
    df = feat.join(F.broadcast(implied), "date").filter("rv21 > 0 and rv > 0")
    return rounded(df.select("ticker", "date", (-F.log(F.col("rv") / (F.col("rv21") / 252**0.5))).alias("premium")), "premium")


# --- books


@register(f"with {WEIGHTED}, g as (select date, grp, sum(weight) as w from weighted group by 1, 2) select date, round(max(w), 6) as largest, count(*) as groups from g group by 1")
def largest_group(spark, folder):
    """The largest share of a group on each date, and how many groups are held."""
    g = panel._weighted(spark, folder).groupBy("date", "grp").agg(F.sum("weight").alias("w"))
    return rounded(g.groupBy("date").agg(F.max("w").alias("largest"), F.count("*").alias("groups")), "largest")


@register(f"with {WEIGHTED} select ticker, date, round(weight, 6) as weight, round(0.01 * adv20 / 1e5, 6) as most, weight > 0.01 * adv20 / 1e5 as too_much from weighted")
def adv_caps(spark, folder):
    """The most of a book of 100,000 that a name may be at a hundredth of its dollar volume, and whether its weight is above."""
    most = 0.01 * F.col("adv20") / F.lit(1e5)
    return rounded(panel._weighted(spark, folder).select("ticker", "date", "weight", most.alias("most"), (F.col("weight") > most).alias("too_much")), "weight", "most")


@register(
    f"""with {WEIGHTED}, nm as (select s_suppkey as ticker, s_name, n_name, r_name from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey),
l as (select * from weighted where date = (select max(date) from weighted))
select rnk, l.ticker, s_name, n_name, r_name, round(weight, 6) as weight, round(beta, 6) as beta, round(score, 6) as score, round(sum(weight) over (partition by r_name), 6) as group_weight from l left join nm using (ticker)"""
)
def holdings_review(spark, folder):
    """The last book with what is known of its names."""
    weighted = panel._weighted(spark, folder).select("date", "ticker", "rnk", "weight", "beta", "score")
    last = weighted.groupBy("date").agg(F.collect_list(F.struct(*[c for c in weighted.columns if c != "date"])).alias("b")).agg(F.max_by("b", "date").alias("b")).select(F.inline("b"))
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    names = table(spark, folder, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))
    df = last.join(names.select(F.col("s_suppkey").alias("ticker"), "s_name", "n_name", "r_name"), "ticker", "left")
    df = df.withColumn("group_weight", F.sum("weight").over(Window.partitionBy("r_name")))
    return rounded(df.select(F.col("rnk").cast("long").alias("rnk"), "ticker", "s_name", "n_name", "r_name", "weight", "beta", "score", "group_weight"), "weight", "beta", "score", "group_weight")


@register(
    f"""with {WEIGHTED}, m as (select max(date) as date from weighted group by date_trunc('month', date)), w as (select date, ticker from weighted semi join m using (date)),
n as (select date, lead(date) over (order by date) as nx from m), p as (select w.ticker, n.nx as date from w join n using (date) where nx is not null)
select 'stays' as what, date, ticker from (select date, ticker from w intersect select date, ticker from p) union all select 'enters', date, ticker from (select date, ticker from w except select date, ticker from p) union all select 'leaves', date, ticker from (select date, ticker from p except select date, ticker from w)"""
)
def book_changes(spark, folder):
    """Names that stay, enter and leave between the books of successive month ends."""
    w = panel.weighted_of(panel._kept_scores(spark, folder)).select("date", "ticker")
    m = w.select("date").distinct().groupBy(F.date_trunc("month", "date").alias("m")).agg(F.max("date").alias("date")).select("date", F.lead("date").over(Window.orderBy("date")).alias("next"))  # a row per month
    w = w.join(F.broadcast(m), "date")
    now, before = w.select("date", "ticker"), w.filter("next is not null").select(F.col("next").alias("date"), "ticker")
    parts = (("stays", now.intersect(before)), ("enters", now.exceptAll(before)), ("leaves", before.exceptAll(now)))
    out = [df.select(F.lit(name).alias("what"), "date", "ticker") for name, df in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@register(
    f"""with {LIQ}, s as (select * from liq where ('0x' || substr(md5('7-' || ticker::varchar), 1, 4))::int < 0.7 * 65536),
b as (select date, ticker, row_number() over (partition by date order by momentum desc, ticker) as rnk from s)
select date, count(*) as names, min(case when rnk = 15 then ticker end) as fifteenth from b group by 1"""
)
def part_universe(spark, folder):
    """Liquid names of a universe of seven tenths of all, drawn by a hash so that a name is always in or out (a sampling study)."""
    keep = F.conv(F.substring(F.md5(F.concat(F.lit("7-"), F.col("ticker").cast("string"))), 1, 4), 16, 10).cast("int") < 0.7 * 65536
    df = panel._liquid(spark, folder).filter(keep).withColumn("rnk", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("momentum"), "ticker")))
    return df.groupBy("date").agg(F.count("*").alias("names"), F.min(F.when(F.col("rnk") == 15, F.col("ticker"))).alias("fifteenth"))


@register(f"with {LIQ} select ticker, grp, round(adv20 / 1e6, 6) as adv20_m, row_number() over (order by round(adv20 / 1e6, 6) desc, ticker) as rnk from liq where date = (select max(date) from liq)")
def eligible_last(spark, folder):
    """The names that pass all tests of liquidity on the last date, by dollar volume."""
    liquid = panel._liquid(spark, folder).select("date", "ticker", "grp", F.round(F.col("adv20") / 1e6, 6).alias("adv20_m"))
    liquid = checkpoint(liquid)  # used twice
    newest = liquid.agg(F.max("date").alias("date"))  # one row
    last = liquid.join(F.broadcast(newest), "date", "left_semi")
    return last.select("ticker", "grp", "adv20_m", F.row_number().over(Window.orderBy(F.desc("adv20_m"), "ticker")).cast("long").alias("rnk"))


STATE = f"""{WEIGHTED}, {rp.REPORTS.removeprefix('with ')},
sv as (select b.ticker, b.date, k.filed - b.date as days from (select ticker, date from bars semi join (select distinct date from weighted) using (date)) b asof left join (select ticker, filed from known where filed is not null) k on k.ticker = b.ticker and k.filed >= b.date)"""


@register(
    f"""with {STATE}, n as (select w.ticker, w.date, sv.days, coalesce(sv.days between 0 and 30, false) as near from weighted w left join sv on sv.ticker = w.ticker and sv.date = w.date),
c as (select *, case when near then 0.06::double else 0.1::double end as cap, count(*) over d as n, count_if(near) over d as k from n window d as (partition by date)),
r as (select *, sum(cap) over (partition by date) as room from c)
select ticker, date, days as days_to_report, near, round(case when room < 1 then cap / room when 1.0::double / n <= 0.06 or k = 0 then 1.0::double / n when near then 0.06::double else (1 - 0.06::double * k) / (n - k) end, 6) as weight from r"""
)
def weights_near_reports(spark, folder):
    """Books with the days to each name's next report, read for book dates only, and weights under caps by these days."""
    kept = panel._kept_bars(spark, folder)
    book = checkpoint(panel.book_of(panel._scored(spark, folder, kept)).select("ticker", "date"))  # used twice
    dates = book.select("date").distinct()
    rows = kept.select("ticker", "date").join(F.broadcast(dates), "date", "left_semi")  # a row per date
    state = days_to_next(rows, rp._known(spark, folder).select("ticker", "filed"), "ticker", "date", "filed", "days_to_report")
    held = book.join(state, ["ticker", "date"], "left").withColumn("near", F.coalesce(F.col("days_to_report").between(0, 30), F.lit(False)))
    return rounded(fx.capped_weights(held, F.col("near")).select("ticker", "date", F.col("days_to_report").cast("long").alias("days_to_report"), "near", "weight"), "weight")


# --- regimes


@register(
    f"""with {IDX}, w as (select name, date, max(stress_raw::int) over (partition by name order by date rows between 1 preceding and current row) = 1 as stress from weekly),
d as (select f.name, f.date, f.ret, coalesce(w.stress, false) as stress from flags f asof left join w on w.name = f.name and w.date < f.date)
select name, stress, count(*) as days, round(avg(ret) * 252, 6) as mean_ann, round(stddev_samp(ret) * sqrt(252.0::double), 6) as vol_ann from d where ret is not null group by 1, 2"""
)
def flag_means(spark, folder):
    """Return and volatility of the days after a check that is on, and of those after one that is off."""
    flags = sr.conditions(panel._index(spark, folder))
    weekly = sr.held_on(sr.last_of_week(flags), "stress_raw", "stress").select("name", "date", "stress")
    last = F.last("stress", ignorenulls=True).over(sr.days().rowsBetween(Window.unboundedPreceding, -1))
    d = flags.select("name", "date", "ret").join(weekly, ["name", "date"], "left").withColumn("stress", F.coalesce(last, F.lit(False))).filter("ret is not null")
    out = d.groupBy("name", "stress").agg(F.count("*").alias("days"), (F.avg("ret") * 252).alias("mean_ann"), (F.stddev_samp("ret") * F.sqrt(F.lit(252.0))).alias("vol_ann"))
    return rounded(out, "mean_ann", "vol_ann")


@register(
    f"""with {IDX}, fw as (select case name when 'MKTCOMP' then 'SMALLCOMP' else 'MKTCOMP' end as name, date, abs(ret) as funding from weekly),
ff as (select f.*, w.funding from flags f asof left join fw w on w.name = f.name and w.date <= f.date),
fp as (select x.name, x.date, count(y.funding) as seen, count_if(y.funding <= x.funding) as atmost from ff x join ff y on y.name = x.name and y.day_no <= x.day_no and y.funding is not null where x.funding is not null group by 1, 2)
select ff.name, ff.date, round(funding, 6) as funding, round(case when fp.seen >= 252 then fp.atmost::double / fp.seen end, 6) as funding_pct, coalesce(below_ma, false) and (coalesce(vol_pct > 0.8, false) or coalesce(fp.seen >= 252 and fp.atmost::double / fp.seen > 0.8, false)) as stress_raw from ff left join fp on fp.name = ff.name and fp.date = ff.date"""
)
def funding_conditions(spark, folder):
    """Stress with a second gauge beside volatility, known once a week and carried forward: here the other index's last move."""
    weekly = sr.last_of_week(panel._index_returns(spark, folder))
    other = F.when(F.col("name") == "MKTCOMP", "SMALLCOMP").otherwise("MKTCOMP")
    gauge = weekly.select(other.alias("name"), "date", F.abs("ret").alias("funding"))
    return rounded(sr.conditions(panel._index(spark, folder), funding=gauge).select("name", "date", "funding", "funding_pct", "stress_raw"), "funding", "funding_pct")


EPISODES = [("spring 2024", "2024-03-01", "2024-05-31"), ("fall 2024", "2024-09-01", "2024-11-30"), ("2025", "2025-01-01", "2025-12-31")]


@register(
    f"""with {IDX}, e as (select * from (values {', '.join(f"('{n}', date '{a}', date '{b}')" for n, a, b in EPISODES)}) as t(episode, lo, hi))
select name, episode, count(*) as checks, min(case when vol_pct > 0.8 then date end) as first_flagged, round(avg(coalesce(vol_pct > 0.8, false)::int), 6) as share_flagged from weekly join e on date between lo and hi group by 1, 2"""
)
def episode_timing(spark, folder):
    """In each episode the first week whose volatility is high, and the share of such weeks."""
    named = F.filter(F.array(*[F.when(F.col("date").between(a, b), F.lit(n)) for n, a, b in EPISODES]), lambda e: e.isNotNull())
    weekly = sr.last_of_week(sr.conditions(panel._index(spark, folder))).withColumn("episode", F.explode(named))
    high = F.coalesce(F.col("vol_pct") > 0.8, F.lit(False))
    return rounded(weekly.groupBy("name", "episode").agg(F.count("*").alias("checks"), F.min(F.when(high, F.col("date"))).alias("first_flagged"), F.avg(high.cast("double")).alias("share_flagged")), "share_flagged")


@register(
    f"""with {panel.CAPM}, r21 as (select date, case when count(*) over w = 21 then product(1 + y) over w - 1 end as own, case when count(*) over w = 21 then product(1 + x) over w - 1 end as idx from k window w as (order by date rows between 20 preceding and current row))
select count(*) as windows, round(avg((own < 0)::int), 6) as loss, round(avg((own > idx)::int), 6) as beats, round(avg((own - idx < -0.03)::int), 6) as trails_by_3 from r21 where own is not null"""
)
def rolling_odds(spark, folder):
    """Of all spans of 21 days the share with a loss, ahead of the index, and behind it by three points."""
    r = panel._index_returns(spark, folder).filter("ret is not null").groupBy("date").pivot("name", ["SMALLCOMP", "MKTCOMP"]).agg(F.max("ret")).dropna()
    w = Window.orderBy("date").rowsBetween(-20, 0)  # a row per day
    span = lambda c: F.when(F.count("*").over(w) == 21, F.product(1 + F.col(c)).over(w) - 1)
    d = r.select(span("SMALLCOMP").alias("own"), span("MKTCOMP").alias("idx")).filter("own is not null")
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    own, idx = F.col("own"), F.col("idx")
    return d.agg(F.count("*").alias("windows"), share(own < 0).alias("loss"), share(own > idx).alias("beats"), share(own - idx < -0.03).alias("trails_by_3"))


@register(
    f"""with {panel.CAPM}, b as (select count(*) as n, covar_samp(y, x) / var_samp(x) as beta, avg(y) - covar_samp(y, x) / var_samp(x) * avg(x) as alpha, var_samp(y) as vy, var_samp(x) as vx, avg(x) as mx from k)
select round(beta, 6) as beta, round(alpha * 252, 6) as alpha_ann, round(alpha / sqrt((vy - beta * beta * vx) * (n - 1) / (n - 2) * (1.0::double / n + mx * mx / (vx * (n - 1)))), 6) as alpha_t from b"""
)
def alpha_t(spark, folder):
    """Alpha of the small index on the large one and how sure it is, by the residuals' spread."""
    r = panel._index_returns(spark, folder).filter("ret is not null").groupBy("date").pivot("name", ["SMALLCOMP", "MKTCOMP"]).agg(F.max("ret")).dropna()
    b = r.agg(F.count("*").alias("n"), F.covar_samp("SMALLCOMP", "MKTCOMP").alias("c"), F.var_samp("SMALLCOMP").alias("vy"), F.var_samp("MKTCOMP").alias("vx"), F.avg("SMALLCOMP").alias("my"), F.avg("MKTCOMP").alias("mx"))
    b = b.withColumn("beta", F.col("c") / F.col("vx")).withColumn("alpha", F.col("my") - F.col("beta") * F.col("mx"))
    rest = (F.col("vy") - F.col("beta") * F.col("beta") * F.col("vx")) * (F.col("n") - 1) / (F.col("n") - 2)
    sd = F.sqrt(rest * (1.0 / F.col("n") + F.col("mx") * F.col("mx") / (F.col("vx") * (F.col("n") - 1))))
    return rounded(b.select("beta", (F.col("alpha") * 252).alias("alpha_ann"), (F.col("alpha") / sd).alias("alpha_t")), "beta", "alpha_ann", "alpha_t")


# --- reports and names


@register(
    """with f as (select * from fundamentals_actuals where ticker is not null and date is not null and revision is not null qualify row_number() over (partition by ticker, date, revision order by fund_id) = 1),
p as (select ticker, date, max(case when revision = 0 then eps end) as first, max(case when revision = 1 then eps end) as again, count(*) as n from f group by 1, 2)
select count(*) as periods, count_if(n > 1) as restated, count_if(again is not null and first is not null and again <> first) as changed, round(quantile_cont(abs(again / nullif(first, 0) - 1), 0.5), 6) as median_change, count_if(abs(first) > 100) as extreme, count_if(first is null) as missing from p"""
)
def fundamentals_check(spark, folder):
    """How many periods were restated, by how much, and how many are extreme or missing."""
    f = table(spark, folder, "fundamentals_actuals").dropna(subset=["ticker", "date", "revision"]).groupBy("ticker", "date", "revision").agg(F.min_by("eps", "fund_id").alias("eps"))
    p = f.groupBy("ticker", "date").agg(F.max(F.when(F.col("revision") == 0, F.col("eps"))).alias("first"), F.max(F.when(F.col("revision") == 1, F.col("eps"))).alias("again"), F.count("*").alias("n"))
    first, again = F.col("first"), F.col("again")
    change = F.abs(again / F.nullif(first, F.lit(0.0)) - 1)
    return p.agg(
        F.count("*").alias("periods"), F.count_if(F.col("n") > 1).alias("restated"), F.count_if(again.isNotNull() & first.isNotNull() & (again != first)).alias("changed"),
        F.round(F.percentile(change, F.lit(0.5)), 6).alias("median_change"), F.count_if(F.abs(first) > 100).alias("extreme"), F.count_if(first.isNull()).alias("missing"),
    )


_KEYWORDS_SQL = " ".join(f"when regexp_matches(lower(sic_description), '{k}') then '{g}'" for k, g in reports.KEYWORDS)


@register(f"select ticker, case {rp._CASES} {_KEYWORDS_SQL} else 'other' end as sector from reference_tickers")
def sector_by_words(spark, folder):
    """Sector by code, or where there is none by the first words that fit the description."""
    return table(spark, folder, "reference_tickers").select("ticker", reports.sector(F.col("sic_code"), F.col("sic_description")).alias("sector"))


@register(
    """with l as (select ticker, date, close, volume, row_number() over (partition by ticker order by date desc) as k from (select * from stocks_daily where ticker is not null and date is not null qualify row_number() over (partition by ticker, date order by loaded_at desc nulls last, bar_id desc) = 1))
select ticker, sha256(string_agg(strftime(date, '%Y-%m-%d'), '|' order by date)) as fingerprint, count(*) as bars from l where k <= 5 group by 1"""
)
def fingerprints(spark, folder):
    """A hash of the dates of the last five bars of each name: it changes when new ones arrive."""
    from almagest.operators.rolling import latest_delivery

    bars = latest_delivery(table(spark, folder, "stocks_daily").select("ticker", "date", "loaded_at", "bar_id"), ["ticker", "date"], ["loaded_at", "bar_id"], [])
    last = bars.withColumn("k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))).filter("k <= 5")
    return last.groupBy("ticker").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list("date")), lambda d: d.cast("string")), "|"), 256).alias("fingerprint"), F.count("*").alias("bars"))


@register("select t.ticker, min(date) as first_bar from stocks_daily t anti join corporate_actions c on c.ticker = t.ticker where t.ticker is not null group by 1")
def without_actions(spark, folder):
    """Names with bars that have no corporate action at all."""
    actions = table(spark, folder, "corporate_actions").select("ticker").dropna().distinct()
    return table(spark, folder, "stocks_daily").select("ticker", "date").filter("ticker is not null").join(actions, "ticker", "left_anti").groupBy("ticker").agg(F.min("date").alias("first_bar"))


@register(
    f"""with {RETS}, {panel.GROUPS}, y as (select ticker, year(date) as y, row_number() over (partition by year(date) order by avg(close) desc, ticker) % 5 as g from bars group by 1, 2),
c as (select a.y + 1 as year, a.g as a, b.g as b, count(*) as n from y a join y b on b.ticker = a.ticker and b.y = a.y + 1 group by 1, 2, 3),
t as (select year, sum(n) as n, sum(n * (n - 1) / 2.0::double) as ab from c group by 1),
ra as (select year, sum(x * (x - 1) / 2.0::double) as ra from (select year, a, sum(n) as x from c group by 1, 2) group by 1), rb as (select year, sum(x * (x - 1) / 2.0::double) as rb from (select year, b, sum(n) as x from c group by 1, 2) group by 1)
select year, n::bigint as names, round((ab - ra * rb / (n * (n - 1) / 2.0::double)) / nullif((ra + rb) / 2 - ra * rb / (n * (n - 1) / 2.0::double), 0), 6) as ari from t join ra using (year) join rb using (year)"""
)
def group_stability(spark, folder):
    """How alike the groups of successive years are (adjusted Rand index); groups here by mean price, dealt out in turn."""
    bars = panel._bars(spark, folder)
    y = bars.groupBy("ticker", F.year("date").alias("y")).agg(F.avg("close").alias("c"))
    y = y.withColumn("g", F.row_number().over(Window.partitionBy("y").orderBy(F.desc("c"), "ticker")) % 5)
    both = y.select("ticker", (F.col("y") + 1).alias("year"), F.col("g").alias("a")).join(y.select("ticker", F.col("y").alias("year"), F.col("g").alias("b")), ["ticker", "year"])
    return rounded(rp.rand_index(both, "year").withColumn("year", F.col("year").cast("long")), "ari")


@register(
    f"""with {panel.DRAW}, g as (select name, date, equity, drawdown, floor(ret * 100)::int as pct from dd)
select 'growth' as chart, name, strftime(date, '%Y-%m-%d') as x, round(equity, 6) as y from g union all select 'drawdown', name, strftime(date, '%Y-%m-%d'), round(drawdown, 6) from g union all select 'histogram', name, pct::varchar, count(*)::double from g group by 2, 3"""
)
def chart_data(spark, folder):
    """What charts show: growth and drawdown by day, and days by whole percents of return."""
    d = sr.drawdowns(panel._index_returns(spark, folder).filter("ret is not null"))
    line = lambda what, c: d.select(F.lit(what).alias("chart"), "name", F.col("date").cast("string").alias("x"), F.round(c, 6).alias("y"))
    histogram = d.groupBy("name", F.floor(F.col("ret") * 100).cast("int").cast("string").alias("x")).agg(F.count("*").cast("double").alias("y"))
    return line("growth", "equity").unionByName(line("drawdown", "drawdown")).unionByName(histogram.select(F.lit("histogram").alias("chart"), "name", "x", "y"))

