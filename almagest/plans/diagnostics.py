"""Verdicts on factors, regimes by method, calendars of decisions, groups in force, with the same in SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from almagest.operators import models
from almagest.operators import calendar as cal
from almagest.operators import series as sr
from almagest.plans import panel
from almagest.plans import reports as rp
from almagest.plans.panel import FORWARD, register, rounded
from almagest.sources.tables import table

FIELDS = ("momentum", "low_risk", "low_beta", "size")
# A spread or a rank correlation above these is too good to be true.
TOO_GOOD_SPREAD, TOO_GOOD_IC = 0.02, 0.1


def _bucketed(spark, folder):
    """Rows of each factor and date with bucket and ranks; dates with 50 names and five different values at least."""
    u = panel._forward_all(spark, folder).unpivot(["ticker", "date", "fwd"], list(FIELDS), "factor", "v").filter("v is not null")
    d = Window.partitionBy("factor", "date")
    u = u.withColumns({"rn": F.row_number().over(d.orderBy("v", "ticker")), "kind": F.dense_rank().over(d.orderBy("v")), "n": F.count("*").over(d), "a": panel.average_rank("v", "factor", "date"), "b": panel.average_rank("fwd", "factor", "date")})
    u = u.withColumn("kinds", F.max("kind").over(d)).filter("n >= 50 and kinds >= 5")
    return u.withColumn("bucket", F.greatest(F.lit(1), F.ceil(5.0 * (F.col("rn") - 1) / (F.col("n") - 1) - 1e-9).cast("int")))


BUCKETS = FORWARD + f""",
u as (unpivot (select ticker, date, fwd, {', '.join(FIELDS)} from al) on {', '.join(FIELDS)} into name factor value v),
n as (select *, row_number() over d as rn, count(*) over (partition by factor, date) as n, count(distinct v) over (partition by factor, date) as kinds, {panel.average_rank_sql("v", "factor, date")} as a, {panel.average_rank_sql("fwd", "factor, date")} as b from u where v is not null window d as (partition by factor, date order by v, ticker)),
bk as (select *, greatest(1, ceil(5.0::double * (rn - 1) / (n - 1) - 1e-9))::int as bucket from n where n >= 50 and kinds >= 5),
dt as (select factor, date, count(*) as names, corr(a, b) as ic, {', '.join(f'avg(case when bucket = {k} then fwd end) as q{k}' for k in range(1, 6))} from bk group by 1, 2),
yr as (select factor, year(date) as y, avg(q5 - q1) as s, sum(q5 - q1) as total, count(*) as c from dt group by 1, 2),
by_year as (select factor, count(*) as years, count_if(s > 0) as positive, sum(total) as total, sum(c) as c, arg_max(total, (s, -y)) as best_total, arg_max(c, (s, -y)) as best_c from yr group by 1),
sm as (select factor, count(*) as dates, avg(names) as names, avg(ic) as ic, avg(q5 - q1) as spread, stddev_samp(q5 - q1) as sd, {', '.join(f'avg(q{k}) as q{k}' for k in range(1, 6))} from dt group by 1),
rk as (select factor, corr(k, r) as mono from (select factor, k, rank() over (partition by factor order by m) as r from (unpivot (select factor, q1, q2, q3, q4, q5 from sm) on q1, q2, q3, q4, q5 into name bucket value m) join (values ('q1', 1), ('q2', 2), ('q3', 3), ('q4', 4), ('q5', 5)) as t(bucket, k) using (bucket)) group by 1)"""


@register(
    f"""with {BUCKETS}, f as (select sm.*, mono, years, positive, (total - best_total) / nullif(c - best_c, 0) as rest from sm join rk using (factor) join by_year using (factor))
select factor, dates, round(names, 6) as names, {', '.join(f'round(q{k}, 6) as q{k}' for k in range(1, 6))}, round(spread, 6) as q5_minus_q1, round(case when dates > 2 then spread / (sd / sqrt(dates)) end, 6) as spread_t, round(mono, 6) as monotonic, round(ic, 6) as mean_ic, positive, years,
coalesce(nullif(concat_ws(',', case when spread < 0 then 'backwards' end, case when round(mono, 9) < 0.5 then 'not_monotone' end, case when years >= 2 and (positive < 0.5 * years or (spread > 0 and coalesce(rest, 0) <= 0)) then 'one_year' end, case when spread > {TOO_GOOD_SPREAD} or ic > {TOO_GOOD_IC} then 'too_good' end), ''), 'ok') as verdict from f"""
)
def factor_verdicts(spark, folder):
    """Each factor's five buckets, their spread by date and by year, and what speaks against it.

    backwards: the best bucket earns less than the worst; not_monotone: the rank correlation of bucket and return is
    below a half; one_year: the spread is positive in less than half of the years or owes all to the best one;
    too_good: a spread or rank correlation beyond belief.
    """
    dates = _bucketed(spark, folder).groupBy("factor", "date").agg(
        F.count("*").alias("names"), F.corr("a", "b").alias("ic"), *[F.avg(F.when(F.col("bucket") == k, F.col("fwd"))).alias(f"q{k}") for k in range(1, 6)]
    )
    dates = dates.withColumn("spread", F.col("q5") - F.col("q1"))
    # Sums by year first: a year is one row of its factor, so all that follows is small.
    moments = [F.sum(f"q{k}").alias(f"q{k}") for k in range(1, 6)]
    years = dates.groupBy("factor", F.year("date").alias("y")).agg(F.count("*").alias("c"), F.sum("spread").alias("total"), F.sum(F.col("spread") * F.col("spread")).alias("square"), F.sum("ic").alias("ic"), F.sum("names").alias("names"), *moments)
    best = F.max_by(F.struct("total", "c"), F.struct(F.col("total") / F.col("c"), -F.col("y")))
    s = years.groupBy("factor").agg(
        F.sum("c").alias("dates"), F.sum("total").alias("total"), F.sum("square").alias("square"), F.sum("ic").alias("ic"), F.sum("names").alias("names"),
        *[F.sum(f"q{k}").alias(f"q{k}") for k in range(1, 6)], F.count("*").alias("years"), F.count_if(F.col("total") > 0).alias("positive"), best.alias("best"),
    )
    n = F.col("dates")
    s = s.withColumns({c: F.col(c) / n for c in ("ic", "names", *[f"q{k}" for k in range(1, 6)])}).withColumn("spread", F.col("total") / n)
    sd = F.sqrt((F.col("square") - n * F.col("spread") * F.col("spread")) / F.nullif(n - 1, F.lit(0)))
    place = [sum(((F.col(f"q{j}") < F.col(f"q{k}")).cast("int") for j in range(1, 6)), F.lit(0)) for k in range(1, 6)]
    centred = sum((p * (k - 2) for k, p in enumerate(place)), F.lit(0))
    total = sum(place, F.lit(0))
    square = sum((p * p for p in place), F.lit(0))
    s = s.withColumn("mono", centred / F.nullif(F.sqrt(10.0 * (square - total * total / 5.0)), F.lit(0.0)))
    rest = (F.col("total") - F.col("best.total")) / F.nullif(n - F.col("best.c"), F.lit(0))
    flags = F.concat_ws(
        ",",
        F.when(F.col("spread") < 0, "backwards"),
        F.when(F.round("mono", 9) < 0.5, "not_monotone"),
        F.when((F.col("years") >= 2) & ((F.col("positive") < 0.5 * F.col("years")) | ((F.col("spread") > 0) & (F.coalesce(rest, F.lit(0.0)) <= 0))), "one_year"),
        F.when((F.col("spread") > TOO_GOOD_SPREAD) | (F.col("ic") > TOO_GOOD_IC), "too_good"),
    )
    out = s.select(
        "factor", "dates", "names", *[f"q{k}" for k in range(1, 6)], F.col("spread").alias("q5_minus_q1"), F.when(n > 2, F.col("spread") / (sd / F.sqrt(n))).alias("spread_t"),
        F.col("mono").alias("monotonic"), F.col("ic").alias("mean_ic"), "positive", "years", F.coalesce(F.nullif(flags, F.lit("")), F.lit("ok")).alias("verdict"),
    )
    return rounded(out, "names", *[f"q{k}" for k in range(1, 6)], "q5_minus_q1", "spread_t", "monotonic", "mean_ic")


# --- regimes by method


@register()
def regime_methods(spark, folder):
    """Weekly stress of each index by rule, by fitted states, by these below the 50-day mean, and by rule or the latter.

    Probabilities are walk-forward (see ``hmm_filter``), carried to the week's last day; before there are any they are 0.
    """
    index = panel._index(spark, folder)
    w50 = sr.days().rowsBetween(-49, 0)
    flags = sr.conditions(index).withColumn("below_50", sr.full(F.col("close") < F.avg("close").over(w50), "close", w50, 50))
    flags = flags.join(rp.hmm_filter(spark, folder), ["name", "date"], "left")
    upto = sr.days().rowsBetween(Window.unboundedPreceding, 0)
    weekly = sr.last_of_week(flags.withColumn("p", F.coalesce(F.last("p_stress", ignorenulls=True).over(upto), F.lit(0.0))))
    weekly = sr.held_on(weekly, "stress_raw", "rule")
    weekly = sr.dead_band(weekly, "p", "hmm", 0.8, 0.5)
    weekly = sr.dead_band(weekly, "p", "hmm_trend", 0.8, 0.5, also=F.coalesce("below_50", F.lit(False)))
    return rounded(weekly.select("name", "date", "p", "rule", "hmm", "hmm_trend", (F.col("rule") | F.col("hmm_trend")).alias("rule_or_hmm"), "panic"), "p")


@register()
def regime_description(spark, folder):
    """Of each fitted year: yearly volatility in both states and how many days a stay is expected to last."""

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part[part["year"] < part["fit_year"]].sort_values("date")
        if len(part) < rp.LEAST_HISTORY:
            return pd.DataFrame({"name": [], "fit_year": [], "n": [], "calm_vol": [], "stress_vol": [], "calm_days": [], "stress_days": []}, dtype=object)
        m = models.fit_two_states(part["ret"].to_numpy() * 100)
        vol, stay = m["sd"] / 100 * 252**0.5, 1 / (1 - m["move"].diagonal())
        return pd.DataFrame([[part["name"].iloc[0], part["fit_year"].iloc[0], len(part), *vol, *stay]], columns=["name", "fit_year", "n", "calm_vol", "stress_vol", "calm_days", "stress_days"]).round(6)

    return rp._upto_year(spark, folder).groupBy("name", "fit_year").applyInPandas(fit, "name string, fit_year int, n long, calm_vol double, stress_vol double, calm_days double, stress_days double")


# --- calendars

CALENDAR = """td as (select distinct date from index_daily),
sp as (select min(date) as lo, max(date) as hi from td),
dy as (select unnest(generate_series(lo::timestamp, hi::timestamp, interval 1 day))::date as day from sp),
op as (select day, td.date is not null as trades from dy left join td on td.date = dy.day),
nx as (select day, trades, max(case when trades then day end) over (order by day) as last_open, min(case when trades then day end) over (order by day rows between 1 following and unbounded following) as next_open from op),
wk as (select *, trades and next_open is not null and date_trunc('week', next_open) <> date_trunc('week', day) as week_end from nx)"""


@register(
    f"""with {CALENDAR} select day, trades, not trades and isodow(day) <= 5 as closed_weekday, last_open as data_after_close, max(case when trades then day end) over (order by day rows between unbounded preceding and 1 preceding) as data_before_close,
week_end as rebalances, max(case when week_end then day end) over (order by day) as decided_on, next_open as executes_on from wk"""
)
def decision_calendar(spark, folder):
    """For each day: whether it trades, closed weekdays, the last day known before and after the close, the weekly decision in force, the next open."""
    return cal.decision_days(table(spark, folder, "index_daily").select("date"))


@register(
    f"""with {CALENDAR}, r as (select bar_id, epoch_us(loaded_at) // 1000000 + 900 as s from stocks_daily where loaded_at is not null),
x as (select bar_id, date '1970-01-01' + cast(s // 86400 as int) as day, s % 86400 < 34200 as early from r)
select bar_id, case when trades and early then day else next_open end as executes_on from x join wk using (day)"""
)
def execution_days(spark, folder):
    """The first session that opens after a decision taken 15 minutes after each delivery (times of day in UTC)."""
    loaded = table(spark, folder, "stocks_daily").select("bar_id", (F.unix_micros("loaded_at") + 900_000_000).alias("at")).filter("at is not null")
    return cal.execution_day(loaded, "at", table(spark, folder, "index_daily").select("date")).select("bar_id", "executes_on")


# --- groups in force


@register(
    f"""with {panel.BARS}, y as (select ticker, year(date) + 1 as fit_year, sum(volume) as v from bars group by 1, 2),
g as (select fit_year, ticker, row_number() over (partition by fit_year order by v desc, ticker) as r, count(*) over (partition by fit_year) as n from y where fit_year <= (select max(year(date)) from bars)),
s as (select fit_year, ticker, case when 3 * (r - 1) < n then 'large' when 3 * (r - 1) < 2 * n then 'middle' else 'small' end as grp from g),
f as (select distinct fit_year from s), d as (select distinct date from bars),
w as (select date, coalesce(max(case when fit_year <= year(date) then fit_year end), min(fit_year)) as fit_year from d cross join f group by 1)
select b.ticker, b.date, w.fit_year, coalesce(s.grp, 'other') as grp from bars b join w using (date) left join s on s.ticker = b.ticker and s.fit_year = w.fit_year"""
)
def groups_in_force(spark, folder):
    """Groups fitted each January on the year before (thirds by volume), and for each bar the ones in force.

    A date has the latest fit of its year or before, the earliest where there is none; names without a group are other.
    """
    bars = panel._bars(spark, folder).select("ticker", "date", "volume")
    yearly = bars.groupBy("ticker", (F.year("date") + 1).alias("fit_year")).agg(F.sum("volume").alias("v"))
    newest = bars.agg(F.year(F.max("date")).alias("newest"))  # one row
    order = Window.partitionBy("fit_year")
    g = yearly.join(F.broadcast(newest), F.col("fit_year") <= F.col("newest")).withColumns({"r": F.row_number().over(order.orderBy(F.desc("v"), "ticker")) - 1, "n": F.count("*").over(order)})
    grp = F.when(3 * F.col("r") < F.col("n"), "large").when(3 * F.col("r") < 2 * F.col("n"), "middle").otherwise("small")
    return cal.groups_at(bars, g.select("fit_year", "ticker", grp.alias("grp"))).select("ticker", "date", F.col("fit_year").cast("long").alias("fit_year"), "grp")


