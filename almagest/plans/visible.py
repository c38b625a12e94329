"""Queries on what was known of reports at each date, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almagest.functions.instants import with_instant
from almagest.operators import pit, reports
from almagest.plans import panel
from almagest.plans import reports as rp
from almagest.plans.panel import register
from almagest.session import checkpoint
from almagest.sources.tables import table

#: Months between the dates at which the panel's reports are looked at: the last bar of each month.
MONTH_ENDS = "select ticker, date, close, day_idx from bars qualify date = max(date) over (partition by date_trunc('month', date))"
VISIBLE = f"""{rp.SUE}, {panel.BARS}, ends as ({MONTH_ENDS}),
kn as (select rep.*, 1 - cost / sales as margin, knowable, sue from rep join known using (ticker, pe) left join sue using (ticker, pe)),
vi as (select e.ticker, e.date, e.close, k.* exclude (ticker), row_number() over (partition by e.ticker, e.date order by k.pe desc) as k from ends e join kn k on k.ticker = e.ticker and k.knowable <= e.date),
st as (select ticker, date, max(close) as close, max(pe) as pe, min(pe) as first_pe, max(case when k = 1 then knowable end) as public, max(case when k = 1 then sue end) as sue, max(case when k = 1 then qty end) as latest_qty,
  case when count(*) = 4 and max(pe) - min(pe) <= 300 and count(sales) = 4 then sum(sales) end as ttm_sales, case when count(*) = 4 and max(pe) - min(pe) <= 300 and count(eps) = 4 then sum(eps) end as ttm_eps,
  case when count(*) = 4 and max(pe) - min(pe) <= 300 and count(margin) >= 3 then avg(margin) end as ttm_margin from vi where k <= 4 group by 1, 2)"""


def _states(spark: SparkSession, folder: str) -> DataFrame:
    """The panel's reports as states by date of knowledge."""
    rep = checkpoint(rp._reports(spark, folder))  # used twice
    known = rp._known(spark, folder, rep).select("ticker", "pe", "knowable")
    rows = reports.surprise(rep).join(known, ["ticker", "pe"]).withColumn("margin", 1 - F.col("cost") / F.col("sales"))
    return pit.trailing_states(rows, ["sales", "eps"], ["margin"], ["sue", "qty"])


def _at_month_ends(spark: SparkSession, folder: str) -> DataFrame:
    bars = checkpoint(panel._bars(spark, folder).select("ticker", "date", "close"))  # used twice
    ends = F.broadcast(bars.groupBy(F.date_trunc("month", "date").alias("m")).agg(F.max("date").alias("date")).select("date"))  # a row per month
    values = ["pe", "first_pe", "public", "ttm_sales", "ttm_eps", "ttm_margin", "latest_sue", "latest_qty"]
    intervals = checkpoint(_states(spark, folder))
    return pit.at_dates(bars.join(ends, "date", "left_semi"), intervals, values)


@register(
    f"with {VISIBLE} select ticker, date, pe, first_pe, public, round(ttm_sales / 1e6 + 1e-9, 6) as ttm_sales_m, round(ttm_eps, 6) as ttm_eps, round(ttm_margin, 6) as ttm_margin, latest_qty, case when date - public < 91 then round(sue, 6) end as pead from st"
)
def visible_ttm(spark, folder):
    """At the end of each month and for each name: trailing year, latest values and fresh surprise, of what was known then."""
    df = _at_month_ends(spark, folder)
    fresh = F.when(F.datediff("date", "public") < pit.FRESH, F.round("latest_sue", 6))
    return df.select("ticker", "date", "pe", "first_pe", "public", F.round(F.col("ttm_sales") / 1e6 + 1e-9, 6).alias("ttm_sales_m"), F.round("ttm_eps", 6).alias("ttm_eps"), F.round("ttm_margin", 6).alias("ttm_margin"), "latest_qty", fresh.alias("pead"))


@register(f"with {VISIBLE} select ticker, date, round(sue, 6) as pead from st where date - public < 91 and sue is not null")
def pead(spark, folder):
    """Surprise of the latest report visible at each month's end, if it became public less than 91 days before."""
    df = _at_month_ends(spark, folder).filter((F.datediff("date", "public") < pit.FRESH) & F.col("latest_sue").isNotNull())
    return df.select("ticker", "date", F.round("latest_sue", 6).alias("pead"))


@register(
    f"""with {VISIBLE}, p as (select ticker, date, close, ttm_eps, round(ttm_margin, 9) as a, round(case when latest_qty > 0 then ttm_sales / latest_qty end, 9) as b from st),
r as (select *, case when a is not null then (rank() over (partition by date, a is null order by a) + (count(*) over (partition by date, a) - 1) / 2.0::double) / count(a) over (partition by date) - 0.5 end as ra, case when b is not null then (rank() over (partition by date, b is null order by b) + (count(*) over (partition by date, b) - 1) / 2.0::double) / count(b) over (partition by date) - 0.5 end as rb from p)
select ticker, date, round((ra + rb) / 2, 6) as quality, round(case when close > 0 and ttm_eps is not null then greatest(ttm_eps, 0) / close end, 6) as value from r"""
)
def visible_factors(spark, folder):
    """Quality (the blend of two margins) and value of each name at the end of each month, of what was known then."""
    df = _at_month_ends(spark, folder).select("ticker", "date", "close", F.col("ttm_eps").alias("eps"), F.round("ttm_margin", 9).alias("gross_margin"), F.round(pit.safe_ratio("ttm_sales", "latest_qty"), 9).alias("ebit"), F.lit(1.0).alias("sales"))
    df = pit.value(pit.quality(df), "close")
    return df.select("ticker", "date", F.round("quality", 6).alias("quality"), F.round("value", 6).alias("value"))


@register(
    f"""with {VISIBLE}, sp as (select l_suppkey as ticker, max(l_shipdate)::date - 400 as ex_date from lineitem group by 1)
select st.ticker, st.date, coalesce(bool_or(ex_date >= first_pe - 92 and ex_date <= st.date), false) as split_inside from st left join sp on sp.ticker = st.ticker group by 1, 2"""
)
def splits_in_window(spark, folder):
    """Whether a split (here a day 400 before a name's last line) lies inside the year that is summed up at each month's end."""
    splits = table(spark, folder, "lineitem").groupBy(F.col("l_suppkey").alias("ticker")).agg(F.date_sub(F.max("l_shipdate").cast("date"), 400).alias("ex_date"))
    return pit.split_inside(_at_month_ends(spark, folder).select("ticker", "date", "first_pe"), splits).select("ticker", "date", "split_inside")


@register()
def knowable_times(spark, folder):
    """Every first report or restatement: from which day it may be used, and whether by its period, a near filing or by default."""
    filings = with_instant(table(spark, folder, "report_calendar_us").select("ticker", "filing_date", "form_type", "period_end"), "filing_date", out="us", day_out="filed")
    filings = filings.filter(F.col("form_type").isin("10-Q", "10-K", "10-Q/A", "10-K/A")).select("ticker", F.date_from_unix_date("filed").alias("filing_day"), "period_end")
    rows = table(spark, folder, "fundamentals_actuals").select("fund_id", "ticker", F.col("date").alias("pe"))
    return pit.knowable(rows, filings).select("fund_id", "knowable", "by")
