"""Queries p1 to p5 over a folder of tables, and SQL for those it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almagest.functions.instants import day_text, instant_text, new_york_midnight, with_instant
from almagest.operators import asof, nearest, rolling, spikes
from almagest.session import checkpoint
from almagest.sources.tables import table

# --- 1


def _last_bars(spark: SparkSession, folder: str) -> DataFrame:
    bars = table(spark, folder, "stocks_daily").select("bar_id", "ticker", "date", "close", "volume", "loaded_at")
    return rolling.latest_delivery(bars, ["ticker", "date"], ["loaded_at", "bar_id"], ["close", "volume"])


def p1_trailing(spark: SparkSession, folder: str) -> DataFrame:
    """Totals and averages of close and volume over the last 7 and 30 days, for every ticker and calendar day."""
    out = rolling.trailing(_last_bars(spark, folder), "ticker", "date", ["close", "volume"])
    return out.select(
        "ticker", F.col("date").cast("string").alias("day"), "has_row",
        *[F.round(F.col(c) + 1e-9, 6).alias(c) if dict(out.dtypes)[c] == "double" else F.col(c) for c in out.columns[3:]],
    )


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    bars = _last_bars(spark, folder).withColumn("active", F.when(rolling.finite(F.col("volume")) != 0, 1.0))
    out = rolling.trailing(bars, "ticker", "date", ["volume", "active"], windows=(7,))
    return out.filter((F.col("volume_total_7") == 0) & (F.col("active_rows_7") == 0)).select("ticker", F.col("date").cast("string").alias("day"))


_DENSE = """
with bars as (
  select ticker, date, case when isfinite(close) then close::decimal(38,6) end as close, case when isfinite(volume) then volume::decimal(38,6) end as volume
  from stocks_daily where ticker is not null and date is not null
  qualify row_number() over (partition by ticker, date order by loaded_at desc nulls last, bar_id desc) = 1),
span as (select ticker, min(date) as lo, max(date) as hi from bars group by ticker),
days as (select ticker, lo, unnest(generate_series(lo::timestamp, hi::timestamp, interval 1 day))::date as d from span),
dense as (select days.ticker, days.d, days.lo, bars.date is not null as has_row, bars.close, bars.volume
  from days left join bars on bars.ticker = days.ticker and bars.date = days.d)
"""


def _trailing_sql() -> str:
    parts = []
    for v in ("close", "volume"):
        for n in (7, 30):
            over = f"over w{n}"
            parts += [
                f"round(coalesce(sum({v}) {over}, 0)::double + 1e-9, 6) as {v}_total_{n}",
                f"count({v}) {over} as {v}_rows_{n}",
                f"round((sum({v}) {over})::double / nullif(count({v}) {over}, 0) + 1e-9, 6) as {v}_avg_{n}",
                f"round(coalesce(sum({v}) {over}, 0)::double / least({n}, date_diff('day', lo, d) + 1) + 1e-9, 6) as {v}_daily_{n}",
            ]
    frames = ", ".join(f"w{n} as (partition by ticker order by d rows between {n - 1} preceding and current row)" for n in (7, 30))
    return _DENSE + f"select ticker, strftime(d, '%Y-%m-%d') as day, has_row, {', '.join(parts)} from dense window {frames}"


P1_FOUND_SQL = (
    _DENSE
    + """, t as (select ticker, d, sum(abs(coalesce(volume, 0))) over (partition by ticker order by d rows between 6 preceding and current row) as v from dense)
select ticker, strftime(d, '%Y-%m-%d') as day from t where v = 0"""
)

# --- 3 (2 and 5 use its results)

QUARTERLY, AMENDED = ("10-Q", "10-K"), ("10-Q/A", "10-K/A")


def _filings(spark: SparkSession, folder: str, accepted: bool = False) -> DataFrame:
    """Filings with the New York day of filing_date, ``filed``, and the instant of acceptance."""
    df = table(spark, folder, "report_calendar_us").select("filing_id", "ticker", "filing_date", "form_type", "acceptance_datetime", "period_end")
    df = with_instant(df, "filing_date", out="filed_us", day_out="filed")
    return with_instant(df, "acceptance_datetime", out="accepted_us") if accepted else df


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    filings = table(spark, folder, "report_calendar_us").select(
        F.col("filing_id").alias("record_id"),
        F.inline(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("text")) for c in ("acceptance_datetime", "filing_date")])),
    )
    requests = table(spark, folder, "decide_requests").select(F.col("request_id").alias("record_id"), F.lit("information_cutoff").alias("field_name"), F.col("information_cutoff").alias("text"))
    found = []
    for part, hour in ((filings, 0), (requests, 16)):
        part = with_instant(part.filter(F.col("text").isNotNull()), "text", out="us", bare_hour=hour, day_out="day" if hour == 0 else None)
        form, there = instant_text(F.col("us")), F.col("us").isNotNull()
        if hour == 0:
            dated = F.col("field_name") == "filing_date"
            form, there = F.when(dated, day_text(F.col("day"))).otherwise(form), F.when(dated, F.col("day").isNotNull()).otherwise(there)
        found.append(part.filter(there).select("field_name", "record_id", form.alias("normal_form")))
    return found[0].unionByName(found[1])


# --- 2


def _first_reports(spark: SparkSession, folder: str, filings: DataFrame) -> DataFrame:
    """Distinct periods of first-reported rows with the filing nearest 6 to 120 days after the period's end."""
    funds = table(spark, folder, "fundamentals_actuals").filter(F.col("revision") == 0)
    reports = filings.filter(F.col("form_type").isin(*QUARTERLY) & F.col("filed").isNotNull())
    return nearest.nearest(funds, reports, "ticker", "date", "filed", "filing_id", 6, 120)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _first_reports(spark, folder, _filings(spark, folder)).select("fund_id", "filing_id")


# --- 4


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    bars = table(spark, folder, "stocks_daily").select("bar_id", "ticker", "date", "close", "volume", "loaded_at")
    index = table(spark, folder, "index_daily").filter(F.col("index_name") == "MKTCOMP").groupBy("date").agg(F.max("close").alias("level"))
    found = spikes.flag_series(bars, "ticker", "date", "close", "bar_id", activity="volume", order=["loaded_at", "bar_id"], market=index)
    actions = spikes.flag_events(table(spark, folder, "corporate_actions").select("action_id", "ticker", "ex_date", "kind", "value"), "ticker", "ex_date", "kind", "value", "action_id")
    return found.select(F.lit("stocks_daily").alias("table_name"), F.col("bar_id").alias("record_id")).unionByName(
        actions.select(F.lit("corporate_actions").alias("table_name"), F.col("action_id").alias("record_id"))
    )


# --- 5


def _published(spark: SparkSession, folder: str) -> DataFrame:
    """Filings that denote a day, with the instant from which they were public. Their texts are parsed here only."""
    filings = _filings(spark, folder, accepted=True).filter(F.col("filed").isNotNull() & F.col("form_type").isin(*QUARTERLY, *AMENDED))
    public = F.coalesce(F.col("accepted_us"), new_york_midnight(F.col("filed") + 1))
    return checkpoint(filings.select("ticker", F.col("form_type").isin(*AMENDED).alias("amends"), "period_end", "filed", "filing_id", public.alias("known_us")))


def _known_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Per ticker, period and revision the smallest fund_id, its eps, and the instant from which it was known."""
    filings = _published(spark, folder)
    funds = table(spark, folder, "fundamentals_actuals").select("ticker", "date", "revision", "fund_id", "eps")
    funds = funds.dropna(subset=["ticker", "date", "revision"]).groupBy("ticker", "date", "revision").agg(F.min(F.struct("fund_id", "eps")).alias("f"))
    funds = funds.select("ticker", "date", "revision", "f.fund_id", "f.eps")
    periods = funds.filter("revision = 0").select("ticker", "date")
    first = nearest.nearest(periods, filings.filter("not amends"), "ticker", "date", "filed", "filing_id", 6, 120, carry="known_us")
    first = first.select("ticker", "date", F.lit(0).alias("revision"), "known_us")
    amended = filings.filter("amends").groupBy("ticker", F.col("period_end").alias("date")).agg(F.min(F.struct("filed", "filing_id", "known_us")).alias("f"))
    amended = amended.select("ticker", "date", F.lit(1).alias("revision"), "f.known_us")
    known = funds.join(first.unionByName(amended), ["ticker", "date", "revision"], "left")
    return known.withColumn("known_us", F.coalesce("known_us", new_york_midnight(F.unix_date("date") + 60)))


def p5_asof(spark: SparkSession, folder: str) -> DataFrame:
    """Requests with the eps that was known at their cutoff."""
    intervals = asof.validity(_known_rows(spark, folder), "ticker", "known_us", [F.col("date"), F.col("revision"), -F.col("fund_id")], ["fund_id", "eps"])
    requests = table(spark, folder, "decide_requests").select("request_id", "ticker", "information_cutoff").dropna()
    events = with_instant(requests, "information_cutoff", out="cutoff_us", bare_hour=16).select("request_id", "ticker", "cutoff_us")
    return asof.known_at(events, checkpoint(intervals), "ticker", "cutoff_us").select("request_id", "ticker", "cutoff_us", "fund_id", "eps")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_asof(spark, folder).select("fund_id", "request_id")


QUERIES = {"p1_found": p1_found, "p1_trailing": p1_trailing, "p2_found": p2_found, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found, "p5_asof": p5_asof}
SQL = {"p1_found": P1_FOUND_SQL, "p1_trailing": _trailing_sql()}
