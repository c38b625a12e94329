"""Requests answered as DataFrames: what a service over these tables would return. Each checks its request first."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almagest.functions.instants import with_instant
from almagest.operators import replay, reports
from almagest.operators import calendar as cal
from almagest.plans import extras, panel, problems, records
from almagest.sources.tables import table

TABLES = ("stocks_daily", "corporate_actions", "reference_tickers", "index_daily", "fundamentals_actuals", "report_calendar_us")
#: Rows that a screen returns at most, as a request may ask for.
MOST = 200


@dataclass(frozen=True)
class BacktestRequest:
    tickers: list[str]
    start: dt.date
    end: dt.date
    weights: list[float] = field(default_factory=list)
    rebalance: str = "none"
    cost_bps: float = 10.0


def health(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each table; a table that can't be read has none."""
    out = None
    for name in TABLES:
        try:
            one = table(spark, folder, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n", F.lit(True).alias("there"))
        except Exception:  # noqa: BLE001 - whatever the file system says, the table isn't there
            one = spark.createDataFrame([(name, 0, False)], "table_name string, n long, there boolean")
        out = one if out is None else out.unionByName(one)
    return out


def last_day(spark: SparkSession, folder: str) -> DataFrame:
    """The last day of the market calendar, as one row."""
    return table(spark, folder, "index_daily").agg(F.max("date").alias("last_day"))


def holdings(spark: SparkSession, folder: str) -> DataFrame:
    """The last book with cash, to six digits."""
    bars = panel._kept_bars(spark, folder)
    target = records._targets(spark, folder, bars)
    return replay.holdings(target).agg(F.max("date").alias("as_of"), F.max_by("target_holdings", "date").alias("h")).select("as_of", F.inline("h"))


def model(spark: SparkSession, folder: str) -> DataFrame:
    """The last date's thirty best candidates."""
    ranked = panel.QUERIES["candidates_top30"](spark, folder)
    return ranked.groupBy("date").agg(F.collect_list(F.struct("ticker", "rnk", "score")).alias("c")).agg(F.max_by("c", "date").alias("c")).select(F.inline("c")).orderBy("rnk")


def decide(spark: SparkSession, folder: str, cutoff: str) -> DataFrame:
    """The record in force at a cutoff, a text in any of the known forms: made of bars up to it only.

    The decision is taken 15 minutes after the cutoff and executed at the next bar. A cutoff that denotes no instant is
    an error; one before the first record gives no row.
    """
    at = with_instant(spark.createDataFrame([(cutoff,)], "t string"), "t", out="us", bare_hour=16).first()["us"]
    if at is None:
        raise ValueError(f"no instant: {cutoff!r}")
    day = dt.datetime.fromtimestamp(at / 1e6, dt.timezone.utc).date()
    bars = panel._kept_bars(spark, folder).filter(F.col("date") <= F.lit(day))
    last = records._records(spark, folder, bars).orderBy(F.desc("data_through")).limit(1)
    return last.select(F.concat(F.lit("weekly-"), F.lit(day.isoformat())).alias("decision_id"), F.timestamp_micros(F.lit(at)).alias("information_cutoff"), F.timestamp_micros(F.lit(at + 900_000_000)).alias("decision_time"), "data_through", "decided_on", F.when(F.col("decided_on") == F.lit(day), "rebalance").otherwise("hold").alias("action"), "target_holdings")


def decisions(spark: SparkSession, folder: str, start: dt.date, end: dt.date) -> DataFrame:
    """All records between two days, both included."""
    if end < start:
        raise ValueError("the end is before the start")
    return records._records(spark, folder, panel._kept_bars(spark, folder)).filter(F.col("data_through").between(start, end))


def frozen(spark: SparkSession, book: list[tuple[str, float]], as_of: dt.date, start: dt.date, end: dt.date) -> DataFrame:
    """One record for a window that a kept book is held through, bought on its first weekday.

    ValueError if the window starts on or before the day the book was made of, or has no weekday: that would look ahead.
    """
    if start <= as_of:
        raise ValueError(f"the book knows days up to {as_of}")
    first = next((d for d in (start + dt.timedelta(k) for k in range((end - start).days + 1)) if d.weekday() < 5), None)
    if first is None:
        raise ValueError("no weekday in the window")
    return spark.createDataFrame([(as_of, as_of, first, "rebalance", book)], f"data_through date, {replay.RECORD}")


def backtest(spark: SparkSession, folder: str, request: BacktestRequest) -> DataFrame:
    """Performance of fixed weights over the trading days of a window, net of costs, splits taken out."""
    weights = replay.checked(request.tickers, request.weights or [1 / len(request.tickers)] * len(request.tickers), request.start, request.end)
    if request.rebalance not in ("none", "daily") or request.cost_bps < 0:
        raise ValueError("rebalance is none or daily, costs are zero or more")
    days = table(spark, folder, "index_daily").select("date").distinct().filter(F.col("date").between(request.start, request.end))
    if days.limit(3).count() < 3:
        raise ValueError("three trading days at least")
    returns = records._event_returns(spark, folder).filter(F.col("ticker").isin(*weights))
    book = spark.createDataFrame(list(weights.items()), "ticker string, weight double")
    return replay.metrics(replay.fixed_book(returns, book, F.broadcast(days), request.rebalance == "daily", request.cost_bps))


def screen(spark: SparkSession, folder: str, min_adv: float = 0.0, sector_contains: str | None = None, limit: int = 25) -> DataFrame:
    """Names by average dollar volume of their last 20 bars; ``limit`` is at most ``MOST``."""
    if not 1 <= limit <= MOST:
        raise ValueError(f"1 to {MOST} rows")
    out = extras._own_adv(spark, folder).filter(F.col("adv20") >= min_adv)
    if sector_contains:
        named = table(spark, folder, "reference_tickers")
        sector = reports.sector(F.col("sic_code"), F.col("sic_description"))
        words = F.concat_ws(" ", "sic_description", sector)
        out = out.join(named.filter(F.lower(words).contains(sector_contains.lower())).select("ticker"), "ticker", "left_semi")
    return out.orderBy(F.desc("adv20"), "ticker").limit(limit)


def known_on(spark: SparkSession, folder: str, ticker: str, on: dt.date) -> DataFrame:
    """The periods of a ticker as known at the end of a day in New York, each in its latest revision known by then."""
    known = problems._known_rows(spark, folder).filter(F.col("ticker") == ticker)
    midnight = problems.new_york_midnight(F.lit((on - dt.date(1970, 1, 1)).days + 1))
    seen = known.filter(F.col("known_us") < midnight)
    return seen.groupBy("ticker", "date").agg(F.max_by(F.struct("revision", "fund_id", "eps", "known_us"), F.struct("revision", -F.col("fund_id"))).alias("r")).select("ticker", "date", "r.*").orderBy("date")


def calendar_of(spark: SparkSession, folder: str) -> DataFrame:
    return cal.decision_days(table(spark, folder, "index_daily").select("date"))


