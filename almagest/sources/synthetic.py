"""A made-up market with a planted signal, an unadjusted split, sectors and filings, for tests and trials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _normal(seed: int, *keys: Column | str) -> Column:
    u = [(F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(k), *keys), 11) + 0.5) / F.lit(float(1 << 53)) for k in (1, 2)]
    return F.sqrt(-2 * F.log(u[0])) * F.cos(6.283185307179586 * u[1])


def build(spark: SparkSession, names: int = 40, start: str = "2019-01-02", end: str = "2026-09-30", seed: int = 0) -> dict[str, DataFrame]:
    """Tables of a market whose values depend on the seed, name and day only, however they are partitioned.

    ``stocks_daily``: business days; a signal of every tenth day moves the next five days by 0.0008 for each unit; the
    sixth name splits four for one in the middle, and neither closes nor volumes before are adjusted. ``state_vector``
    has the signal and the days to the next report, ``corporate_actions`` the split, ``reference_tickers`` ten industry
    codes, ``index_daily`` a random walk, ``report_calendar_us`` and ``fundamentals_actuals`` four periods a year, filed
    33 days after their end. Each name's days are one window, so a name's history is the largest unit of work.
    """
    days = spark.sql(f"select explode(sequence(date'{start}', date'{end}')) as date").filter(F.weekday("date") < 5)
    days = days.withColumn("i", F.row_number().over(Window.orderBy("date")) - 1)  # a row per day
    n = F.broadcast(days.agg(F.count("*").alias("n")))  # one row
    ticker = F.format_string("T%03d", F.col("id").cast("int"))
    grid = spark.range(names).select("id", ticker.alias("ticker")).join(F.broadcast(days)).join(n)
    signal = _normal(seed, F.lit("signal"), "ticker", F.floor(F.col("i") / 10))
    grid = grid.withColumn("signal", signal).withColumn("ret", 0.0003 + F.when(F.col("i") % 10 < 5, 0.0008 * F.col("signal")).otherwise(0.0) + 0.015 * _normal(seed, F.lit("ret"), "ticker", "i"))
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    splits = (F.col("id") == 5) & (F.col("i") >= F.floor(F.col("n") / 2))
    grid = grid.withColumn("close", F.exp(F.sum(F.log1p("ret")).over(w)) * (20 + 3 * F.col("id")) / F.when(splits, 4.0).otherwise(1.0))
    bars = grid.select("ticker", "date", (F.col("close") * (1 + 0.002 * _normal(seed, F.lit("open"), "ticker", "i"))).alias("open"), "close", (F.when(splits, 4.0).otherwise(1.0) * 2e6).alias("volume"))
    state = grid.select("ticker", "date", F.col("signal").alias("guidance_range_velocity"), F.pmod(F.lit(90) - F.col("i"), F.lit(91)).cast("double").alias("days_to_next_report"))
    actions = grid.filter(splits & (F.col("i") == F.floor(F.col("n") / 2))).select("ticker", F.col("date").alias("ex_date"), F.lit("split").alias("kind"), F.lit(4.0).alias("value"), F.lit("").alias("raw"))
    codes = F.array(*[F.lit(c) for c in ("1311", "1531", "2011", "2834", "3571", "3711", "4813", "4911", "5311", "6021")])
    names_ = spark.range(names).select(ticker.alias("ticker"), F.concat(F.lit("Name "), F.col("id").cast("string")).alias("name"), F.element_at(codes, (F.col("id") % 10 + 1).cast("int")).alias("sic_code"), F.lit("").alias("sic_description"), F.lit("XNYS").alias("primary_exchange"), (1e9 * (1 + F.col("id"))).alias("market_cap"))
    walk = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    index = days.select(F.lit("SPX").alias("index_name"), "date", (3000 * F.exp(F.sum(0.01 * _normal(seed, F.lit("index"), "i")).over(walk))).alias("close"))
    ends = spark.sql(f"select explode(sequence(trunc(date'{start}', 'quarter'), date'{end}', interval 3 months)) as date").select(F.date_sub("date", 1).alias("date"))
    funds = spark.range(names).select("id", ticker.alias("ticker")).join(F.broadcast(ends))
    reports = funds.select("ticker", "date", (1e8 * (1 + F.col("id"))).alias("revenue"), (1 + 0.1 * _normal(seed, F.lit("eps"), "ticker", "date")).alias("eps"))
    filings = funds.select("ticker", F.date_add("date", 33).alias("filing_date"), F.lit("10-Q").alias("form_type"), F.concat_ws("-", "ticker", F.col("date").cast("string")).alias("accession_number"))
    return {"stocks_daily": bars, "state_vector": state, "corporate_actions": actions, "reference_tickers": names_, "index_daily": index, "fundamentals_actuals": reports, "report_calendar_us": filings}
