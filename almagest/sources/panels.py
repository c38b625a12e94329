"""A panel kept by year, read through: what is missing or stale is fetched and kept."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class MissingYear(LookupError):
    """A year that isn't kept was asked for where fetching isn't allowed."""


def kept_years(spark: SparkSession, path: str) -> dict[int, dt.date]:
    """Years that are kept and the last date of each. Only the partition column and dates are read."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(place) or not any(s.isDirectory() for s in files.listStatus(place)):
        return {}
    return {r["year"]: r["last"] for r in spark.read.parquet(path).groupBy("year").agg(F.max("date").alias("last")).collect()}


def read_through(spark: SparkSession, path: str, start: dt.date, end: dt.date, fetch: Callable[[dt.date, dt.date], DataFrame], slack_days: int = 4) -> DataFrame:
    """Rows from ``start`` to ``end`` of the panel kept at ``path``.

    Years that aren't kept are fetched whole (up to ``end``) and kept; so is the last year, if what is kept of it ends
    more than ``slack_days`` before ``end``. Only those partitions are written.
    """
    have = kept_years(spark, path)
    for year in range(start.year, end.year + 1):
        stale = year == end.year and year in have and have[year] < end - dt.timedelta(days=slack_days)
        if year not in have or stale:
            last = min(dt.date(year, 12, 31), end)
            rows = fetch(dt.date(year, 1, 1), last).withColumn("year", F.year("date"))
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)
    return kept(spark, path, start, end)


def kept(spark: SparkSession, path: str, start: dt.date, end: dt.date) -> DataFrame:
    """Rows from ``start`` to ``end`` of what is kept; raises if a year is missing."""
    missing = [y for y in range(start.year, end.year + 1) if y not in kept_years(spark, path)]
    if missing:
        raise MissingYear(f"not kept: {missing}")
    years = F.col("year").between(start.year, end.year)
    return spark.read.parquet(path).filter(years & F.col("date").between(start, end)).drop("year")


def write_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.write.mode("overwrite").json(path)
