"""Regime flags and performance figures of daily series; one series per name, at most one row per name and day."""

from __future__ import annotations

from bisect import bisect_right, insort

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def days(name: str = "name") -> Window:
    return Window.partitionBy(name).orderBy("date")


def full(column: Column, count_of: str, window: Window, n: int) -> Column:
    """``column`` where the window is full, else null."""
    return F.when(F.count(count_of).over(window) >= n, column)


def conditions(levels: DataFrame, average: int = 200, vol: int = 21, history: int = 252, year: int = 252, high: float = 0.8, funding: DataFrame | None = None) -> DataFrame:
    """Per day: return, below its moving average, annual volatility, its share of the past at or below, year's return.

    ``stress_raw`` is a level below its average in high volatility; ``panic`` a negative year in high volatility. With
    ``funding`` (``name, date, funding``, carried forward between its days) a high share of it makes stress as well.
    """
    w = days()
    ma, rv = w.rowsBetween(1 - average, 0), w.rowsBetween(1 - vol, 0)
    df = levels.withColumn("ret", F.col("close") / F.lag("close").over(w) - 1)
    df = df.withColumns(
        {
            "day_no": F.row_number().over(w),
            "below_ma": full(F.col("close") < F.avg("close").over(ma), "close", ma, average),
            "vol": full(F.stddev_samp("ret").over(rv) * F.sqrt(F.lit(252.0)), "ret", rv, vol),
            "ret_year": F.col("close") / F.lag("close", year).over(w) - 1,
        }
    )
    df = expanding_share(df, "vol", "vol_pct", history)
    high_vol = F.coalesce(F.col("vol_pct") > high, F.lit(False))
    tense = high_vol
    if funding is not None:
        df = df.join(funding.select("name", "date", "funding"), ["name", "date"], "left")
        df = df.withColumn("funding", F.last("funding", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        df = expanding_share(df, "funding", "funding_pct", history)
        tense = high_vol | F.coalesce(F.col("funding_pct") > high, F.lit(False))
    return df.withColumns({"stress_raw": F.coalesce(F.col("below_ma"), F.lit(False)) & tense, "panic": F.coalesce(F.col("ret_year") < 0, F.lit(False)) & high_vol})


def expanding_share(df: DataFrame, value: str, out: str, least: int) -> DataFrame:
    """Share of a name's values up to now that are at or below the present one; null before ``least`` values.

    One ordered pass per name (a name has a row per day), which finds each value's place among those before by
    bisection. Null and NaN values get null and don't count.
    """
    schema = StructType([*[f for f in df.schema.fields if f.name != out], StructField(out, DoubleType())])

    def scan(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("date")
        seen: list[float] = []
        shares: list[float | None] = []
        for v in part[value].tolist():
            if v is None or v != v:
                shares.append(None)
                continue
            insort(seen, v)
            shares.append(bisect_right(seen, v) / len(seen) if len(seen) >= least else None)
        return part.assign(**{out: pd.Series(shares, index=part.index, dtype=object)})[schema.names]

    return df.groupBy("name").applyInPandas(scan, schema)


def last_of_week(df: DataFrame) -> DataFrame:
    """The last row of each ISO week of a name."""
    w = Window.partitionBy("name", F.date_trunc("week", "date")).orderBy(F.desc("date"))
    return df.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def rebalance_days(dates: DataFrame, offset: int = 0, every: int = 1) -> DataFrame:
    """The day ``offset`` (the last if there are fewer) of every ``every``-th ISO week; without the very first date."""
    week = F.date_trunc("week", "date").cast("date")
    w = Window.partitionBy("week")
    df = dates.withColumn("week", week).withColumn("k", F.row_number().over(w.orderBy("date")) - 1).withColumn("n", F.count("*").over(w))
    df = df.withColumns({"week_no": F.dense_rank().over(Window.orderBy("week")) - 1, "first_date": F.min("date").over(Window.partitionBy())})
    return df.filter((F.col("k") == F.least(F.lit(offset), F.col("n") - 1)) & (F.col("week_no") % every == 0) & (F.col("date") > F.col("first_date"))).select("week", "date")


def held_on(weekly: DataFrame, raw: str, out: str, off_after: int = 2) -> DataFrame:
    """On at once, off after ``off_after`` checks in a row without: true if any of the last ``off_after`` is."""
    return weekly.withColumn(out, F.max(raw).over(days().rowsBetween(1 - off_after, 0)))


def dead_band(weekly: DataFrame, p: str, out: str, on: float, off: float, off_after: int = 2, also: Column | None = None) -> DataFrame:
    """On when ``p`` reaches ``on`` (and ``also`` holds), off after ``off_after`` values in a row below ``off``, else as it was."""
    w = days()
    upto, last = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(1 - off_after, 0)
    df = weekly.withColumn("__i", F.row_number().over(w)).withColumn("__calm", F.count_if(F.col(p) < off).over(last) == off_after)
    on_at = F.max(F.when((F.col(p) >= on) & (F.lit(True) if also is None else also), F.col("__i"))).over(upto)
    off_at = F.max(F.when(F.col("__calm"), F.col("__i"))).over(upto)
    return df.withColumn(out, F.coalesce(on_at, F.lit(-1)) > F.coalesce(off_at, F.lit(-1))).drop("__i", "__calm")


def drawdowns(returns: DataFrame) -> DataFrame:
    """Equity, its running peak and the fall from it."""
    upto = days().rowsBetween(Window.unboundedPreceding, 0)
    df = returns.withColumn("equity", F.product(1 + F.coalesce("ret", F.lit(0.0))).over(upto))
    df = df.withColumn("peak", F.greatest(F.max("equity").over(upto), F.lit(1.0)))
    return df.withColumn("drawdown", F.col("equity") / F.col("peak") - 1)


def episodes(drawn: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` deepest falls of each name: first and last day below the peak, day of the trough, depth, days, recovery.

    ``recovered`` is the day on which the peak is reached again, null if it hasn't been.
    """
    drawn = drawn.withColumn("__next", F.lead("date").over(days()))
    upto = days().rowsBetween(Window.unboundedPreceding, 0)
    df = drawn.withColumn("island", F.sum(F.when(F.col("drawdown") >= -1e-12, 1).otherwise(0)).over(upto)).filter(F.col("drawdown") < -1e-12)
    df = df.groupBy("name", "island").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.min("drawdown").alias("depth"), F.min_by("date", F.struct("drawdown", "date")).alias("trough"), F.count("*").alias("length"), F.max_by("__next", "date").alias("recovered"))
    rank = F.row_number().over(Window.partitionBy("name").orderBy("depth", "start"))
    return df.withColumn("rank", rank).filter(F.col("rank") <= k).drop("island")


def performance(returns: DataFrame, window: int = 21) -> DataFrame:
    """Days, total and annual return, volatility, Sharpe ratio, deepest fall, and compounded returns over 21 days."""
    roll = days().rowsBetween(1 - window, 0)
    df = drawdowns(returns.filter("ret is not null"))
    df = df.withColumn("roll", full(F.product(1 + F.col("ret")).over(roll) - 1, "ret", roll, window))
    n, total, vol = F.count("*"), F.product(1 + F.col("ret")), F.stddev_samp("ret") * F.sqrt(F.lit(252.0))
    return df.groupBy("name").agg(
        n.alias("n"), (total - 1).alias("total"), (F.pow(total, F.lit(252.0) / n) - 1).alias("annual"), vol.alias("vol"),
        (F.avg("ret") * 252 / F.nullif(vol, F.lit(0.0))).alias("sharpe"), F.min("drawdown").alias("max_drawdown"),
        F.percentile("roll", F.lit(0.5)).alias("roll_median"), F.percentile("roll", F.lit(0.05)).alias("roll_p05"),
        F.percentile("roll", F.lit(0.95)).alias("roll_p95"), F.min("roll").alias("roll_worst"),
    )
