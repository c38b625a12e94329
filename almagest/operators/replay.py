"""Records of decisions, written as lines and scored again; books of fixed weights over daily prices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CASH = "CASHHOLDING"
RECORD = "decided_on date, execution_date date, action string, target_holdings array<struct<ticker:string,weight:double>>"


def six_digits(weights: DataFrame, date: str = "date") -> DataFrame:
    """Weights of each date rounded to six digits; what rounding takes or adds goes to the largest (the first of equal ones)."""
    w = Window.partitionBy(date)
    first = F.row_number().over(w.orderBy(F.desc("__r"), "ticker"))
    df = weights.withColumn("__r", F.round("weight", 6)).withColumns({"__rest": F.round(F.sum("weight").over(w) - F.sum("__r").over(w), 6), "__first": first})
    return df.withColumn("weight", F.round(F.col("__r") + F.when(F.col("__first") == 1, F.col("__rest")).otherwise(0.0), 6)).drop("__r", "__rest", "__first")


def with_cash(weights: DataFrame, date: str = "date") -> DataFrame:
    """``date, ticker, weight`` with a line of cash for what the weights of a date lack to one."""
    rest = weights.groupBy(date).agg(F.round(1 - F.sum("weight"), 10).alias("weight")).filter("weight > 1e-9")
    return weights.select(date, "ticker", "weight").unionByName(rest.select(date, F.lit(CASH).alias("ticker"), "weight"))


def holdings(weights: DataFrame, date: str = "date") -> DataFrame:
    """One row per date with ``target_holdings``, an array of ticker and weight in order of ticker."""
    return weights.groupBy(date).agg(F.sort_array(F.collect_list(F.struct("ticker", "weight"))).alias("target_holdings"))


def write_records(records: DataFrame, path: str) -> None:
    """One JSON object a line."""
    records.write.mode("overwrite").json(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).json(path)


def score(records: DataFrame, prices: DataFrame, flat_bps: float = 10.0) -> DataFrame:
    """Returns by day of records that are executed at the open: ``date, gross, cost, turnover, net``.

    ``prices`` has ``ticker, date, open, close``. On an execution day the old book earns from the last close to the
    open, the new one from the open to the close, and the change of weights at the open pays ``flat_bps``. A missing
    open is the last close; missing days earn nothing. Cash earns nothing and trades free. Of records with action
    'rebalance' that execute on one day the last decided counts. All holdings of a period are joined to its days, so
    nothing is carried from row to row: within a period a book's value is one plus the sum of weight times growth.
    """
    trades = records.filter("action = 'rebalance' and execution_date is not null").groupBy("execution_date").agg(F.max_by("target_holdings", "decided_on").alias("target_holdings"))
    order = Window.orderBy("start")  # a row per rebalance
    days = prices.select("date").distinct()
    span = days.agg(F.max("date").alias("__last"))
    periods = trades.withColumnRenamed("execution_date", "start").join(F.broadcast(days.withColumnRenamed("date", "start")), "start").join(F.broadcast(span))
    periods = periods.withColumn("next", F.lead("start").over(order)).withColumns({"end": F.coalesce("next", "__last"), "final": F.col("next").isNull()})
    held = periods.select("start", "end", "final", F.inline("target_holdings")).filter(F.col("ticker") != CASH)

    w = Window.partitionBy("ticker").orderBy("date")
    bars = prices.filter("close > 0").withColumn("__prev", F.lag("close").over(w))
    bars = bars.select("ticker", "date", "close", F.coalesce(F.when(F.col("open") > 0, F.col("open")), "__prev", "close").alias("open"))
    # The last close at or before each day of a period, from the ticker's own bars.
    cells = held.join(F.broadcast(days), (F.col("date") >= F.col("start")) & (F.col("date") <= F.col("end")))  # held names times days
    cells = cells.join(bars, ["ticker", "date"], "left")
    upto = Window.partitionBy("start", "ticker").orderBy("date")
    cells = cells.withColumns({"__bought": F.first("open", ignorenulls=True).over(upto.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "__seen": F.last("close", ignorenulls=True).over(upto.rowsBetween(Window.unboundedPreceding, 0)), "__before": F.last("close", ignorenulls=True).over(upto.rowsBetween(Window.unboundedPreceding, -1))})
    at_open = F.coalesce(F.when((F.col("date") == F.col("end")) & ~F.col("final"), F.coalesce("open", "__before")), "__seen")
    cells = cells.withColumn("growth", F.coalesce(at_open / F.col("__bought"), F.lit(1.0)))
    value = cells.groupBy("start", "end", "final", "date").agg((1 + F.sum(F.col("weight") * (F.col("growth") - 1))).alias("value"))
    within = value.withColumn("ret", F.col("value") / F.coalesce(F.lag("value").over(Window.partitionBy("start").orderBy("date")), F.lit(1.0)))
    gross = within.groupBy("date").agg((F.product("ret") - 1).alias("gross"))
    # Weights at the open of the next rebalance against its targets.
    last = cells.filter("date = end and not final").select(F.col("end").alias("day"), "start", "ticker", (F.col("weight") * F.col("growth")).alias("grown"))
    left = last.join(within.filter("date = end and not final").select(F.col("end").alias("day"), "start", "value"), ["day", "start"]).select("day", "ticker", (F.col("grown") / F.col("value")).alias("before"))
    both = held.select(F.col("start").alias("day"), "ticker", F.col("weight").alias("after")).join(left, ["day", "ticker"], "full").na.fill(0.0, ["after", "before"])
    turns = both.groupBy(F.col("day").alias("date")).agg(F.sum(F.abs(F.col("after") - F.col("before"))).alias("turnover"))
    out = gross.join(turns, "date", "left").na.fill(0.0, ["turnover"]).withColumn("cost", F.col("turnover") * flat_bps / 1e4)
    return out.select("date", "gross", "cost", "turnover", (F.col("gross") - F.col("cost")).alias("net"))


def event_returns(bars: DataFrame, splits: DataFrame) -> DataFrame:
    """``ticker, date, ret`` of unadjusted closes: on a split's first print (1 + r) times its ratio less one.

    ``bars`` has one close per ticker and day, ``splits`` the first prints and ratios of splits that show in the closes.
    """
    ratio = splits.groupBy("ticker", F.col("first_print").alias("date")).agg(F.product("ratio").alias("__ratio"))
    plain = bars.withColumn("ret", F.col("close") / F.lag("close").over(Window.partitionBy("ticker").orderBy("date")) - 1)
    return plain.join(ratio, ["ticker", "date"], "left").withColumn("ret", (1 + F.col("ret")) * F.coalesce("__ratio", F.lit(1.0)) - 1).drop("__ratio")


def checked(tickers: Sequence[str], weights: Sequence[float], start, end) -> dict[str, float]:
    """The weights of a request by ticker, scaled to one; ValueError if the request makes no sense."""
    if not tickers or len(tickers) != len(weights):
        raise ValueError("as many weights as tickers, one at least")
    if len(set(tickers)) != len(tickers):
        raise ValueError("tickers repeat")
    if not end > start:
        raise ValueError("the end isn't after the start")
    if any(not w >= 0 for w in weights) or abs(sum(weights) - 1) > 0.01:
        raise ValueError("weights are zero or more and sum to one")
    return {t: w / sum(weights) for t, w in zip(tickers, weights)}


def fixed_book(returns: DataFrame, weights: DataFrame, days: DataFrame, rebalance: bool, bps: float) -> DataFrame:
    """Daily ``gross, turnover, ret`` of a book over ``days`` (``date``): bought on the first, sold on the last, costs on both.

    ``weights`` has ``ticker, weight``. With ``rebalance`` the weights are restored every day and the trades paid; else
    they drift. A missing return is zero.
    """
    grid = F.broadcast(weights).join(days)  # names of one book times days
    cells = grid.join(returns.select("ticker", "date", "ret"), ["ticker", "date"], "left").na.fill(0.0, ["ret"])
    w = Window.partitionBy("ticker").orderBy("date")
    if rebalance:
        day = cells.groupBy("date").agg(F.sum(F.col("weight") * F.col("ret")).alias("gross"), F.collect_list(F.struct("weight", "ret")).alias("c"))
        traded = F.aggregate("c", F.lit(0.0), lambda a, x: a + F.abs(x["weight"] - x["weight"] * (1 + x["ret"]) / (1 + F.col("gross"))))
        day = day.select("date", "gross", traded.alias("turnover"))
    else:
        grown = cells.withColumn("g", F.product(1 + F.col("ret")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        value = grown.groupBy("date").agg(F.sum(F.col("weight") * F.col("g")).alias("v"))
        order = Window.orderBy("date")  # a row per day
        day = value.select("date", (F.col("v") / F.coalesce(F.lag("v").over(order), F.lit(1.0)) - 1).alias("gross"), F.lit(0.0).alias("turnover"))
    every = Window.partitionBy(F.lit(0))
    ends = (F.col("date") == F.min("date").over(every)).cast("int") + (F.col("date") == F.max("date").over(every)).cast("int")
    day = day.withColumn("turnover", F.col("turnover") + ends)
    return day.withColumn("ret", F.col("gross") - F.col("turnover") * F.lit(bps / 1e4))


def metrics(daily: DataFrame, per_year: float = 252.0, *by: str) -> DataFrame:
    """Days, total and yearly return, volatility, Sharpe ratio and deepest fall of ``ret`` by ``date``."""
    w = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    df = daily.withColumn("equity", F.product(1 + F.col("ret")).over(w))
    df = df.withColumn("fall", F.col("equity") / F.greatest(F.max("equity").over(w), F.lit(1.0)) - 1)
    n, grown, vol = F.count("*"), F.product(1 + F.col("ret")), F.stddev_samp("ret") * per_year**0.5
    sharpe: Column = F.avg("ret") * per_year / F.nullif(vol, F.lit(0.0))
    return df.groupBy(*by).agg(n.alias("n_days"), (grown - 1).alias("total_return"), (F.pow(grown, F.lit(per_year) / n) - 1).alias("ann_return"), vol.alias("ann_vol"), sharpe.alias("sharpe"), F.abs(F.min("fall")).alias("max_drawdown"))
