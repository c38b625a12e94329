"""Quarterly reports: trailing sums, earnings surprises, yields, split adjustment, sectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Two-digit industry codes (first, last) and their sector groups.
SECTORS = [
    (1, 14, "materials_energy"),
    (15, 17, "industrials"),
    (20, 27, "consumer_staples"),
    (28, 28, "pharma_chemicals"),
    (29, 34, "materials_energy"),
    (35, 36, "tech_hardware"),
    (37, 39, "industrials"),
    (40, 47, "industrials"),
    (48, 48, "communications"),
    (49, 49, "utilities"),
    (50, 59, "consumer_trade"),
    (60, 67, "financials"),
    (70, 72, "consumer_trade"),
    (73, 73, "software_services"),
    (74, 79, "consumer_trade"),
    (80, 80, "health_services"),
    (81, 99, "software_services"),
]


# Words of an industry's description and their sector groups; the first that fits counts.
KEYWORDS = [
    ("pharm|biolog|chemical|drug", "pharma_chemicals"),
    ("semiconductor|computer|electronic", "tech_hardware"),
    ("software|prepackaged|data processing|services-", "software_services"),
    ("bank|insur|invest|finance|reit|real estate", "financials"),
    ("electric|gas|water|utilit", "utilities"),
    ("telephone|communication|broadcast|cable", "communications"),
    ("oil|petroleum|mining|metal|steel|crude", "materials_energy"),
    ("health|hospital|medical", "health_services"),
    ("retail|wholesale|store|restaurant|eating", "consumer_trade"),
]


def sector(code: Column, description: Column | None = None) -> Column:
    """Sector group of a four-digit industry code given as text; 'other' where there is none.

    With a ``description``, codes of no group and missing ones get the group of the first words that it holds.
    """
    two = F.floor(code.try_cast("double") / 100)
    out = reduce(lambda out, r: out.when(two.between(r[0], r[1]), r[2]), SECTORS, F.when(F.lit(False), "other"))
    if description is not None:
        out = reduce(lambda out, r: out.when(F.lower(description).rlike(r[0]), r[1]), KEYWORDS, out)
    return out.otherwise("other")


def trailing_year(reports: DataFrame, flows: list[str]) -> DataFrame:
    """Sums of the last four reports of a ticker; null unless there are four, all with a value, within 300 days."""
    four = Window.partitionBy("ticker").orderBy("pe").rowsBetween(-3, 0)
    fits = (F.count("*").over(four) == 4) & (F.datediff("pe", F.min("pe").over(four)) <= 300)
    return reports.withColumns({f"ttm_{c}": F.when(fits & (F.count(c).over(four) == 4), F.sum(c).over(four)) for c in flows})


def surprise(reports: DataFrame) -> DataFrame:
    """Standardised change of eps on the year before: over the deviation of the eight changes before, four at least."""
    w = Window.partitionBy("ticker").orderBy("pe")
    past = w.rowsBetween(-8, -1)
    gap = F.datediff("pe", F.lag("pe", 4).over(w))
    df = reports.withColumn("diff", F.when(gap.between(330, 400), F.col("eps") - F.lag("eps", 4).over(w)))
    spread = F.when(F.count("diff").over(past) >= 4, F.stddev_samp("diff").over(past))
    return df.withColumn("spread", spread).withColumn("sue", F.when(F.col("spread") > 0, F.col("diff") / F.col("spread"))).drop("spread")


def split_factors(bars: DataFrame, splits: DataFrame, tolerance: float = 0.25, least: float = 0.05) -> DataFrame:
    """Splits with the first print on or after their ex-date and whether the jump there shows them unadjusted.

    ``bars`` has one positive close per ticker and date. A split of ratio r is applied if ln r is at least ``least``
    and the jump to the first print times r is within ``tolerance`` of one, in logs.
    """
    # Splits of a ticker travel as one short array; a bar is the first print of those since the bar before.
    w = Window.partitionBy("ticker").orderBy("date")
    before = bars.select("ticker", "date", "close", F.lag("close").over(w).alias("prev"), F.lag("date").over(w).alias("prev_date"))
    listed = splits.dropna(subset=["ticker", "ex_date"]).groupBy("ticker").agg(F.collect_set(F.struct("ex_date", "ratio")).alias("s"))
    due = F.filter("s", lambda x: (x["ex_date"] <= F.col("date")) & (F.col("prev_date").isNull() | (x["ex_date"] > F.col("prev_date"))))
    first = before.join(listed, "ticker").select("ticker", F.struct("date", "close", "prev").alias("f"), F.inline(due))
    jump = F.log(F.col("f.close") / F.col("f.prev") * F.col("ratio"))
    applied = F.coalesce((F.abs(F.log("ratio")) >= least) & (F.abs(jump) < tolerance), F.lit(False))
    return first.select("ticker", "ex_date", "ratio", F.col("f.date").alias("first_print"), applied.alias("applied"))


def split_adjust(bars: DataFrame, factors: DataFrame) -> DataFrame:
    """Closes before an applied split over its ratio, volumes times it. Splits of a ticker travel as one short array."""
    held = factors.filter("applied").groupBy("ticker").agg(F.collect_list(F.struct("first_print", "ratio")).alias("splits"))
    df = bars.join(held, "ticker", "left")
    factor = F.aggregate(F.coalesce("splits", F.array().cast("array<struct<first_print:date,ratio:double>>")), F.lit(1.0), lambda a, s: F.when(s["first_print"] > F.col("date"), a * s["ratio"]).otherwise(a))
    return df.withColumn("factor", factor).withColumns({"close_adj": F.col("close") / F.col("factor"), "volume_adj": F.col("volume") * F.col("factor")}).drop("splits")
