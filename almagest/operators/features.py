"""Windows over a market calendar, cross-sectional scores and books, on long panels.

A panel has one row per ticker and date with a ``day_idx``, the position of the date in the market calendar. Lags and
windows are positions in that calendar, not rows of the ticker, so a missing day gives null, never an older value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR, MONTH = 252, 21
WEIGHTS = {"momentum": 1.0, "low_risk": 1.0, "low_beta": 1.0, "liquidity": 0.5}


def calendar(panel: DataFrame) -> DataFrame:
    """Dates with their positions from 0. Distinct dates of a market are few, so one task numbers them."""
    return panel.select("date").distinct().withColumn("day_idx", (F.row_number().over(Window.orderBy("date")) - 1).cast("long"))


def weekly_bars(lineitem: DataFrame) -> DataFrame:
    """Weekly bars per supplier: volume-weighted price and volume. Prices have two digits, so their sum is exact."""
    week = F.date_trunc("week", "l_shipdate").cast("date")
    bars = lineitem.groupBy(F.col("l_suppkey").alias("ticker"), week.alias("date")).agg(
        (F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double") / F.sum("l_quantity")).alias("close"), F.sum("l_quantity").alias("volume")
    )
    return bars.join(calendar(bars), "date").withColumn("dv", F.col("close") * F.col("volume"))


def frame(start: int, end: int = 0) -> Window:
    """Calendar positions ``start`` to ``end`` before the row's own."""
    return Window.partitionBy("ticker").orderBy("day_idx").rangeBetween(-start, -end)


def lagged(column: str, k: int) -> Column:
    """The value exactly ``k`` calendar positions before."""
    return F.max(column).over(frame(k, k))


def with_returns(panel: DataFrame) -> DataFrame:
    return panel.withColumn("ret", F.col("close") / lagged("close", 1) - 1)


def market_returns(panel: DataFrame) -> DataFrame:
    """Equal-weight return per date, with sums over the trailing year. One row per date, so one task has the window."""
    year = Window.orderBy("day_idx").rangeBetween(-YEAR, 0)
    daily = panel.groupBy("date", "day_idx").agg(F.avg("ret").alias("mkt"))
    return daily.select("date", "mkt", F.count("mkt").over(year).alias("mkt_n"), F.sum("mkt").over(year).alias("mkt_sum"), F.sum(F.col("mkt") * F.col("mkt")).over(year).alias("mkt_sq"))


def market_or_given(daily: DataFrame, given: str, least: float = 0.9) -> DataFrame:
    """``daily`` (``date, day_idx, mkt`` and ``given``, a row per date) with ``market``: the given one if it covers enough.

    Enough is more than ``least`` of the dates of the trailing year; else the mean of all names counts. ``given_used``
    says which; where the given one counts, its missing days are zero.
    """
    year = Window.orderBy("day_idx").rangeBetween(-YEAR, 0)
    enough = F.count(given).over(year) / F.count(F.lit(1)).over(year) > least
    return daily.withColumn("given_used", enough).withColumn("market", F.when(F.col("given_used"), F.coalesce(given, F.lit(0.0))).otherwise(F.col("mkt")))


def features(panel: DataFrame) -> DataFrame:
    """adv20, rv21, amihud, momentum 12-1 and shrunk beta for every ticker and date. Two shuffles: ticker, date."""
    panel = with_returns(panel)
    market = market_returns(panel)
    panel = panel.join(F.broadcast(market), "date")  # one row per date of the calendar
    illiquid = F.abs("ret") / F.nullif(F.col("dv"), F.lit(0.0))
    both = F.when(F.col("ret").isNotNull(), F.col("mkt"))
    # Sums over a year are differences of sums from the start: a sliding frame would add up 253 rows for each row.
    sums = {"r": F.col("ret"), "m": both, "rm": F.col("ret") * F.col("mkt"), "n": F.col("ret").isNotNull().cast("double")}
    order = Window.partitionBy("ticker").orderBy("day_idx")
    upto, before = order.rangeBetween(Window.unboundedPreceding, 0), order.rangeBetween(Window.unboundedPreceding, -YEAR - 1)
    panel = panel.withColumns(
        {
            "adv20": F.avg("dv").over(frame(19)),
            "rv21": F.stddev_samp("ret").over(frame(20)) * F.sqrt(F.lit(float(YEAR))),
            "amihud": F.avg(illiquid).over(frame(20)) * 1e6,
            "momentum": F.when(F.col("day_idx") >= YEAR, lagged("close", MONTH) / lagged("close", YEAR) - 1),
            "year_return": F.col("close") / lagged("close", YEAR) - 1,
            **{f"b_{k}": F.coalesce(F.sum(c).over(upto), F.lit(0.0)) for k, c in sums.items()},
        }
    )
    panel = panel.withColumns({f"y_{k}": F.col(f"b_{k}") - F.coalesce(F.last(f"b_{k}").over(before), F.lit(0.0)) for k in sums})
    spread = F.col("mkt_sq") - F.col("mkt_sum") * F.col("mkt_sum") / F.col("mkt_n")
    beta = (F.col("y_rm") - F.col("y_r") * F.col("y_m") / F.nullif("y_n", F.lit(0.0))) / F.nullif(spread, F.lit(0.0))
    return panel.withColumn("beta", F.when(F.col("y_n") >= YEAR // 2, 0.67 * beta + 0.33)).drop(*[f"{t}_{k}" for t in "by" for k in sums], "mkt_n", "mkt_sum", "mkt_sq")


def marked_liquid(features: DataFrame, min_adv: float, min_price: float, amihud_keep: float = 0.9) -> DataFrame:
    """``features`` with ``liquid``: enough dollar volume and price, known momentum, not the most illiquid of those."""
    ok = (F.col("adv20") >= min_adv) & (F.col("close") > min_price) & F.col("momentum").isNotNull() & F.col("amihud").isNotNull()
    limit = F.percentile(F.when(ok, F.col("amihud")), F.lit(amihud_keep)).over(Window.partitionBy("date"))
    return features.withColumn("liquid", F.coalesce(ok & (F.col("amihud") <= limit), F.lit(False)))


def liquid(features: DataFrame, min_adv: float, min_price: float, amihud_keep: float = 0.9) -> DataFrame:
    """Liquid names of each date: enough dollar volume and price, known momentum, and not the most illiquid of those."""
    ok = (F.col("adv20") >= min_adv) & (F.col("close") > min_price) & F.col("momentum").isNotNull() & F.col("amihud").isNotNull()
    limit = F.percentile("amihud", F.lit(amihud_keep)).over(Window.partitionBy("date"))
    return features.filter(ok).withColumn("amihud_limit", limit).filter(F.col("amihud") <= F.col("amihud_limit")).drop("amihud_limit")


def zscores(pool: DataFrame, columns: list[str], group: str, clip: float = 3.0, least: int = 5) -> DataFrame:
    """``z_c`` for each column c: winsorised, standardised in its group (small groups: in the whole date), clipped.

    All columns share two windows, of the date and of its groups, on one shuffle by date.
    """
    date, own = Window.partitionBy("date"), Window.partitionBy("date", group)
    limits = {f"__l_{c}": F.percentile(c, F.array(F.lit(0.01), F.lit(0.99))).over(date) for c in columns}
    pool = pool.withColumns(limits)
    x = {f"__x_{c}": F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), F.col(f"__l_{c}")[0]), F.col(f"__l_{c}")[1])) for c in columns}
    pool = pool.withColumns(x).drop(*limits)
    stats = {}
    for c in columns:
        v = f"__x_{c}"
        for tag, w in (("g", own), ("d", date)):
            stats |= {f"__n{tag}_{c}": F.count(v).over(w), f"__m{tag}_{c}": F.avg(v).over(w), f"__s{tag}_{c}": F.stddev_samp(v).over(w)}
    pool = pool.withColumns(stats)
    out = {}
    for c in columns:
        wide = F.col(f"__ng_{c}") >= least
        pick = lambda k, wide=wide, c=c: F.when(wide, F.col(f"__{k}g_{c}")).otherwise(F.col(f"__{k}d_{c}"))
        z = (F.col(f"__x_{c}") - pick("m")) / F.nullif(pick("s"), F.lit(0.0))
        out[f"z_{c}"] = F.when(z.isNotNull(), F.least(F.greatest(z, F.lit(-clip)), F.lit(clip)))
    return pool.withColumns(out).drop(*x, *stats)


def composite(pool: DataFrame, factors: dict[str, float], group: str) -> DataFrame:
    """Weighted sum of z-scores over the sum of all weights; a missing factor is neutral."""
    pool = zscores(pool, list(factors), group)
    total = sum(factors.values())
    score = sum((F.coalesce(F.col(f"z_{f}"), F.lit(0.0)) * w for f, w in factors.items()), F.lit(0.0)) / total
    return pool.withColumn("score", score)


def unheld_book(scored: DataFrame, group: str, n: int = 15, per_group: int = 4) -> DataFrame:
    """The best ``n`` names of each date with at most ``per_group`` of a group. Ranks tie-break by ticker."""
    own = Window.partitionBy("date", group).orderBy(F.desc("score"), "ticker")
    rank = Window.partitionBy("date").orderBy(F.desc("score"), "ticker")
    return scored.withColumn("group_rank", F.row_number().over(own)).filter(F.col("group_rank") <= per_group).withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= n)


def capped_weights(book: DataFrame, near_report: Column, cap: float = 0.1, near_cap: float = 0.06) -> DataFrame:
    """Equal weights under caps, in closed form: what the near-report cap cuts is shared by the others equally."""
    date = Window.partitionBy("date")
    book = book.withColumns({"__near": near_report, "__cap": F.when(near_report, near_cap).otherwise(cap)})
    n, k, room = F.count("*").over(date), F.count_if("__near").over(date), F.sum("__cap").over(date)
    weight = (
        F.when(room < 1, F.col("__cap") / room)
        .when((F.lit(1.0) / n <= near_cap) | (k == 0), F.lit(1.0) / n)
        .when(F.col("__near"), F.lit(near_cap))
        .otherwise((1 - near_cap * k) / (n - k))
    )
    return book.withColumn("weight", weight).drop("__near", "__cap")
