"""Fundamentals as they were visible at each date: when reports became known, trailing years, quality and value."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from almagest.operators import asof, nearest

# Names under which vendors deliver a field, in order of preference.
CANDIDATES = {
    "eps": ["is_eps", "eps", "basic_eps", "diluted_eps", "is_diluted_eps", "eps_basic", "eps_diluted", "trail_12m_eps", "is_basic_eps_cont_ops"],
    "sales": ["sales_rev_turn", "revenue", "sales", "total_revenue"],
    "gross_profit": ["gross_profit", "is_gross_profit"],
    "ebit": ["ebit", "is_oper_inc", "operating_income", "oper_inc"],
    "net_income": ["net_income", "is_net_income", "ni"],
    "fcf": ["cf_free_cash_flow", "free_cash_flow", "fcf"],
    "fcf_per_share": ["fcf_per_share", "free_cash_flow_per_sh", "cf_free_cash_flow_per_sh"],
    "ebitda": ["ebitda", "is_ebitda"],
    "total_assets": ["bs_tot_asset", "total_assets", "tot_assets"],
    "equity": ["equity", "shareholders_equity", "total_equity", "tot_common_eqy", "bs_tot_eqy", "total_shareholders_equity"],
    "net_debt": ["net_debt", "bs_net_debt"],
    "gross_margin": ["gross_margin", "gross_margin_pct"],
}
#: Days from a period's end to its filing, least and most; days after which a period without filing counts as known.
EARLIEST, LATEST, DEFAULT = 6, 120, 60
#: Days that the four reports of a year span at most; days for which a surprise counts as fresh.
SPAN, FRESH = 300, 91
DAY_US = 86_400_000_000


def resolve_columns(columns: Iterable[str]) -> dict[str, str]:
    """Field to column, for the fields that are there under some name; case doesn't count, earlier names go first."""
    there = {c.lower(): c for c in reversed(list(columns))}
    found = {field: next((there[n] for n in names if n in there), None) for field, names in CANDIDATES.items()}
    return {field: c for field, c in found.items() if c is not None}


def knowable(reports: DataFrame, filings: DataFrame) -> DataFrame:
    """Reports (``ticker, pe``) with ``knowable``, the date from which they may be used, and ``by``, what says so.

    A filing (``ticker, filing_day, period_end``) that names the period, at most ``LATEST`` days after its end, makes it
    known on the day after ('period'). Else the nearest filing ``EARLIEST`` to ``LATEST`` days after the end does
    ('near'), else it is known ``DEFAULT`` days after the end ('default'). Repeated reports keep their rows; null
    tickers or ends give the default, or null. Filings with null tickers or days count for nothing.
    """
    filings = filings.select("ticker", F.col("filing_day").cast("date").alias("filing_day"), F.col("period_end").cast("date").alias("pe")).dropna(subset=["ticker", "filing_day"])
    named = filings.filter(F.datediff("filing_day", "pe") <= LATEST).groupBy("ticker", "pe").agg(F.min("filing_day").alias("__named"))
    rows = reports.drop("knowable", "by").join(named, ["ticker", "pe"], "left")
    todo = rows.filter("__named is null").select("ticker", "pe").distinct()
    near = nearest.nearest(todo, filings.withColumn("day", F.unix_date("filing_day")), "ticker", "pe", "filing_day", "day", EARLIEST, LATEST)
    rows = rows.join(near.select("ticker", "pe", F.date_from_unix_date(F.col("day").cast("int")).alias("__near")), ["ticker", "pe"], "left")
    day = F.coalesce(F.date_add("__named", 1), F.date_add("__near", 1), F.date_add("pe", DEFAULT))
    by = F.when(F.col("__named").isNotNull(), "period").when(F.col("__near").isNotNull(), "near").otherwise("default")
    return rows.withColumns({"knowable": day, "by": by}).drop("__named", "__near")


def trailing_states(reports: DataFrame, flows: Sequence[str] = (), ratios: Sequence[str] = (), stocks: Sequence[str] = ()) -> DataFrame:
    """What is known of each ticker from each date on which something became known: one row per ticker and such date.

    ``reports`` has one row per ticker and period (``ticker, pe, knowable``). Of the reports visible at ``known`` the
    four latest make a year if there are four within ``SPAN`` days: ``ttm_f`` of a flow is their sum if all have it,
    ``ttm_r`` of a ratio their mean if three have it. ``latest_s`` is the value of the latest report. Also ``pe``,
    ``first_pe`` (earliest of the four) and ``public``, since when the latest has been known.

    Each report meets the dates of its own ticker only, so rows grow with the square of the periods a ticker has (tens),
    not with tickers. A later report may be known before an earlier one; what is visible is taken at each date.
    """
    seen = reports.dropna(subset=["ticker", "pe", "knowable"])
    at = seen.select("ticker", F.col("knowable").alias("known")).distinct()
    rows = at.join(seen, "ticker").filter("knowable <= known")
    rank = F.row_number().over(Window.partitionBy("ticker", "known").orderBy(F.desc("pe")))
    four = rows.withColumn("__k", rank).filter("__k <= 4")
    first = lambda c: F.max(F.when(F.col("__k") == 1, F.col(c)))
    full = (F.count("*") == 4) & (F.datediff(F.max("pe"), F.min("pe")) <= SPAN)
    return four.groupBy("ticker", "known").agg(
        F.max("pe").alias("pe"), F.min("pe").alias("first_pe"), first("knowable").alias("public"),
        *[F.when(full & (F.count(c) == 4), F.sum(c)).alias(f"ttm_{c}") for c in flows],
        *[F.when(full & (F.count(c) >= 3), F.avg(c)).alias(f"ttm_{c}") for c in ratios],
        *[first(c).alias(f"latest_{c}") for c in stocks],
    )


def at_dates(rows: DataFrame, states: DataFrame, values: Sequence[str]) -> DataFrame:
    """Rows of ``ticker, date`` with the ``values`` of the state of their ticker in force at the end of the date.

    Rows of tickers of which nothing was known yet are left out. The join is on ticker and time node.
    """
    us = lambda c: F.unix_date(c).cast("long") * DAY_US
    intervals = asof.validity(states.withColumn("__us", us("known")), "ticker", "__us", [F.col("__us")], [v for v in values])
    return asof.known_at(rows.withColumn("__at", us("date")), intervals, "ticker", "__at").drop("__at")


def safe_ratio(a: str, b: str) -> Column:
    """a over a positive b, else null."""
    return F.when(F.col(b) > 0, F.col(a) / F.col(b))


def quality(df: DataFrame, by: str = "date") -> DataFrame:
    """``df`` with ``quality``, by the first definition that its columns allow, and ``quality_def``.

    Gross profit over assets; income over equity; or the mean of what is there of gross margin, operating margin,
    cash-flow margin and low leverage as shares of ranks among the rows of ``by`` less a half, where a row has two of
    them at least. Without two of these columns all are null.
    """
    have = set(df.columns)
    if {"gross_profit", "total_assets"} <= have:
        return df.withColumns({"quality": safe_ratio("gross_profit", "total_assets"), "quality_def": F.lit("gross_profit_assets")})
    if {"net_income", "equity"} <= have:
        return df.withColumns({"quality": safe_ratio("net_income", "equity"), "quality_def": F.lit("roe")})
    parts = {}
    if "gross_margin" in have:
        parts["gross_margin"] = F.col("gross_margin")
    for name, a, b, sign in (("oper_margin", "ebit", "sales", 1), ("fcf_margin", "fcf", "sales", 1), ("low_leverage", "net_debt", "ebitda", -1)):
        if {a, b} <= have:
            parts[name] = sign * safe_ratio(a, b)
    if len(parts) < 2:
        return df.withColumns({"quality": F.lit(None).cast("double"), "quality_def": F.lit("unavailable")})
    cells = [f"__q_{k}" for k in parts]
    df = df.withColumns(dict(zip(cells, parts.values())))
    share = {f"__r_{c}": F.when(F.col(c).isNotNull(), (F.rank().over(Window.partitionBy(by, F.col(c).isNull()).orderBy(c)) + (F.count("*").over(Window.partitionBy(by, c)) - 1) / 2.0) / F.count(c).over(Window.partitionBy(by)) - 0.5) for c in cells}
    df = df.withColumns(share)
    count = reduce(Column.__add__, [F.col(c).isNotNull().cast("int") for c in cells])
    total = reduce(Column.__add__, [F.coalesce(F.col(c), F.lit(0.0)) for c in share])
    return df.withColumns({"quality": F.when(count >= 2, total / count), "quality_def": F.lit("margin_blend:" + "+".join(parts))}).drop(*cells, *share)


def value(df: DataFrame, price: str) -> DataFrame:
    """``df`` with ``value``: earnings over price, or free cash flow per share over it where there are no earnings at all.

    Losses count as zero, so that loss-makers rank last together. A price of zero or less gives null.
    """
    base = next((c for c in ("eps", "fcf_per_share") if c in df.columns), None)
    if base is None:
        return df.withColumns({"value": F.lit(None).cast("double"), "value_def": F.lit("unavailable")})
    name = "earnings_yield" if base == "eps" else "fcf_yield"
    return df.withColumns({"value": F.greatest(safe_ratio(base, price), F.when(F.col(base).isNotNull() & (F.col(price) > 0), 0.0)), "value_def": F.lit(name)})


def split_inside(states: DataFrame, splits: DataFrame, at: str = "date") -> DataFrame:
    """``states`` (``ticker, first_pe`` and a date ``at``) with ``split_inside``: a split (``ticker, ex_date``) since the first quarter began.

    Splits of a ticker travel as one short array.
    """
    dates = splits.select("ticker", F.col("ex_date").cast("date").alias("ex_date")).dropna().groupBy("ticker").agg(F.collect_set("ex_date").alias("__ex"))
    inside = F.exists("__ex", lambda d: (d >= F.date_sub("first_pe", 92)) & (d <= F.col(at)))
    return states.join(dates, "ticker", "left").withColumn("split_inside", F.coalesce(inside, F.lit(False))).drop("__ex")
