"""Small readings of names and symbols, and spans of calendar days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_in_name(path: Column) -> Column:
    """The first date written in a file's name as yyyy-MM-dd or yyyyMMdd, or null; folders don't count."""
    name = F.element_at(F.split(path, "/"), -1)
    digits = F.regexp_extract(name, r"(?<!\d)(\d{4})-?(\d{2})-?(\d{2})(?!\d)", 0)
    return F.when(digits != "", F.try_to_timestamp(F.replace(digits, F.lit("-"), F.lit("")), F.lit("yyyyMMdd")).cast("date"))


def is_put(symbol: Column) -> Column:
    """Whether a listed option's symbol (root, yyMMdd, C or P, strike) is of a put; null for other text."""
    kind = F.regexp_extract(F.upper(F.trim(symbol)), r"^[A-Z][A-Z0-9.]{0,5}\s*\d{6}([CP])\d{8}$", 1)
    return F.when(kind != "", kind == "P")


def window_start(day: Column, trading_days: int) -> Column:
    """A calendar day that surely lies so many trading days before: half as many again, and ten."""
    return F.date_sub(day, int(1.5 * trading_days + 10))
