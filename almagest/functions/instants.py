"""Timestamps written in many forms and zones, brought to one UTC instant.

One regular expression holds every form as an alternation with named groups. It runs once per value: a replacement
that names all groups turns the text into separated parts (a group of another alternative adds nothing). What follows
is integer arithmetic on those parts inside generated code: calendar ranges, days since 1970, zone rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Month names by their first three letters, in calendar order.
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"

# Abbreviations and zone names with their minutes east of UTC in winter and the rule for summer.
FIXED, AMERICA, EUROPE = 0, 1, 2
ZONES = {
    "z": (0, FIXED),
    "utc": (0, FIXED),
    "ut": (0, FIXED),
    "gmt": (0, FIXED),
    "est": (-300, FIXED),
    "edt": (-240, FIXED),
    "cst": (-360, FIXED),
    "cdt": (-300, FIXED),
    "mst": (-420, FIXED),
    "mdt": (-360, FIXED),
    "pst": (-480, FIXED),
    "pdt": (-420, FIXED),
    "bst": (60, FIXED),
    "cet": (60, FIXED),
    "cest": (120, FIXED),
    "jst": (540, FIXED),
    "hkt": (480, FIXED),
    "et": (-300, AMERICA),
    "ct": (-360, AMERICA),
    "mt": (-420, AMERICA),
    "pt": (-480, AMERICA),
    "us/eastern": (-300, AMERICA),
    "us/central": (-360, AMERICA),
    "us/mountain": (-420, AMERICA),
    "us/pacific": (-480, AMERICA),
    "america/new_york": (-300, AMERICA),
    "america/toronto": (-300, AMERICA),
    "america/chicago": (-360, AMERICA),
    "america/denver": (-420, AMERICA),
    "america/los_angeles": (-480, AMERICA),
    "europe/london": (0, EUROPE),
    "europe/dublin": (0, EUROPE),
    "europe/lisbon": (0, EUROPE),
    "europe/paris": (60, EUROPE),
    "europe/berlin": (60, EUROPE),
    "europe/madrid": (60, EUROPE),
    "europe/rome": (60, EUROPE),
    "europe/amsterdam": (60, EUROPE),
    "europe/brussels": (60, EUROPE),
    "europe/vienna": (60, EUROPE),
    "europe/zurich": (60, EUROPE),
    "europe/stockholm": (60, EUROPE),
    "europe/athens": (120, EUROPE),
    "europe/helsinki": (120, EUROPE),
    "etc/utc": (0, FIXED),
    "asia/tokyo": (540, FIXED),
    "asia/seoul": (540, FIXED),
    "asia/shanghai": (480, FIXED),
    "asia/hong_kong": (480, FIXED),
    "asia/singapore": (480, FIXED),
    "asia/kolkata": (330, FIXED),
    "asia/dubai": (240, FIXED),
}
HOME = "america/new_york"
#: The summer rules of ZONES hold from this year on; earlier local times in such zones denote nothing here.
FIRST_RULED_YEAR, FIRST_AMERICAN = 1996, 2007

_MONTH = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
_WEEKDAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+)?"
_OFFSET = r"[+-]\d{2}(?::?\d{2})?"
_ZONE = rf"(?:(?<o>{_OFFSET})(?:\[[a-z]+(?:/[a-z_]+)+\])?|\[?(?<z>[a-z]{{1,4}}|[a-z]+(?:/[a-z_]+)+)\]?)"
_CLOCK = r"(?<h>\d{1,2}):(?<i>\d{2})(?::(?<s>\d{2})(?:[.,](?<f>\d{1,9}))?)?(?:\s*(?<p>[ap])\.?m\.?(?![a-z]))?"
_DATES = (
    r"(?<y1>\d{4})(?<g1>[-/.])(?<m1>\d{1,2})\k<g1>(?<d1>\d{1,2})",
    r"(?<m2>\d{1,2})/(?<d2>\d{1,2})/(?<y2>\d{4})",
    rf"{_WEEKDAY}(?<d3>\d{{1,2}})(?<g3>[-\s])(?<m3>{_MONTH})\.?\k<g3>(?<y3>\d{{4}})",
    rf"{_WEEKDAY}(?<m4>{_MONTH})\.?\s+(?<d4>\d{{1,2}}),?\s+(?<y4>\d{{4}})",
)
_COMPACT = r"(?<y5>\d{4})(?<m5>\d{2})(?<d5>\d{2})(?:t?(?<h5>\d{2})(?<i5>\d{2})(?:(?<s5>\d{2})(?:\.(?<f5>\d{1,9}))?)?"
PATTERN = (
    rf"(?i)^\s*(?:(?:{'|'.join(_DATES)})(?:(?:t|\s+|,\s*|\s+at\s+){_CLOCK}(?:\s*{_ZONE})?)?"
    rf"|{_COMPACT}\s*(?:(?<o5>{_OFFSET})|(?<z5>z|utc|gmt))?)?"
    r"|(?<n6>\d{9,11}|\d{13}))\s*$"
)
_CUT = "\u0001"
_PARTS = {
    "y": ("y1", "y2", "y3", "y4", "y5"),
    "m": ("m1", "m2", "m3", "m4", "m5"),
    "d": ("d1", "d2", "d3", "d4", "d5"),
    "h": ("h", "h5"),
    "i": ("i", "i5"),
    "s": ("s", "s5"),
    "f": ("f", "f5"),
    "p": ("p",),
    "o": ("o", "o5"),
    "z": ("z", "z5"),
    "n": ("n6",),
}
_REPLACEMENT = "".join(_CUT + "".join(f"${{{g}}}" for g in groups) for groups in _PARTS.values())


def civil_days(y: Column, m: Column, d: Column | int) -> Column:
    """Days from 1970-01-01 to a date of the Gregorian calendar, years from 1 on. No range is checked."""
    early = F.when(m <= 2, 1).otherwise(0)
    year = y - early
    month = m - 3 + 12 * early
    return year * 365 + _div(year, 4) - _div(year, 100) + _div(year, 400) + _div(month * 153 + 2, 5) + d - 719469


def _div(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(b)).cast("long")


def _sunday(day: Column) -> Column:
    """The first Sunday on or after a day number (day 0 was a Thursday)."""
    return day + F.pmod(F.lit(7) - F.pmod(day + 4, F.lit(7)), F.lit(7))


def _zone(key: Column, at: int) -> Column:
    known = F.create_map(*[F.lit(x) for k, v in ZONES.items() for x in (k, v[at])])
    return F.try_element_at(known, key)


def _american(year: Column, march: Column) -> tuple[Column, Column]:
    """Days on which clocks go forward and back in America, by the rule of the year (that of 1987 before 2007)."""
    now = year >= FIRST_AMERICAN
    return _sunday(march + F.when(now, 7).otherwise(31)), _sunday(march + F.when(now, 245).otherwise(238))


def new_york_day(seconds: Column, year: Column) -> Column:
    """Day number in New York of ``seconds`` since 1970, of the UTC year ``year`` (1987 or later)."""
    spring, autumn = _american(year, civil_days(year, F.lit(3), 1))
    summer = (seconds >= spring * 86400 + 7 * 3600) & (seconds < autumn * 86400 + 6 * 3600)
    return _div(seconds - F.when(summer, 4 * 3600).otherwise(5 * 3600), 86400)


def _step(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with computed columns that the optimizer keeps as a step of their own.

    A filter on a later column would be pushed through plain projections by writing out all they are made of, with the
    regular expression once for each use. It isn't pushed through a generator, here of one row.
    """
    return df.drop(*columns).select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def with_instant(
    df: DataFrame, text: str, out: str = "instant_us", bare_hour: Column | int = 0, home: str = HOME, day_out: str | None = None
) -> DataFrame:
    """``df`` with column ``out``: microseconds since 1970 UTC that ``text`` denotes, or null.

    Text without a zone, and ET, mean ``home``. A written offset or abbreviation holds as written. A date without a
    time means ``bare_hour`` o'clock; other parts not written are zero. Plain numbers of 8, 12 or 14 digits are dates
    or dates with times; of 9 to 11 digits seconds, of 13 milliseconds since 1970. Null for text of any other form,
    dates or times out of range, unknown zones, and local times that a clock change skips or repeats (before 1996
    also all local times in zones with summer time, whose older rules are not held here). Slashed dates with
    the year last are month first.

    ``day_out`` adds the New York day number (days since 1970): the written date where no zone is written, else the
    New York date at the instant. A date without time and zone denotes a day whatever the year.

    Nulls and blank text give null. Existing columns stay; names starting with ``__t`` are taken by the operator.
    Columns ``out`` and ``day_out`` replace columns of those names.
    """
    part = {name: F.try_element_at(F.col("__tparts"), F.lit(k + 2)) for k, name in enumerate(_PARTS)}
    # Parts hold digits or nothing, so a plain cast does; a failed try_cast would cost an exception for each empty part.
    digits = lambda c, kind="int": F.when((c != "") & (c < ":"), c.cast(kind))
    number = lambda name: digits(part[name])
    df = _step(df, {"__tmarked": F.regexp_replace(F.col(text), PATTERN, _REPLACEMENT)})
    df = _step(df, {"__tparts": F.when(F.col("__tmarked").startswith(_CUT), F.split("__tmarked", _CUT))})
    name = F.lower(F.substring(part["m"], 1, 3))
    df = _step(
        df,
        {
            "__ty": number("y").cast("long"),
            "__tw": F.coalesce(number("m"), F.nullif(F.instr(F.lit(MONTHS), name), F.lit(0)) + 2) + 0,
            "__tnamed": number("m").isNull(),
            "__td": number("d"),
            "__tbare": part["h"] == "",
            "__th": F.coalesce(number("h"), F.lit(bare_hour) if isinstance(bare_hour, int) else bare_hour),
            "__ti": F.coalesce(number("i"), F.lit(0)),
            "__ts": F.coalesce(number("s"), F.lit(0)),
            "__tf": F.rpad(part["f"], 6, "0").cast("int"),
            "__tp": F.lower(part["p"]),
            "__to": F.replace(part["o"], F.lit(":"), F.lit("")),
            "__tz": F.lower(part["z"]),
            "__tn": digits(part["n"], "long"),
            "__tlong": F.length(part["n"]) == 13,
        },
    )
    df = _step(df, {"__tm": F.when(F.col("__tnamed"), _div(F.col("__tw"), 3).cast("int")).otherwise(F.col("__tw"))})
    y, m, d, h = (F.col(f"__t{x}") for x in "ymdh")
    leap = (F.pmod(y, F.lit(4)) == 0) & ((F.pmod(y, F.lit(100)) != 0) | (F.pmod(y, F.lit(400)) == 0))
    month_days = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    half = F.col("__tp").isin("a", "p")
    fits = (
        (y >= 1) & m.between(1, 12) & (d >= 1) & (d <= month_days) & (F.col("__ti") <= 59) & (F.col("__ts") <= 59)
        & F.when(half, h.between(1, 12)).otherwise(h <= 23)
    )
    hour = F.when(half, F.pmod(h, F.lit(12)) + F.when(F.col("__tp") == "p", 12).otherwise(0)).otherwise(h)
    minutes = digits(F.substring("__to", 4, 2))
    offset = digits(F.substring("__to", 2, 2)) * 60 + F.coalesce(minutes, F.lit(0))
    zone = F.when(F.col("__tz") == "", F.lit(home)).otherwise(F.col("__tz"))
    df = _step(
        df,
        {
            "__tday": F.when(fits, civil_days(y, m, d)),
            "__tmin": hour * 60 + F.col("__ti"),
            "__toff": F.when(
                (F.col("__to") != "") & (offset <= 18 * 60) & (F.coalesce(minutes, F.lit(0)) < 60),
                F.when(F.col("__to").startswith("-"), -offset).otherwise(offset),
            ),
            "__tbase": F.when(F.col("__to") == "", _zone(zone, 0)),
            "__trule": F.when(F.col("__to") == "", _zone(zone, 1)),
            "__tmarch": civil_days(y, F.lit(3), 1),
        },
    )
    march, local, base = F.col("__tmarch"), F.col("__tday") * 1440 + F.col("__tmin"), F.col("__tbase")
    forward, back = _american(y, march)
    spring = F.when(F.col("__trule") == AMERICA, forward * 1440 + 120).otherwise(_sunday(march + 24) * 1440 + 60 + base)
    autumn = F.when(F.col("__trule") == AMERICA, back * 1440 + 60).otherwise(_sunday(march + 238) * 1440 + 60 + base)
    df = _step(df, {"__tlocal": local, "__tspring": spring, "__tautumn": autumn})
    t = F.col("__tlocal")
    ruled = (
        F.when(F.col("__trule") == FIXED, base)
        .when(y < FIRST_RULED_YEAR, F.lit(None).cast("int"))
        .when((t < F.col("__tspring")) | (t >= F.col("__tautumn") + 60), base)
        .when((t >= F.col("__tspring") + 60) & (t < F.col("__tautumn")), base + 60)
    )
    written = ((t - F.coalesce(F.col("__toff"), ruled)) * 60 + F.col("__ts")) * 1000000 + F.col("__tf")
    plain = F.col("__tn") * F.when(F.col("__tlong"), 1000).otherwise(1000000)
    df = _step(df, {out: F.coalesce(written, plain).cast("long")})
    if day_out:
        seconds = _div(F.col(out), 1000000)
        # A day's UTC year is found from its day number: 400 years have 146097 days.
        df = _step(df, {"__tsec": seconds, "__tyear": F.year(F.date_from_unix_date(_div(seconds, 86400).cast("int"))).cast("long")})
        homely = (F.col("__tz") == "") & (F.col("__to") == "") & F.col("__tn").isNull()
        day = (
            F.when(homely & F.col("__tbare"), F.col("__tday"))
            .when(F.col(out).isNull(), None)
            .when(homely, F.col("__tday"))
            .otherwise(new_york_day(F.col("__tsec"), F.col("__tyear")))
            .cast("int")
        )
        df = _step(df, {day_out: day})
    return df.drop(*[c for c in df.columns if c.startswith("__t")])


def instant_text(us: Column) -> Column:
    """'yyyy-MM-ddTHH:mm:ss.SSSSSSZ' of microseconds since 1970; independent of the session's zone."""
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    day, within = _div(us, 86400000000), F.pmod(us, F.lit(86400000000))
    return F.concat(
        F.date_from_unix_date(day.cast("int")).cast("string"), F.lit("T"),
        two(_div(within, 3600000000)), F.lit(":"), two(F.pmod(_div(within, 60000000), F.lit(60))), F.lit(":"),
        two(F.pmod(_div(within, 1000000), F.lit(60))), F.lit("."), F.lpad(F.pmod(within, F.lit(1000000)).cast("string"), 6, "0"), F.lit("Z"),
    )


def new_york_midnight(day: Column) -> Column:
    """Microseconds since 1970 at which a day (1987 or later) begins in New York. Clocks change later on a day."""
    year = F.year(F.date_from_unix_date(day.cast("int"))).cast("long")
    spring, autumn = _american(year, civil_days(year, F.lit(3), 1))
    summer = (day > spring) & (day <= autumn)
    return (day.cast("long") * 86400 + F.when(summer, 4 * 3600).otherwise(5 * 3600)) * 1000000


def day_text(day: Column) -> Column:
    """'yyyy-MM-dd' of a day number."""
    return F.date_from_unix_date(day.cast("int")).cast("string")
