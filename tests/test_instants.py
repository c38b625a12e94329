from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from almagest.functions.instants import civil_days, day_text, instant_text, new_york_midnight, with_instant

NY = ZoneInfo("America/New_York")

CASES = [
    ("2020-11-03T17:18:05-05:00", "2020-11-03T22:18:05.000000Z"),
    (" 2020-07-13t22:41:58.125z ", "2020-07-13T22:41:58.125000Z"),
    ("20260421162836", "2026-04-21T20:28:36.000000Z"),
    ("20190107T124048Z", "2019-01-07T12:40:48.000000Z"),
    ("1510178318330", "2017-11-08T21:58:38.330000Z"),
    ("1560286884", "2019-06-11T21:01:24.000000Z"),
    ("01/02/2023 06:07 PM", "2023-01-02T23:07:00.000000Z"),
    ("01/02/2023 12:07 AM EST", "2023-01-02T05:07:00.000000Z"),
    ("2022-05-02 15:07 EST", "2022-05-02T20:07:00.000000Z"),
    ("Thu, 9 Mar 2023 21:59:43 GMT", "2023-03-09T21:59:43.000000Z"),
    ("Mon, 10 May 2021 17:44:54 -0400", "2021-05-10T21:44:54.000000Z"),
    ("1 Jun 2021 09:10 ET", "2021-06-01T13:10:00.000000Z"),
    ("2021-08-30 17:04:27 Europe/London", "2021-08-30T16:04:27.000000Z"),
    ("2021-08-30T17:04:27[Asia/Tokyo]", "2021-08-30T08:04:27.000000Z"),
    ("2021-07-13T17:14:39-03:30", "2021-07-13T20:44:39.000000Z"),
    ("Nov 15, 2019", "2019-11-15T21:00:00.000000Z"),
    ("2022/05/19", "2022-05-19T20:00:00.000000Z"),
    ("25-APR-2022", "2022-04-25T20:00:00.000000Z"),
    ("20250716", "2025-07-16T20:00:00.000000Z"),
    ("2024-03-10 02:05", None),
    ("2024-03-10 02:05 EST", "2024-03-10T07:05:00.000000Z"),
    ("2023-11-05 01:30 ET", None),
    ("2023-11-05 01:30 EDT", "2023-11-05T05:30:00.000000Z"),
    ("2023-03-26 01:30:00 Europe/London", None),
    ("2023-10-29 01:30:00 Europe/London", None),
    ("2023-02-29 10:00", None),
    ("2024-02-29 10:00", "2024-02-29T15:00:00.000000Z"),
    ("0000-00-00", None),
    ("2021-13-12", None),
    ("2020-11-00", None),
    ("2020-11-01 24:00", None),
    ("13/13/2020", None),
    ("01/02/2023 13:07 PM", None),
    ("1e99", None),
    ("TBD", None),
    ("", None),
    ("   ", None),
    (None, None),
    ("2021-08-30T17:04:27[Mars/Olympus]", None),
    ("x" * 100000, None),
    ("20211332256199", None),
]


def test_forms(spark):
    """Every form, texts of no meaning, nulls, blank and very long texts; extra and clashing columns stay."""
    df = spark.createDataFrame([(i, a, b, "keep") for i, (a, b) in enumerate(CASES)], "k int, v string, want string, y string")
    got = with_instant(df, "v", bare_hour=16).withColumn("got", instant_text(F.col("instant_us"))).collect()
    assert [(r.v, r.got) for r in got if r.got != r.want] == []
    assert {r.y for r in got} == {"keep"}
    assert with_instant(df.limit(0), "v").count() == 0


def test_days(spark):
    cases = [("2017-08-18T02:00:00Z", "2017-08-17"), ("August 1, 2022", "2022-08-01"), ("1/10/2022", "2022-01-10"), ("1523851200000", "2018-04-16"), ("2023-11-05 00:00:00", "2023-11-05"), ("-", None)]
    df = spark.createDataFrame(cases, "v string, want string")
    got = with_instant(df, "v", day_out="day").select("v", "want", day_text(F.col("day")).alias("got")).collect()
    assert [(r.v, r.got) for r in got if r.got != r.want] == []


def test_local_times_against_zoneinfo(spark):
    """Every quarter of an hour around clock changes: one instant if exactly one instant has that local time."""
    rows = []
    for zone in ("America/New_York", "Europe/London", "Europe/Berlin", "America/Los_Angeles"):
        z = ZoneInfo(zone)
        for year in (1999, 2006, 2007, 2020, 2024, 2027):
            for month in (3, 4, 10, 11):
                for quarter in range(0, 30 * 24, 1):
                    t = datetime(year, month, 1) + timedelta(hours=quarter, minutes=30)
                    found = {u for fold in (0, 1) if (u := t.replace(tzinfo=z, fold=fold).astimezone(timezone.utc)).astimezone(z).replace(tzinfo=None) == t}
                    rows.append((f"{t:%Y-%m-%d %H:%M} {zone}", int(found.pop().timestamp()) * 1000000 if len(found) == 1 else None))
    df = spark.createDataFrame(rows, "v string, want long")
    wrong = with_instant(df, "v").filter(~F.col("want").eqNullSafe(F.col("instant_us")))
    assert wrong.take(3) == []


def test_civil_days(spark):
    df = spark.range(-30000, 60000, 7).select(F.date_from_unix_date(F.col("id").cast("int")).alias("d"), "id")
    wrong = df.filter(civil_days(F.year("d").cast("long"), F.month("d"), F.dayofmonth("d")) != F.col("id"))
    assert wrong.count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="0123456789-/:T Z+aeptJn,", max_size=25), min_size=1, max_size=50))
def test_any_text_is_handled(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    assert with_instant(df, "v", day_out="day").count() == len(texts)


if __name__ == "__main__":
    pytest.main([__file__, "-x", "-q"])


def test_days_and_midnights_before_2007(spark):
    """American clocks changed in April and October then; a date alone denotes a day in any year."""
    import datetime as dt

    ny = NY
    days = [dt.date(y, m, d) for y in (1990, 1999, 2006, 2007, 2024) for m in (3, 4, 10, 11) for d in range(1, 31)]
    df = spark.createDataFrame([(d.toordinal() - 719163,) for d in days], "day int").withColumn("us", new_york_midnight(F.col("day")))
    want = [int(dt.datetime(d.year, d.month, d.day, tzinfo=ny).timestamp() * 1e6) for d in days]
    assert [r.us for r in df.collect()] == want
    texts = [f"{d} 04:30:00Z" for d in days] + ["1994-05-02", "1950-01-31", "1994-02-30"]
    got = [r.day for r in with_instant(spark.createDataFrame([(t,) for t in texts], "t string"), "t", day_out="day").collect()]
    local = [dt.datetime(d.year, d.month, d.day, 4, 30, tzinfo=dt.timezone.utc).astimezone(ny).date().toordinal() - 719163 for d in days]
    assert got == local + [dt.date(1994, 5, 2).toordinal() - 719163, dt.date(1950, 1, 31).toordinal() - 719163, None]
