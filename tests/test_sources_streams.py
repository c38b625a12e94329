import datetime as dt

import pytest

from almagest.sources.panels import MissingYear, kept, read_through, write_lines
from almagest.streaming.events import first_deliveries, held_flags, hourly


def test_years_are_fetched_once_and_when_stale(spark, tmp_path):
    calls = []

    def fetch(a, b):
        calls.append((a, b))
        return spark.createDataFrame([("A", a + dt.timedelta(k), 1.0) for k in range(0, (b - a).days + 1, 30)] + [("A", b, 2.0)], "ticker string, date date, close double").distinct()

    path = str(tmp_path / "panel")
    assert read_through(spark, path, dt.date(2020, 6, 1), dt.date(2021, 3, 1), fetch).filter("date < '2020-06-01'").count() == 0
    assert calls == [(dt.date(2020, 1, 1), dt.date(2020, 12, 31)), (dt.date(2021, 1, 1), dt.date(2021, 3, 1))]
    read_through(spark, path, dt.date(2020, 6, 1), dt.date(2021, 3, 4), fetch)
    assert len(calls) == 2
    read_through(spark, path, dt.date(2020, 6, 1), dt.date(2021, 4, 1), fetch)
    assert calls[2:] == [(dt.date(2021, 1, 1), dt.date(2021, 4, 1))]
    with pytest.raises(MissingYear):
        kept(spark, path, dt.date(2019, 1, 1), dt.date(2020, 1, 1))


def test_lines(spark, tmp_path):
    write_lines(spark.range(3), str(tmp_path / "x"))
    assert spark.read.json(str(tmp_path / "x")).count() == 3


def test_stream_equals_batch(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [(i % 40, t + dt.timedelta(minutes=7 * (i % 40)), "a" if i % 3 else "b", float(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double")
    df.write.parquet(str(tmp_path / "in"))
    stream = first_deliveries(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("first_once").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("first_once").count() == 40 == first_deliveries(df).count()
    stream = hourly(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("by_hour").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("by_hour").collect())) == sorted(map(tuple, hourly(df).collect()))


def test_flags_with_memory(spark, tmp_path):
    raw = [0, 1, 0, 0, 1, 0, 1, 0, 0, 0]
    for k, part in enumerate((raw[:5], raw[5:])):
        rows = [("a", dt.date(2024, 1, 1) + dt.timedelta(5 * k + i), bool(x)) for i, x in enumerate(part)]
        spark.createDataFrame(rows, "name string, date date, raw boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = held_flags(spark.readStream.schema("name string, date date, raw boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("flags").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = [r.flag for r in spark.table("flags").orderBy("date").collect()]
    assert got == [False, True, True, False, True, True, True, True, False, False]
