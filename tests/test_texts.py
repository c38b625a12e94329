import datetime as dt

from pyspark.sql import functions as F

from almagest.functions.texts import date_in_name, is_put, window_start


def test_dates_in_names(spark):
    rows = [("s3a://b/2020-01-01/bars_2024-03-05.parquet", dt.date(2024, 3, 5)), ("x/20231231.csv", dt.date(2023, 12, 31)), ("bars-20240230.csv", None), ("/2024-03-05/bars.csv", None), ("id_1202403051.csv", None), ("", None), (None, None)]
    got = [r.d for r in spark.createDataFrame(rows, "p string, want date").select(date_in_name(F.col("p")).alias("d")).collect()]
    assert got == [w for _, w in rows]


def test_puts(spark):
    rows = [("AAPL  240119P00150000", True), ("spy240119c00470000", False), ("AAPL", None), ("", None), (None, None), ("AAPL 240119X00150000", None)]
    assert [r.p for r in spark.createDataFrame(rows, "s string, want boolean").select(is_put(F.col("s")).alias("p")).collect()] == [w for _, w in rows]


def test_window_start(spark):
    df = spark.createDataFrame([(dt.date(2024, 6, 28),), (None,)], "d date").select(window_start(F.col("d"), 252).alias("s"))
    assert [r.s for r in df.collect()] == [dt.date(2024, 6, 28) - dt.timedelta(388), None]
