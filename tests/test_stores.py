import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from almagest.operators import features as fx
from almagest.operators import reports
from almagest.sources import stores, synthetic


def test_universe(spark, tmp_path):
    (tmp_path / "u.txt").write_text("AAA\n\n# note\n BBB \nAAA\n")
    df = stores.universe(spark, str(tmp_path / "u.txt"))
    assert sorted(r.ticker for r in df.collect()) == ["AAA", "BBB"]
    stores.write_universe(df, str(tmp_path / "out"))
    assert sorted(r.ticker for r in stores.universe(spark, str(tmp_path / "out")).collect()) == ["AAA", "BBB"]


def test_json_there_and_back(spark, tmp_path):
    value = {"meta": {"k": 3, "x": np.float64(0.5)}, "years": {2024: {"move": np.array([[0.9, 0.1], [0.2, 0.8]])}}}
    path = str(tmp_path / "m.json")
    assert stores.load_json(spark, path) is None
    stores.save_json(spark, value, path)
    got = stores.load_json(spark, path)
    assert got["meta"] == {"k": 3, "x": 0.5} and np.allclose(got["years"]["2024"]["move"], value["years"][2024]["move"])
    (tmp_path / "bad.json").write_text("{")
    assert stores.load_json(spark, str(tmp_path / "bad.json")) is None
    assert stores.changed({"a": {"x": 1, "y": 2}}, {"a": {"x": 5}, "b": {"z": 1}}) == {"a": {"x": 5, "y": 2}, "b": {"z": 1}}


def test_a_kept_book_isnt_computed_again(spark, tmp_path):
    calls = []
    make = lambda: calls.append(1) or spark.createDataFrame([("A", 1.0)], "ticker string, weight double")
    for _ in range(2):
        assert stores.kept_book(spark, str(tmp_path), "v1", "2024-01-05", make).collect()[0].ticker == "A"
    stores.kept_book(spark, str(tmp_path), "v2", "2024-01-05", make)
    assert len(calls) == 2
    stores.write_csv(make(), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).collect()[0].weight == "1.0"


def test_made_up_market(spark):
    made = synthetic.build(spark, 12, "2019-01-02", "2021-12-31")
    bars = made["stocks_daily"].toPandas().sort_values(["ticker", "date"])
    again = synthetic.build(spark, 12, "2019-01-02", "2021-12-31")["stocks_daily"].repartition(7).toPandas().sort_values(["ticker", "date"])
    assert np.allclose(bars["close"], again["close"]) and bars.groupby("ticker").size().nunique() == 1
    # The signal moves the days after it.
    j = bars.merge(made["state_vector"].toPandas(), on=["ticker", "date"])
    j["ret"] = j.groupby("ticker")["close"].pct_change()
    j["i"] = j.groupby("ticker").cumcount()
    on = j[(j.i % 10 < 5) & (j.ticker != "T005")].dropna()
    assert np.corrcoef(on["ret"], on["guidance_range_velocity"])[0, 1] > 0.02
    # The split shows, is found and is taken out.
    splits = made["corporate_actions"].select("ticker", "ex_date", F.col("value").alias("ratio"))
    factors = reports.split_factors(made["stocks_daily"], splits)
    assert [(r.ticker, r.applied) for r in factors.collect()] == [("T005", True)]
    adjusted = reports.split_adjust(made["stocks_daily"], factors).filter("ticker = 'T005'").toPandas().sort_values("date")
    assert adjusted["close_adj"].pct_change().abs().max() < 0.2 and adjusted["volume_adj"].nunique() == 1
    assert made["fundamentals_actuals"].count() == made["report_calendar_us"].count() == 12 * 12
    assert made["reference_tickers"].count() == 12 and made["index_daily"].filter(F.col("close") > 0).count() == len(bars) // 12


def test_given_market_needs_coverage(spark):
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(d), d, 0.01, 0.02 if d != 3 and d < 30 else None) for d in range(60)]
    daily = spark.createDataFrame(rows, "date date, day_idx long, mkt double, m double")
    got = {r.day_idx: (r.given_used, r.market) for r in fx.market_or_given(daily, "m").collect()}
    assert got[0] == (True, 0.02) and got[3] == (False, 0.01) and got[20] == (True, 0.02) and got[59] == (False, 0.01)
    assert got[30] == (True, 0.0)
