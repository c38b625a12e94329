"""Models of a year know nothing of it, and the future changes no probability."""

import datetime as dt

import numpy as np
import pandas as pd

from almagest.operators import books, models
from almagest.plans import extras, reports


def indices():
    rng = np.random.default_rng(5)
    days = [d for d in (dt.date(2023, 1, 2) + dt.timedelta(i) for i in range(1090)) if d.weekday() < 5]
    rows = []
    for name in ("A", "B"):
        sd = np.where((np.arange(len(days)) // 60) % 4 == 3, 0.03, 0.008)
        rows += list(zip([name] * len(days), days, 100 * np.cumprod(1 + rng.normal(0.0003, sd))))
    return pd.DataFrame(rows, columns=["index_name", "date", "close"])


def test_walk_forward(spark, tmp_path):
    df = indices()
    for name, part in (("all", df), ("cut", df[df["date"] <= dt.date(2025, 5, 16)])):
        spark.createDataFrame(part, "index_name string, date date, close double").write.parquet(f"{tmp_path}/{name}/index_daily.parquet")
    found = {n: {(r.name, r.date): r.p_stress for r in reports.hmm_filter(spark, f"{tmp_path}/{n}").collect()} for n in ("all", "cut")}
    assert {k: p for k, p in found["all"].items() if k[1] <= dt.date(2025, 5, 16)} == found["cut"]
    fits = {n: {tuple(r) for r in extras.hmm_fit(spark, f"{tmp_path}/{n}").collect()} for n in ("all", "cut")}
    assert fits["all"] == fits["cut"] and {(f[0], f[1]) for f in fits["all"]} == {(n, y) for n in "AB" for y in (2024, 2025)}
    want = {}
    for name, part in df.groupby("index_name"):
        x, dates = part["close"].pct_change().to_numpy()[1:] * 100, list(part["date"])[1:]
        year = np.array([d.year for d in dates])
        for y in (2024, 2025):
            m = models.fit_two_states(x[year < y])
            p = books.forward_filter(x[year <= y], m["pi"], m["move"], m["mean"], m["sd"])
            want |= {(name, d): v for d, v, own in zip(dates, p, year[year <= y] == y) if own}
    assert want.keys() == found["all"].keys() and all(abs(want[k] - found["all"][k]) < 1e-5 for k in want)
    volatile = [p for (n, d), p in found["all"].items() if (indices_day(df, d) // 60) % 4 == 3]
    assert np.mean(volatile) > 0.7


def indices_day(df, day):
    return int((df[df["index_name"] == "A"]["date"] < day).sum())
