"""Draws in blocks from one index, against loops over days with the same random numbers."""

import datetime as dt

import numpy as np
import pandas as pd

from almagest.plans import extras, reports


def made(spark, tmp_path, n=90):
    close = 100 * np.cumprod(1 + np.random.default_rng(3).normal(0.001, 0.02, n + 1))
    rows = [("A", dt.date(2024, 1, 1) + dt.timedelta(i), float(c)) for i, c in enumerate(close)]
    spark.createDataFrame(rows, "index_name string, date date, close double").write.parquet(f"{tmp_path}/index_daily.parquet")
    return close[1:] / close[:-1] - 1


def test_bootstrap(spark, tmp_path):
    r = made(spark, tmp_path)
    n, means = len(r), []
    for run in range(2000):
        rng = np.random.default_rng(run)
        jump, starts, at, total = rng.random(n) < 1 / 21, rng.integers(0, n, n), 0, 0.0
        for i in range(n):
            at = starts[i] if i == 0 or jump[i] else (at + 1) % n
            total += r[at]
        means.append(total / n)
    got = reports.bootstrap(spark, str(tmp_path)).collect()
    assert len(got) == 1 and got[0].runs == 2000
    assert np.allclose([got[0].p05, got[0].p50, got[0].p95], np.quantile(means, [0.05, 0.5, 0.95]), atol=1e-7)


def test_monte_carlo(spark, tmp_path):
    r = made(spark, tmp_path)
    n, totals = len(r), []
    for run in range(200):
        rng = np.random.default_rng(run)
        jump, starts = rng.random((100, 21)) < 0.2, rng.integers(0, n, (100, 21))
        for path in range(100):
            at, grown = 0, 1.0
            for i in range(21):
                at = starts[path, i] if i == 0 or jump[path, i] else (at + 1) % n
                grown *= 1 + r[at]
            totals.append(grown - 1)
    got = extras.monte_carlo(spark, str(tmp_path)).collect()[0]
    assert got.paths == 20_000 and np.allclose([got.p05, got.p50, got.p95, got.loss], [*np.quantile(totals, [0.05, 0.5, 0.95]), np.mean(pd.Series(totals) < 0)], atol=1e-5)
