"""Draws that take both series of a pair together."""

import datetime as dt

import numpy as np
import pandas as pd

from almagest.plans import extras, reports


def write(spark, folder, shift):
    """The small index is the market plus ``shift`` a day; one day of it is missing."""
    rng = np.random.default_rng(4)
    market = rng.normal(0.0002, 0.02, 400)
    rows = []
    for name, r in (("MKTCOMP", market), ("SMALLCOMP", market + shift)):
        rows += [(name, dt.date(2024, 1, 1) + dt.timedelta(i), float(c)) for i, c in enumerate(100 * np.cumprod(1 + r))]
    spark.createDataFrame(pd.DataFrame(rows[:-1], columns=["index_name", "date", "close"])).write.parquet(f"{folder}/index_daily.parquet")


def test_a_steady_gap_is_never_lost(spark, tmp_path):
    for name, shift in (("up", 0.0005), ("down", -0.0005)):
        write(spark, f"{tmp_path}/{name}", shift)
        gap = reports.paired_bootstrap(spark, f"{tmp_path}/{name}").collect()[0]
        assert (gap.days, gap.runs, gap.p) == (398, 2000, 0.0 if shift > 0 else 1.0)
        assert all(abs(x - 252 * shift) < 1e-5 for x in (gap.gap, gap.p05, gap.p95))  # the market's moves cancel in each draw
        paths = extras.joint_monte_carlo(spark, f"{tmp_path}/{name}").collect()[0]
        assert paths.paths == 20000 and paths.beats == (1.0 if shift > 0 else 0.0)
        assert paths.p05 < paths.p50 < paths.p95 and 0 < paths.loss < 1


def test_error_with_bartlett_weights():
    x = np.random.default_rng(2).normal(0.1, 1, 250)
    e, n, lags = x - x.mean(), 250, int(4 * 2.5 ** (2 / 9))
    total = sum(max(0.0, 1 - abs(i - j) / (lags + 1)) * e[i] * e[j] for i in range(n) for j in range(n) if abs(i - j) <= lags)
    assert abs(reports._newey_west(x) - x.mean() / np.sqrt(total / n / n)) < 1e-12
    assert np.isnan(reports._newey_west(x[:9])) and np.isnan(reports._newey_west(np.zeros(20)))
