"""Quotas that leave a book short are topped up from all ranked names."""

import datetime as dt

import pytest

from almagest.operators import books
from almagest.plans import extras, panel, reports


def scored(spark, hot):
    """240 names on three dates; the best ``hot`` are of three groups, the others of five. Some have no group."""
    rows = []
    for k in range(3):
        for i in range(240):
            name = (i * 7 + 11 * k) % 240
            grp = i % 3 if i < hot else None if i % 17 == 0 else i % 5
            rows.append((dt.date(2024, 1, 1) + dt.timedelta(7 * k), name, grp, float(240 - i), 0.5 + (i % 9) / 6))
    return spark.createDataFrame(rows, "date date, ticker long, grp int, score double, beta double")


@pytest.mark.parametrize("hot", [0, 95, 200])
def test_books_are_full(spark, monkeypatch, hot):
    df = scored(spark, hot)
    monkeypatch.setattr(panel, "_scored", lambda *_: df)
    got = {(r.scenario_id, r.date): r.names for r in reports.backtest_banded(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == 12 and all(n == (25 if s == 4 else 15) for (s, _), n in got.items())
    capped = extras.beta_capped(spark, "").groupBy("date").count().collect()
    assert len(capped) == 3 and all(r["count"] == 15 for r in capped)


@pytest.mark.parametrize("hot", [0, 95, 200])
def test_reach_is_exact(spark, hot):
    df = scored(spark, hot).selectExpr("date", "ticker", "grp", "cast(241 - score as int) as rnk")
    near = books.within_reach(df, 60, 7)
    assert near.count() < df.count() / 2
    rows = lambda c: sorted(map(tuple, books.banded_books(c, reports.BANDED).collect()))
    assert rows(near) == rows(df)
