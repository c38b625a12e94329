"""Consensus clusters of many names: linkage by blocks, equal names as one row, leftovers by blocks."""

import datetime as dt
import time

import numpy as np
import pandas as pd
import pytest
from test_clusters import plain_groups

from almagest.operators import clusters, models


def runs_of(n, seed, noise=0.35):
    """Labels of sixty runs in three sets, five planted groups; some names are in no run of a set."""
    rng = np.random.default_rng(seed)
    label = np.where(rng.random((n, 60)) < noise, rng.integers(0, 5, (n, 60)), rng.integers(0, 5, n)[:, None])
    for w in range(3):
        label[np.ix_(rng.random(n) < 0.2, range(20 * w, 20 * w + 20))] = -1
    return label[(label >= 0).any(axis=1)]


@pytest.mark.parametrize("dense", [3000, 4])
def test_linkage_of_distinct_rows_against_loops(monkeypatch, dense):
    monkeypatch.setattr(models, "DENSE", dense)
    monkeypatch.setattr(models, "CELLS", 500)
    for seed in range(3):
        label = runs_of(70, seed)
        ones, kind, over = clusters.shares(label)
        same = np.random.default_rng(seed).integers(0, len(label), 160)
        _, same = np.unique(same, return_inverse=True)
        rows = ones[: same.max() + 1], kind[: same.max() + 1]
        sim = over[rows[1]][:, rows[1]] * (rows[0].astype(float) @ rows[0].T)
        got = models.linkage_groups(rows[0], rows[0], 5, 12, rows[1], over, same)
        assert [frozenset(np.flatnonzero(got == g)) for g in range(got.max() + 1)] == plain_groups(sim[same][:, same], 5, 12)


def test_rounds_and_chain_give_one_tree(monkeypatch):
    """Similarities without ties leave one tree."""
    x = np.random.default_rng(3).normal(size=(90, 5))
    sim = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2))
    chain = models.merge_tree(sim, np.eye(90))
    monkeypatch.setattr(models, "DENSE", 2)
    assert np.array_equal(models.merge_tree(sim, np.eye(90)), chain)


def test_copies_of_names_cost_no_more_than_the_names():
    label = runs_of(400, 5)
    ones, kind, over = clusters.shares(label)
    began = time.perf_counter()
    got = models.linkage_groups(ones, ones, 5, 15, kind, over, np.tile(np.arange(len(label)), 150))
    assert time.perf_counter() - began < 60  # of 60,000 names only the 400 rows count
    assert np.array_equal(got, np.tile(models.linkage_groups(ones, ones, 5, 15, kind, over), 150))


def test_followed_group_against_pandas():
    rng = np.random.default_rng(7)
    x, means = rng.normal(size=(40, 30)), rng.normal(size=(3, 30))
    x[rng.random(x.shape) < 0.4], means[rng.random(means.shape) < 0.2] = np.nan, np.nan
    x[0], x[1], x[2] = 0.1, np.nan, means[2]
    got = clusters.follow(x, means)
    for row, g in zip(x, got):
        corr = [pd.Series(row).corr(pd.Series(m)) for m in means] if np.nanstd(row) > 1e-12 else [np.nan] * 3
        assert g == (-1 if np.isnan(corr).all() else int(np.nanargmax(np.round(corr, 9))))
    assert got[0] == got[1] == -1 and got[2] == 2


def test_blocks_change_no_group_and_nameless_rows_have_none(spark):
    rng = np.random.default_rng(8)
    common, rows = rng.normal(0, 0.05, (3, 150)), []
    for t in range(60):
        rows += [(f"t{t:02d}", dt.date(2020, 1, 6) + dt.timedelta(7 * w), w, float(common[t % 3, w] + rng.normal(0, 0.01)) if w and t < 58 else None) for w in range(150 if t < 59 else 40)]
    rows += [(None, dt.date(2020, 1, 6) + dt.timedelta(7 * w), w, 0.01 * w) for w in range(150)]
    returns = spark.createDataFrame(rows, "ticker string, date date, day_idx long, ret double")
    kept, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for blocks in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", blocks)
            got = clusters.consensus(returns, k=3, seeds=4, windows=[40, 80], components=2, coverage=0.6, least=10, min_days=20).collect()
            assert len(got) == 2 * 61
            found.append({(r.fit_year, r.ticker): r.grp for r in got})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert found[0] == found[1]
    for y in (2021, 2022):
        groups = [{found[0][y, f"t{t:02d}"] for t in range(g, 58, 3)} for g in range(3)]
        assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3
        assert found[0][y, None] == found[0][y, "t58"] == found[0][y, "t59"] == "other"
