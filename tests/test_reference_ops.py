"""Operators without SQL, or with a closed form, against plain loops."""

import datetime as dt
import random

import numpy as np

from almagest.operators import books, features, reports, series


def test_closed_form_weights(spark):
    from pyspark.sql import functions as F

    def loop(n, near):
        cap = [0.06 if i < near else 0.1 for i in range(n)]
        w = [min(1 / n, c) for c in cap]
        for _ in range(50):
            rest = 1 - sum(w)
            room = [c - x for c, x in zip(cap, w)]
            if rest < 1e-12 or sum(room) < 1e-12:
                break
            w = [x + min(r, rest * r / sum(room)) for x, r in zip(w, room)]
        return [x / sum(w) for x in w]

    rows = [(n * 100 + k, i, i < k) for n in range(8, 17) for k in range(n + 1) for i in range(n)]
    got = {(r.date, r.i): r.weight for r in features.capped_weights(spark.createDataFrame(rows, "date int, i int, near boolean"), F.col("near")).collect()}
    for n in range(8, 17):
        for k in range(n + 1):
            assert np.allclose([got[n * 100 + k, i] for i in range(n)], loop(n, k), atol=1e-9), (n, k)


def test_banded_selection():
    rank = {f"T{i}": i + 1 for i in range(40)}
    group = {t: "x" if r <= 10 else f"g{r % 7}" for t, r in rank.items()}
    got = books.select_banded(rank, group, ["T25", "T35"])
    assert "T25" in got and "T35" not in got and len(got) == 15 and sum(group[t] == "x" for t in got) == 4
    assert books.select_banded({}, {}, ["a"]) == []


def test_hysteresis_against_loops(spark):
    rng = random.Random(1)
    ps = [rng.random() for _ in range(300)]
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(i)
    df = spark.createDataFrame([("a", day(i), p, p > 0.8) for i, p in enumerate(ps)], "name string, date date, p double, raw boolean")
    got = [r.on for r in series.held_on(df, "raw", "on", 3).orderBy("date").collect()]
    calm, on, want = 99, False, []
    for p in ps:
        calm = 0 if p > 0.8 else calm + 1
        on = p > 0.8 or (on and calm < 3)
        want.append(on)
    assert got == want
    got = [r.on for r in series.dead_band(df, "p", "on", 0.8, 0.5).orderBy("date").collect()]
    low, on, want = 0, False, []
    for p in ps:
        low = low + 1 if p < 0.5 else 0
        on = True if p >= 0.8 else False if low >= 2 else on
        want.append(on)
    assert got == want


def test_split_adjust(spark):
    a = [100, 101, 102, 25.5, 26, 26.5]
    rows = [("A", dt.date(2024, 1, i + 1), float(v), 1.0) for i, v in enumerate(a)] + [("B", dt.date(2024, 1, i + 1), 50.0 + i, 1.0) for i in range(6)]
    bars = spark.createDataFrame(rows, "ticker string, date date, close double, volume double")
    splits = spark.createDataFrame([("A", dt.date(2024, 1, 4), 4.0), ("B", dt.date(2024, 1, 4), 2.0)], "ticker string, ex_date date, ratio double")
    factors = reports.split_factors(bars, splits)
    assert {(r.ticker, r.applied) for r in factors.collect()} == {("A", True), ("B", False)}
    got = {(r.ticker, r.date.day): (r.close_adj, r.volume_adj) for r in reports.split_adjust(bars, factors).collect()}
    assert got["A", 3] == (25.5, 4.0) and got["A", 4] == (25.5, 1.0) and got["B", 1] == (50.0, 1.0)


def test_drift_is_the_recursive_form(spark):
    rng = np.random.default_rng(0)
    r = rng.normal(0, 0.03, (3, 8))
    df = spark.createDataFrame([(i, d, float(r[i, d])) for i in range(3) for d in range(8) if (i, d) != (1, 4)], "ticker int, day_idx long, ret double")
    held = spark.createDataFrame([(0, 7, i, w) for i, w in enumerate([0.3, 0.4, 0.2])], "start_idx long, end_idx long, ticker int, weight double")
    r[1, 4] = 0
    got = {}
    for x in books.drift(df, held).collect():
        got[x.day_idx] = got.get(x.day_idx, 1.0) + x.weight * (x.growth - 1)
    w, cash, value = np.array([0.3, 0.4, 0.2]), 0.1, 1.0
    for d in range(1, 8):
        w = w * (1 + r[:, d])
        value = w.sum() + cash
        assert abs(got[d] - value) < 1e-12


def test_forward_filter_finds_the_volatile_spell():
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 0.7, 300), rng.normal(0, 2.5, 60), rng.normal(0, 0.7, 100)])
    args = np.array([0.9, 0.1]), np.array([[0.98, 0.02], [0.05, 0.95]]), np.array([0.0, 0.0]), np.array([0.7, 2.5])
    p = books.forward_filter(x, *args)
    assert p[320:360].mean() > 0.7 and p[:300].mean() < 0.2
    assert np.allclose(books.forward_filter(x[:350], *args), p[:350])  # the future changes nothing
