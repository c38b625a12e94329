import numpy as np

from almagest.operators.spikes import event_outliers, flag_events, flag_series, robust_pca, spike_profile, stuck


def test_robust_pca_parts_low_rank_and_sparse():
    rng = np.random.default_rng(0)
    low = rng.normal(size=(200, 2)) @ rng.normal(size=(2, 40))
    sparse = np.where(rng.random((200, 40)) < 0.05, rng.choice([-8.0, 8.0], (200, 40)), 0)
    a, b = robust_pca(low + sparse)
    assert np.abs(a - low).max() < 0.05 and ((np.abs(b) > 1) == (sparse != 0)).all()
    assert robust_pca(np.zeros((3, 4)))[1].sum() == 0


def walk(n=300, sd=0.02, seed=1):
    return 4 + np.cumsum(np.random.default_rng(seed).normal(0, sd, n))


def test_spikes_found_lasting_changes_not():
    for seed in range(12):
        x = walk(seed=seed)
        x[100:] += np.log(4)  # a split
        planted = {30: 4.6, 60: -0.4, 61: -0.4, 150: 0.3, 200: -4.6, 201: -4.6, 202: -4.6}
        for i, size in planted.items():
            x[i] += size
        x[250:254] += 0.5  # four readings are no spike
        assert set(np.flatnonzero(spike_profile(x)[2])) == set(planted), seed


def test_short_series_are_left_alone():
    for n in range(6):
        assert not spike_profile(np.arange(n, dtype=float))[2].any()


def test_stuck():
    v = np.array([1, 2, 3, 3, 3, 3, 3, 4, 5, 5, 5, 5, 6, 7, 7, 7, 7, 7, 8.0] + list(range(10, 40)))
    active = np.ones(len(v), bool)
    active[15] = False
    assert np.flatnonzero(stuck(v, active)).tolist() == [3, 4, 5, 6]
    assert not stuck(np.full(50, 3.0), np.ones(50, bool)).any()


def test_event_outliers():
    x = np.log(np.array([0.5, 0.5, 0.55, 0.55, 55.0, 0.6, 0.6, 0.006, 0.7, 0.75, 0.8, 0.8, 1.2, 1.2]))
    assert np.flatnonzero(event_outliers(x)).tolist() == [4, 7]
    assert not event_outliers(np.log(np.array([1.0, 90.0]))).any()


def test_deliveries_are_judged_by_their_own_value(spark):
    import datetime as dt

    x = np.exp(walk(80, seed=5)).round(4)
    rows = [(i, "a", dt.date(2024, 1, 1) + dt.timedelta(i), float(v), 10.0, 1) for i, v in enumerate(x)]
    rows += [(1000, "a", rows[40][2], float(x[40]) * 100, 10.0, 0), (1001, "a", rows[41][2], float(x[41]), 10.0, 0), (1002, "a", rows[42][2], -1.0, 10.0, 0)]
    rows += [(1003, "a", None, 5.0, 1.0, 1), (1004, None, rows[3][2], 5.0, 1.0, 1), (1005, "a", rows[5][2], None, 1.0, 0), (1006, "a", rows[6][2], float("nan"), None, 0), (1007, "b", rows[6][2], 7.0, None, 0)]
    rows[50] = (*rows[50][:3], rows[50][3] / 100, *rows[50][4:])
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, e string, d date, v double, n double, at int, reason string")
    market = spark.createDataFrame([(dt.date(2024, 1, 1), 100.0)], "date date, level double")
    got = {(r.id, r.reason) for r in flag_series(df, "e", "d", "v", "id", "n", ["at", "id"], market).collect()}
    assert got == {(1000, "spike"), (50, "spike"), (1002, "range")}
    assert flag_series(df.limit(0), "e", "d", "v", "id", "n", ["at", "id"], market).count() == 0


def test_flag_events(spark):
    import datetime as dt

    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(90 * k)
    rows = [(i, "a", day(i), "dividend", 0.5 + 0.02 * i) for i in range(16)]
    rows += [(100, "a", day(3), "Dividend ", 51.0), (101, "a", day(4), "dividend", 0.0), (102, "a", day(5), "split", 3000.0), (103, "a", day(5), "split", 0.05), (104, "a", day(6), "special_dividend", 9.0), (105, "a", day(7), "dividend", None), (106, None, day(7), "split", -2.0), (107, "a", day(2), "dividend", float("nan")), (108, "a", day(2), None, 1.0), (109, "a", day(3), "dividend", 0.56)]
    df = spark.createDataFrame(rows, "id long, e string, d date, kind string, v double")
    assert sorted(r.id for r in flag_events(df, "e", "d", "kind", "v", "id").collect()) == [100, 101, 102, 106]
    assert flag_events(df.limit(0), "e", "d", "kind", "v", "id").count() == 0


def test_pegged_values_are_not_stuck():
    """A value that lies still in many runs doesn't normally change, however little of it lies outside the runs."""
    for between in ([1, 2, 1, 2], [1, 1, 2, 1, 1, 2]):  # of the pairs outside the runs none, or a third, are equal
        v = np.array([x for k, n in enumerate((8, 10, 20, 35, 43, 78)) for x in [10 + 0.01 * (k % 3)] * n + [10 + 0.05 * y for y in between]])
        assert (np.diff(v) == 0).mean() > 0.8 and not stuck(v, np.ones(len(v), bool)).any()
    v = np.arange(60, dtype=float)
    v[20:34] = 20.0  # one long run of a value that else changes each time
    assert np.flatnonzero(stuck(v, np.ones(60, bool))).tolist() == list(range(21, 34))
