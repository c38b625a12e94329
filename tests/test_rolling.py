import random
from datetime import date, timedelta

from almagest.operators.rolling import latest_delivery, trailing


def brute(rows, n):
    """Per entity and day: total and number of the values of the last n days."""
    out = {}
    by = {}
    for e, d, v in rows:
        by.setdefault(e, {})[d] = v
    for e, days in by.items():
        d = min(days)
        while d <= max(days):
            inside = [days[x] for k in range(n) if (x := d - timedelta(k)) in days]
            inside = [v for v in inside if v is not None and v == v and abs(v) < float("inf")]
            out[e, d] = (round(sum(inside), 6), len(inside))
            d += timedelta(1)
    return out


def test_against_brute_force(spark):
    """Gaps of days to months, nulls, NaN, infinite values, negative ones, and an entity with most of the rows."""
    rng = random.Random(2)
    rows = []
    for e in ["hot"] * 1 + [f"e{i}" for i in range(12)]:
        d = date(2024, 1, 1) + timedelta(rng.randint(0, 50))
        for _ in range(300 if e == "hot" else rng.randint(1, 25)):
            rows.append((e, d, rng.choice([None, float("nan"), float("inf"), 0.0, -3.25, round(rng.uniform(0, 1e6), 4)])))
            d += timedelta(rng.choice([1, 1, 1, 2, 3, 8, 45]))
    df = spark.createDataFrame([(e, d, v, "x") for e, d, v in rows], "e string, d date, v double, __e string")
    got = {(r.e, r.d): r for r in trailing(df, "e", "d", ["v"]).collect()}
    for n in (7, 30):
        want = brute(rows, n)
        assert got.keys() == want.keys()
        for k, (total, count) in want.items():
            r = got[k]
            assert (round(r[f"v_total_{n}"], 6), r[f"v_rows_{n}"]) == (total, count)
            assert (r[f"v_avg_{n}"] is None) == (count == 0)
    first = {e: min(d for x, d, _ in rows if x == e) for e, _, _ in rows}
    for (e, d), r in got.items():
        assert abs(r.v_daily_7 * min(7, (d - first[e]).days + 1) - r.v_total_7) < 1e-6 * max(1, abs(r.v_total_7))


def test_latest_delivery(spark):
    rows = [("a", 1, 5, 1.0), ("a", 1, 5, 2.0), ("a", 1, None, 9.0), ("a", 2, 1, None), (None, 1, 9, 3.0), ("b", None, 1, 1.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, e string, d int, at int, v double")
    got = {(r.e, r.d): r.v for r in latest_delivery(df, ["e", "d"], ["at", "id"], ["v"]).collect()}
    assert got == {("a", 1): 2.0, ("a", 2): None}


def test_nothing(spark):
    assert trailing(spark.createDataFrame([], "e string, d date, v double"), "e", "d", ["v"]).count() == 0
    assert trailing(spark.createDataFrame([(None, None, 1.0)], "e string, d date, v double"), "e", "d", ["v"]).count() == 0
