import random

from pyspark.sql import functions as F

from almagest.operators.asof import dyadic_nodes, known_at, validity

DAY = 86_400_000_000


def test_against_brute_force(spark):
    """Ties in time and precedence, rows that become known late, events before the first row, null keys and values."""
    rng = random.Random(6)
    name = lambda: rng.choice(["hot", None, *[f"e{i}" for i in range(15)]] + ["hot"] * 7)
    known = [(i, name(), rng.choice([None, rng.randint(-3000, 9000) * DAY // rng.choice([1, 7])]), rng.randint(0, 40), rng.choice([None, 1.5])) for i in range(400)]
    events = [(i, name(), rng.choice([None, rng.randint(-4000, 30000) * DAY // rng.choice([1, 7])])) for i in range(1500)]
    events += [(2000 + k[0], k[1], k[2]) for k in known] + [(3000 + k[0], k[1], k[2] - 1 if k[2] else None) for k in known]
    a = spark.createDataFrame([(*e, "clash") for e in events], "id int, e string, t long, v string")
    b = spark.createDataFrame(known, "k int, e string, at long, p int, v double")
    intervals = validity(b, "e", "at", [F.col("p"), -F.col("k")], ["k", "v"])
    got = sorted((r.id, r.k, r.v) for r in known_at(a, intervals, "e", "t").collect())
    want = []
    for i, e, t in events:
        seen = [(p, -k, v) for k, f, at, p, v in known if e is not None and f == e and at is not None and t is not None and at <= t]
        if seen:
            p, k, v = max(seen, key=lambda r: r[:2])
            want.append((i, -k, v))
    assert got == sorted(want)


def test_later_rows_change_nothing_before(spark):
    rows = [(k, "a", k * DAY, k, float(k)) for k in range(50)]
    events = spark.createDataFrame([(i, "a", i * DAY // 2) for i in range(98)], "id int, e string, t long")
    make = lambda n: {r.id: r.k for r in known_at(events, validity(spark.createDataFrame(rows[:n], "k int, e string, at long, p int, v double"), "e", "at", [F.col("p")], ["k"]), "e", "t").collect()}
    full, cut = make(50), make(25)
    assert all(full[i] == cut[i] for i in range(50))


def test_nothing(spark):
    none = spark.createDataFrame([], "k int, e string, at long, p int, v double")
    events = spark.createDataFrame([(1, "a", 5)], "id int, e string, t long")
    intervals = validity(none, "e", "at", [F.col("p")], ["k", "v"])
    assert known_at(events, intervals, "e", "t").count() == 0
    assert known_at(events.limit(0), intervals, "e", "t").count() == 0


def test_nodes_cover_each_interval_once(spark):
    """With all sizes in a row at most two nodes of each but the largest; without gaps, overlaps or needless nodes."""
    rng = random.Random(1)
    rows = [(a, a + rng.choice([1, 3, 40, 700, 9000, rng.randint(1, 30000)])) for a in (rng.randint(-20000, 20000) for _ in range(300))]
    df = spark.createDataFrame(rows, "a long, b long")
    for levels in ((3, 6), (3, 4, 5, 6, 7), (2,), (0, 5, 9)):
        for a, b, nodes in df.select("a", "b", dyadic_nodes(F.col("a"), F.col("b"), levels)).collect():
            spans = sorted(((n >> 6) << (n & 63), ((n >> 6) + 1) << (n & 63), n & 63) for n in nodes)
            assert all(x[1] == y[0] for x, y in zip(spans, spans[1:])) and spans[0][0] <= a and spans[-1][1] >= b
            assert a - spans[0][0] < 1 << levels[0] and spans[-1][1] - b < 1 << levels[0]
            if levels == (3, 4, 5, 6, 7):
                assert all(sum(s[2] == k for s in spans) <= 2 for k in levels[:-1])


def test_levels_and_horizon_change_nothing(spark):
    rows = [(k, f"e{k % 3}", k * k * DAY, k, float(k)) for k in range(60)]
    events = spark.createDataFrame([(i, f"e{i % 5}", i * 40 * DAY) for i in range(400)], "id int, e string, t long")  # far beyond the last row
    intervals = validity(spark.createDataFrame(rows, "k int, e string, at long, p int, v double"), "e", "at", [F.col("p")], ["k"])
    want = {(i, max(k for k in range(60) if k % 3 == i % 5 and k * k <= i * 40)) for i in range(400) if i % 5 < 3 and any(k % 3 == i % 5 and k * k <= i * 40 for k in range(60))}
    for levels in ((43, 46), (43, 44, 45, 46), (44,)):
        assert {(r.id, r.k) for r in known_at(events, intervals, "e", "t", levels).collect()} == want
