"""Decision days, executions and groups in force; scores of records against a loop over days."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from almagest.operators import calendar as cal
from almagest.operators import replay

D = dt.date


def test_holidays_and_week_ends(spark):
    """A week that ends before a Friday without trading, one day closed in the middle, a Monday holiday."""
    closed = {D(2024, 3, 29), D(2024, 12, 25), D(2024, 9, 2)}
    days = [d for d in (D(2024, 1, 1) + dt.timedelta(i) for i in range(366)) if d.weekday() < 5 and d not in closed]
    df = spark.createDataFrame([(d,) for d in days] + [(days[0],), (None,)], "date date")
    got = {r.day: r for r in cal.decision_days(df).collect()}
    assert got[D(2024, 3, 28)].rebalances and not got[D(2024, 3, 27)].rebalances and got[D(2024, 3, 29)].closed_weekday
    assert got[D(2024, 12, 24)].executes_on == D(2024, 12, 26) and not got[D(2024, 12, 24)].rebalances
    assert got[D(2024, 9, 2)].closed_weekday and got[D(2024, 8, 30)].executes_on == D(2024, 9, 3) and got[D(2024, 8, 30)].rebalances
    assert got[D(2024, 9, 3)].data_before_close == D(2024, 8, 30) and got[D(2024, 9, 3)].data_after_close == D(2024, 9, 3)
    assert got[D(2024, 9, 5)].decided_on == D(2024, 8, 30) and got[D(2024, 1, 3)].decided_on is None
    us = lambda *a: int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp() * 1e6)
    asked = [(1, us(2024, 12, 24, 16, 15)), (2, us(2024, 12, 24, 9, 29)), (3, us(2024, 12, 24, 9, 30)), (4, us(2024, 12, 28, 8, 0)), (5, None), (6, us(2030, 1, 1))]
    out = {r.id: r.executes_on for r in cal.execution_day(spark.createDataFrame(asked, "id int, at long"), "at", df).collect()}
    assert out == {1: D(2024, 12, 26), 2: D(2024, 12, 24), 3: D(2024, 12, 26), 4: D(2024, 12, 30)}
    assert cal.decision_days(df.limit(0)).count() == 0


def test_groups_of_the_latest_fit(spark):
    rows = spark.createDataFrame([(t, D(y, 6, 1)) for t in ("a", "b") for y in (2018, 2020, 2021, 2023)], "ticker string, date date")
    schedule = spark.createDataFrame([(2020, "a", "x"), (2022, "a", "y"), (2022, "b", "z")], "fit_year int, ticker string, grp string")
    got = {(r.ticker, r.date.year): (r.fit_year, r.grp) for r in cal.groups_at(rows, schedule).collect()}
    assert got == {("a", 2018): (2020, "x"), ("b", 2018): (2020, "other"), ("a", 2020): (2020, "x"), ("b", 2020): (2020, "other"), ("a", 2021): (2020, "x"), ("b", 2021): (2020, "other"), ("a", 2023): (2022, "y"), ("b", 2023): (2022, "z")}


def scored(records, prices, bps):
    close = {(t, d): c for t, d, _, c in prices}
    opens = {(t, d): o for t, d, o, _ in prices}
    days = sorted({d for _, d, _, _ in prices})
    targets = {}
    for _, decided, ex, action, h in sorted(records, key=lambda r: r[1]):
        if action == "rebalance" and ex in days:
            targets[ex] = {t: w for t, w in h if t != replay.CASH}
    held, last, out = {}, {}, []
    for d in days:
        seen = dict(last)
        price_open = lambda t: opens[t, d] if (t, d) in opens and opens[t, d] else seen.get(t, close.get((t, d)))  # noqa: E731, B023
        gross = turnover = 0.0
        if d in targets:
            r = sum(w * (price_open(t) / seen[t] - 1) for t, w in held.items() if (t, d) in close)
            grown = {t: w * (price_open(t) / seen[t] if (t, d) in close else 1) / (1 + r) for t, w in held.items()}
            turnover = sum(abs(targets[d].get(t, 0) - grown.get(t, 0)) for t in {*targets[d], *grown})
            held = targets[d]
            r2 = sum(w * (close[t, d] / price_open(t) - 1) for t, w in held.items())
            gross = (1 + r) * (1 + r2) - 1
            held = {t: w * close[t, d] / price_open(t) / (1 + r2) for t, w in held.items()}
        elif held:
            gross = sum(w * (close[t, d] / seen[t] - 1) for t, w in held.items() if (t, d) in close)
            held = {t: w * (close[t, d] / seen[t] if (t, d) in close else 1) / (1 + gross) for t, w in held.items()}
        last |= {t: c for (t, x), c in close.items() if x == d}
        if targets and d >= min(targets):
            out.append((d, gross, turnover * bps / 1e4, turnover))
    return out


def test_scores_against_a_loop(spark, tmp_path):
    rng = random.Random(4)
    days = [D(2024, 1, 1) + dt.timedelta(i) for i in range(40)]
    rebalances = {5, 6, 15, 27, 39}
    prices = []
    for t in "ABCDEF":
        p = 10.0
        for i, d in enumerate(days):
            p *= 1 + rng.uniform(-0.05, 0.05)
            if i in rebalances or rng.random() > 0.1:
                prices.append((t, d, None if rng.random() < 0.15 else p * (1 + rng.uniform(-0.02, 0.02)), p))
    records = []
    for i in sorted(rebalances):
        names = rng.sample("ABCDEF", 3)
        for k, day in enumerate((i - 2, i - 1)):  # decided twice for one execution: the later one counts
            records.append((days[day], days[day], days[i], "rebalance", [(n, 0.3 - 0.05 * k) for n in names] + [(replay.CASH, 0.1 + 0.15 * k)]))
        records.append((days[i], days[i - 1], days[min(i + 1, 39)], "hold", [("A", 1.0)]))
    records.append((days[39], days[39], None, "rebalance", [("A", 1.0)]))
    df = spark.createDataFrame(records, f"data_through date, {replay.RECORD}")
    replay.write_records(df, str(tmp_path / "r"))
    back = replay.read_records(spark, str(tmp_path / "r"))
    got = replay.score(back, spark.createDataFrame(prices, "ticker string, date date, open double, close double")).orderBy("date").collect()
    want = scored(records, prices, 10.0)
    assert [r.date for r in got] == [w[0] for w in want]
    assert np.allclose([(r.gross, r.cost, r.turnover) for r in got], [w[1:] for w in want])
    assert replay.score(back.limit(0), spark.createDataFrame(prices, "ticker string, date date, open double, close double")).count() == 0


def test_requests_that_make_no_sense():
    ok = replay.checked(["A", "B"], [0.5, 0.501], D(2024, 1, 1), D(2024, 2, 1))
    assert abs(sum(ok.values()) - 1) < 1e-12
    for bad in ((["A"], [0.5, 0.5], 1, 2), (["A", "B"], [0.7, 0.5], 1, 2), (["A"], [1.0], 2, 2), (["A", "B"], [1.5, -0.5], 1, 2), (["A", "A"], [0.5, 0.5], 1, 2), ([], [], 1, 2), (["A"], [float("nan")], 1, 2)):
        with pytest.raises(ValueError):
            replay.checked(*bad)


def test_six_digits_sum_to_one(spark):
    df = spark.createDataFrame([(1, f"t{i}", 1 / 15) for i in range(15)] + [(2, "a", 0.6), (2, "b", 0.4)], "date int, ticker string, weight double")
    got = replay.six_digits(df).groupBy("date").agg(F.round(F.sum("weight"), 9).alias("s"), F.max("weight").alias("m")).collect()
    assert all(r.s == 1 for r in got)
    cash = replay.with_cash(df.filter("date = 2").withColumn("weight", F.col("weight") * 0.75)).collect()
    assert {r.ticker: round(r.weight, 9) for r in cash} == {"a": 0.45, "b": 0.3, replay.CASH: 0.25}


def test_days_to_the_next_event(spark):
    rng = random.Random(9)
    day = lambda: None if rng.random() < 0.05 else D(2024, 1, 1) + dt.timedelta(rng.randint(0, 200))
    name = lambda: rng.choice(["hot", "hot", "a", "b", None])
    rows = [(i, name(), day()) for i in range(150)]
    events = [(name(), day()) for _ in range(60)]
    df = spark.createDataFrame(rows, "id int, e string, d date")
    got = {r.id: r.days for r in cal.days_to_next(df, spark.createDataFrame(events, "e string, at date"), "e", "d", "at", "days").collect()}
    want = {i: min(((x - d).days for f, x in events if f == e and x is not None and x >= d), default=None) if e is not None and d is not None else None for i, e, d in rows}
    assert got == want
