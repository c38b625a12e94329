import random

import numpy as np
import pytest

from almagest.llm.packing import best_fit, fill_report, pack


def test_best_fit_invariants():
    rng = np.random.default_rng(1)
    for capacity in (10, 128, 1000):
        sizes = rng.integers(1, capacity + 1, 3000)
        got = best_fit(sizes, capacity)
        fill = np.bincount(got, weights=sizes)
        assert fill.max() <= capacity and fill.min() > 0
        assert np.sort(fill)[:2].sum() > capacity  # no two containers fit into one
        assert len(fill) <= 1.23 * np.ceil(sizes.sum() / capacity) + 2 or (sizes > capacity / 2).sum() >= len(fill) * 0.8


def test_best_fit_is_best_fit():
    """Against the plain definition."""
    rng = random.Random(3)
    sizes = np.array([rng.randint(1, 50) for _ in range(400)])
    rooms: list[int] = []
    for s in sorted(sizes.tolist(), reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= s]
        if fits:
            rooms[min(fits)[1]] -= s
        else:
            rooms.append(50 - s)
    got = np.bincount(best_fit(sizes, 50), weights=sizes)
    assert sorted(50 - got) == sorted(rooms)


@pytest.mark.parametrize("task_items", [50, 100_000])
def test_pack(spark, task_items):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, 0, 3, 40, 64, 65, 128, 129, 1000, rng.randint(1, 300)])) for i in range(600)] + [(7, 50), (7, 50)]
    df = spark.createDataFrame(rows, "doc_id long, n long")
    got = pack(df, "doc_id", "n", {1: 128, 2: 512}, task_items).toPandas()
    for spec, capacity in ((1, 128), (2, 512)):
        one = got[got.spec_id == spec]
        assert one["size"].sum() == sum(n or 0 for _, n in rows)
        assert one.groupby("container_id")["size"].sum().max() <= capacity
        assert one[one["size"] == 0].container_id.isna().all() and len(one[one["size"] == 0]) == sum(not n for _, n in rows)
        cut = one[one.part_no > 0].groupby("item_id")["size"].sum()
        sizes = dict(rows[:600])
        assert all(sizes[i] > capacity for i in cut.index)
        assert set(one.item_id) == {i for i, _ in rows}
    report = fill_report(pack(df, "doc_id", "n", {1: 128}, task_items), {1: 128}).collect()[0]
    assert report.fill > 0.9 and report.containers >= report.least_containers


def test_pack_nothing(spark):
    assert pack(spark.createDataFrame([], "doc_id long, n long"), "doc_id", "n", {1: 128}).count() == 0


def test_rounds_have_no_number(spark, monkeypatch):
    """Small tasks take many rounds, and each leaves less room than the one before."""
    from almagest.llm import packing

    df = spark.range(3000).selectExpr("id as doc_id", "1 + pmod(xxhash64(id), 90) as n")
    turns, fills = [], []
    real = packing.checkpoint
    monkeypatch.setattr(packing, "checkpoint", lambda d: turns.append(1) or real(d))
    for least in (1.0, 0.0):  # one round, and as many as place anything
        monkeypatch.setattr(packing, "LEAST_PLACED", least)
        turns.clear()
        got = pack(df, "doc_id", "n", {1: 128}, task_items=12)
        assert got.count() == 3000
        fills.append(fill_report(got, {1: 128}).collect()[0].fill)
    assert len(turns) > 7 and fills[1] > fills[0] + 0.02


def test_texts_are_sized_once(spark):
    """The size is computed once a row, whatever comes of the row."""
    from pyspark.sql import functions as F

    count = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def size(n):
        count.add(1)
        return n

    df = spark.createDataFrame([(i, n) for i, n in enumerate([None, 0, 5, 127, 128, 129, 300, 5000] * 5)], "doc_id long, n long")
    pack(df.select("doc_id", size("n").alias("tokens")), "doc_id", "tokens", {1: 128, 2: 512}).collect()
    assert count.value == 40
