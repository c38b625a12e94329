import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from almagest.operators.nearest import ERROR, fit_segments, lower_bound, nearest


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-(10**12), 10**12), unique=True, max_size=400), st.lists(st.integers(-(10**12) - 5, 10**12 + 5), max_size=60))
def test_lower_bound(keys, wanted):
    keys, wanted = np.array(sorted(keys), dtype=np.int64), np.array(wanted + keys[:50], dtype=np.int64)
    assert (lower_bound(keys, fit_segments(keys), wanted) == np.searchsorted(keys, wanted)).all()


def test_segments_keep_their_bound_and_are_few():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 10**9, 50_000))
    first, at, slope = fit_segments(keys)
    piece = np.searchsorted(first, keys, side="right") - 1
    assert np.abs(at[piece] + slope[piece] * (keys - first[piece]) - np.arange(len(keys))).max() <= ERROR + 1e-6
    assert len(first) < len(keys) / 20


@pytest.mark.parametrize("low,high", [(6, 120), (-30, 30), (-10, -2), (0, 0), (-5, 400)])
def test_against_brute_force(spark, low, high):
    """Ties in time and id, repeated rows, null keys, clashing columns, one entity with a third of the rows."""
    rng = random.Random(4)
    name = lambda: rng.choice(["hot", None, *[f"e{i}" for i in range(20)]] + ["hot"] * 10)
    left = [(i, name(), rng.choice([None, rng.randint(-900, 3000)]), "b") for i in range(500)]
    right = [(i % 350, name(), rng.choice([None, rng.randint(-900, 3000)])) for i in range(700)]
    a = spark.createDataFrame(left + left[:5], "id int, e string, d int, b string")
    b = spark.createDataFrame(right, "rid long, e string, d int")
    got = sorted((r.id, r.rid) for r in nearest(a, b, "e", "d", "d", "rid", low, high, buckets=3, shard_days=200).collect())
    want = []
    for i, e, d, _ in left + left[:5]:
        near = [(abs(y - d), r) for r, f, y in right if e is not None and f == e and d is not None and y is not None and low <= y - d <= high]
        if near:
            want.append((i, min(near)[1]))
    assert got == sorted(want)


def test_nothing(spark):
    a = spark.createDataFrame([(1, "x", 5)], "id int, e string, d int")
    b = spark.createDataFrame([], "rid long, e string, d int")
    assert nearest(a, b, "e", "d", "d", "rid", 0, 9).count() == 0
    assert nearest(a.limit(0), b, "e", "d", "d", "rid", 0, 9).count() == 0
