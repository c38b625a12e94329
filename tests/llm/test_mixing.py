import math

import numpy as np
import pytest

from almagest.llm.mixing import Target, mix, thresholds


def test_thresholds_are_poisson():
    got = thresholds(np.array([0.3, 2.5]), 4)
    for row, rate in zip(got, (0.3, 2.5)):
        want = np.cumsum([math.exp(-rate) * rate**k / math.factorial(k) for k in range(4)])
        assert np.allclose(row, want)


def test_mix(spark):
    rows = [(i, ["news wire", "NEWS_WIRE ", "chat", "memo", None, "other"][i % 6], 10 + i % 90, "x") for i in range(6000)] + [(9001, "chat", 0, "x"), (9002, "chat", None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, source string, tokens long, copies string")
    targets = {"news_wire": Target(0.5, 1), "chat": Target(0.2, 2), "memo": Target(0.25, 3), "absent": Target(0.05, 2)}
    mixture, report = mix(df, "doc_id", "source", "tokens", targets)
    got, shares = mixture.toPandas(), {r.source: r for r in report.collect()}
    assert got.groupby("doc_id").size().max() <= 3
    assert got[got.source == "news_wire"].groupby("doc_id").size().max() == 1
    assert not got.duplicated(["doc_id", "copy_no"]).any()
    for s in ("news_wire", "chat", "memo"):
        assert abs(shares[s].actual_share - targets[s].share / 0.95) < 0.005
        assert shares[s].tokens == got[got.source == s].tokens.sum()
    assert shares["absent"].actual_share == 0 and shares["absent"].docs_there == 0
    again = mix(df, "doc_id", "source", "tokens", targets)[0].toPandas()
    assert set(zip(again.doc_id, again.copy_no)) == set(zip(got.doc_id, got.copy_no))
    assert got.shuffle_key.is_monotonic_increasing


def test_mix_nothing(spark):
    mixture, report = mix(spark.createDataFrame([], "doc_id long, source string, tokens long"), "doc_id", "source", "tokens", {"a": Target(1.0, 1)})
    assert mixture.count() == 0 and report.collect()[0].tokens == 0


def test_names_of_targets_are_compared_like_those_of_documents(spark):
    df = spark.createDataFrame([(i, ["news wire", "NEWS-WIRE ", "chat"][i % 3], 10) for i in range(300)], "doc_id long, source string, tokens long")
    report = mix(df, "doc_id", "source", "tokens", {"News Wire": Target(0.5, 1), "Chat": Target(0.5, 2), None: Target(0.1, 1)})[1].collect()
    assert {r.source: round(r.actual_share, 1) for r in report} == {"news_wire": 0.5, "chat": 0.5}
    with pytest.raises(ValueError):
        mix(df, "doc_id", "source", "tokens", {"News Wire": Target(0.5, 1), "news_wire": Target(0.5, 2)})
