import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from dirty import write_tables  # noqa: E402

from almagest.llm.queries import QUERIES  # noqa: E402


@pytest.mark.parametrize("empty", [True, False])
def test_empty_and_dirty_tables(spark, tmp_path, empty):
    write_tables(spark, str(tmp_path), ["documents", "review_labels"], empty)
    for name in ("pack_specs", "mix_targets"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in QUERIES.items():
        n = query(spark, str(tmp_path)).count()
        assert n == 0 or not empty or name == "p7_shares", name


def test_texts_are_counted_once(spark):
    """A filter on the number of tokens doesn't count the texts again."""
    from pyspark.sql import functions as F

    from almagest.llm.tokens import token_count

    df = spark.createDataFrame([(i, "word " * i, "s") for i in range(5)], "doc_id long, text string, source string").select("doc_id", "source", token_count("text").alias("n"))
    plan = df.filter((F.col("n") > 2) & (F.col("source") == "s"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert df.filter("n > 2").count() == sum(r.n > 2 for r in df.collect()) > 0
