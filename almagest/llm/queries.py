"""Queries p6 to p8 over a folder of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almagest.llm import abuse, mixing, packing
from almagest.llm.tokens import token_count
from almagest.sources.tables import table


def _sized(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "source", token_count("text").alias("tokens"))


# --- 6


def _capacities(spark: SparkSession, folder: str) -> dict[int, int]:
    rows = table(spark, folder, "pack_specs").select("spec_id", "capacity_tokens").limit(1001).collect()
    assert len(rows) <= 1000, "pack_specs holds a few sizes of containers"
    return {r["spec_id"]: r["capacity_tokens"] for r in rows}


def p6_packed(spark: SparkSession, folder: str) -> DataFrame:
    """Every document, in containers of every capacity."""
    packed = packing.pack(_sized(spark, folder), "doc_id", "tokens", _capacities(spark, folder))
    return packed.withColumnsRenamed({"item_id": "doc_id", "size": "tokens"})


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers and share of their room used, per capacity."""
    capacities = _capacities(spark, folder)
    return packing.fill_report(packing.pack(_sized(spark, folder), "doc_id", "tokens", capacities), capacities)


# --- 7


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, folder, "mix_targets").limit(1001).collect()
    assert len(rows) <= 1000, "mix_targets holds a few sources"
    targets = {r["source"]: mixing.Target(r["target_share"], r["max_repeats"]) for r in rows}
    names = [mixing.plain_name(s) for s in targets if s is not None]
    wanted = table(spark, folder, "documents").filter(mixing.source_name(F.col("source")).isin(*names))  # only these are counted
    return mixing.mix(wanted.select("doc_id", "source", token_count("text").alias("tokens")), "doc_id", "source", "tokens", targets)


def p7_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """The mixture: one row per copy of a document, in random order."""
    return _mix(spark, folder)[0]


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Target and actual shares of the sources."""
    report = _mix(spark, folder)[1]
    return report.withColumn("actual_share", F.round("actual_share", 6))


# --- 8


def p8_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its score and whether it is found."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return abuse.scored(docs, abuse.train(docs, table(spark, folder, "review_labels"))).drop("text")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_scores(spark, folder).filter("found").select("doc_id")


def p8_rates(spark: SparkSession, folder: str) -> DataFrame:
    """Per source (names without case and spacing): documents, found ones, their rate."""
    docs = p8_scores(spark, folder).groupBy(mixing.source_name(F.col("source")).alias("source"))
    return docs.agg(F.count("*").alias("docs"), F.count_if("found").alias("found_docs"), F.round(F.avg(F.col("found").cast("double")), 6).alias("found_rate"))


QUERIES = {"p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates, "p6_packed": p6_packed, "p6_fill": p6_fill, "p7_mixture": p7_mixture, "p7_shares": p7_shares}
SQL: dict[str, str] = {}
