"""Sources mixed to target shares of all tokens by hash-seeded Poisson replication."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almagest.session import checkpoint

#: Rates tried at once in the search for a source's rate, and passes of the search.
GRID, PASSES = 64, 4


@dataclass(frozen=True)
class Target:
    share: float
    max_repeats: int


def source_name(source: Column) -> Column:
    """A source's name without differences of case and spacing."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s_\-]+", "_")


def plain_name(source: str) -> str:
    """The same of one name."""
    return re.sub(r"[\s_\-]+", "_", source.strip(" ").lower())


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11) / F.lit(float(1 << 53))


def thresholds(rate: np.ndarray, repeats: int) -> np.ndarray:
    """P(N < k) for k = 1 to ``repeats`` of Poisson numbers N with the given rates; one row per rate."""
    rate = np.asarray(rate, dtype=np.float64)[:, None]
    k = np.arange(repeats)
    term = np.exp(-rate) * np.cumprod(np.where(k == 0, 1.0, rate / np.maximum(k, 1)), axis=1)
    return np.cumsum(term, axis=1)


def rates(docs: DataFrame, targets: dict[str, Target], budget: dict[str, float]) -> dict[str, float]:
    """Per source the Poisson rate at which the copies of its documents hold ``budget`` tokens.

    The uniform number of a document is fixed, so its number of copies only grows with the rate, and so do the tokens
    of the source: a grid search narrows the rate, summing all documents in each pass. Partial sums are made before
    the shuffle, one row per source, rate and batch.
    """
    low = {s: 0.0 for s in budget}
    high = {s: 40.0 + 4 * targets[s].max_repeats for s in budget}
    best = {s: (0.0, abs(budget[s])) for s in budget}
    for _ in range(PASSES):
        grid = {s: np.linspace(low[s], high[s], GRID) for s in budget}
        cut = {s: thresholds(grid[s], targets[s].max_repeats) for s in budget}

        def sums(batches: Iterator[pd.DataFrame], cut: dict = cut) -> Iterator[pd.DataFrame]:
            total = {s: np.zeros(GRID) for s in cut}
            for batch in batches:
                for s, part in batch.groupby("source"):
                    order = np.argsort(part["u"].to_numpy())
                    u, upto = part["u"].to_numpy()[order], np.append(0, np.cumsum(part["tokens"].to_numpy()[order]))
                    for k in range(cut[s].shape[1]):  # a copy k + 1 for each u at or above the threshold
                        total[s] += upto[-1] - upto[np.searchsorted(u, cut[s][:, k], side="left")]
            yield pd.DataFrame([(s, j, float(x)) for s, t in total.items() for j, x in enumerate(t)], columns=["source", "j", "tokens"])

        found = docs.mapInPandas(sums, "source string, j int, tokens double").groupBy("source", "j").agg(F.sum("tokens").alias("tokens"))
        reached = {s: np.zeros(GRID) for s in budget}
        for r in found.collect():  # GRID rows for each target source
            reached[r["source"]][r["j"]] = r["tokens"]
        for s in budget:
            miss = np.abs(reached[s] - budget[s])
            j = int(np.argmin(miss))
            if miss[j] < best[s][1]:
                best[s] = (float(grid[s][j]), float(miss[j]))
            below = int(np.searchsorted(reached[s], budget[s], side="right")) - 1
            low[s], high[s] = float(grid[s][max(0, below)]), float(grid[s][min(GRID - 1, below + 1)])
    return {s: r for s, (r, _) in best.items()}


def mix(
    docs: DataFrame, doc_id: str, source: str, tokens: str, targets: dict[str, Target], total: float | None = None, seed: int = 7
) -> tuple[DataFrame, DataFrame]:
    """A mixture in which each source holds its target share of all tokens, and a report.

    The mixture has one row per copy of a document (``doc_id, source, tokens, copy_no, shuffle_key``), in global random
    order of ``shuffle_key``. The number of copies of a document is a Poisson number, inverted from a hash of its id and
    cut at the source's ``max_repeats``; the rate of each source is such that its tokens come as near its share as
    whole documents allow. ``total`` tokens are wanted; by default as many as the scarcest source allows at its share.
    If ``total`` asks more of a source than its documents repeated ``max_repeats`` times, it gives them all.

    The report has one row per target: documents and tokens there are, ``target_share``, documents used, copies, tokens
    and ``actual_share`` reached. A target without documents reaches 0; the others keep their proportions. Documents without a target, with
    null source or without tokens are not used. Names of sources and of targets are compared without case and spacing;
    the report has the names of the documents. Targets that are the same name are an error; one without a name counts
    for nothing.
    """
    named = [(plain_name(s), t) for s, t in targets.items() if s is not None]
    plain = dict(named)
    if len(plain) < len(named):
        raise ValueError("targets that differ in case or spacing only")
    targets = plain
    named = docs.select(F.col(doc_id).alias("doc_id"), source_name(F.col(source)).alias("source"), F.col(tokens).cast("long").alias("tokens"))
    named = checkpoint(named.filter((F.col("tokens") > 0) & F.col("source").isin(*targets)).withColumn("u", uniform(F.col("doc_id"), seed)))
    have = {r["source"]: r for r in named.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")).collect()}
    active = {s: t for s, t in targets.items() if s in have and t.share > 0 and t.max_repeats > 0}
    if total is None:
        total = min((have[s]["tokens"] * t.max_repeats / t.share for s, t in active.items()), default=0.0)
    budget = {s: min(t.share * total, float(have[s]["tokens"] * t.max_repeats)) for s, t in active.items()}
    rate = rates(named.filter(F.col("source").isin(*active)), active, budget) if active else {}
    cut = {s: thresholds(np.array([rate[s]]), t.max_repeats)[0].tolist() for s, t in active.items()}
    if cut:
        limits = F.create_map(*[x for s, c in cut.items() for x in (F.lit(s), F.array(*map(F.lit, c)))])
        copies = F.size(F.filter(F.try_element_at(limits, F.col("source")), lambda c: F.col("u") >= c))
        used = named.filter(F.col("source").isin(*active)).withColumn("copies", copies).filter("copies > 0")
    else:
        used = named.withColumn("copies", F.lit(0)).limit(0)
    mixture = used.select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(1), "copies")).alias("copy_no"))
    mixture = mixture.withColumn("shuffle_key", F.xxhash64(F.lit(seed + 1), "doc_id", "copy_no")).repartitionByRange("shuffle_key").sortWithinPartitions("shuffle_key")
    spark = docs.sparkSession
    wanted = [(s, float(t.share), int(t.max_repeats), int(have[s]["docs"]) if s in have else 0, int(have[s]["tokens"]) if s in have else 0) for s, t in targets.items()]
    wanted = spark.createDataFrame(wanted, "source string, target_share double, max_repeats int, docs_there long, tokens_there long")
    reached = used.groupBy("source").agg(F.count("*").alias("docs_used"), F.sum("copies").alias("copies"), F.max("copies").alias("most_repeats"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"))
    report = wanted.join(reached, "source", "left").na.fill(0)
    from pyspark.sql import Window

    everything = F.sum("tokens").over(Window.partitionBy())  # one row per target
    return mixture, report.withColumn("actual_share", F.col("tokens") / F.nullif(everything, F.lit(0)))
