"""Streams of events: windowed counts, duplicates, flags with memory. The transformations also run on batches."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from almagest.operators import books, models


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts and totals per hour and type; on a stream, rows later than ``late`` are left out.

    Zoneless times are read as UTC, since a watermark needs instants.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def first_deliveries(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once; a stream remembers ids for as long as ``late``."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else timed.dropDuplicates(["event_id"])


def held_flags(checks: DataFrame, off_after: int = 2) -> DataFrame:
    """A flag per name that is on with a true check and off after ``off_after`` false ones in a row.

    ``checks`` has ``name, date, raw``. The state of a name is the number of checks since the last true one. A batch of
    a name is put in order of date; micro-batches must arrive in that order.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (calm,) = state.get if state.exists else (off_after,)
        part = pd.concat(parts).sort_values("date")
        flags: list[Any] = []
        for raw in part["raw"].fillna(False):
            calm = 0 if raw else calm + 1
            flags.append(calm < off_after)
        state.update((min(calm, off_after),))
        yield pd.DataFrame({"name": part["name"], "date": part["date"], "flag": flags})

    return checks.groupBy("name").applyInPandasWithState(step, "name string, date date, flag boolean", "calm int", "append", GroupStateTimeout.NoTimeout)


def stress_probabilities(returns: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """Probability of the second of two states after each return (``name, date, ret``), as in batch.

    ``model`` has ``pi, move, mean, sd``. The state of a name is its two shares; micro-batches must arrive in order of
    date. Null and NaN returns give no row.
    """
    pi, move, mean, sd = (model[k] for k in ("pi", "move", "mean", "sd"))

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        part = pd.concat(parts).dropna(subset=["ret"]).sort_values("date")
        if part.empty:
            return
        start = np.array(state.get) @ move if state.exists else pi
        share, _ = models.filtered(part["ret"].to_numpy(float), start, move, mean, sd)
        state.update(tuple(float(x) for x in share[-1]))
        yield pd.DataFrame({"name": part["name"], "date": part["date"], "p_stress": share[:, 1]})

    return returns.groupBy("name").applyInPandasWithState(step, "name string, date date, p_stress double", "calm double, stress double", "append", GroupStateTimeout.NoTimeout)


def carried_books(candidates: DataFrame, n: int = 15, exit_rank: int = 30, quota: int = 4) -> DataFrame:
    """Books of each portfolio from its candidates of each date (``portfolio, date, ticker, grp, rnk``), as in batch.

    The state of a portfolio is the names it holds. A micro-batch holds whole dates, in order.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (held,) = state.get if state.exists else ([],)
        held, out = list(held), []
        for date, part in pd.concat(parts).groupby("date", sort=True):
            held = books.select_banded(dict(zip(part["ticker"], part["rnk"])), books.groups_of(part), held, n, exit_rank, quota)
            out += [(key[0], date, t, 1.0 / len(held)) for t in held]
        state.update((held,))
        yield pd.DataFrame(out, columns=["portfolio", "date", "ticker", "weight"])

    return candidates.groupBy("portfolio").applyInPandasWithState(step, "portfolio string, date date, ticker string, weight double", "held array<string>", "append", GroupStateTimeout.NoTimeout)


def known_by(updates: DataFrame, late: str = "1 day") -> DataFrame:
    """The newest period of each ticker that became known in each day of knowledge time (``ticker, period, known``).

    Knowledge time is the stream's event time: the watermark says up to when everything known has arrived.
    """
    timed = updates.withColumn("known", F.col("known").cast("timestamp")).withWatermark("known", late)
    out = timed.groupBy(F.window("known", "1 day").alias("w"), "ticker").agg(F.max("period").alias("period"))
    return out.select(F.col("w.start").alias("day"), "ticker", "period")


def start(df: DataFrame, path: str, checkpoints: str, every: str | None = None) -> StreamingQuery:
    """Write a stream to Parquet, all that is there at once or looking again ``every`` so often; it goes on where it stopped."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoints).outputMode("append").trigger(**trigger).start()
