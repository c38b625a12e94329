"""Small things that are kept: settings, groups, fitted models, universes, weekly books, tables for charts."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def universe(spark: SparkSession, path: str) -> DataFrame:
    """Names of a text file with one a line: ``ticker``, each once. Blank lines and lines that begin with # are no names."""
    lines = spark.read.text(path).select(F.trim("value").alias("ticker"))
    return lines.filter((F.col("ticker") != "") & ~F.col("ticker").startswith("#")).distinct()


def write_universe(df: DataFrame, path: str) -> None:
    df.select("ticker").dropna().distinct().write.mode("overwrite").text(path)


def _plain(value: Any) -> Any:
    if isinstance(value, np.ndarray):
        return {"array": value.tolist()}
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    return value.item() if isinstance(value, np.generic) else value


def _back(value: Any) -> Any:
    if isinstance(value, dict):
        return np.array(value["array"]) if set(value) == {"array"} else {k: _back(v) for k, v in value.items()}
    return value


def _path(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def save_json(spark: SparkSession, value: dict, path: str) -> None:
    """Settings, groups by year or fitted models as one JSON file of any file system; arrays come back as arrays."""
    place, files = _path(spark, path)
    out = files.create(place, True)
    try:
        out.write(bytearray(json.dumps(_plain(value), indent=1, sort_keys=True).encode()))
    finally:
        out.close()


def load_json(spark: SparkSession, path: str) -> dict | None:
    """What :func:`save_json` kept, or None where nothing is or what is there is no JSON. Keys come back as text."""
    place, files = _path(spark, path)
    if not files.exists(place):
        return None
    text = "\n".join(r["value"] for r in spark.read.text(path).collect())  # one small file
    try:
        return _back(json.loads(text))
    except ValueError:
        return None


def changed(settings: dict, change: dict[str, dict]) -> dict:
    """A copy of settings with the keys of some sections replaced; the settings stay as they were."""
    copy = json.loads(json.dumps(settings))
    return {**copy, **{part: {**copy.get(part, {}), **keys} for part, keys in change.items()}}


def kept_book(spark: SparkSession, path: str, version: str, decided: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The book of a version and day, computed and kept if it isn't yet. Only its own partition is read and written."""
    place, files = _path(spark, f"{path}/version={version}/decided={decided}")
    if not files.exists(place):
        compute().write.mode("overwrite").parquet(place.toString())
    return spark.read.parquet(place.toString())


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
