"""What a run folder holds besides the submission: configuration, split, and the training log, as JSON."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.panoptic import PostConfig


def save_config(spark: SparkSession, path: str, config: PostConfig, extra: dict | None = None) -> None:
    """The configuration's fields, and what else is known of it under ``validation``."""
    value = config.values() | ({"validation": extra} if extra is not None else {})
    spark.createDataFrame([(json.dumps(value, indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_config(spark: SparkSession, path: str) -> PostConfig:
    """Unknown fields are ignored, missing ones have their default; no file at all gives the default."""
    try:
        text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return PostConfig()
        raise
    return PostConfig.of(json.loads(text))


def save_weights(spark: SparkSession, path: str, weights: dict[str, np.ndarray]) -> None:
    """A checkpoint as a table: one row an array (name, shape, values as little-endian floats)."""
    rows = [(name, list(x.shape), bytearray(np.ascontiguousarray(x, "<f4").tobytes())) for name, x in weights.items()]
    spark.createDataFrame(rows, "name string, shape array<int>, data binary").coalesce(1).write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    """A checkpoint's arrays by name: a network's size, whatever the tables' size."""
    rows = spark.read.schema("name string, shape array<int>, data binary").parquet(path).collect()
    return {r["name"]: np.frombuffer(bytes(r["data"]), "<f4").reshape(r["shape"]) for r in rows}


def save_split(frames: DataFrame, path: str) -> None:
    frames.select("stem", "split").write.mode("overwrite").partitionBy("split").json(path)


def load_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """(stem) of one side; the other side's files aren't read."""
    return spark.read.schema("stem string, split string").json(path).where(F.col("split") == split).select("stem")


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Epochs in order; validation scores may be missing."""
    return spark.read.schema("epoch int, train_loss double, lr double, val_dice double, seconds double").json(path).orderBy("epoch")
