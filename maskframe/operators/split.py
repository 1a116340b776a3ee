"""Leakage-safe splits: whole months go to validation until it has its share."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def split_by_rank(frames: DataFrame, month: str, rank: DataFrame, share: float = 0.15) -> DataFrame:
    """``frames`` with a split column; ``rank`` holds (month, rank). A month is taken while those before it hold too few."""
    counts = frames.groupBy(F.col(month).alias("m")).agg(F.count("*").alias("n")).join(rank.select(F.col(month).alias("m"), "rank"), "m")
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.sum("n").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    target = F.greatest(F.lit(1), F.bround(F.lit(share) * F.sum("n").over(everything)))
    chosen = counts.withColumn("held", before < target).select("m", "held")
    return frames.join(F.broadcast(chosen), F.col(month) == F.col("m")).select(*frames.columns, F.when(F.col("held"), "val").otherwise("train").alias("split"))


def shuffled_months(frames: DataFrame, month: str, seed: int = 42) -> DataFrame:
    """(month, rank) by a seeded shuffle of the sorted months: a list of calendar months, so it is small by nature."""
    months = sorted(r[0] for r in frames.select(month).where(F.col(month).isNotNull()).distinct().collect())
    random.Random(seed).shuffle(months)
    return frames.sparkSession.createDataFrame([(m, k) for k, m in enumerate(months)], f"{month} string, rank long")


def split_stems(frames: DataFrame, stem: str, share: float = 0.15, seed: int = 42) -> DataFrame:
    """Frames by the first six characters of their stem; where validation took everything, the first stem goes to training."""
    rows = frames.withColumn("__month", F.substring(stem, 1, 6))
    out = split_by_rank(rows, "__month", shuffled_months(rows, "__month", seed), share).drop("__month")
    first = out.agg(F.min(stem).alias("first"), F.count_if(F.col("split") == "train").alias("trains"))
    moved = (F.col("trains") == 0) & (F.col(stem) == F.col("first"))
    return out.crossJoin(F.broadcast(first)).withColumn("split", F.when(moved, "train").otherwise(F.col("split"))).drop("first", "trains")
