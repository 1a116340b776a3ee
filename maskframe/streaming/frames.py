"""Frames as a stream: each new image file is scored once, its instances go to a sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names


def image_stream(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """(path, stem, content) of image files as they arrive."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    raw = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", per_trigger).load(folder)
    return raw.where(names.is_image(F.col("path"))).select("path", names.image_stem(F.col("path")).alias("stem"), "content")


def run(stream: DataFrame, each: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Apply ``each`` to every micro-batch and append its rows; the checkpoint makes a file count once. Returns the query."""

    def write(batch: DataFrame, number: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
