"""Table functions for SQL: the spans of a mask's counts text, and tile starts."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .rle import counts_from, runs_of


@udtf(returnType="s int, e int")
class MaskSpans:
    """Runs of a counts text; no row for null, malformed or incomplete texts."""

    def eval(self, text: str, h: int, w: int):
        try:
            yield from (() if text is None else runs_of(counts_from(text, h * w)))
        except ValueError:
            return


@udtf(returnType="start int")
class TileStarts:
    """Regular starts and one flush with the end."""

    def eval(self, size: int, tile: int, stride: int):
        from ..operators.raster import tile_starts

        for s in tile_starts(size, tile, stride):
            yield (s,)


def register(spark: SparkSession) -> None:
    spark.udtf.register("mask_spans", MaskSpans)
    spark.udtf.register("tile_starts", TileStarts)
