"""Checks of a submission: rows (rule, image, detail) of what is wrong; no row means it is fine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, rle


def violations(rows: DataFrame, known: DataFrame, height: int = 2048, width: int = 2048) -> DataFrame:
    """``rows``: (filament_id, segmentation_rle); ``known``: (image).

    One pass: each row is decoded once, spread over its spans, and shuffled once by image; overlaps are a sweep over an
    image's spans, and the rules that a row breaks are told at its first span. Rows without an image go by their id.
    """
    parsed = rows.select("filament_id", "segmentation_rle", names.instance_stem(F.col("filament_id")).alias("image"))
    key = F.coalesce("image", F.concat(F.lit("\u0000"), F.col("filament_id")), F.lit("\u0001"))
    decoded = parsed.withColumn("key", key).withColumn("runs", rle.rle_decode(F.col("segmentation_rle"), F.lit(height), F.lit(width)))
    spans = decoded.select("*", F.posexplode_outer("runs").alias("place", "r")).select("*", F.col("r.s").alias("s"), F.col("r.e").alias("e"), F.coalesce(F.col("place") == 0, F.lit(True)).alias("first"))
    sweep, whole, same = Window.partitionBy("key").orderBy("s", "e"), Window.partitionBy("key"), Window.partitionBy("key", "filament_id")
    ahead = F.max("e").over(sweep.rowsBetween(Window.unboundedPreceding, -1))
    told = spans.withColumn("crossing", F.col("image").isNotNull() & (ahead > F.col("s"))).withColumn("n_image", F.row_number().over(sweep))
    told = told.withColumn("crossing", F.max("crossing").over(whole)).withColumn("copies", F.sum(F.col("first").cast("int")).over(same)).withColumn("n_id", F.row_number().over(same.orderBy("place")))
    told = told.where("first or n_image = 1").join(known.select(F.col("image").alias("known")).distinct(), F.col("image") == F.col("known"), "left")
    id_, none = F.col("filament_id"), F.lit(None).cast("string")
    rule = lambda name, broken, detail=id_: F.when(broken, F.struct(F.lit(name).alias("rule"), detail.alias("detail")))
    broken = F.array(
        rule("illegal_characters", F.col("first") & (names.illegal_counts(F.col("segmentation_rle")) | id_.rlike("[,\"']"))),
        rule("duplicate_id", F.col("first") & (F.col("copies") > 1) & (F.col("n_id") == 1)),
        rule("bad_id", F.col("first") & F.col("image").isNull()),
        rule("unknown_image", F.col("first") & F.col("image").isNotNull() & F.col("known").isNull()),
        rule("undecodable", F.col("first") & F.col("runs").isNull()),
        rule("empty_mask", F.col("first") & (F.size("runs") == 0)),
        rule("overlap", F.col("crossing") & (F.col("n_image") == 1), none),
    )
    out = told.select("image", F.explode(F.filter(broken, lambda x: x.isNotNull())).alias("x"))
    return out.select("x.rule", "image", "x.detail")


def unknown(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Images that rows are for and that aren't known, once each."""
    return rows.select(names.instance_stem(F.col("filament_id")).alias("image")).where("image is not null").distinct().join(known, "image", "left_anti")


def undetected(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Known images without any row."""
    return known.join(rows.select(names.instance_stem(F.col("filament_id")).alias("image")).distinct(), "image", "left_anti")
