"""Submission files: two unquoted columns as text, and the run folder's small JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names

COLUMNS = ("filament_id", "segmentation_rle")
HEADER = ",".join(COLUMNS)


def write_submission(rows: DataFrame, path: str) -> int:
    """Write one text file in order of image and number; counts that could not stand unquoted raise. Returns the rows."""
    counts = F.col("segmentation_rle")
    safe = F.when(names.illegal_counts(counts), F.raise_error(F.concat(F.lit("illegal character in the counts of "), F.col("filament_id")))).otherwise(counts)
    lines = rows.select(F.lit(1).alias("part"), names.instance_stem(F.col("filament_id")).alias("stem"), names.instance_number(F.col("filament_id")).alias("n"), F.concat_ws(",", "filament_id", safe).alias("value"))
    head = rows.sparkSession.createDataFrame([(0, None, None, HEADER)], "part int, stem string, n long, value string")
    # the format is one file with a header, so one task writes it
    head.unionByName(lines).repartition(1).sortWithinPartitions("part", "stem", "n").select("value").write.mode("overwrite").text(path)
    # what was written is counted, not what it was made from: that may be a whole run's inference
    return rows.sparkSession.read.text(path).count() - 1


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a submission: the header must be exact, blank lines are skipped, the first comma separates."""
    lines = spark.read.text(path, wholetext=True).select(F.split(F.regexp_replace("value", "\r\n", "\n"), "\n").alias("lines"))
    ok = F.when(F.get("lines", F.lit(0)) != HEADER, F.raise_error(F.concat(F.lit("unexpected header: "), F.get("lines", F.lit(0))))).otherwise(F.col("lines"))
    rows = lines.select(F.explode(F.slice(ok, 2, F.greatest(F.size(ok) - 1, F.lit(0)))).alias("line")).where(F.trim("line") != "")
    return rows.select(F.regexp_extract("line", "^([^,]*)", 1).alias("filament_id"), F.regexp_extract("line", "^[^,]*,?(.*)$", 1).alias("segmentation_rle"))


def by_image(rows: DataFrame) -> DataFrame:
    """(image, counts) with counts in order of their number."""
    parsed = rows.select(names.instance_stem(F.col("filament_id")).alias("image"), F.struct(names.instance_number(F.col("filament_id")).alias("n"), F.col("segmentation_rle").alias("counts")).alias("c"))
    return parsed.where("image is not null").groupBy("image").agg(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["counts"]).alias("counts"))


def summary(images: DataFrame, rows: DataFrame, **extra) -> DataFrame:
    """One row: images, rows, images without a row (in order), and what else is given. No rows at all raises."""
    parsed = rows.select(names.instance_stem(F.col("filament_id")).alias("image")).groupBy("image").agg(F.count("*").alias("n"))
    joined = images.join(parsed, "image", "left")
    total = F.coalesce(F.sum("n"), F.lit(0))
    out = joined.agg(F.count("*").alias("images"), total.alias("rows"), F.array_sort(F.collect_list(F.when(F.col("n").isNull(), F.col("image")))).alias("undetected"))
    checked = F.when(F.col("rows") == 0, F.raise_error(F.lit("no instance in any image"))).otherwise(F.col("rows")).cast("long")
    return out.withColumn("rows", checked).select("*", *[F.lit(v).alias(k) for k, v in extra.items()])


def write_json(values: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Small JSON lines: a split, a configuration, a summary; logs append."""
    values.write.mode(mode).json(path)
