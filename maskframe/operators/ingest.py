"""Annotation documents to records: one row for each (physical image, annotator), with its segmentations.

Documents are read as VARIANT, since ids may be numbers or text and a segmentation has five shapes. Ids match by type and
value (1 is not "1"; 1 equals 1.0), nulls match nulls, and an image without usable annotations keeps an empty record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..functions.poly import variant_segmentation


def read_document(spark: SparkSession, path: str) -> DataFrame:
    """(doc variant) of each JSON file, read whole."""
    return spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("doc"))


def elements(docs: DataFrame, key: str) -> DataFrame:
    """(pos, entry) of a top-level list; a missing list is empty."""
    docs.createOrReplaceTempView("__maskframe_docs")
    sql = f"SELECT t.pos, t.value AS entry FROM __maskframe_docs, LATERAL variant_explode(try_variant_get(doc, '$.{key}', 'variant')) AS t"
    return docs.sparkSession.sql(sql)


def typed(v: Column) -> Column:
    """An id that keeps its type: numbers by value, text as text."""
    kind = F.schema_of_variant(v)
    text = v.try_cast("string")
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT", "INT") | F.startswith(kind, F.lit("DECIMAL"))
    return F.when(v.isNull() | F.is_variant_null(v), F.lit(None)).when(number, F.concat(F.lit("n:"), v.try_cast("double").cast("string"))).otherwise(F.concat(F.lit("s:"), text))


def _text(entry: str, key: str) -> Column:
    return F.try_variant_get(F.col(entry), f"$.{key}", "string")


def is_filled(v: Column) -> Column:
    """Neither missing nor null, nor an empty list, object or text."""
    text = F.to_json(v)
    return v.isNotNull() & ~F.is_variant_null(v) & ~text.isin("[]", "{}", '""', "0", "false")


def load_records(docs: DataFrame, files: DataFrame) -> DataFrame:
    """(stem, annotator, path, height, width, segmentations) from documents and (stem, path) of the image files.

    The path and size are those of the first entry, in document order; segmentations keep document order.
    """
    images = elements(docs, "images").select(
        F.col("pos").alias("image_pos"), typed(F.try_variant_get("entry", "$.id", "variant")).alias("id"), _text("entry", "id").alias("id_text"),
        names.first_filled(_text("entry", "file_name"), _text("entry", "filename"), _text("entry", "id")).alias("file"), names.annotator_of(F.col("entry")).alias("own"),
        names.side_or_default(F.try_variant_get("entry", "$.height", "int")).alias("height"), names.side_or_default(F.try_variant_get("entry", "$.width", "int")).alias("width"),
    )
    images = images.withColumn("stem", names.image_stem(F.col("file")))
    images = images.withColumn("default", names.default_annotator("own", names.prefix_annotator(F.col("file"), F.col("stem")), names.prefix_annotator(F.col("id_text"), F.col("stem")), image_id=F.col("id_text")))
    annotations = elements(docs, "annotations").select(
        F.col("pos").alias("ann_pos"), typed(F.try_variant_get("entry", "$.image_id", "variant")).alias("image_id"), names.annotator_of(F.col("entry")).alias("ann_by"), F.try_variant_get("entry", "$.segmentation", "variant").alias("seg"),
    ).where(is_filled(F.col("seg")))
    found = images.join(files.select(F.col("stem").alias("file_stem"), "path"), F.col("stem") == F.col("file_stem"))
    rows = found.join(annotations, F.col("id").eqNullSafe(F.col("image_id")), "left")
    rows = rows.withColumn("annotator", F.coalesce("ann_by", "default"))
    first = F.struct("image_pos", F.coalesce("ann_pos", F.lit(-1)))
    seg = F.when(F.col("seg").isNotNull(), F.struct("image_pos", "ann_pos", variant_segmentation(F.col("seg")).alias("segmentation")))
    out = rows.groupBy("stem", "annotator").agg(F.min_by("path", first).alias("path"), F.min_by("height", first).alias("height"), F.min_by("width", first).alias("width"), F.array_sort(F.collect_list(seg)).alias("segs"))
    return out.select("stem", "annotator", "path", "height", "width", F.transform("segs", lambda s: s["segmentation"]).alias("segmentations"))


def missing_images(images: DataFrame, files: DataFrame) -> DataFrame:
    return images.join(files, "stem", "left_anti")


def report(images: DataFrame, annotations: DataFrame, records: DataFrame, missing: DataFrame, examples: int = 5) -> DataFrame:
    """One row of counts, with the first missing stems in order."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    stems = records.agg(F.count("*").alias("records"), F.count_distinct("stem").alias("physical_images"), F.count_distinct("annotator").alias("annotators"))
    first = missing.agg(F.count("*").alias("missing")).crossJoin(missing.select("stem").orderBy("stem").limit(examples).agg(F.array_join(F.array_sort(F.collect_list("stem")), ",").alias("missing_examples")))
    return count(images, "images").crossJoin(count(annotations, "annotations")).crossJoin(stems).crossJoin(first)
