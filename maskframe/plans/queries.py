"""Every operator on the test tables' own structures: traces (events), 8 by 8 rasters (embeddings), intervals (lineitem),
file names (orders, pages), two raters (labels), and multimaps (conversations).

Each function takes (spark, sf_dir); ``oracle`` holds the same in SQL under the same key.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names, rle, scores
from .. import session
from ..operators import components, ingest, panoptic, raster, split, training, validate
from ..operators import spans as sp
from ..operators.panoptic import PostConfig
from ..sources import images, layout, submission, synthetic
from . import stages

ORIGIN, FRAME_DAYS = "1990-01-01", 5000
#: Four masks of an 8 by 8 frame as counts; the last doesn't cover the frame.
COUNTS = ([10, 5, 49], [12, 9, 43], [40, 8, 16], [10, 5, 40])
GRID = panoptic.grid((0.04, 0.07, 0.1), (1, 3), (0, 2, 3), max_instances=4)
MERGES = [PostConfig(0.15, 0, reach, False, 64) for reach in (1, 2, 3)]
ANNOTATORS = [PostConfig(0.04, 1, 0, False, 6), PostConfig(0.06, 1, 0, False, 6), PostConfig(0.08, 1, 0, False, 6)]
PREDICTION = PostConfig(0.07, 2, 0, True, 5)


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _rounded(c: Column, places: int = 6) -> Column:
    return F.bround(c, places)


def frames(spark, sf) -> DataFrame:
    """(o_orderkey, path): image files of several kinds, most of them named by a frame id."""
    o = _t(spark, sf, "orders")
    stem = F.concat(F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.element_at(F.array(*map(F.lit, "BML")), (F.col("o_orderkey") % 3 + 1).cast("int")), F.lit("h"))
    plain = F.concat(F.lit("plain-"), F.col("o_orderkey").cast("string"))
    suffix = F.element_at(F.array(*map(F.lit, (".jpg", ".PNG", ".tiff", ".txt"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    path = F.concat(F.lit("img/A"), (F.col("o_custkey") % 5).cast("string"), F.lit("-"), F.when(F.col("o_orderkey") % 7 != 0, stem).otherwise(plain), suffix)
    return o.select("o_orderkey", "o_custkey", path.alias("path"))


def rasters(spark, sf) -> DataFrame:
    return _t(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def pixels(spark, sf) -> DataFrame:
    return rasters(spark, sf).select("vec_id", F.posexplode("v").alias("pos", "v"))


def intervals(spark, sf) -> DataFrame:
    """(l_orderkey, n, flag, rater, s, e): shipping intervals in days, numbered by all columns."""
    l = _t(spark, sf, "lineitem")  # noqa: E741
    order = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_quantity", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    s = F.datediff(F.to_date("l_shipdate"), F.to_date(F.lit(ORIGIN))).cast("long")
    return l.select("l_orderkey", F.row_number().over(order).alias("n"), F.col("l_returnflag").alias("flag"), (F.col("l_suppkey") % 3).alias("rater"), s.alias("s"), (s + F.col("l_quantity").cast("long")).alias("e"))


def trace(spark, sf) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _t(spark, sf, "events").select("user_id", "event_id", "value", (F.row_number().over(order) - 1).cast("long").alias("i"))


def image_stem_parse(spark, sf):
    f = frames(spark, sf).withColumn("stem", names.image_stem(F.col("path")))
    return f.select("o_orderkey", "stem", names.month_key(F.col("stem")).alias("month"), names.year_key(F.col("stem")).alias("year"))


def annotator_coalesce(spark, sf):
    """Annotators named under several keys of a JSON object, as text, number or not at all."""
    k, e = F.col("event_id"), _t(spark, sf, "events")
    entry = F.struct(
        F.when(k % 4 == 0, "").alias("annotator"), F.when(k % 5 == 0, k).alias("annotator_name"), F.when(k % 3 != 0, F.get_json_object("props", "$.k").cast("long")).alias("rater"),
        F.when(k % 7 != 0, F.col("event_type")).alias("user_id"), F.lit("x").alias("other"))
    return e.select("event_id", names.default_annotator(names.annotator_of(F.parse_json(F.to_json(entry))), image_id=k).alias("annotator"))


def prefix_annotator(spark, sf):
    f = frames(spark, sf)
    return f.select("o_orderkey", names.prefix_annotator(F.col("path"), names.image_stem(F.col("path"))).alias("annotator"))


def _numbered(spark, sf) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return _t(spark, sf, "orders").select("o_orderkey", names.instance_id(F.col("o_custkey").cast("string"), n).alias("filament_id"))


def submission_ids(spark, sf):
    return _numbered(spark, sf)


def submission_id_parse(spark, sf):
    i = F.col("filament_id")
    return _numbered(spark, sf).select("o_orderkey", names.instance_stem(i).alias("stem"), names.instance_number(i).alias("n"), names.instance_stem(F.concat(F.lit("x"), names.instance_stem(i))).isNull().alias("bad"))


def working_size(spark, sf):
    scale = F.explode(F.array(*map(F.lit, (0.25, 0.5, 1.0, 1.5)))).alias("scale")
    return _t(spark, sf, "part").select("p_partkey", F.col("p_size").alias("side"), scale).select("p_partkey", "scale", names.working_size(F.col("side"), F.col("scale")).alias("size"))


def polygon_normalize(spark, sf):
    v = F.col("v")
    pairs = F.array(F.slice(v, 1, 2), F.slice(v, 3, 2), F.slice(v, 5, 2), F.slice(v, 7, 2))
    lists = F.array(F.slice(v, 1, 8), F.slice(v, 9, 4), F.slice(v, 13, 6))
    rings = names.normalized_polygons(F.when(F.col("vec_id") % 3 == 0, pairs).otherwise(lists))
    numbers = F.aggregate("rings", F.lit(0), lambda a, r: a + F.size(r))
    return rasters(spark, sf).select("vec_id", rings.alias("rings")).select("vec_id", F.size("rings").alias("rings_kept"), numbers.alias("numbers"), F.get(F.get("rings", F.size("rings") - 1), F.lit(0)).alias("last_first"))


def config_list_parse(spark, sf):
    text = F.concat(F.lit(" 0.3, ,"), F.col("r_regionkey").cast("string"), F.lit(".5,,0.6 ,"))
    return _t(spark, sf, "region").select("r_regionkey", F.posexplode(names.number_list(text)).alias("place", "value"))


def find_annotation_rank(spark, sf):
    """The annotation file among many, some in folders whose names would rank first if they counted."""
    k = F.col("page_id")
    folder = F.element_at(F.array(*map(F.lit, ("train_annotation_set", "plain", "de-ep/er"))), (k % 3 + 1).cast("int"))
    file = F.element_at(F.array(*map(F.lit, ("labels", "Annotation", "Train-Annotations", "train"))), (k % 4 + 1).cast("int"))
    return layout.first_annotations(_t(spark, sf, "pages").select(F.concat(folder, F.lit("/"), file, F.lit("_"), k.cast("string"), F.lit(".json")).alias("path")))


def list_images_filter(spark, sf):
    return images.index_images(frames(spark, sf).where(names.is_image(F.col("path"))))


def first_n_images(spark, sf):
    return frames(spark, sf).select("o_orderkey", names.image_stem(F.col("path")).alias("stem")).orderBy("stem", "o_orderkey").limit(25)


def documents_as_annotations(spark, sf) -> DataFrame:
    """(doc variant): JSON annotation documents of 50 images each, with the labels as annotations.

    An image has one of three annotators before its frame id, every fifth no size; annotations come in three layouts, some of
    them empty, some with an annotator of their own.
    """
    d, a = _t(spark, sf, "documents").select("doc_id", "n_chars"), _t(spark, sf, "labels").withColumnRenamed("doc_id", "image_id")
    k, part = F.col("doc_id"), F.floor(F.col("doc_id") / 50)
    file = F.concat(F.lit("d/A"), (k % 3).cast("string"), F.lit("-"), _stem_of(k), F.lit(".jpg"))
    image = F.struct(k.alias("id"), file.alias("file_name"), F.when(k % 5 != 0, 64 + k % 7).alias("height"), F.lit(48).alias("width"))
    ring = F.array(*[(F.col("image_id") % 9 + x).cast("double") for x in (0, 1, 20, 1, 20, 30)])
    flat, deep, none = (F.to_json(x) for x in (ring, F.array(ring, F.transform(ring, lambda v: v + 5)), F.array().cast("array<double>")))
    seg = F.when(F.col("image_id") % 4 == 0, flat).when(F.col("image_id") % 4 == 3, none).otherwise(deep)
    by = F.when(F.col("toxic") == 1, F.lit(',"labeler":"T"')).otherwise(F.lit(""))
    annotation = F.concat(F.lit('{"image_id":'), F.col("image_id").cast("string"), by, F.lit(',"segmentation":'), seg, F.lit("}"))
    listed = lambda rows, key, x: rows.groupBy("part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), x.alias("x")))), lambda y: y["x"]), ",").alias(key))
    made = listed(d.withColumn("part", part), "doc_id", F.to_json(image)).join(listed(a.withColumn("part", F.floor(F.col("image_id") / 50)), "image_id", annotation), "part", "left")
    return made.select(F.parse_json(F.concat(F.lit('{"images":['), "doc_id", F.lit('],"annotations":['), F.coalesce("image_id", F.lit("")), F.lit("]}"))).alias("doc"))


def _stem_of(k: Column) -> Column:
    """The frame id of two neighbouring documents."""
    return F.concat(F.date_format(F.timestamp_seconds(F.lit(1_400_000_000) + F.floor(k / 2) * 3600), "yyyyMMddHHmmss"), F.lit("Bh"))


def load_records(spark, sf):
    d = _t(spark, sf, "documents").select(_stem_of(F.col("doc_id")).alias("stem"), F.floor(F.col("doc_id") / 2).alias("k")).distinct().where("k % 7 <> 0")
    found = ingest.load_records(documents_as_annotations(spark, sf), d.select("stem", F.concat(F.lit("img/"), "stem", F.lit(".jpg")).alias("path")))
    rings = F.aggregate("segmentations", F.lit(0), lambda n, s: n + F.size(s["polys"]))
    first = F.get(F.get(F.get(F.col("segmentations"), F.lit(0))["polys"], F.lit(0)), F.lit(0))
    return found.select("stem", "annotator", "path", "height", "width", F.size("segmentations").alias("segmentations"), rings.alias("rings"), first.alias("first"))


def loader_report(spark, sf):
    d, a = _t(spark, sf, "documents").select(F.format_string("%09d", "doc_id").alias("stem"), F.col("source").alias("annotator")), _t(spark, sf, "labels").select(F.format_string("%09d", "doc_id").alias("stem"))
    return ingest.report(d, a, d.join(a, "stem", "left_semi"), ingest.missing_images(d, a))


def group_by_stem(spark, sf):
    c = _t(spark, sf, "conversations")
    turns = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat_ws(":", x["turn"], x["role"])), ",")
    return c.groupBy("conv_id").agg(F.count("*").alias("n"), turns.alias("turns"))


def annotators_per_image(spark, sf):
    per = _t(spark, sf, "conversations").groupBy("conv_id").agg(F.count_distinct("role").alias("roles"))
    return per.groupBy("roles").agg(F.count("*").alias("conversations"))


def top_annotators(spark, sf):
    e = _t(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    return e.orderBy(F.col("n").desc(), "first").limit(10).select("user_id", "n")


def filaments_min_mean_max(spark, sf):
    per = _t(spark, sf, "conversations").groupBy(F.col("conv_id").alias("stem")).agg(F.min("role").alias("annotator"), F.collect_list("turn").alias("segmentations"))
    return stages.inspect(per)


def images_per_year(spark, sf):
    return image_stem_parse(spark, sf).groupBy("year").agg(F.count("*").alias("images"))


def known_image_check(spark, sf):
    rows = _t(spark, sf, "orders").where("o_orderstatus = 'F'").select(names.instance_id(F.col("o_custkey").cast("string"), F.col("o_orderkey")).alias("filament_id"))
    known = _t(spark, sf, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").cast("string").alias("image"))
    return validate.unknown(rows, known).select(F.lit("unknown").alias("rule"), "image").unionAll(validate.undetected(rows, known).select(F.lit("undetected").alias("rule"), "image"))


def split_holdout_months(spark, sf):
    o = _t(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMM").alias("month"))
    rank = o.select("month").distinct().withColumn("rank", F.row_number().over(Window.orderBy(F.md5("month"))))
    return split.split_by_rank(o, "month", rank).groupBy("month", "split").agg(F.count("*").alias("images"))


def zscore_normalize(spark, sf):
    rows = raster.normalized(trace(spark, sf), ["user_id"], "value", F.col("value") >= 20)
    return rows.select("user_id", "event_id", _rounded(F.col("z")).alias("z"))


def disk_mask_1d(spark, sf):
    return raster.trace_disk(trace(spark, sf), ["user_id"], "i", "value")


def soft_target(spark, sf):
    """Four raters' masks of an image, pixel by pixel where any of them marks it."""
    image = F.floor(F.col("vec_id") / 4)
    raters = _t(spark, sf, "embeddings").select(image.alias("image"), F.col("vec_id").alias("rater"))
    share = sp.soft_target(_mask_runs(spark, sf).select(image.alias("image"), F.col("vec_id").alias("rater"), "s", "e"), raters, ["image"], "rater")
    return share.select("image", F.explode(F.sequence(F.col("s"), F.col("e") - 1)).alias("pos"), _rounded(F.col("share")).alias("share"))


def soft_target_sweep(spark, sf):
    i = intervals(spark, sf)
    return sp.soft_target(i, i, ["l_orderkey"], "rater").select("l_orderkey", "s", "e", _rounded(F.col("share")).alias("share"))


def resize_area_half(spark, sf):
    p = pixels(spark, sf).select("vec_id", F.floor(F.col("pos") / 8).alias("x"), (F.col("pos") % 8).alias("y"), "v")
    return raster.halved(p, ["vec_id"]).select("vec_id", "x", "y", _rounded(F.col("v")).alias("v"))


def _on_disk(pos: Column) -> Column:
    dx, dy = F.floor(pos / 8) - 3.5, pos % 8 - 3.5
    return dx * dx + dy * dy <= 13


def threshold_mask(spark, sf):
    """Pixels on the disk that reach the threshold: all instances, whatever their size, touching ones as one."""
    return _instances(spark, sf, [PostConfig(0.1, 0, 0, True, 64)]).select("vec_id", F.explode(F.sequence(F.col("s"), F.col("e") - 1)).alias("pos"))


def _mask_runs(spark, sf, threshold: float = 0.05) -> DataFrame:
    return sp.runs(pixels(spark, sf), ["vec_id"], "pos", F.col("v") >= threshold)


def mask_rle_runs(spark, sf):
    return _mask_runs(spark, sf)


def rle_counts_string(spark, sf):
    side = F.lit(8)
    runs = _mask_runs(spark, sf).groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct(F.col("s").cast("int").alias("s"), F.col("e").cast("int").alias("e")))).alias("runs"))
    coded = runs.withColumn("counts", rle.rle_encode(F.col("runs"), side, side))
    back = coded.withColumn("again", rle.rle_decode(F.col("counts"), side, side))
    text = F.array_join(F.transform("again", lambda r: F.concat_ws("-", r["s"], r["e"])), ",")
    return back.select("vec_id", text.alias("runs"), rle.runs_area(F.col("again")).alias("area"))


def mask_union(spark, sf):
    return sp.union(intervals(spark, sf), ["l_orderkey"])


def mask_intersection(spark, sf):
    i = intervals(spark, sf)
    return sp.intersection(i.where("flag = 'A'"), i.where("flag = 'R'"), ["l_orderkey"])


def mask_complement(spark, sf):
    i = intervals(spark, sf)
    return sp.complement(i, i.select("l_orderkey").distinct().withColumn("size", F.lit(FRAME_DAYS).cast("long")), ["l_orderkey"])


def mask_area_bbox(spark, sf):
    return sp.boxes(_mask_runs(spark, sf, 0.1), ["vec_id"], F.lit(8))


def _with_disk(spark, sf) -> DataFrame:
    return rasters(spark, sf).select("*", F.transform(F.sequence(F.lit(0), F.lit(63)), _on_disk).alias("disk"))


def _instances(spark, sf, configs) -> DataFrame:
    return components.raster_instances(_with_disk(spark, sf), ["vec_id"], "v", 8, configs, "disk")


def instance_filter(spark, sf):
    return sp.area(_instances(spark, sf, [PostConfig(0.1, 3, 0, False, 64)]), ["vec_id", "label"])


def label_components_1d(spark, sf):
    return components.trace_components(trace(spark, sf), ["user_id"], "i", F.col("value") >= 50, reach=1)


def label_components_2d(spark, sf):
    return _instances(spark, sf, [PostConfig(0.05, 0, 0, False, 64)]).select("vec_id", "label", F.explode(F.sequence(F.col("s"), F.col("e") - 1)).alias("pos"))


def dilate_merge(spark, sf):
    return _instances(spark, sf, MERGES).select("config", "vec_id", "label", F.explode(F.sequence(F.col("s"), F.col("e") - 1)).alias("pos"))


def top_k_instances(spark, sf):
    return sp.area(_instances(spark, sf, [PostConfig(0.1, 1, 0, False, 2)]), ["vec_id", "label"])


def instances_from_prob(spark, sf):
    return _instances(spark, sf, [PREDICTION]).select("vec_id", "label", "s", "e")


def iou_matrix(spark, sf):
    i = intervals(spark, sf)
    pairs = panoptic.iou(i.where("flag = 'A'").withColumnRenamed("n", "pred"), i.where("flag = 'R'").withColumnRenamed("n", "truth"), ["l_orderkey"])
    return pairs.select("l_orderkey", "pred", "truth", "inter", _rounded(F.col("iou")).alias("iou"))


def _sides(spark, sf, configs) -> tuple[DataFrame, DataFrame]:
    """Predictions of every configuration and truths of every annotator, both by (vec_id, rater, config)."""
    n = len(configs)
    # labelled once: what follows reads the instances several times
    both = session.written(_instances(spark, sf, [*configs, *ANNOTATORS]), "instances")
    pred = both.where(F.col("config") < n).select("vec_id", F.explode(F.array(*map(F.lit, range(len(ANNOTATORS))))).alias("rater"), "config", F.col("label").alias("pred"), "s", "e")
    truth = both.where(F.col("config") >= n).select("vec_id", (F.col("config") - n).alias("rater"), F.explode(F.array(*map(F.lit, range(n)))).alias("config"), F.col("label").alias("truth"), "s", "e")
    return pred, truth


KEYS = ["vec_id", "rater", "config"]


def pq_match(spark, sf):
    pred, truth = _sides(spark, sf, [PREDICTION])
    found = panoptic.match(panoptic.iou(pred, truth, KEYS, 64), KEYS)
    return found.select("vec_id", "rater", "pred", "truth", _rounded(F.col("iou")).alias("iou"))


def _pooled(spark, sf, configs) -> DataFrame:
    return panoptic.pooled(panoptic.raster_statistics(_with_disk(spark, sf), ["vec_id"], "v", 8, configs, ANNOTATORS, "disk"), ["config"])


def pq_pooled(spark, sf):
    return _pooled(spark, sf, [PREDICTION]).select("tp", "fp", "fn", *[_rounded(F.col(c), 5).alias(c) for c in ("pq", "sq", "rq")])


def grid_tune(spark, sf):
    settings = spark.createDataFrame([(k, c.threshold, c.min_area, c.merge_dist) for k, c in enumerate(GRID)], "config int, threshold double, min_area int, merge_dist int")
    scored = _pooled(spark, sf, GRID).join(F.broadcast(settings), "config").select("config", "threshold", "min_area", "merge_dist", _rounded(F.col("pq"), 5).alias("pq"))
    return scored.orderBy(F.col("pq").desc(), "config").limit(5)


def dice_score(spark, sf):
    l = _t(spark, sf, "labels")  # noqa: E741
    target = (F.col("quality") + F.col("toxic")) / 2  # two raters' soft target
    return l.agg(_rounded(scores.pooled_dice(F.col("quality"), target)).alias("dice"), F.count("*").alias("n"))


def bce_dice_loss(spark, sf):
    e = _t(spark, sf, "events").select(((F.col("value") - 100) / 50).alias("z"), (F.col("event_id") % 2).cast("double").alias("t"), "event_type")
    return e.groupBy("event_type").agg(_rounded(scores.bce_dice_loss(F.col("z"), F.col("t")), 5).alias("loss"))


TILINGS = [(1024, 512, 384), (2048, 512, 384), (100, 128, 96), (512, 512, 384), (700, 256, 100), (513, 512, 1)]


def tile_starts(spark, sf):
    p = raster.parameters(spark, TILINGS, "size int, tile int, stride int")
    return p.select("*", F.explode(raster.starts(F.col("size"), F.col("tile"), F.col("stride"))).alias("start"))


def hann_window(spark, sf):
    n = spark.range(1, 25).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("id") - 1)).alias("i"))
    return n.select("n", "i", _rounded(raster.hann(F.col("i"), F.col("n"))).alias("w"))


def overlap_add(spark, sf):
    t = trace(spark, sf).withColumn("size", F.count("*").over(Window.partitionBy("user_id")).cast("int"))
    at = F.explode(raster.starts(F.col("size"), F.lit(16), F.lit(12))).alias("start")
    parts = t.select("user_id", "i", "value", "size", at).where("i >= start and i < start + 16")
    weight = F.greatest(raster.hann(F.col("i") - F.col("start"), F.least("size", F.lit(16))), F.lit(1e-3))
    parts = parts.select("user_id", "i", (F.col("value") + F.col("start") % 7).alias("p"), weight.alias("w"))
    return raster.overlap_add(parts, ["user_id", "i"], "p", "w").select("user_id", "i", _rounded(F.col("p"), 5).alias("p"))


def tta_mean(spark, sf):
    score = lambda a: F.transform(a, lambda x, k: scores.sigmoid(x * (k % 3 + 1)))
    return raster.flip_mean(rasters(spark, sf), ["vec_id"], "v", 8, score).select("vec_id", "pos", _rounded(F.col("p")).alias("p"))


def validate_submission(spark, sf):
    text = F.element_at(F.array(*[F.lit(rle.text_of(list(c))) for c in COUNTS]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    k = F.col("o_orderkey")
    rows = _numbered(spark, sf).select(F.when(k % 50 == 0, F.lit("nonumber")).otherwise(F.col("filament_id")).alias("filament_id"), F.when(k % 60 == 6, F.lit("1,2")).otherwise(text).alias("segmentation_rle"))
    known = _t(spark, sf, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").cast("string").alias("image"))
    return validate.violations(rows, known, 8, 8)


def prediction_summary(spark, sf):
    c = _t(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("image"))
    rows = _numbered(spark, sf).select("filament_id")
    return submission.summary(c, rows).select("images", "rows", F.size("undetected").alias("undetected"))


def best_checkpoint(spark, sf):
    return training.best_checkpoint(_t(spark, sf, "events").select("user_id", "event_id", "value"), "event_id", "value", ["user_id"]).select("user_id", "event_id", "value")


def epoch_log(spark, sf):
    log = training.epoch_log(_t(spark, sf, "events"), F.date_format("ts", "yyyy-MM-dd"), "value")
    return log.select("epoch", _rounded(F.col("train_loss")).alias("train_loss"), "steps")


def _crops(spark, sf) -> tuple[DataFrame, DataFrame]:
    p = pixels(spark, sf).where("v >= 0.2").select("vec_id", (F.col("pos") % 8).cast("int").alias("y"), F.floor(F.col("pos") / 8).cast("int").alias("x"))
    return p, training.crops(p, rasters(spark, sf).select("vec_id", F.lit(8).alias("h"), F.lit(8).alias("w")), ["vec_id"], 4, 4)


def crop_sampling(spark, sf):
    """Where the crops fall is hashed; what holds of each crop is told: inside the frame, near a positive pixel if it says so."""
    p, made = _crops(spark, sf)
    hit = (F.col("y") >= F.col("top")) & (F.col("y") < F.col("top") + 4) & (F.col("x") >= F.col("left")) & (F.col("x") < F.col("left") + 4)
    inside = F.col("top").between(0, 4) & F.col("left").between(0, 4) & F.col("turns").between(0, 3) & F.col("gain").between(0.85, 1.15) & F.col("bias").between(-0.15, 0.15)
    near = made.join(p, "vec_id", "left").groupBy("vec_id", "i").agg(F.first(inside).alias("inside"), F.first("positive").alias("positive"), F.coalesce(F.bool_or(hit), F.lit(False)).alias("hit"), F.count("x").alias("pixels"))
    return near.select("vec_id", "i", "inside", (~F.col("positive") | F.col("hit")).alias("holds"), (F.col("pixels") > 0).alias("can"))


def synthetic_frames(spark, sf):
    """Each annotator's masks of each frame: numbered from 1, decodable, none empty, and the first annotator's disjoint."""
    made = synthetic.frames(spark, 12, 96).withColumn("runs", rle.rle_decode(F.col("counts"), F.lit(96), F.lit(96)))
    spans = made.select("stem", "annotator", F.explode("runs").alias("r")).select("stem", "annotator", F.col("r.s").alias("s"), F.col("r.e").alias("e"))
    crossing = sp.overlapping(spans.where("annotator = 'A1'"), ["stem", "annotator"]).withColumn("crossing", F.lit(True))
    told = made.groupBy("stem", "annotator").agg(F.max("h").alias("h"), F.max("w").alias("w"), (F.max("n") == F.count("*")).alias("numbered"), F.bool_and(F.coalesce(rle.runs_area(F.col("runs")) > 0, F.lit(False))).alias("filled"))
    return told.join(crossing, ["stem", "annotator"], "left").select("stem", "annotator", "h", "w", "numbered", "filled", F.col("crossing").isNull().alias("disjoint"))


WEIGHTS = [((k * 7) % 11 - 5) / 4 for k in range(64)]


def scorer_predict(spark, sf):
    def load():
        w = np.array(WEIGHTS)
        return lambda x: x @ w

    return training.scored(rasters(spark, sf), "v", load).select("vec_id", _rounded(F.col("p")).alias("p"))


_KEYS = """image_stem_parse annotator_coalesce prefix_annotator submission_ids submission_id_parse working_size polygon_normalize config_list_parse find_annotation_rank list_images_filter
first_n_images load_records loader_report group_by_stem annotators_per_image top_annotators filaments_min_mean_max images_per_year known_image_check split_holdout_months zscore_normalize
disk_mask_1d soft_target soft_target_sweep resize_area_half threshold_mask mask_rle_runs rle_counts_string mask_union mask_intersection mask_complement mask_area_bbox instance_filter
label_components_1d label_components_2d dilate_merge top_k_instances instances_from_prob iou_matrix pq_match pq_pooled grid_tune dice_score bce_dice_loss tile_starts hann_window overlap_add
tta_mean validate_submission prediction_summary best_checkpoint epoch_log crop_sampling synthetic_frames scorer_predict"""


def queries() -> dict:
    return {k: globals()[k] for k in _KEYS.split()}
