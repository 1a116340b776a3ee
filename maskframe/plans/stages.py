"""The stages of a segmentation run, each a function over tables: inspect, tune, predict, check, draw.

A frame is one row, its instances are found in its own task; scores and checks are relational from there on. The scorer is
given by a function that returns one, called once for every task's batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import session
from ..functions import names, poly, scores
from ..functions.rle import counts_of, label_runs, text_of
from ..operators import components, panoptic, raster, validate
from ..operators.panoptic import PostConfig
from ..sources import images, submission

Load = Callable[[], Callable[[np.ndarray], np.ndarray]]


def inspect(records: DataFrame) -> DataFrame:
    """One row: records, frames, annotators, and the least, mean and largest number of segmentations."""
    n = F.size("segmentations")
    return records.agg(F.count("*").alias("records"), F.count_distinct("stem").alias("frames"), F.count_distinct("annotator").alias("annotators"), F.min(n).alias("least"), F.bround(F.avg(n), 2).alias("mean"), F.max(n).alias("most"))


def frame_instances(frames: DataFrame, load: Load, configs: list[PostConfig], scale: float = 0.5, **tiling) -> DataFrame:
    """(stem, file_stem, h, w, config, label, counts, spans) of every frame's instances under each configuration."""
    kinds = "stem string, file_stem string, h int, w int, config int, label int, counts string, spans array<struct<s:int,e:int>>"
    schema = pa.schema([("stem", pa.string()), ("file_stem", pa.string()), *[(c, pa.int32()) for c in ("h", "w", "config", "label")], ("counts", pa.string()), ("spans", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))])

    def run(batches: Iterator[pa.RecordBatch]):
        score = load()
        for batch in batches:
            for row in batch.to_pylist():
                frame = np.frombuffer(row["pixels"], np.uint8).reshape(row["height"], row["width"])
                prob, disk = raster.predict_image(frame, score, scale, **tiling)
                shared: dict[tuple, np.ndarray] = {}
                out = []
                for number, c in enumerate(configs):
                    key = (c.threshold, c.merge_dist, c.use_disk)
                    if key not in shared:
                        shared[key] = components.label_components(prob, disk, *key)
                    labels = components.filter_components(shared[key], c.min_area, c.max_instances)
                    for k, runs in label_runs(labels).items():
                        spans = [{"s": s, "e": e} for s, e in runs]
                        out.append({"stem": row["stem"], "file_stem": row["file_stem"], "h": frame.shape[0], "w": frame.shape[1], "config": number, "label": k, "counts": text_of(counts_of(runs, frame.size)), "spans": spans})
                yield pa.RecordBatch.from_pylist(out, schema)

    rows = frames.select(names.image_stem(F.col("path")).alias("stem"), names.file_stem(F.col("path")).alias("file_stem"), "height", "width", "pixels")
    return rows.mapInArrow(run, kinds)


def truth_spans(records: DataFrame) -> DataFrame:
    """(stem, annotator, truth, s, e) of the records' segmentations that have a pixel."""
    one = records.select("stem", "annotator", "height", "width", F.posexplode("segmentations").alias("truth", "seg"))
    runs = one.select("stem", "annotator", "truth", poly.to_runs(F.col("seg"), F.col("height"), F.col("width")).alias("runs"))
    return runs.select("stem", "annotator", "truth", F.explode("runs").alias("r")).select("stem", "annotator", "truth", F.col("r.s").alias("s"), F.col("r.e").alias("e"))


def working_set(frames: DataFrame, records: DataFrame, scale: float = 0.5) -> DataFrame:
    """(stem, height, width, x, target) at the working size, 16-bit floats in row order: prepared once, written, read by every epoch.

    ``target`` is the share of the frame's annotators that mark a place. Frames without a record are left out.
    """
    spans = truth_spans(records).groupBy("stem").agg(F.collect_list(F.struct("annotator", "s", "e")).alias("spans"))
    raters = records.groupBy("stem").agg(F.count_distinct("annotator").alias("raters")).join(spans, "stem", "left")
    rows = frames.select(names.image_stem(F.col("path")).alias("stem"), "height", "width", "pixels").join(raters, "stem")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                frame = np.frombuffer(row["pixels"], np.uint8).reshape(row["height"], row["width"])
                x, _ = raster.preprocess(frame, scale)
                by: dict[str, np.ndarray] = {}
                for r in row["spans"] or []:
                    by.setdefault(r["annotator"], np.zeros(frame.size, bool))[r["s"] : r["e"]] = True
                share = sum((m.astype(float) for m in by.values()), np.zeros(frame.size)) / row["raters"]
                target = raster.area_resize(share.reshape(row["width"], row["height"]).T, *x.shape)
                half = lambda a: pa.array([a.astype("<f2").tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([row["stem"]]), *[pa.array([n], pa.int32()) for n in x.shape], half(x), half(target)], ["stem", "height", "width", "x", "target"])

    return session.written(rows.mapInArrow(run, "stem string, height int, width int, x binary, target binary"), "working")


def pooled_dice(working: DataFrame, load: Load, **tiling) -> DataFrame:
    """(dice) of a scorer over a working set: places where probability and target reach a half, pooled over all frames."""

    def run(batches):
        score = load()
        for batch in batches:
            for row in batch.to_pylist():
                x, target = (np.frombuffer(row[c], "<f2").reshape(row["height"], row["width"]).astype(np.float32) for c in ("x", "target"))
                pred, truth = raster.predict_prob(score, x, **tiling) >= 0.5, target >= 0.5
                yield pa.RecordBatch.from_arrays([pa.array([int((pred & truth).sum())]), pa.array([int(pred.sum() + truth.sum())])], ["both", "total"])

    counts = working.mapInArrow(run, "both long, total long").agg(F.coalesce(F.sum("both"), F.lit(0)).alias("both"), F.coalesce(F.sum("total"), F.lit(0)).alias("total"))
    return counts.select(scores.dice(F.col("both"), F.col("total")).alias("dice"))


def tune(frames: DataFrame, records: DataFrame, load: Load, configs: list[PostConfig], scale: float = 0.5, **tiling) -> DataFrame:
    """(config, tp, fp, fn, iou_sum, pq, sq, rq), best first; equal scores in the configurations' order.

    Every annotator of a frame is scored against the frame's instances; sums are pooled over all of them.
    """
    raters = records.select("stem", "annotator").distinct()
    # inference runs once: what follows reads the instances several times
    made = session.written(frame_instances(frames, load, configs, scale, **tiling).select("stem", "config", "label", "spans"), "instances")
    made = made.select("stem", "config", F.col("label").alias("pred"), F.explode("spans").alias("r"))
    pred = made.join(raters, "stem").select("stem", "annotator", "config", "pred", F.col("r.s").alias("s"), F.col("r.e").alias("e"))
    truth = session.written(truth_spans(records), "truth").withColumn("config", F.explode(F.array(*map(F.lit, range(len(configs))))))
    keys = ["stem", "annotator", "config"]
    found = panoptic.match(panoptic.iou(pred, truth, keys), keys)
    return panoptic.pooled(panoptic.statistics(found, pred, truth, keys), ["config"]).orderBy(F.col("pq").desc(), "config")


def predict(folder_frames: DataFrame, load: Load, config: PostConfig, path: str, scale: float = 0.5, **tiling) -> DataFrame:
    """Write the submission of all frames below ``path``; returns the summary row. Inference runs once."""
    made = frame_instances(folder_frames, load, [config], scale, **tiling)
    rows = made.select(names.instance_id(F.col("file_stem"), F.col("label")).alias("filament_id"), F.col("counts").alias("segmentation_rle"))
    submission.write_submission(rows, path)
    back = submission.read_submission(folder_frames.sparkSession, f"{path}/part-*.txt")
    return submission.summary(folder_frames.select(names.file_stem(F.col("path")).alias("image")), back, threshold=config.threshold, min_area=config.min_area)


def check(path: str, frames: DataFrame, height: int = 2048, width: int = 2048) -> DataFrame:
    """Violations of a submission against the frames it is for; none means it may be sent."""
    rows = submission.read_submission(frames.sparkSession, f"{path}/part-*.txt")
    return validate.violations(rows, frames.select(names.file_stem(F.col("path")).alias("image")), height, width)


def drawings(frames: DataFrame, instances: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """(file_stem, png): each frame with its instances' outlines.

    With ``records`` there are three panels: the frame, the first annotator's masks outlined in green, the instances.
    """
    spans = instances.groupBy("file_stem").agg(F.collect_list(F.struct("label", "spans")).alias("instances"))
    rows = frames.select(names.file_stem(F.col("path")).alias("file_stem"), names.image_stem(F.col("path")).alias("stem"), "height", "width", "pixels").join(spans, "file_stem", "left")
    three = records is not None
    if three:
        first = truth_spans(records).groupBy("stem", "annotator").agg(F.collect_list(F.struct("truth", "s", "e")).alias("truth"))
        rows = rows.join(first.groupBy("stem").agg(F.min_by("truth", "annotator").alias("truth")), "stem", "left")
    else:
        rows = rows.withColumn("truth", F.lit(None).cast("array<struct<truth:int,s:int,e:int>>"))

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                h, w = row["height"], row["width"]
                frame = np.frombuffer(row["pixels"], np.uint8).reshape(h, w)
                painted = lambda spans: _painted(spans, h, w)
                panels = [images.outlined(frame, painted((i["label"], r["s"], r["e"]) for i in row["instances"] or [] for r in i["spans"]))]
                if three:
                    truth = painted((t["truth"] + 1, t["s"], t["e"]) for t in row["truth"] or [])
                    panels = [images.outlined(frame, np.zeros((h, w), int)), images.outlined(frame, truth, (images.GREEN,)), *panels]
                out.append(images.png(np.concatenate(panels, axis=1)))
            yield pa.RecordBatch.from_arrays([batch.column("file_stem"), pa.array(out, pa.binary())], ["file_stem", "png"])

    return rows.select("file_stem", "height", "width", "pixels", "instances", "truth").mapInArrow(run, "file_stem string, png binary")


def _painted(spans, h: int, w: int) -> np.ndarray:
    flat = np.zeros(h * w, np.int32)
    for label, s, e in spans:
        flat[s:e] = label
    return flat.reshape(w, h).T
