"""The stages of a run as one command: ``python -m maskframe STAGE --option value``.

Each stage reads what the ones before left in the run folder: the split, the weights, the tuned configuration. Without
weights the network's fresh ones stand in. Paths must be ones that driver and executors share.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..functions import names
from ..operators import ingest, panoptic, split
from ..operators.training import UNet
from ..sources import images, layout, runs, submission, synthetic
from . import stages


def numbers(kind):
    """A comma-separated list; blank entries are skipped."""
    return lambda text: tuple(kind(x) for x in text.split(",") if x.strip())


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="maskframe", description=__doc__.splitlines()[0])
    stage = top.add_subparsers(dest="stage", required=True)

    def add(name: str, *groups: str) -> argparse.ArgumentParser:
        p = stage.add_parser(name)
        if "data" in groups:
            p.add_argument("--data-root", default=None)
        if "run" in groups:
            p.add_argument("--run", required=True)
        if "score" in groups:
            p.add_argument("--scale", type=float, default=0.5)
            p.add_argument("--tile", type=int, default=512)
            p.add_argument("--overlap", type=int, default=128)
            p.add_argument("--tta", action="store_true")
        return p

    add("inspect", "data")
    p = add("split", "data", "run")
    p.add_argument("--val-frac", type=float, default=0.15)
    p.add_argument("--seed", type=int, default=42)
    p = add("tune", "data", "run", "score")
    p.add_argument("--thresholds", type=numbers(float), default=(0.3, 0.4, 0.5, 0.6))
    p.add_argument("--min-areas", type=numbers(int), default=(50, 150, 400))
    p.add_argument("--merge-dists", type=numbers(int), default=(0, 10, 25))
    add("predict", "data", "run", "score").add_argument("--out", required=True)
    p = add("check", "data")
    p.add_argument("--file", required=True)
    p = add("draw", "data", "run", "score")
    p.add_argument("--n", type=int, default=4)
    p.add_argument("--out", required=True)
    p = add("synthesize")
    p.add_argument("--out", required=True)
    p.add_argument("--n", type=int, default=8)
    p.add_argument("--size", type=int, default=512)
    p.add_argument("--seed", type=int, default=7)
    return top


def _data(spark: SparkSession, root: str | None) -> tuple[layout.DataPaths, DataFrame, DataFrame]:
    """(paths, training frames, records)."""
    paths = layout.resolve(layout.find_root(root))
    files = images.index_images(images.list_images(spark, str(paths.train_images)))
    records = session.written(ingest.load_records(ingest.read_document(spark, str(paths.annotations)), files), "records")
    return paths, images.read_images(spark, str(paths.train_images)), records


def _load(spark: SparkSession, run: str):
    """A function that makes the scorer in each task: the run's weights go along with it."""
    try:
        weights = runs.load_weights(spark, f"{run}/weights")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        weights = UNet().weights()
    shared = spark.sparkContext.broadcast(weights)  # a network's size, whatever the frames
    return lambda: UNet.of(shared.value)


def _held_out(spark: SparkSession, run: str, frames: DataFrame) -> DataFrame:
    """Validation frames, or all if validation has none."""
    val = runs.load_split(spark, f"{run}/split", "val")
    if val.isEmpty():
        return frames
    return frames.withColumn("stem", names.image_stem(F.col("path"))).join(val, "stem", "left_semi").drop("stem")


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run one stage; 0 if it went well, 1 if a check found something."""
    a = arguments().parse_args(argv)
    spark = spark or SparkSession.builder.appName("maskframe").getOrCreate()
    session.ship(spark)
    if a.stage == "synthesize":
        synthetic.write_dataset(spark, a.out, a.n, a.size, a.seed)
        return 0
    paths, frames, records = _data(spark, a.data_root)
    tiling = {"tile": a.tile, "overlap": a.overlap, "tta": a.tta} if hasattr(a, "tile") else {}
    if a.stage == "inspect":
        stages.inspect(records).show(truncate=False)
    elif a.stage == "split":
        stems = frames.select(names.image_stem(F.col("path")).alias("stem")).join(records.select("stem").distinct(), "stem", "left_semi")
        runs.save_split(split.split_stems(stems, "stem", a.val_frac, a.seed), f"{a.run}/split")
    elif a.stage == "tune":
        configs = panoptic.grid(a.thresholds, a.min_areas, a.merge_dists)
        best = stages.tune(_held_out(spark, a.run, frames), records, _load(spark, a.run), configs, a.scale, **tiling).first()
        extra = {k: best[k] for k in ("pq", "sq", "rq", "tp", "fp", "fn")}
        runs.save_config(spark, f"{a.run}/postprocess", configs[best["config"]], extra)
    elif a.stage == "predict":
        test = images.read_images(spark, str(paths.test_images or paths.train_images))
        summary = stages.predict(test, _load(spark, a.run), runs.load_config(spark, f"{a.run}/postprocess"), a.out, a.scale, **tiling)
        submission.write_json(summary, f"{a.out}.summary")
    elif a.stage == "check":
        test = images.list_images(spark, str(paths.test_images or paths.train_images))
        found = stages.check(a.file, test)
        bad = found.orderBy("rule", "image").limit(20).collect()
        print("ok" if not bad else "\n".join(f"{r['rule']}: {r['image'] or ''} {r['detail'] or ''}" for r in bad))
        return 1 if bad else 0
    elif a.stage == "draw":
        some = _held_out(spark, a.run, frames).orderBy("path").limit(a.n)
        made = stages.frame_instances(some, _load(spark, a.run), [runs.load_config(spark, f"{a.run}/postprocess")], a.scale, **tiling)
        stages.drawings(some, made, records).write.mode("overwrite").parquet(a.out)
    return 0
