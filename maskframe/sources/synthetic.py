"""Seeded synthetic frames with filaments and several annotators, one frame a row: ``spark.range`` and a generator.

Every frame has its own seed, so any partitioning gives the same rows. Masks are spans from the start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rle import encode
from ..operators.components import grown

SITES = ("B", "C", "L", "M", "T", "U")


def filament(r: np.random.Generator, side: int) -> np.ndarray:
    """A curved band inside the disk."""
    y, x = np.mgrid[:side, :side]
    radius, angle = r.uniform(0, 0.3 * side), r.uniform(0, 2 * np.pi)
    cy, cx = side / 2 + radius * np.sin(angle), side / 2 + radius * np.cos(angle)
    turn, length, bend, thick = r.uniform(0, np.pi), r.uniform(0.05, 0.15) * side, r.uniform(-0.01, 0.01), max(1.5, r.uniform(0.006, 0.012) * side)
    u, v = (x - cx) * np.cos(turn) + (y - cy) * np.sin(turn), (y - cy) * np.cos(turn) - (x - cx) * np.sin(turn)
    return (np.abs(u) <= length) & (np.abs(v - bend * u * u) <= thick)


def frame(seed: int, side: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(8-bit frame, disjoint filaments of at least 20 pixels)."""
    r = np.random.default_rng(seed)
    y, x = np.mgrid[:side, :side]
    distance = np.hypot(y - side / 2, x - side / 2) / (0.45 * side)
    light = np.where(distance < 1, 180 * np.sqrt(np.clip(1 - 0.6 * distance**2, 0, 1)), 5) + r.normal(0, 4, (side, side))
    taken, out = np.zeros((side, side), bool), []
    wanted = int(r.integers(3, 8))
    for _ in range(20 * wanted):
        if len(out) == wanted:
            break
        m = filament(r, side) & (distance < 0.95)
        if m.sum() >= 20 and not (m & taken).any():
            out.append(m)
            taken |= m
            light[m] *= 0.55
    return np.clip(light, 0, 255).astype(np.uint8), out


def frames(spark: SparkSession, n: int, side: int = 128, seed: int = 7, pixels: bool = False) -> DataFrame:
    """(stem, annotator, n, counts, h, w[, image]): each annotator's instances of each frame.

    One to three annotators: the second draws everything a pixel larger, the third leaves out a fifth.
    """
    stem = F.concat(F.date_format(F.timestamp_seconds(F.lit(1_400_000_000) + F.col("id") * 86_400 * 9), "yyyyMMddHHmmss"), F.element_at(F.array(*map(F.lit, SITES)), (F.col("id") % len(SITES) + 1).cast("int")), F.lit("h"))
    kinds = "stem string, annotator string, n int, counts string, h int, w int" + (", image binary" if pixels else "")

    def make(batches):
        for b in batches:
            rows = []
            for k, name in zip(b.column("id").to_pylist(), b.column("stem").to_pylist(), strict=True):
                image, masks = frame(seed * 1_000_003 + k, side)
                r = np.random.default_rng([seed, k])
                for a in range(1 + k % 3):
                    own = [grown(m, 1) if a == 1 else m for m in masks if a != 2 or r.random() >= 0.2]
                    rows += [(name, f"A{a + 1}", i + 1, encode(m), side, side, *([image.tobytes()] if pixels else [])) for i, m in enumerate(own)]
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in rows], schema)

    names = [c.split()[0] for c in kinds.split(", ")]
    types = {"string": pa.string(), "int": pa.int32(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in kinds.split(", ")])
    return spark.range(n).withColumn("stem", stem).mapInArrow(make, kinds)


def write_dataset(spark: SparkSession, folder: str, n: int, side: int = 128, seed: int = 7) -> None:
    """A dataset in the usual layout: PNG frames, and one annotation document with an entry for each annotator of a frame.

    ``folder`` must be one that all executors see.
    """
    import os

    from .images import png
    from .layout import TRAIN

    rows = frames(spark, n, side, seed, pixels=True)

    def save(batches):
        for b in batches:
            for stem, h, w, image in zip(*(b.column(c).to_pylist() for c in ("stem", "h", "w", "image")), strict=True):
                os.makedirs(f"{folder}/{TRAIN}", exist_ok=True)
                with open(f"{folder}/{TRAIN}/{stem}.png", "wb") as f:
                    f.write(png(np.frombuffer(image, np.uint8).reshape(h, w)))
            yield b.select(["stem"])

    one = rows.groupBy("stem").agg(F.first("h").alias("h"), F.first("w").alias("w"), F.first("image").alias("image"))
    one.mapInArrow(save, "stem string").count()
    key = F.concat_ws("-", "annotator", "stem")
    listed = rows.groupBy("stem", "annotator").agg(F.first("h").alias("height"), F.first("w").alias("width")).select(F.struct(key.alias("id"), F.concat(F.col("stem"), F.lit(".png")).alias("file_name"), "height", "width").alias("x"))
    marks = rows.select(F.struct(F.concat_ws("-", key, "n").alias("id"), key.alias("image_id"), F.lit(1).alias("category_id"), F.struct(F.array("h", "w").alias("size"), F.col("counts").alias("counts")).alias("segmentation")).alias("x"))
    # a small document by nature: one entry an annotator and frame of a generated set
    doc = {"images": [r["x"].asDict(True) for r in listed.orderBy("x.id").collect()], "annotations": [r["x"].asDict(True) for r in marks.orderBy("x.id").collect()], "categories": [{"id": 1, "name": "filament"}]}
    import json

    with open(f"{folder}/train_annotations.json", "w") as f:
        json.dump(doc, f)
