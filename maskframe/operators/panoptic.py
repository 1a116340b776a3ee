"""Panoptic quality: overlaps of instance spans, one-to-one matches, pooled statistics, parameter grids."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, fields
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scores
from . import components
from . import spans as sp

#: Pixels of rasters of one shape that are scored together, side by side; a larger raster is scored alone.
BLOCK = 1 << 18


@dataclass(frozen=True)
class PostConfig:
    """How probabilities become instances."""

    threshold: float = 0.5
    min_area: int = 150
    merge_dist: int = 0
    use_disk: bool = True
    max_instances: int = 60

    @classmethod
    def of(cls, values: dict) -> PostConfig:
        """From a mapping; unknown keys are ignored, missing ones have their default."""
        return cls(**{f.name: values[f.name] for f in fields(cls) if f.name in values})

    def values(self) -> dict:
        return asdict(self)


def grid(thresholds=(0.3, 0.4, 0.5, 0.6), areas=(50, 150, 400), merges=(0, 10, 25), **fixed) -> list[PostConfig]:
    """All settings; their order (threshold, area, merge) breaks ties."""
    return [PostConfig(t, a, m, **fixed) for t, a, m in product(thresholds, areas, merges)]


def iou(pred: DataFrame, truth: DataFrame, keys: list[str], bucket: int = 4096) -> DataFrame:
    """(keys, pred, truth, inter, iou) of pairs that overlap. Instances are rows (keys, pred|truth, s, e), disjoint inside one."""
    inter = sp.overlaps(pred, truth, keys, ["pred"], ["truth"], bucket)
    a, b = sp.area(pred, [*keys, "pred"]).withColumnRenamed("area", "pa"), sp.area(truth, [*keys, "truth"]).withColumnRenamed("area", "ta")
    # spans compress so well that the planner takes tables of them for small ones and would collect them on the driver
    joined = inter.join(a.hint("merge"), [*keys, "pred"]).join(b.hint("merge"), [*keys, "truth"])
    return joined.select(*keys, "pred", "truth", "inter", (F.col("inter") / (F.col("pa") + F.col("ta") - F.col("inter"))).alias("iou"))


def match(pairs: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """One-to-one matches with iou above ``threshold`` (strictly), by falling iou; ties to the smaller pred, then truth.

    With disjoint predictions and a threshold of a half or more a truth has one candidate at most, and the best candidate of
    each prediction is the greedy result. A lower threshold goes through the greedy loop, a key at a time.
    """
    good = pairs.where(F.col("iou") > threshold)
    if threshold >= 0.5:
        order = Window.partitionBy(*keys, "pred").orderBy(F.col("iou").desc(), "truth")
        return good.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")

    def greedy(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (-r["iou"], r["pred"], r["truth"]))
        left, right, kept = set(), set(), []
        for r in rows:
            if r["pred"] not in left and r["truth"] not in right:
                left.add(r["pred"])
                right.add(r["truth"])
                kept.append(r)
        return pa.Table.from_pylist(kept, table.schema)

    return good.groupBy(*keys).applyInArrow(greedy, good.schema)


def statistics(matches: DataFrame, pred: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tp, fp, fn, iou_sum) of every key that has a prediction or a truth."""
    n = lambda df, c, name: df.groupBy(*keys).agg(F.count_distinct(c).alias(name))
    hits = matches.groupBy(*keys).agg(F.count("*").alias("tp"), F.sum("iou").alias("iou_sum"))
    both = n(pred, "pred", "preds").join(n(truth, "truth", "truths"), keys, "full").join(hits.hint("merge"), keys, "left")
    both = both.fillna(0, ["preds", "truths", "tp"]).fillna(0.0, ["iou_sum"])
    return both.select(*keys, "tp", (F.col("preds") - F.col("tp")).alias("fp"), (F.col("truths") - F.col("tp")).alias("fn"), "iou_sum")


def raster_statistics(rasters: DataFrame, keys: list[str], values: str, height: int, configs: list[PostConfig], raters: list[PostConfig], disk: str | None = None) -> DataFrame:
    """(keys, config, rater, tp, fp, fn, iou_sum) of each raster's instances under every configuration, against those under every rater's.

    What ``statistics`` gives of matches above a half, but in the raster's own task: no span leaves it, and a row is all that is
    left of a configuration and a rater. Rasters are read as ``raster_instances`` reads them; rows without an instance are left out.
    """
    kinds = {f.name: f for f in rasters.schema.fields}
    counts = ("config", "rater", "tp", "fp", "fn")
    schema = T.StructType([*[kinds[k] for k in keys], *[T.StructField(c, T.LongType() if len(c) == 2 else T.IntegerType()) for c in counts], T.StructField("iou_sum", T.DoubleType())])

    gap = max([1, *(c.merge_dist for c in (*configs, *raters))])

    def blocks(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list]]:
        places, block = [], []
        for place, *one in components.rasters_of(batch, len(keys), height, bool(disk)):
            if block and (one[0].shape != block[0][0].shape or (len(block) + 1) * one[0].size > BLOCK):
                yield places, block
                places, block = [], []
            places.append(place)
            block.append(one)
        if block:
            yield places, block

    def scored(block: list) -> Iterator[tuple]:
        """(raster of the block, config, rater, tp, fp, fn, iou_sum), each an array."""
        prob, on, inside = components.side_by_side(block, gap)
        n = len(block)

        def side(cs: list[PostConfig]) -> Iterator[tuple]:
            for setting, members in components.shared_settings(cs).items():
                labels = components.label_components(prob, on, *setting, inside)
                for number, c in members:
                    yield number, components.filter_side_by_side(labels, prob.size // n, c.min_area, c.max_instances)

        truth = list(side(raters))
        for config, (p, pred_area, pred_of) in side(configs):
            preds = np.bincount(pred_of, minlength=n)
            for rater, (t, truth_area, truth_of) in truth:
                at, base = np.flatnonzero((p > 0) & (t > 0)), len(truth_area) + 1
                pair, inter = np.unique(p[at] * base + t[at], return_counts=True)
                a, b = pair // base - 1, pair % base - 1
                iou = inter / (pred_area[a] + truth_area[b] - inter)
                hit = iou > 0.5  # both sides are disjoint: an instance is in one such pair at most
                of = pred_of[a[hit]]
                tp, truths = np.bincount(of, minlength=n), np.bincount(truth_of, minlength=n)
                some = np.flatnonzero(preds + truths)
                yield tuple(x[some] for x in (np.arange(n), np.full(n, config), np.full(n, rater), tp, preds - tp, truths - tp, np.bincount(of, iou[hit], n)))

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for places, block in blocks(batch):
                parts = list(scored(block))
                if not parts:
                    continue
                at, *rest, total = (np.concatenate(x) for x in zip(*parts, strict=True))
                columns = [pa.array(x, pa.int64() if len(c) == 2 else pa.int32()) for c, x in zip(counts, rest, strict=True)]
                at = pa.array(np.array(places)[at])
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(at) for k in range(len(keys))], *columns, pa.array(total)], schema.names)

    return rasters.select(*keys, values, *([disk] if disk else [])).mapInArrow(run, schema)


def pooled(stats: DataFrame, keys: list[str]) -> DataFrame:
    """Sums over everything but ``keys``, with pq, sq and rq."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("double" if c == "iou_sum" else "long").alias(c) for c in ("tp", "fp", "fn", "iou_sum")]
    total = stats.groupBy(*keys).agg(*sums) if keys else stats.agg(*sums)
    tp, fp, fn, s = (F.col(c) for c in ("tp", "fp", "fn", "iou_sum"))
    return total.select("*", scores.pq(s, tp, fp, fn).alias("pq"), scores.sq(s, tp).alias("sq"), scores.rq(tp, fp, fn).alias("rq"))
