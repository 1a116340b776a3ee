"""Connected components of masks, size filters and instances.

A raster is one row (a key and its spans, or its values); components are found in the row's own task, so nothing is
shuffled and a frame is the unit of work. Traces (one-dimensional masks) need only windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import spans as sp


def trace_components(bits: DataFrame, keys: list[str], at: str, bit, reach: int = 0) -> DataFrame:
    """Islands of a trace's ones, joined across gaps of up to ``reach`` places: (keys, label, s, e, area), labels by start."""
    ones = sp.runs(bits, keys, at, bit)
    ahead = F.lag("e").over(Window.partitionBy(*keys).orderBy("s"))
    new = F.when(F.col("s") - ahead <= reach, 0).otherwise(1)
    label = F.sum("new").over(Window.partitionBy(*keys).orderBy("s").rowsBetween(Window.unboundedPreceding, 0))
    return ones.withColumn("new", new).withColumn("label", label).groupBy(*keys, "label").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.sum(F.col("e") - F.col("s")).alias("area"))


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component under the links (a, b): hooking and pointer jumping."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return root
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def raster_labels(mask: np.ndarray) -> np.ndarray:
    """8-connected components of a raster (h, w), numbered by their smallest column-major offset; 0 is background.

    Column runs are the nodes; runs of neighbouring columns touch if their ends do, corners included.
    """
    h, w = mask.shape
    flat = np.zeros((w, h + 1), np.int8)  # columns one after another, with a blank between
    flat[:, :h] = mask.T
    edge = np.flatnonzero(np.diff(flat.ravel(), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros((h, w), np.int32)
    before = start // (h + 1) * (h + 1) - (h + 1)
    lo, hi = np.searchsorted(end, before + start % (h + 1)), np.searchsorted(start, before + end - start // (h + 1) * (h + 1), "right")
    count = np.maximum(hi - lo, 0)
    run = np.repeat(np.arange(len(start)), count)
    root = joined(len(start), np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count - lo, count), run)
    label = np.unique(root, return_inverse=True)[1].astype(np.int32) + 1
    step = np.zeros(w * (h + 1) + 1, np.int32)
    step[start], step[end] = label, -label
    return np.cumsum(step[:-1], dtype=np.int32).reshape(w, h + 1)[:, :h].T


def grown(mask: np.ndarray, reach: int) -> np.ndarray:
    out = np.zeros_like(mask)
    for dx, half in sp.ellipse(reach):
        source = mask[:, max(0, -dx) : mask.shape[1] - max(0, dx)]
        target = out[:, max(0, dx) : mask.shape[1] + min(0, dx)]
        for dy in range(-half, half + 1):
            target[max(0, dy) : mask.shape[0] + min(0, dy)] |= source[max(0, -dy) : mask.shape[0] - max(0, dy)]
    return out


def label_components(prob: np.ndarray, disk: np.ndarray | None, threshold: float = 0.5, merge: int = 0, use_disk: bool = True, inside: np.ndarray | None = None) -> np.ndarray:
    """Labels of the pixels that reach the threshold (on the disk, if it is used); pieces joined by dilation share one.

    Pieces up to 2 * merge apart are joined; what the dilation covers outside the disk connects but is not labelled.
    ``inside``: where the raster is several rasters beside each other, their pixels; between them nothing connects.
    """
    on = prob >= threshold
    if use_disk and disk is not None:
        on &= disk
    if not on.any():
        return np.zeros(prob.shape, np.int32)
    if merge <= 0:
        return raster_labels(on)
    wide = grown(on, merge)
    labels = np.where(on, raster_labels(wide if inside is None else wide & inside), 0)
    return _renumbered(labels)


def _renumbered(labels: np.ndarray) -> np.ndarray:
    """Labels 1..k by their smallest column-major offset."""
    seen, first = np.unique(labels.T.ravel(), return_index=True)
    order = seen[np.argsort(first)]
    order = order[order > 0]
    table = np.zeros(int(labels.max(initial=0)) + 1, np.int32)
    table[order] = np.arange(1, len(order) + 1)
    return table[labels]


def filter_components(labels: np.ndarray, min_area: int, max_instances: int = 60) -> np.ndarray:
    """Labels of at least ``min_area`` pixels, the largest ``max_instances`` (ties to the smaller label), numbered 1..k in order."""
    sizes = np.bincount(labels.ravel())
    kept = np.flatnonzero(sizes >= max(min_area, 1))
    kept = kept[kept > 0]
    kept = np.sort(kept[np.lexsort((kept, -sizes[kept]))][:max_instances])
    table = np.zeros(len(sizes), np.int32)
    table[kept] = np.arange(1, len(kept) + 1)
    return table[labels]


def label_spans(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label, s, e) of the column-major spans of a raster of labels, by place."""
    flat = labels.T.ravel()
    edge = np.flatnonzero(np.diff(flat, prepend=0, append=0))
    s, e = edge[:-1], edge[1:]
    on = flat[s] > 0 if len(s) else np.zeros(0, bool)
    return flat[s[on]] if len(s) else flat[:0], s[on], e[on]


def side_by_side(rasters: list[tuple[np.ndarray, np.ndarray | None]], gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, disks, inside) of rasters of one shape as one raster, each followed by ``gap`` blank columns."""
    h, w = rasters[0][0].shape
    inside = np.zeros((h, len(rasters), w + gap), bool)
    inside[:, :, :w] = True
    prob, disk = np.full(inside.shape, np.nan), inside.copy()
    for k, (v, on) in enumerate(rasters):
        prob[:, k, :w] = v
        if on is not None:
            disk[:, k, :w] = on
    return prob.reshape(h, -1), disk.reshape(h, -1), inside.reshape(h, -1)


def filter_side_by_side(labels: np.ndarray, size: int, min_area: int, max_instances: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``filter_components`` of rasters side by side, of ``size`` places each with the gap: the kept labels' numbers 1..k by place
    (column-major), and for each number its area and its raster."""
    flat = labels.T.ravel()
    area, owner = np.bincount(flat), np.zeros(int(flat.max(initial=0)) + 1, np.int64)
    at = np.flatnonzero(flat)
    owner[flat[at]] = at // size
    label = np.flatnonzero(area >= max(min_area, 1))
    label = label[label > 0]
    order = label[np.lexsort((label, -area[label], owner[label]))]
    rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
    kept = np.sort(order[rank < max_instances])
    table = np.zeros(len(area), np.int64)
    table[kept] = np.arange(1, len(kept) + 1)
    return table[flat], area[kept], owner[kept]


def instances(prob: np.ndarray, disk: np.ndarray | None, config) -> np.ndarray:
    labels = label_components(prob, disk, config.threshold, config.merge_dist, config.use_disk)
    return filter_components(labels, config.min_area, config.max_instances)


def _frames(column: pa.Array) -> list[np.ndarray | None]:
    """The values of each row of an array column as NumPy; None where the row or one of its values is null."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, at = column.values, column.offsets.to_numpy()
    holes = np.append(0, np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))) if flat.null_count else None
    values = flat.fill_null(False if pa.types.is_boolean(flat.type) else 0).to_numpy(zero_copy_only=False)
    there = column.is_valid().to_numpy(zero_copy_only=False)
    return [values[a:b] if ok and (holes is None or holes[a] == holes[b]) else None for a, b, ok in zip(at[:-1], at[1:], there, strict=True)]


def rasters_of(batch: pa.RecordBatch, at: int, height: int, disk: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray | None]]:
    """(place, values, disk) of a batch's rasters, whose values are its column ``at`` and whose disks, if any, the next; broken ones are left out."""
    frames = _frames(batch.column(at))
    disks = _frames(batch.column(at + 1)) if disk else [None] * len(frames)
    for place, (v, on) in enumerate(zip(frames, disks, strict=True)):
        if v is None or not len(v) or len(v) % height or (on is not None and len(on) != len(v)):
            continue
        yield place, v.astype(float).reshape(-1, height).T, None if on is None else on.astype(bool).reshape(-1, height).T


def shared_settings(configs: list) -> dict[tuple, list]:
    """(number, configuration) by what components depend on: those that differ only in the sizes they keep share them."""
    group: dict[tuple, list] = {}
    for number, c in enumerate(configs):
        group.setdefault((c.threshold, c.merge_dist, c.use_disk), []).append((number, c))
    return group


def raster_instances(rasters: DataFrame, keys: list[str], values: str, height: int, configs: list, disk: str | None = None) -> DataFrame:
    """(keys, config, label, s, e): column-major spans of each raster's instances under each configuration.

    ``values``: an array column in column-major order; ``disk``: one of booleans, for configurations that use it (null: the
    whole raster). Components are shared by configurations that differ only in the sizes they keep. Rasters that are null,
    hold a null, or whose length is no multiple of the height (or not the disk's) have no instance.
    """
    kinds = {f.name: f for f in rasters.schema.fields}
    schema = T.StructType([*[kinds[k] for k in keys], *[T.StructField(n, T.IntegerType()) for n in ("config", "label", "s", "e")]])
    group = shared_settings(configs)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            parts: list[list[np.ndarray]] = [[] for _ in range(5)]
            for place, prob, where in rasters_of(batch, len(keys), height, bool(disk)):
                for setting, members in group.items():
                    labels = label_components(prob, where, *setting)
                    for number, c in members:
                        label, s, e = label_spans(filter_components(labels, c.min_area, c.max_instances))
                        for to, x in zip(parts, (np.full(len(s), place), np.full(len(s), number), label, s, e), strict=True):
                            to.append(x)
            at, *rest = (np.concatenate([*x, np.zeros(0, np.int64)]).astype(np.int64) for x in parts)
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(pa.array(at)) for k in range(len(keys))], *[pa.array(x.astype(np.int32)) for x in rest]], schema.names)

    return rasters.select(*keys, values, *([disk] if disk else [])).mapInArrow(run, schema)
