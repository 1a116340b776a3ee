"""Polygon rasters by COCO's boundary rule, and the segmentation variants that annotations hold.

A ring's edges are walked on a grid five times finer; where a walk enters a new column, the boundary's row there, brought
back to pixels, toggles the column-major mask from that offset on. So a box [10,10,30,10,30,30,10,30] has 20 by 20 pixels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .rle import counts_from, runs_of

FINE = 5.0


def ring_runs(ring: list[float], h: int, w: int) -> list[tuple[int, int]]:
    """Runs of one ring given as x0, y0, x1, y1, ..."""
    point = np.floor(FINE * np.asarray(ring, float).reshape(-1, 2) + 0.5).astype(np.int64)
    us, vs = [], []
    for (xs, ys), (xe, ye) in zip(point, np.roll(point, -1, axis=0), strict=True):
        dx, dy = abs(xe - xs), abs(ye - ys)
        flip = (dx >= dy and xs > xe) or (dx < dy and ys > ye)
        if flip:
            xs, xe, ys, ye = xe, xs, ye, ys
        t = np.arange(max(dx, dy) + 1)
        if flip:
            t = max(dx, dy) - t
        slope = (ye - ys) / dx if dx >= dy and dx else (xe - xs) / dy if dy else 0.0
        if dx >= dy:
            us.append(t + xs)
            vs.append(np.floor(ys + slope * t + 0.5).astype(np.int64))
        else:
            vs.append(t + ys)
            us.append(np.floor(xs + slope * t + 0.5).astype(np.int64))
    u, v = np.concatenate(us), np.concatenate(vs)
    turn = np.flatnonzero(u[1:] != u[:-1]) + 1
    left = np.where(u[turn] < u[turn - 1], u[turn], u[turn] - 1)
    x = (left + 0.5) / FINE - 0.5
    y = np.ceil(np.clip((np.minimum(v[turn], v[turn - 1]) + 0.5) / FINE - 0.5, 0, h)).astype(np.int64)
    on = (np.floor(x) == x) & (x >= 0) & (x <= w - 1)
    edges = np.sort(x[on].astype(np.int64) * h + y[on])
    edges = np.append(edges, [h * w] * (len(edges) % 2))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True) if a < b]


def union(parts: list[list[tuple[int, int]]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(r for p in parts for r in p):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def segmentation_runs(polys, counts, text, h: int, w: int) -> list[tuple[int, int]] | None:
    """Runs of a segmentation given as rings, a counts array or a counts text; None if there is none."""
    if counts is not None:
        return runs_of(counts) if sum(counts) == h * w else None
    if text is not None:
        try:
            return runs_of(counts_from(text, h * w))
        except ValueError:
            return None
    rings = [r for r in polys or [] if len(r) >= 6]
    return union([ring_runs(r[: len(r) // 2 * 2], h, w) for r in rings]) if rings else None


def to_runs(segmentation: Column, h: Column, w: Column) -> Column:
    """Runs of a column of (polys, counts, text) structs."""

    def f(s: pa.Array, hs: pa.Array, ws: pa.Array) -> pa.Array:
        out = []
        for x, a, b in zip(s.to_pylist(), hs.to_pylist(), ws.to_pylist(), strict=True):
            r = None if x is None else segmentation_runs(x["polys"], x["counts"], x["text"], a, b)
            out.append(None if r is None else [{"s": p, "e": q} for p, q in r])
        return pa.array(out, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))

    return F.arrow_udf(f, "array<struct<s:int,e:int>>")(segmentation, h, w)


def variant_segmentation(v: Column) -> Column:
    """(polys, counts, text) of a variant: flat ring, rings, [x, y] pairs, or RLE with counts as array or text; null if empty."""
    flat = F.try_variant_get(v, "$", "array<double>")
    deep = F.try_variant_get(v, "$", "array<array<double>>")
    clean = F.when(F.forall(deep, lambda r: r.isNotNull()), deep)
    pairs = F.size(clean) == F.size(F.filter(clean, lambda r: F.size(r) == 2))
    rings = F.when(F.forall(flat, lambda x: x.isNotNull()) & (F.size(flat) > 0), F.array(flat)).when(pairs & (F.size(clean) > 0), F.array(F.flatten(clean))).otherwise(clean)
    polys = F.filter(rings, lambda r: F.size(r) >= 6)
    counts, text = F.try_variant_get(v, "$.counts", "array<int>"), F.when(F.schema_of_variant(F.try_variant_get(v, "$.counts", "variant")) == "STRING", F.try_variant_get(v, "$.counts", "string"))
    is_object = F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
    return F.when(is_object & (counts.isNotNull() | text.isNotNull()), F.struct(F.lit(None).cast("array<array<double>>").alias("polys"), counts.alias("counts"), text.alias("text"))).when(
        ~is_object & (F.size(polys) > 0), F.struct(polys.alias("polys"), F.lit(None).cast("array<int>").alias("counts"), F.lit(None).cast("string").alias("text")))
