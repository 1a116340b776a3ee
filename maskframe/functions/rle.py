"""Run-length masks: column-major runs, COCO's compressed counts text, and NumPy rasters.

A mask is h, w and half-open runs [s, e) of offset x * h + y. Counts alternate background and foreground, background
first. The text form stores from the third count on the difference to the count two before, in groups of five bits,
lowest first; a group's sixth bit says that more follow, the last group's fifth bit is the sign; characters start at '0'.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

RUNS = "array<struct<s:int,e:int>>"


def counts_of(runs: list[tuple[int, int]], total: int) -> list[int]:
    """Counts of sorted, disjoint runs; touching runs are joined."""
    out, at = [], 0
    for s, e in runs:
        if e <= s:
            continue
        if out and s == at:
            out[-1] += e - s
        else:
            out += [s - at, e - s]
        at = e
    if at < total or not out:
        out.append(total - at)
    return out


def runs_of(counts: list[int]) -> list[tuple[int, int]]:
    edge = np.concatenate(([0], np.cumsum(np.asarray(counts, np.int64))))
    return [(int(edge[k]), int(edge[k + 1])) for k in range(1, len(counts), 2) if counts[k] > 0]


def text_of(counts: list[int]) -> str:
    out = []
    for i, c in enumerate(counts):
        value = int(c) - (int(counts[i - 2]) if i > 2 else 0)
        while True:
            low, value = value & 31, value >> 5
            done = value == (-1 if low & 16 else 0)
            out.append(chr(48 + (low if done else low | 32)))
            if done:
                break
    return "".join(out)


def counts_from(text: str, total: int | None = None) -> list[int]:
    """Counts of a text; ValueError where it is malformed or doesn't cover ``total`` pixels."""
    out, at = [], 0
    while at < len(text):
        value, shift = 0, 0
        while True:
            if at >= len(text):
                raise ValueError("counts end inside a number")
            c = ord(text[at]) - 48
            at += 1
            if not 0 <= c < 64:
                raise ValueError("counts hold a character out of range")
            value |= (c & 31) << shift
            shift += 5
            if not c & 32:
                if c & 16:
                    value -= 1 << shift
                break
        if len(out) > 2:
            value += out[-2]
        if value < 0:
            raise ValueError("counts hold a negative run")
        out.append(value)
    if total is not None and sum(out) != total:
        raise ValueError("counts don't cover the frame")
    return out


def encode(mask: np.ndarray) -> str:
    """Counts text of a raster (h, w)."""
    flat = np.concatenate(([0], np.asarray(mask, bool).T.ravel().astype(np.int8), [0]))
    edge = np.flatnonzero(np.diff(flat))
    return text_of(counts_of(list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)), mask.size))


def decode(text: str, h: int = 2048, w: int = 2048) -> np.ndarray:
    counts = counts_from(text, h * w)
    flat = np.repeat(np.arange(len(counts)) % 2 == 1, counts)
    return flat.reshape(w, h).T


def label_runs(labels: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Column-major runs of each label from 1 that has a pixel, ascending; one pass over the raster."""
    flat = labels.T.ravel()
    edge = np.flatnonzero(np.diff(flat, prepend=0, append=0))
    out: dict[int, list[tuple[int, int]]] = {}
    for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if flat[s] > 0:
            out.setdefault(int(flat[s]), []).append((s, e))
    return dict(sorted(out.items()))


def label_counts(labels: np.ndarray) -> list[str]:
    """Counts text of each label from 1 that has a pixel, ascending."""
    return [text_of(counts_of(runs, labels.size)) for runs in label_runs(labels).values()]


def _udf(kind: str):
    return lambda f: F.arrow_udf(f, kind)


def rle_encode(runs: Column, h: Column, w: Column) -> Column:
    """Counts text of a column of runs."""

    def f(r: pa.Array, hs: pa.Array, ws: pa.Array) -> pa.Array:
        rows = zip(r.to_pylist(), hs.to_pylist(), ws.to_pylist(), strict=True)
        return pa.array([None if x is None else text_of(counts_of([(y["s"], y["e"]) for y in x], a * b)) for x, a, b in rows], pa.string())

    return F.arrow_udf(f, "string")(runs, h, w)


def rle_decode(text: Column, h: Column, w: Column) -> Column:
    """Runs of a column of counts texts; null where a text is malformed or doesn't cover the frame."""

    def one(x, a, b):
        try:
            return None if x is None else [{"s": s, "e": e} for s, e in runs_of(counts_from(x, a * b))]
        except ValueError:
            return None

    def f(t: pa.Array, hs: pa.Array, ws: pa.Array) -> pa.Array:
        rows = zip(t.to_pylist(), hs.to_pylist(), ws.to_pylist(), strict=True)
        return pa.array([one(*x) for x in rows], pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))

    return F.arrow_udf(f, "array<struct<s:int,e:int>>")(text, h, w)


def runs_from_counts(counts: Column) -> Column:
    """Runs of an uncompressed counts array, by expressions alone."""
    edge = F.transform(F.sequence(F.lit(0), F.size(counts)), lambda k: F.aggregate(F.slice(counts, 1, k), F.lit(0), lambda a, x: a + x.cast("int")))
    odd = F.filter(F.sequence(F.lit(0), F.greatest(F.size(counts) - 1, F.lit(0))), lambda k: (k % 2 == 1) & (F.get(counts, k) > 0))
    return F.transform(odd, lambda k: F.struct(F.get(edge, k).alias("s"), F.get(edge, k + 1).alias("e")))


def runs_area(runs: Column) -> Column:
    return F.aggregate(runs, F.lit(0).cast("long"), lambda a, r: a + r["e"] - r["s"])
