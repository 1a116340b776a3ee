"""Substring dedup by words: remove every word covered by a 50-word window that also starts in a smaller document.

Relative Lempel-Ziv parsing. ``repeats`` routes word contexts to shards; there every different word gets a number, and
every different window a name (by naming runs of 1, 2, 4 ... words, as Karp, Miller and Rosenberg do; no hash decides).
A shard's contexts are its reference blocks, indexed by window name with the first block (smallest id) that has it. Every
context is parsed greedily: a cursor looks its window up; a hit is extended along the reference as far as both agree, and
becomes a factor; the windows that straddle a factor's end are then looked up one after another until the next factor
begins. So a window lies in a factor or was looked up itself, and the result is that of comparing all windows.

Words are runs of anything but ASCII white space, unchanged. Null texts have no words; texts of fewer words than a
window stay whole; equal ids never remove from each other; of equal windows the smallest id's stay.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import repeats


class Reference:
    """Window index of reference blocks laid one after another."""

    def __init__(self, units: np.ndarray, sizes: np.ndarray, ids: np.ndarray, window: int):
        self.units, self.window = units, window
        begin = np.cumsum(sizes) - sizes
        count = np.maximum(sizes - window + 1, 0)
        self.block = np.repeat(np.arange(len(sizes)), count)
        self.start = np.repeat(begin, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        self.end = (begin + sizes)[self.block]
        self.name = named(units, window)[self.start] if len(self.start) else self.start
        owner = ids[self.block]
        order = np.lexsort((self.start, owner, self.name))
        new = np.concatenate(([True], self.name[order][1:] != self.name[order][:-1])) if len(order) else np.zeros(0, bool)
        first = order[new]
        self.keys, self.at, self.id, self.until = self.name[first], self.start[first], owner[first], self.end[first]

    def find(self, k: np.ndarray, id_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For windows (by number): whether a smaller id has it, where, and where that block ends."""
        place = np.searchsorted(self.keys, self.name[k])
        return self.id[place] < id_, self.at[place], self.until[place]


def named(units: np.ndarray, window: int) -> np.ndarray:
    """A number for each run of ``window`` units, the same for equal runs only."""
    name, width = np.unique(units, return_inverse=True)[1].astype(np.int64), 1
    while width < window and len(name):
        step = min(width, window - width)
        name = np.unique(name[:-step] * (int(name.max()) + 1) + name[step:], return_inverse=True)[1].astype(np.int64)
        width += step
    return name


def resolve(units: np.ndarray, sizes: np.ndarray, ids: np.ndarray, window: int) -> np.ndarray:
    """Which windows of a shard's contexts lie in factors of contexts with a smaller id."""
    ref = Reference(units, sizes, ids, window)
    count = np.maximum(sizes - window + 1, 0)
    first = np.cumsum(count) - count
    covered = np.zeros(len(ref.start), bool)
    cursor = first.copy()
    live = np.flatnonzero(count > 0)
    while len(live):
        k = cursor[live]
        hit, at, until = ref.find(k, ids[live])
        got = np.flatnonzero(hit)
        length = np.full(len(live), window)
        grow = got
        while len(grow):  # along the reference, while both go on and agree
            a, b = ref.start[k[grow]] + length[grow], at[grow] + length[grow]
            ok = (a < ref.end[k[grow]]) & (b < until[grow])
            ok[ok] = units[a[ok]] == units[b[ok]]
            grow = grow[ok]
            length[grow] += 1
        factor = length[got] - window + 1
        np.add.at(step := np.zeros(len(covered) + 1, np.int32), k[got], 1)
        np.add.at(step, k[got] + factor, -1)
        covered |= np.cumsum(step[:-1]) > 0
        # past the factor, or past the window that had none
        cursor[live] = k + np.where(hit, length - window + 1, 1)
        live = live[cursor[live] < first[live] + count[live]]
    return covered


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int = 25) -> DataFrame:
    """``row`` (the other columns), ``n_units`` (words), ``spans`` (removed word runs) and ``kept`` (words, UTF-8)."""
    return repeats(docs, id_col, text_col, unit="word", window=window, gram=gram, resolve=resolve, compare_copies=True)


def op9_substring_dedup(spark, sf_dir) -> DataFrame:
    from .common import table

    out = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select(F.col("row.doc_id").alias("doc_id"), F.col("n_units").alias("n_words"), gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
