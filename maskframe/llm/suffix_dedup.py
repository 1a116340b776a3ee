"""Suffix-array dedup: remove every byte covered by a 50-byte string that also starts in a smaller document.

Shards hold the byte contexts that ``repeats`` routed to them. Each block of a shard gets a suffix array by
Larsson-Sadakane refinement (rank doubling that touches only groups not yet singletons), common prefixes by Kasai's
algorithm, and groups of window-long prefixes with their smallest id; blocks are merged by binary search for their groups' strings.

Null texts are empty; texts shorter than the window stay whole; equal ids never remove from each other; ties between
equal strings go to the smallest id, which keeps its bytes. Removal is judged on the input, not on what is left.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .repeats import repeats

#: Bytes of contexts that one suffix array covers; a larger shard is several blocks.
BLOCK = 1 << 18


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions in order of the next ``depth`` values at least (Larsson and Sadakane 1999), ties by position.

    ``text`` is an integer array; a shorter suffix precedes its extensions.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    if text.dtype == np.uint16 and n > 7 and int(text.max()) < 512:  # seven values at a time to begin with
        t = np.concatenate((text.astype(np.uint64), np.zeros(6, np.uint64)))
        key, h = t[:n].copy(), 7
        for k in range(1, h):
            key <<= np.uint64(9)
            key |= t[k : n + k]
    else:
        key, h = text, 1
    sa = np.argsort(key, kind="stable")
    sorted_ = key[sa]
    new = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
    rank = np.empty(n + 1, np.int64)
    # a group's rank is the place of its last member, as in the original algorithm; the end of text ranks below all
    rank[n] = -1
    last = np.append(np.flatnonzero(new)[1:], n) - 1
    rank[sa] = last[np.cumsum(new) - 1]
    group = np.concatenate((np.flatnonzero(new), [n]))
    while h < depth:
        size = np.diff(group)
        open_ = np.flatnonzero(size > 1)
        if not len(open_):
            break
        size = size[open_]
        begin = group[:-1][open_]
        # the places of all members of unsorted groups, group after group
        place = np.repeat(begin - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        member = sa[place]
        second = rank[np.minimum(member + h, n)]
        owner = np.repeat(np.arange(len(begin)), size)
        order = np.argsort(owner * (n + 2) + second + 1, kind="stable")
        member, second = member[order], second[order]
        sa[place] = member
        new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (second[1:] != second[:-1])))
        first = np.flatnonzero(new)
        end = np.append(first[1:], len(new)) - 1
        rank[member] = place[end][np.cumsum(new) - 1]
        group = np.append(place[first], n)
        # groups were split in place: what lies between them is sorted already
        group = _with_gaps(place[first], place[end] + 1, n)
        h *= 2
    return sa


def _with_gaps(begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Bounds of the given groups and of single stretches for what lies between; only groups keep a size over one."""
    # sorted places between groups become groups of one
    single = np.ones(n, bool)
    step = np.zeros(n + 1, np.int32)
    step[begin] += 1
    step[end] -= 1
    single = np.cumsum(step[:-1]) == 0
    return np.append(np.sort(np.concatenate((begin, np.flatnonzero(single)))), n)


def kasai(text: np.ndarray, sa: np.ndarray, limit: int, strips: int = 8192) -> np.ndarray:
    """Common prefix of each suffix and its predecessor in ``sa`` (0 for the first), counted up to ``limit``.

    Kasai's scan in text order, where a suffix shares all but one of the values its neighbour to the left shared;
    it runs in many strips of the text at once, each of which starts from nothing. ``sa`` may be ordered by its first
    ``limit`` values only: suffixes tied there can have their right neighbours the other way round, and where that is
    so, the count starts from nothing too.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    rank = np.full(n + 1, -1, np.int64)
    rank[sa] = np.arange(n)
    padded = np.concatenate((text.astype(np.int32), np.full(limit + 1, -1, np.int32)))
    length = -(-n // min(strips, n))
    heads = np.arange(0, n, length)
    shared, out = np.zeros(len(heads), np.int64), np.zeros(n, np.int64)
    for k in range(length):
        i = heads + k
        live = i < n
        i = np.where(live, i, n - 1)
        j = before[i]
        shared = np.where(j < 0, 0, shared)
        go = np.flatnonzero(live & (j >= 0) & (shared < limit))
        while len(go):
            a, b = i[go] + shared[go], j[go] + shared[go]
            same = (padded[a] == padded[b]) & (a < n) & (b < n)
            go = go[same]
            shared[go] += 1
            go = go[shared[go] < limit]
        out[i[live]] = shared[live]
        ordered = rank[j + 1] < rank[np.minimum(i + 1, n)]
        shared = np.where(ordered, np.maximum(shared - 1, 0), 0)
    return out[sa]


def window_groups(units: np.ndarray, sizes: np.ndarray, ids: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One block: each window start's place, its group of equal windows, the groups' strings in order, their smallest ids."""
    total = int(sizes.sum())
    # one separator, below all bytes, after each context; windows never cross it
    text = np.zeros(total + len(sizes), np.uint16)
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    at = np.arange(total) + np.repeat(np.arange(len(sizes)), sizes)
    text[at] = units.astype(np.uint16) + 1
    count = sizes - window + 1
    starts = np.repeat(begin, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    owner = np.repeat(np.arange(len(sizes)), count)
    sa = suffix_array(text, window)
    lcp = kasai(text, sa, window)
    is_start = np.zeros(len(text), bool)
    is_start[starts] = True
    keep = is_start[sa]
    # shortest common prefix since the last window start kept
    number = np.cumsum(lcp < window)[keep]
    position = sa[keep]
    new = np.concatenate(([True], number[1:] != number[:-1])) if len(number) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    of = np.empty(len(text), np.int64)
    of[position] = np.cumsum(new) - 1
    whose = np.zeros(len(text), np.int64)
    whose[starts] = ids[owner]
    least = np.minimum.reduceat(whose[position], head) if len(head) else np.zeros(0, np.int64)
    strings = np.lib.stride_tricks.sliding_window_view((text - 1).astype(np.uint8), window)[position[head]] if len(head) else np.zeros((0, window), np.uint8)
    return starts, of[starts], strings, least


def resolve(units: np.ndarray, sizes: np.ndarray, ids: np.ndarray, window: int) -> np.ndarray:
    """Which windows of a shard's contexts also start in a context of a smaller id."""
    cut = np.flatnonzero(np.diff(np.cumsum(sizes) // BLOCK)) + 1
    edges = np.concatenate(([0], cut, [len(sizes)]))
    unit_at = np.concatenate(([0], np.cumsum(sizes)))
    blocks = [window_groups(units[unit_at[a] : unit_at[b]], sizes[a:b], ids[a:b], window) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    least = [b[3] for b in blocks]
    if len(blocks) > 1:  # every block's sorted strings are searched for in what the blocks before have, and merged in
        keys = [np.ascontiguousarray(b[2]).view(f"S{window}").ravel() for b in blocks]
        known, best = keys[0], least[0].copy()
        for mine, ids_ in zip(keys[1:], least[1:], strict=True):
            place = np.searchsorted(known, mine)
            same = known[np.minimum(place, len(known) - 1)] == mine
            np.minimum.at(best, place[same], ids_[same])
            known, best = np.insert(known, place[~same], mine[~same]), np.insert(best, place[~same], ids_[~same])
        least = [best[np.searchsorted(known, mine)] for mine in keys]
    out = []
    for (a, b), (_, of, _, _), least_ in zip(zip(edges[:-1], edges[1:], strict=True), blocks, least, strict=True):
        out.append(least_[of] < np.repeat(ids[a:b], sizes[a:b] - window + 1))
    return np.concatenate(out)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, gram: int = 16, whole_characters: bool = False) -> DataFrame:
    """``row`` (the other columns), ``n_units`` (bytes), ``spans`` (removed byte runs) and ``kept`` (the remaining bytes) for each row of ``docs``."""
    return repeats(docs, id_col, text_col, unit="byte", window=window, gram=gram, resolve=resolve, whole_characters=whole_characters)


def op8_suffix_dedup(spark, sf_dir) -> DataFrame:
    from .common import table

    out = suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select(F.col("row.doc_id").alias("doc_id"), F.col("n_units").alias("n_bytes"), gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


__all__ = ["kasai", "kernels", "op8_suffix_dedup", "resolve", "suffix_array", "suffix_dedup"]
