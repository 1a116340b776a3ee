"""Near-duplicate documents by MinHash and an LSH forest.

1. Each text gets its set of word shingles, the set's digest and a MinHash signature of 256 values. Texts with equal sets
   form a class at once (partial minima by digest), however many they are; the rest works on one text a class, its node.
2. The forest: in each of several trees the signatures are sorted in an order of their own. All trees' rows are sorted
   together, range-partitioned, so that a dense region spreads over as many tasks as its rows need; what lies on either
   side of a partition's edge is compared in a small second pass. Rows whose first ``DEPTHS[0]`` values agree form a run;
   neighbours in it, up to ``NEAR`` rows apart, whose whole signatures agree well enough are candidates.
3. The depth adapts to the region: texts of a run of more than ``NEAR`` rows that its candidates didn't join for the most
   part are sorted again, with deeper prefixes in more trees, so that their runs get short.
4. Candidates, joined to components, are *regions*. Inside one of up to ``BLOCKS`` blocks all links are found on the full
   sets. A larger one has each block compared within itself and with block 0. What that left in several parts is sorted in
   the trees once more, and the candidates between different parts are compared on the full sets, so a region costs its
   own size, not its square. Sets are compared as products of 0/1 matrices over shingles; shingles are numbered by their words
   themselves, without a hash. Only one link for each text to the smallest one it was joined with leaves a task.

Two sets at the similarity threshold share a tree's prefix with probability J**depth; the number of trees is chosen so
that all trees of a depth miss such a pair with probability 1e-5 at most. Signatures drop a candidate only where they lie
more than 4.3 standard deviations below the threshold (1e-5 more). Two cases miss more: a pair of a dense background that
has more than ``NEAR`` rows between its two in every tree of the last depth (README has the recall measured), and a
weak link to a text whose run is one component already, found only if one of up to 2 * ``NEAR`` neighbours a tree links it.

Words: ASCII upper case is lowered; words are runs of anything but ASCII white space. With fewer words than a shingle the
whole sequence is one; texts without words (null too) have an empty set and no links. Texts alone link: rows that share
an id, or lack one, are rows of their own. A component's id is its smallest one that isn't null, and null if all are.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, kernels
from .components import components

HASHES, NEAR = 256, 24
#: Values of a tree's prefix, from one pass to the next.
DEPTHS = (3, 6, 10)
MISS = 1e-5
#: Texts in a block; about so many texts of small regions share a task's group.
CELL, PACK = 512, 2000
#: A region of up to so many blocks is compared block with block, so that a text is sent so many times at most.
BLOCKS = 16
#: Rows of the sorted trees, and rows of small tables, for a partition.
SORTED, SMALL = 50_000, 20_000
#: Cells of a block's matrix at a time.
CELLS = 1 << 21
#: Up to so many rows (under 100 bytes each) are broadcast to pick their texts; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Rows at partitions' edges that one task of the second pass looks at.
EDGES = 100_000
_CHUNK = 1 << 20
_R = np.random.default_rng(77)
_MUL = _R.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _R.integers(0, 2**63, HASHES, dtype=np.uint64)
_PART = _R.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_NIBBLE = np.uint64(0x1111111111111111)


def trees(threshold: float, depth: int = DEPTHS[0]) -> int:
    return max(1, math.ceil(math.log(MISS) / math.log(1 - threshold**depth)))


def least_equal(threshold: float) -> int:
    """The fewest equal signature values that a candidate needs."""
    return math.floor(HASHES * threshold - 4.3 * math.sqrt(HASHES * threshold * (1 - threshold)))


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text (128 bits, two columns), sorted, one text after another, and where each text's begin (one more at the end)."""
    data, start, end = kernels.texts(column)
    _, _, h, first, last = kernels.word_hashes(data, start, end, lower=True)
    n = last - first
    full = np.zeros((max(len(h) - size + 1, 0), 2), np.uint64)
    for k in range(size if len(full) else 0):
        full += h[k : len(h) - size + 1 + k] * _PART[k % 64]
    full = kernels.mix(full)
    parts = []
    for a, b, k in zip(first.tolist(), last.tolist(), n.tolist(), strict=True):
        if k >= size:
            s = full[a : b - size + 1]
            s = s[np.argsort(s[:, 0], kind="stable")]
        elif k:
            s = kernels.digests([h[a:b].tobytes()])
        else:
            s = h[:0]
        parts.append(s)
    flat = np.concatenate(parts) if parts else h[:0]
    at = np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int64)
    if len(flat):
        new = np.ones(len(flat), bool)
        new[1:] = flat[1:, 0] != flat[:-1, 0]
        new[at[:-1][at[:-1] < len(flat)]] = True
        flat, at = flat[new], np.append(0, np.cumsum(new))[at]
    return flat, at


def numbered_sets(texts: list[str | None], size: int) -> tuple[np.ndarray, np.ndarray]:
    """As ``shingle_sets``, with a number for each different shingle of these texts, by its words themselves."""
    known: dict[bytes, int] = {}
    words = [np.array([known.setdefault(w, len(known)) for w in (t or "").encode().lower().split()], np.int64) for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    flat = np.concatenate([*words, np.zeros(0, np.int64)])
    name, width = flat, 1
    while width < size and len(name):  # runs of 2, 4 ... words get numbers from those of their halves
        step = min(width, size - width)
        name = np.unique(name[:-step] * (int(name.max()) + 1) + name[step:], return_inverse=True)[1].astype(np.int64)
        width += step
    short: dict[bytes, int] = {}
    top, first = int(name.max()) + 1 if len(name) else 0, np.cumsum(n) - n
    sets = []
    for w, a, k in zip(words, first.tolist(), n.tolist(), strict=True):
        if k >= size:
            sets.append(np.unique(name[a : a + k - size + 1]))
        else:
            sets.append(np.array([top + short.setdefault(w.tobytes(), len(short))][: min(k, 1)], np.int64))
    return np.concatenate([*sets, np.zeros(0, np.int64)]), np.append(0, np.cumsum([len(x) for x in sets])).astype(np.int64)


def signatures(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    """MinHash signatures, 16 bits a value; rows of empty sets mean nothing."""
    out = np.zeros((len(at) - 1, HASHES), np.uint16)
    full = np.flatnonzero(np.diff(at) > 0)
    if len(full):
        flat = np.ascontiguousarray(flat)
        for k in range(HASHES):
            out[full, k] = np.minimum.reduceat(flat * _MUL[k] + _ADD[k], at[:-1][full]) >> np.uint64(16) & np.uint64(0xFFFF)
    return out


def chunks(batch: pa.RecordBatch, column: int = 1):
    """Slices of a batch of about ``_CHUNK`` bytes of text."""
    size = kernels.texts(batch.column(column))
    total = np.cumsum(size[2] - size[1])
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + _CHUNK, "right")))
        yield batch.slice(a, b - a)
        a = b


def signed(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, text, hash, n, digest, signature, node) for each row: ``hash`` is the text's, ``node`` numbers the rows."""

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                flat, at = shingle_sets(part.column(1), size)
                sig = signatures(flat[:, 0], at)
                digest = [hashlib.blake2b(flat[a:b].tobytes(), digest_size=16).digest() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.diff(at), pa.int64()), pa.array(digest, pa.binary()), kernels.packed(sig)], ["id", "text", "hash", "n", "digest", "signature"])
            kernels.settle()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col).cast("string")).alias("hash"))
    return rows.mapInArrow(run, "id long, text string, hash long, n long, digest binary, signature binary").withColumn("node", F.monotonically_increasing_id())


def forest(classes: DataFrame, n: int, threshold: float, depth: int) -> DataFrame:
    """One row a class (of ``n``) (node, n, part, signature) and tree, sorted over all partitions: o, node, n, part.

    ``o`` orders: the tree, ``depth`` values, then the low halves of all 256 values' bytes in the tree's order.
    """
    count = trees(threshold, depth)

    def run(batches):
        turns = [np.random.default_rng([depth, t]).permutation(HASHES) for t in range(count)]
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(-1, HASHES)
            others = [batch.column(c) for c in ("node", "n", "part")]
            low = (sig & 15).astype(np.uint8)
            for t, turn in enumerate(turns):
                order = np.empty((len(sig), 2 + 2 * depth + HASHES // 2), np.uint8)
                order[:, 0], order[:, 1] = t >> 8, t & 255
                order[:, 2 : 2 + 2 * depth] = np.ascontiguousarray(sig[:, turn[:depth]].astype(">u2")).view(np.uint8).reshape(len(sig), -1)
                own = low[:, np.roll(turn, -depth)]
                order[:, 2 + 2 * depth :] = own[:, ::2] << 4 | own[:, 1::2]
                yield pa.RecordBatch.from_arrays([kernels.packed(order), *others], ["o", "node", "n", "part"])
            kernels.settle()

    rows = classes.select("node", "n", "part", "signature").mapInArrow(run, "o binary, node long, n long, part long")
    k = common.partitions(classes.sparkSession, n * count, SORTED)
    return rows.repartitionByRange(k, "o", "node").sortWithinPartitions("o", "node")


LINK, DENSE, EDGE = 0, 1, 2


def candidates(rows: DataFrame, threshold: float, depth: int, between: bool) -> DataFrame:
    """What a sorted forest shows: (kind, a, b, o, n, part).

    ``LINK`` rows (a, b) join all candidates of a task to the components that they form; with ``between`` they are all
    candidates whose parts differ. ``DENSE`` rows name the nodes a of long runs that aren't joined for the most part.
    ``EDGE`` rows are a partition's first and last ``NEAR`` rows (node in a).
    """
    least, prefix = least_equal(threshold), 2 + 2 * depth

    def run(batches):
        def edge(kind, node, other, o, n, part):
            nulls = lambda x, t: pa.nulls(len(node), t) if x is None else pa.array(x, t)
            order = pa.nulls(len(node), pa.binary()) if o is None else kernels.packed(o)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(node), kind), pa.int32()), pa.array(node, pa.int64()), nulls(other, pa.int64()), order, nulls(n, pa.int64()), nulls(part, pa.int64())], ["kind", "a", "b", "o", "n", "part"])

        tail = None
        for batch in batches:
            now = (np.frombuffer(b"".join(batch.column("o").to_pylist()), np.uint8).reshape(batch.num_rows, -1), *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("node", "n", "part")))
            had = 0 if tail is None else len(tail[1])
            if tail is None:
                yield edge(EDGE, now[1][:NEAR], None, now[0][:NEAR], now[2][:NEAR], now[3][:NEAR])
            else:
                now = tuple(np.concatenate(x) for x in zip(tail, now, strict=True))
            o, node, n, part = now
            key = np.ascontiguousarray(o[:, :prefix]).view(f"V{prefix}").ravel()
            low = np.ascontiguousarray(o[:, prefix:]).view(np.uint64)
            root, found, long = np.arange(len(node)), [], np.zeros(len(node), bool)
            for step in range(1, min(NEAR, len(node) - 1) + 1):
                j = np.arange(max(had, step), len(node))
                j = j[key[j - step] == key[j]]
                if not len(j):
                    break
                i = j - step
                if step == NEAR:
                    step_ = np.zeros(len(node) + 1, np.int64)
                    np.add.at(step_, i, 1)
                    np.add.at(step_, j + 1, -1)
                    long = np.cumsum(step_[:-1]) > 0
                fit = (part[i] != part[j] if between else root[i] != root[j]) & (node[i] != node[j]) & (np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9)
                i, j = i[fit], j[fit]
                fit = equal_values(low[i], low[j]) >= least
                if between:
                    found.append(np.stack((i[fit], j[fit]), axis=1))
                else:
                    found += _joined(root, i[fit], j[fit])
            if between:
                i, j = np.concatenate([*found, np.zeros((0, 2), np.int64)]).astype(np.int64).T
                yield edge(LINK, np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), None, None, None)
            else:
                i = np.unique(np.array(found, np.int64).ravel())
                yield edge(LINK, node[i], _smallest(root, node)[i], None, None, None)
            if long.any():
                yield edge(DENSE, np.unique(node[_unjoined(np.flatnonzero(long), key, part if between else root)]), None, None, None, None)
            tail = tuple(x[-NEAR:].copy() for x in now)
            del now, o, node, n, part, key, low
        kernels.settle()
        if tail is not None:
            yield edge(EDGE, tail[1], None, tail[0], tail[2], tail[3])

    return rows.select("o", "node", "n", "part").mapInArrow(run, "kind int, a long, b long, o binary, n long, part long")


def equal_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values agree in their low four bits, row by row of 64-bit words."""
    x = a ^ b
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return HASHES - np.bitwise_count(x & _NIBBLE).sum(axis=1, dtype=np.int64)


def _unjoined(at: np.ndarray, key: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Of rows in long runs, those outside a component that holds half of their run."""
    _, run = np.unique(key[at], return_inverse=True)
    both, which, size = np.unique(np.stack((run, root[at]), axis=1), axis=0, return_inverse=True, return_counts=True)
    total = np.bincount(run)
    main = 2 * size >= total[both[:, 0]]
    return at[~main[which.ravel()]]


def pairs_of_forest(classes: DataFrame, threshold: float, between: bool = False) -> DataFrame:
    """(a, b) candidates of all passes over ``classes`` (node, n, part, signature)."""
    spark = classes.sparkSession
    links, now, n = None, classes, classes.count()
    for depth in DEPTHS:
        found = common.written(candidates(forest(now, n, threshold, depth), threshold, depth, between), "candidates")
        edges = found.where(F.col("kind") == EDGE)
        counts = {r["kind"]: r["count"] for r in found.groupBy("kind").count().collect()}
        few = max(1, counts.get(EDGE, 0) // EDGES)
        edges = edges.select("o", F.col("a").alias("node"), "n", "part").repartitionByRange(few, "o", "node").sortWithinPartitions("o", "node")
        more = candidates(edges, threshold, depth, between).where(F.col("kind") == LINK).select("a", "b")
        here = found.where(F.col("kind") == LINK).select("a", "b").unionAll(more)
        small = lambda rows, *keys: rows.repartition(common.partitions(spark, counts.get(LINK, 0) + counts.get(DENSE, 0), SMALL), *keys).distinct()
        here = common.written(small(here.where("a <> b"), "a", "b"), "pairs")
        links = here if links is None else links.unionAll(here)
        dense = common.written(small(found.where(F.col("kind") == DENSE).select(F.col("a").alias("node")), "node"), "dense")
        common.done(found)
        n = dense.count()
        if not n:
            break
        now = classes.join(F.broadcast(dense) if n <= BROADCAST_ROWS else dense, "node", "left_semi")
    return links


def _joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Join the components of the pairs in ``root`` (each node's root, flat before and after); the pairs that did so."""
    out = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        a, b = x, y
        while root[a] != a:
            a = root[a]
        while root[b] != b:
            b = root[b]
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((x, y))
    while len(out):
        up = root[root]
        if (up == root).all():
            break
        root[:] = up
    return out


def _smallest(root: np.ndarray, id_: np.ndarray) -> np.ndarray:
    """The smallest id of each node's component: links to it make stars, which join in fewer rounds than chains."""
    least = np.full(len(root), np.iinfo(np.int64).max)
    np.minimum.at(least, root, id_)
    return least[root]


def set_links(flat: np.ndarray, at: np.ndarray, own: np.ndarray, hundredths: int) -> np.ndarray:
    """Components of the sets, by links between any and one of ``own`` (a mask): full sets, exact counts."""
    n = len(at) - 1
    size = np.diff(at)
    values, column, seen = np.unique(flat, return_inverse=True, return_counts=True)
    place = np.cumsum(seen > 1) - 1
    several = seen[column] > 1
    row = np.repeat(np.arange(n), size)[several]
    column = place[column[several]]
    mine = np.flatnonzero(own)
    both = np.zeros((len(mine), n), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    wide = max(64, CELLS // max(n, 1))
    for first in range(0, int(place[-1]) + 1 if len(values) else 0, wide):
        a, b = np.searchsorted(column, [first, first + wide])
        m = np.zeros((n, wide), np.float32)
        m[row[a:b], column[a:b] - first] = 1
        both += m[mine] @ m.T
    root = np.arange(n)
    for k in range(0, len(mine), 64):  # a few rows at a time: counts need more bytes than their products
        own, counts = mine[k : k + 64], both[k : k + 64].astype(np.int64)
        i, j = np.nonzero((counts > 0) & (100 * counts >= hundredths * (size[own][:, None] + size[None, :] - counts)))
        i = own[i]
        fit = root[i] != root[j]
        _joined(root, i[fit], j[fit])
    return root


def links_in_cells(rows: DataFrame, size: int, threshold: float) -> DataFrame:
    """Links (a, b) of texts that share a cell and region; rows: (cell, region, own, node, text), own: compared with all there."""
    hundredths = round(threshold * 100)

    def run(table: pa.Table) -> pa.Table:
        region, node = table.column("region").to_numpy(), table.column("node").to_numpy()
        own = table.column("own").to_numpy(zero_copy_only=False).astype(bool)
        flat, at = numbered_sets(table.column("text").to_pylist(), size)
        order = np.argsort(region, kind="stable")
        bounds = np.flatnonzero(np.concatenate(([True], region[order][1:] != region[order][:-1], [True])))
        a, b = [], []
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            k = order[lo:hi]
            sets = [flat[at[x] : at[x + 1]] for x in k]
            root = set_links(np.concatenate(sets), np.append(0, np.cumsum([len(x) for x in sets])), own[k], hundredths)
            a.append(node[k])
            b.append(_smallest(root, node[k]))
        a, b = np.concatenate(a), np.concatenate(b)
        kernels.settle()
        return pa.table({"a": pa.array(a[a != b], pa.int64()), "b": pa.array(b[a != b], pa.int64())})

    return rows.groupBy("cell").applyInArrow(run, "a long, b long")


def _ends(roots: DataFrame) -> DataFrame:
    """(node, root) of all nodes of stars, their centres included."""
    return roots.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def first_cells(members: DataFrame, packs: int) -> DataFrame:
    """(node, region, cell, own) from (node, region, blocks, block).

    Regions of one block in packs, those of a few block with block (the first one's texts ask), the blocks of large ones with block 0.
    """
    alone = F.concat(F.lit("p"), F.pmod(F.xxhash64("region", F.lit(13)), F.lit(packs)).cast("string"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    pairs = F.transform(every, lambda x: F.concat_ws("-", F.least("block", x), F.greatest("block", x)))
    to = F.when(F.col("blocks") <= BLOCKS, pairs).when(F.col("block") == 0, F.transform(every, lambda x: F.concat(x.cast("string"), F.lit("-0")))).otherwise(F.array(F.concat(F.col("block").cast("string"), F.lit("-0"))))
    cell = F.when(F.col("blocks") == 1, alone).otherwise(F.concat_ws("-", "region", "to"))
    return members.select("*", F.explode(to).alias("to")).select("node", "region", cell.alias("cell"), F.startswith("to", F.concat(F.col("block").cast("string"), F.lit("-"))).alias("own"))


def pair_cells(pairs: DataFrame, torn: DataFrame) -> DataFrame:
    """(node, region, own) of candidate pairs (a, b): a pair's blocks name the group in which its texts meet.

    So a text is sent once for each block that it has candidates in, and never more often than it has candidates.
    """
    ends = lambda x: torn.select(F.col("node").alias(x), F.struct("region", "block").alias(f"{x}_block"))
    group = F.xxhash64("a_block", "b_block").alias("region")
    both = F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(True).alias("own")), F.struct(F.col("b").alias("node"), F.lit(False).alias("own")))).alias("x")
    return pairs.join(ends("a"), "a").join(ends("b"), "b").select(group, both).groupBy("region", "x.node").agg(F.max("x.own").alias("own")).select("node", "region", "own")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """(id, n_shingles, component) for each row of ``docs``: the smallest id that links reach, the row's own included."""
    with common.temporary():
        return common.written(_answer(*_linked(docs, id_col, text_col, size, threshold)), "answer", keep=True)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """(id, hash, component) for each row of ``docs`` whose component has several rows: ``hash`` is xxhash64 of the text, ``component`` a number."""
    with common.temporary():
        sets, classes, ends = _linked(docs, id_col, text_col, size, threshold)
        found = classes.select("digest", "node").join(ends, "node", "left").select("digest", F.coalesce("root", "node").alias("component"))
        rows = sets.where("n > 0").select("id", "hash", "digest").join(found.hint("merge"), "digest").select("id", "hash", "component")
        several = rows.groupBy("component").agg(F.count("*").alias("k")).where("k > 1").select("component")
        return common.written(rows.join(several, "component", "left_semi"), "groups", keep=True)


def _linked(docs: DataFrame, id_col: str, text_col: str, size: int, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their sets, one node for each distinct set, and (node, root) of the nodes that links join."""
    spark = docs.sparkSession
    sets = common.written(signed(docs, id_col, text_col, size), "sets")
    # one node for each distinct set: the row of the smallest number
    same = sets.where("n > 0").groupBy("digest").agg(F.min("node").alias("node"), F.min("id").alias("id"), F.min("n").alias("n"), F.min("signature").alias("signature"))
    few = common.partitions(spark, sets.count(), SMALL)
    classes = common.written(same.withColumn("part", F.lit(0).cast("long")).coalesce(few), "classes")
    regions = _ends(components(pairs_of_forest(classes, threshold))).withColumnRenamed("root", "region")
    sizes = regions.groupBy("region").agg(F.ceil(F.count("*") / CELL).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node", F.lit(11)), F.col("blocks")).cast("int")
    members = common.written(regions.join(sizes, "region").select("node", "region", "blocks", block.alias("block")).coalesce(few), "regions")

    def with_texts(rows: DataFrame) -> DataFrame:
        few = rows.count() <= BROADCAST_ROWS
        return sets.select("node", "text").join(F.broadcast(rows) if few else rows, "node").select("cell", "region", "own", "node", "text")

    packs = max(4 * common.shuffle_partitions(spark), -(-members.count() // PACK))
    cells = common.written(first_cells(members, packs), "cells")
    links = common.written(links_in_cells(with_texts(cells), size, threshold), "links")
    roots = components(links)
    # large regions in several parts: candidates between different parts are compared on their sets
    large = members.where(F.col("blocks") > BLOCKS).join(roots.select(F.col("u").alias("node"), F.col("v").alias("part")), "node", "left").select("node", "region", "block", F.coalesce("part", "node").alias("part"))
    several = large.groupBy("region").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x < y").select("region")
    torn = common.written(large.join(several, "region", "left_semi"), "torn")
    if not torn.isEmpty():
        again = classes.drop("part").join(torn.select("node", "part"), "node").select("node", "n", "part", "signature")
        pairs = common.written(pairs_of_forest(again, threshold, between=True), "pairs")
        cells = common.written(pair_cells(pairs, torn), "cells")
        packs = max(4 * common.shuffle_partitions(spark), -(-cells.count() // PACK))
        rows = cells.select("node", "region", F.pmod(F.col("region"), F.lit(packs)).cast("string").alias("cell"), "own")
        roots = components(links.unionAll(common.written(links_in_cells(with_texts(rows), size, threshold), "links")))
    return sets, classes, _ends(roots)


def _answer(sets: DataFrame, classes: DataFrame, ends: DataFrame) -> DataFrame:
    linked = classes.select("node", "id").join(ends, "node").select("node", "root", "id")
    named = linked.groupBy("root").agg(F.min("id").alias("least"))
    named = linked.select("node", "root").join(named, "root").select("node", "root", "least")
    found = classes.select("digest", "node", F.col("id").alias("own")).join(named, "node", "left")
    found = found.select("digest", F.when(F.col("root").isNull(), F.col("own")).otherwise(F.col("least")).alias("component"), F.lit(True).alias("some"))
    out = sets.select("id", "n", "digest").join(found.hint("merge"), "digest", "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("some"), F.col("component")).otherwise(F.col("id")).alias("component"))


def op7_minhash_forest(spark, sf_dir) -> DataFrame:
    """Rows without an id are kept where their whole component has none."""
    found = near_duplicates(common.table(spark, sf_dir, "documents").select("doc_id", "text"), size=3, threshold=0.85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))
