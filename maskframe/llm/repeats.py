"""Distributed search for windows of a text that also start in a text with a smaller id.

The exact question, for bytes or words: which windows of W consecutive units of a document occur, anywhere, in a
document with a smaller id? Comparing all windows would shuffle the corpus W times over, so windows are first *routed*:

* Every window picks the leftmost smallest hash of its grams (a minimizer). Equal windows pick equal grams, so all
  occurrences of one window meet in the bucket of that gram. Consecutive windows with one pick form a *context*.
* Equal contexts (copies, however many) are collapsed to the smallest id per document group before they are shuffled. With
  ``compare_copies`` two of them are compared below, the smallest id's and the next one's, and what is found for the next
  one holds for all after it; else equal contexts are settled at once, by the smallest id. A context is known by 80 bits
  of the xxh3 hash of its bytes (or of its words' 128-bit hashes), besides its gram's 32.
* Where a gram occurs in several different contexts that agree on one side of it for half of what a window holds
  besides the gram (else no window can be in both), the contexts' bytes themselves go to a *shard* with the bucket, and
  the operator's own method (suffix arrays, or relative Lempel-Ziv parsing) decides every window there, on bytes or on
  whole words.

Documents are hashed into groups by id and text, so that null or repeated ids make no large group; each step's answers
travel back to the group as bit masks in the order in which the group lists its contexts, which depends on nothing but the
group's rows. So a recomputed task gives the same order.
The document exchange is one and the same in all three passes, and Spark reuses it.

Null ids count as larger than any other; rows with equal ids never remove anything from each other; null texts are
empty; a text shorter than a window has none.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, kernels

#: Windows are looked at in tiles of this many, so that a very long text needs bounded working memory.
TILE = 1 << 19
_TILE_BITS = np.uint64((1 << 20) - 1)
ENTRY = np.dtype([("gram", "<u4"), ("context", "<u8"), ("more", "<u2"), ("left", "<u2"), ("right", "<u2")])
META = np.dtype([("entry", "<u4"), ("units", "<u4"), ("id", "<i8")])


def contexts(units: np.ndarray, start: np.ndarray, end: np.ndarray, window: int, gram: int) -> dict[str, np.ndarray]:
    """The contexts of a batch of texts: gram hash, hashes of both sides, text, first and last window start, by position."""
    found = []
    k, n = 0, len(start)
    while k < n:
        stop = max(k + 1, int(np.searchsorted(end, start[k] + TILE, "right")))
        if end[stop - 1] - start[k] <= TILE:
            found.append(_contexts(units, int(start[k]), int(end[stop - 1]), start[k:stop], end[k:stop], k, window, gram))
        else:  # one long text, by tiles that overlap by a window less one
            for at in range(int(start[k]), int(end[k]) - window + 1, TILE):
                to = min(at + TILE + window - 1, int(end[k]))
                found.append(_contexts(units, at, to, np.array([at]), np.array([to]), k, window, gram))
        k = stop
    if not found:
        found = [_nothing()]
    return {c: np.concatenate([f[c] for f in found]) for c in found[0]}


def _nothing() -> dict[str, np.ndarray]:
    kinds = {"gram": np.uint64, "left": np.uint16, "right": np.uint16, "text": np.int64, "first": np.int64, "last": np.int64}
    return {c: np.zeros(0, kind) for c, kind in kinds.items()}


def _contexts(units, lo, hi, start, end, base, window, gram):
    if hi - lo < window:
        return _nothing()
    p = kernels.prefixes(units[lo:hi])
    inverse = kernels.powers(len(p))[1]
    grams = kernels.mix((p[gram:] - p[:-gram]) * inverse[: len(p) - gram])
    key = (grams & ~_TILE_BITS) | np.arange(len(grams), dtype=np.uint64)
    pick = (kernels.sliding_min(key, window - gram + 1) & _TILE_BITS).astype(np.int64)
    step = np.zeros(hi - lo + 1, np.int32)
    long = end - start >= window
    np.add.at(step, start[long] - lo, 1)
    np.add.at(step, end[long] - window + 1 - lo, -1)
    at = np.flatnonzero(np.cumsum(step[: len(pick)]) > 0)
    if not len(at):
        return _nothing()
    picked = pick[at]
    new = np.flatnonzero(np.concatenate(([True], (picked[1:] != picked[:-1]) | (at[1:] != at[:-1] + 1))))
    first, last, anchor = at[new], at[np.append(new[1:], len(at)) - 1], picked[new]
    # a window reaches far enough to the left of its gram, or to the right: hashes of either side, 0 where the context ends before
    side = -(-(window - gram) // 2)
    a, b = np.maximum(anchor - side, 0), np.minimum(anchor + gram + side, len(p) - 1)
    left = np.where(anchor - side >= first, kernels.mix((p[anchor] - p[a]) * inverse[a]) >> np.uint64(48) | np.uint64(1), np.uint64(0)).astype(np.uint16)
    right = np.where(anchor + gram + side <= last + window, kernels.mix((p[b] - p[anchor]) * inverse[anchor]) >> np.uint64(48) | np.uint64(1), np.uint64(0)).astype(np.uint16)
    return {"gram": grams[anchor], "left": left, "right": right, "text": base + np.searchsorted(start, first + lo, "right") - 1, "first": first + lo, "last": last + lo}


class Group:
    """One document group: its texts in a fixed order, their units, and the distinct contexts, by bucket."""

    def __init__(self, data: pa.Table, spec: dict):
        ids = data.column("id").fill_null(common.NULL_ID).to_numpy()
        text = data.column("text").cast(pa.large_binary())
        order = np.argsort(ids, kind="stable")
        same = ids[order][1:] == ids[order][:-1]
        if same.any():  # equal ids: by text, so that the order doesn't depend on how rows arrive
            order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], text[i].as_py() or b"")), np.int64)
        self.data = data.take(pa.array(order))
        self.ids = ids[order]
        self.bytes, self.start, self.end = kernels.texts(self.data.column("text").cast(pa.large_binary()))
        self.window = spec["window"]
        if spec["unit"] == "byte":
            self.unit_start, self.unit_end = self.start, self.end
            self.value = None
            units = _Lazy(self.bytes)
        else:
            self.word_start, self.word_end, self.value, self.unit_start, self.unit_end = kernels.word_hashes(self.bytes, self.start, self.end)
            units = self.value[:, 0]
        c = contexts(units, self.unit_start, self.unit_end, self.window, spec["gram"])
        whole = kernels.slice_digests(self.bytes if self.value is None else self.value, c["first"], c["last"] + self.window)
        c["context"], c["more"] = whole[:, 0], whole[:, 1].astype(np.uint16)
        # distinct (gram, context), each with the smallest id: texts come by id, so the first occurrence has it
        order = np.lexsort((c["more"], c["context"]))
        x, y = c["context"][order], c["more"][order]
        new = np.concatenate(([True], (y[1:] != y[:-1]) | (x[1:] != x[:-1]))) if len(order) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        rep = np.minimum.reduceat(order, at) if len(at) else at
        number = np.cumsum(new) - 1
        self.entry_of = np.empty(len(order), np.int64)
        bucket = (c["gram"][rep] % np.uint64(spec["buckets"])).astype(np.int64)
        by = np.lexsort((rep, bucket))
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        self.entry_of[order] = place[number]
        self.rep, self.bucket = rep[by], bucket[by]
        self.c = c
        self.buckets, self.bucket_at = np.unique(self.bucket, return_index=True)

    def entries(self) -> np.ndarray:
        out = np.empty(len(self.rep), ENTRY)
        for name in ("context", "more", "left", "right"):
            out[name] = self.c[name][self.rep]
        out["gram"] = self.c["gram"][self.rep] >> np.uint64(32)
        return out

    def holders(self) -> list[bytes]:
        """The entries' ids by bucket. Entries come by id, so steps from one to the next are small numbers."""
        ids = self.ids[self.c["text"][self.rep]]
        edge = np.append(self.bucket_at, len(ids))
        return [_steps(ids[a:b]) for a, b in zip(edge[:-1], edge[1:], strict=True)]

    def masks(self, rows: list[tuple[int, bytes]]) -> np.ndarray:
        """The entries' bits, from (bucket, packed bits) in any order."""
        bits, size = np.zeros(len(self.rep), bool), np.append(self.bucket_at[1:], len(self.rep)) - self.bucket_at
        for b, packed in rows:
            k = int(np.searchsorted(self.buckets, b))
            a, n = int(self.bucket_at[k]), int(size[k])
            bits[a : a + n] = np.unpackbits(np.frombuffer(packed, np.uint8), count=n).view(bool)
        return bits

    def bytes_of(self, k: int) -> bytes:
        """A context's bytes; one of words ends with a blank."""
        a, b = int(self.c["first"][k]), int(self.c["last"][k]) + self.window
        if self.value is None:
            return self.bytes[a:b].tobytes()
        return self.bytes[self.word_start[a] : self.word_end[b - 1]].tobytes() + b" "


class _Lazy:
    """Bytes that become unit values a slice at a time."""

    def __init__(self, data):
        self.data = data

    def __getitem__(self, s):
        return kernels.byte_units(self.data[s])


def _binary(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def _steps(ids: np.ndarray) -> bytes:
    """Ascending ids as the first one and the steps from there, in the narrowest type that holds them."""
    step = np.diff(ids.astype(np.int64).view(np.uint64))
    width = next(w for w in (1, 2, 4, 8) if int(step.max(initial=0)) < 1 << 8 * w)
    return ids[:1].astype("<i8").tobytes() + bytes([width]) + step.astype(f"<u{width}").tobytes()


def _ids(blob: bytes) -> np.ndarray:
    return np.cumsum(np.concatenate((np.frombuffer(blob[:8], "<u8"), np.frombuffer(blob[9:], f"<u{blob[8]}").astype(np.uint64))), dtype=np.uint64).view(np.int64)


def _decide(table: pa.Table, compare_copies: bool) -> pa.Table:
    """In a bucket: which entries occur in a smaller id, and which must be compared unit by unit."""
    blobs = table.column("entries").to_pylist()
    sizes = np.array([len(b) // ENTRY.itemsize for b in blobs])
    e = np.frombuffer(b"".join(blobs), ENTRY)
    ids = np.concatenate([_ids(b) for b in table.column("ids").to_pylist()])
    order = np.lexsort((ids, e["more"], e["context"], e["gram"]))
    g, x, y, d = e["gram"][order], e["context"][order], e["more"][order], ids[order]
    new_g = np.concatenate(([True], g[1:] != g[:-1]))
    new = new_g | np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
    least = d[new]  # the smallest id of each context
    number = np.cumsum(new) - 1
    later = np.flatnonzero(least[number] < d)
    several, second = np.unique(number[later], return_index=True)
    copy, open_ = np.zeros(len(e), bool), np.zeros(len(e), bool)
    copy[order[later]] = True
    if compare_copies:  # the second id's context shows its units too and is compared; the others after it are copies of that
        copy[order[later[second]]] = False
        open_[order[later[second]]] = True
    # contexts of one gram: with several of them, and ids that differ, each one's first holder shows its units, in every group that has it
    at = np.flatnonzero(new)
    gram_at = np.flatnonzero(new_g[at])
    many = np.diff(np.append(gram_at, len(at))) > 1
    differ = np.minimum.reduceat(least, gram_at) != np.maximum.reduceat(least, gram_at)
    maybe = np.flatnonzero(np.repeat(many & differ, np.diff(np.append(gram_at, len(at)))))
    rep, near = order[at[maybe]], np.zeros(len(maybe), bool)
    for side in ("left", "right"):  # a window in two contexts of a gram needs an equal side
        x, y = e["gram"][rep], e[side][rep]
        by = np.lexsort((y, x))
        same = (x[by][1:] == x[by][:-1]) & (y[by][1:] == y[by][:-1]) & (y[by][1:] != 0)
        near[by[1:][same]] = near[by[:-1][same]] = True
    shown = np.zeros(len(at), bool)
    shown[maybe[near]] = True
    if compare_copies:
        shown[several] = True
    open_[order[(least[number] == d) & shown[number]]] = True
    edge = np.append(0, np.cumsum(sizes))
    cut = list(zip(edge[:-1], edge[1:], strict=True))
    return pa.table({
        "g": table.column("g"), "bucket": table.column("bucket"),
        "copies": _binary([np.packbits(copy[a:b]).tobytes() for a, b in cut]),
        "open": _binary([np.packbits(open_[a:b]).tobytes() for a, b in cut]),
    })


def repeats(docs: DataFrame, id_col: str, text_col: str, *, unit: str, window: int, gram: int, resolve: Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray], group_bytes: int = 4 << 20, whole_characters: bool = False, compare_copies: bool = False) -> DataFrame:
    """For each row of ``docs``: ``row`` (its columns but the text), ``n_units``, ``spans`` (removed runs of units) and ``kept`` bytes.

    ``resolve(units, sizes, ids, window)`` gets the contexts of a shard, one after another, and returns for each
    window start of each context whether that window also starts in a context of a smaller id.
    Kept words are joined by one space; kept bytes are concatenated, with ``whole_characters`` without those of characters
    that were cut apart.
    """
    from pyspark.sql import types as T

    n = common.group_count(docs, text_col, group_bytes)
    spec = {"unit": unit, "window": window, "gram": gram, "buckets": n}
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(
        F.pmod(F.xxhash64(F.col(id_col).cast("long"), F.col(text_col), F.lit(7)), F.lit(n)).cast("int").alias("g"),
        F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), (F.struct(*others) if others else F.lit(None).cast("int")).alias("row"),
    )

    def listed(table: pa.Table) -> pa.Table:
        group = Group(table, spec)
        values = kernels.packed(group.entries(), group.bucket_at)
        kernels.settle()
        return pa.table({"g": pa.array(np.full(len(group.buckets), table.column("g")[0].as_py()), pa.int32()), "bucket": pa.array(group.buckets, pa.int32()), "entries": values, "ids": _binary(group.holders())})

    def opened(left: pa.Table, right: pa.Table) -> pa.Table:
        """Contexts to compare, by bucket; and the copies' bits, which only pass through."""
        g, out = left.column("g")[0].as_py() if left.num_rows else right.column("g")[0].as_py(), []
        group = Group(left, spec)
        got = list(zip(*(right.column(c).to_pylist() for c in ("bucket", "copies", "open")), strict=True))
        copies = group.masks([(b, c) for b, c, _ in got])
        open_ = np.flatnonzero(group.masks([(b, o) for b, _, o in got]))
        for b in np.unique(group.bucket[open_]):
            k = open_[group.bucket[open_] == b]
            reps = group.rep[k]
            meta = np.empty(len(k), META)
            meta["entry"], meta["units"], meta["id"] = k, group.c["last"][reps] + window - group.c["first"][reps], group.ids[group.c["text"][reps]]
            out.append((g, int(b), meta.tobytes(), b"".join(map(group.bytes_of, reps))))
        out.append((g, -1 - g, np.packbits(copies).tobytes(), b""))
        kernels.settle()
        return pa.table({"g": pa.array([o[0] for o in out], pa.int32()), "bucket": pa.array([o[1] for o in out], pa.int32()), "meta": _binary([o[2] for o in out]), "units": _binary([o[3] for o in out])})

    def compared(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            return table
        metas = [np.frombuffer(m, META) for m in table.column("meta").to_pylist()]
        units = b"".join(table.column("units").to_pylist())
        units = np.frombuffer(units, np.uint8) if unit == "byte" else numbered(units.split())
        meta = np.concatenate(metas)
        hit = resolve(units, meta["units"].astype(np.int64), meta["id"], window)
        starts = np.append(0, np.cumsum(meta["units"].astype(np.int64) - window + 1))
        at, bits = 0, []
        for m in metas:
            bits.append(np.packbits(hit[starts[at] : starts[at + len(m)]]).tobytes())
            at += len(m)
        kernels.settle()
        return table.set_column(3, "units", _binary(bits))

    def removed(left: pa.Table, right: pa.Table) -> pa.Table:
        group = Group(left, spec)
        cover = np.zeros(len(group.bytes if unit == "byte" else group.value) + 1, np.int32)
        c, entry_of = group.c, group.entry_of
        mine = group.ids[c["text"]]
        copies = np.zeros(len(group.rep), bool)
        starts, hits = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for b, meta, bits in zip(*(right.column(x).to_pylist() for x in ("bucket", "meta", "units")), strict=True):
            if b < 0:
                copies = np.unpackbits(np.frombuffer(meta, np.uint8), count=len(group.rep)).view(bool)
                continue
            m = np.frombuffer(meta, META)
            size = m["units"].astype(np.int64) - window + 1
            hit = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), count=int(size.sum())))
            which = np.searchsorted(np.cumsum(size), hit, "right")
            hits.append(m["entry"][which].astype(np.int64))
            starts.append(c["first"][group.rep[m["entry"][which]]] + hit - (np.cumsum(size) - size)[which])
        whole = copies[entry_of] | (mine > group.ids[c["text"][group.rep]][entry_of])
        np.add.at(cover, c["first"][whole], 1)
        np.add.at(cover, c["last"][whole] + window, -1)
        s = np.concatenate(starts)
        # contexts that repeat inside the smallest id's own texts share its compared windows
        found = np.zeros(len(group.rep), bool)
        found[np.concatenate(hits)] = True
        again = np.flatnonzero(found[entry_of] & ~whole & (group.rep[entry_of] != np.arange(len(entry_of))))
        if len(again) and len(s):
            s = np.concatenate([s, _shared(c, group.rep, entry_of, again, s)])
        np.add.at(cover, s, 1)
        np.add.at(cover, s + window, -1)
        gone = np.cumsum(cover[:-1]) > 0
        spans, kept = [], []
        for k in range(len(group.ids)):
            a, b = int(group.unit_start[k]), int(group.unit_end[k])
            lo, hi = runs_of(gone, a, b)
            spans.append([{"start": int(x), "end": int(y)} for x, y in zip(lo, hi, strict=True)])
            if unit == "byte":
                text = group.bytes[a:b]
                text = text[~gone[a:b]].tobytes() if len(lo) else text.tobytes()
                kept.append(text.decode("utf-8", "ignore").encode() if whole_characters and len(lo) else text)
            else:
                text = group.bytes[group.start[k] : group.end[k]].tobytes().split()
                kept.append(b" ".join(w for w, x in zip(text, gone[a:b], strict=True) if not x) if len(lo) else b" ".join(text))
        kernels.settle()
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({"row": group.data.column("row"), "n_units": pa.array(group.unit_end - group.unit_start, pa.int64()), "spans": pa.array(spans, kind), "kept": _binary(kept)})

    listing = rows.groupBy("g").applyInArrow(listed, "g int, bucket int, entries binary, ids binary")
    marks = listing.groupBy("bucket").applyInArrow(lambda t: _decide(t, compare_copies), "g int, bucket int, copies binary, open binary")
    shown = rows.groupBy("g").cogroup(marks.groupBy("g")).applyInArrow(opened, "g int, bucket int, meta binary, units binary")
    settled = shown.groupBy("bucket").applyInArrow(compared, "g int, bucket int, meta binary, units binary")
    schema = T.StructType([
        T.StructField("row", rows.schema["row"].dataType), T.StructField("n_units", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.BinaryType()),
    ])
    return rows.groupBy("g").cogroup(settled.groupBy("g")).applyInArrow(removed, schema)


def numbered(words: list[bytes]) -> np.ndarray:
    """Each word's number: equal words, and only those, have the same."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def runs_of(gone: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    part = gone[a:b]
    if not part.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return kernels.runs(part)


def _shared(c, rep, entry_of, again, starts):
    """Compared windows of an entry's first context, moved to its other contexts in the same id."""
    order = np.sort(starts)
    out = []
    for k in again:
        r = rep[entry_of[k]]
        a, b = np.searchsorted(order, c["first"][r]), np.searchsorted(order, c["last"][r], "right")
        out.append(order[a:b] - c["first"][r] + c["first"][k])
    return np.concatenate(out) if out else np.zeros(0, np.int64)
