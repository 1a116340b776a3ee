"""Benchmark decontamination with SimHash windows, all in DataFrame functions.

Every item of the benchmark is compared with windows of its own number of words in every document. Similarity is that of
weighted five-word shingles: the sum of the smaller counts over the sum of the larger ones.

* A window that shares no shingle with any item has similarity 0 with all, so only windows at places that hold an item's
  shingle are built. Moving a window right to the first such place in it never loses a shared shingle, so one window for
  each place and item size is enough: it starts there, or, near the end, is the text's last window (the whole text, where
  the text is shorter). Windows with too few such places to reach the threshold are left out. Places travel as numbers;
  words are cut out of the few documents that have a window, once.
* Windows and items get 64-bit SimHash fingerprints of their shingles, a repeated shingle's occurrences being numbered, so
  that fingerprints measure the very sets that similarity compares.
* Fingerprints are cut into 8 blocks. If two differ in at most ``RADIUS`` = 23 bits, some block differs in at most 2; the
  items' blocks are indexed with all values within 2 bits, so an equality join on (size, block, value) finds every window
  within the radius of an item of its size. The rest of the pairs goes by the count of differing bits.
* Each remaining pair's similarity is computed exactly.

At similarity 0.8 two fingerprints differ in 9.7 bits on average (an angle of arccos 8/9), with a standard deviation of
about 2.9, so the radius loses a few pairs in a million at the very edge, fewer above it.

Words are runs of anything but ASCII white space, lower-cased. Items of under five words are no evidence and match
nothing; all other items count, however long. Null texts have no words; rows that repeat an id keep apart by their text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE, THRESHOLD, RADIUS = 5, 0.8, 23
#: All changes of at most two bits of a byte.
NEAR = [0, *(1 << i for i in range(8)), *(1 << i | 1 << j for i in range(8) for j in range(i))]
#: A benchmark of up to so many shingles is broadcast (24 bytes each), and a bit mask of it picks places before the
#: join; a larger one is joined by a shuffle.
BROADCAST_SHINGLES, MASK_BITS = 500_000, 20
#: Other tables are broadcast up to so many bytes, counted before.
BROADCAST_BYTES = 16 << 20


def _hashes(text: Column) -> Column:
    return F.transform(common.words(F.lower(text)), lambda w: F.xxhash64(w))


def _shingles(h: Column) -> Column:
    at = F.when(F.size(h) >= SHINGLE, F.sequence(F.lit(0), F.size(h) - SHINGLE)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(SHINGLE)]))


def _numbered(s: Column) -> Column:
    """Shingles as a set: each occurrence is hashed with its number among those of its shingle."""
    order = F.array_sort(s)
    again = F.transform(order, lambda x, i: F.xxhash64(x, i + 1 - F.array_position(order, x).cast("int")))
    first = F.transform(s, lambda x: F.xxhash64(x, F.lit(0)))
    return F.when(F.size(F.array_distinct(s)) == F.size(s), first).otherwise(again)


def simhash(h: Column) -> Column:
    """64-bit SimHash of an array of hashes, each weighing one: bits set in more than half of them.

    Bits are counted several in one long: in eight lanes of 8 bits, or fewer and wider ones where the hashes are too many.
    """

    def counted(width: int) -> Column:
        lanes = sum(1 << k for k in range(0, 64, width))
        half = 1 << width - 2
        over = F.lit(lanes) * (F.lit(half - 1).cast("long") - F.floor(F.size(h) / 2))

        def part(j: int) -> Column:
            sums = F.aggregate(h, F.lit(0).cast("long"), lambda a, x: a + F.shiftrightunsigned(x, j).bitwiseAND(F.lit(lanes)))
            return F.shiftleft(F.shiftrightunsigned(sums + over, width - 2).bitwiseAND(F.lit(lanes)), j)

        return reduce(lambda a, b: a.bitwiseOR(b), map(part, range(width)))

    return F.when(F.size(h) < 1 << 6, counted(8)).when(F.size(h) < 1 << 14, counted(16)).otherwise(counted(32))


def _blocks(f: Column) -> Column:
    return F.array(*[F.struct(F.lit(b).alias("block"), F.shiftrightunsigned(f, 8 * b).bitwiseAND(F.lit(255)).cast("int").alias("value")) for b in range(8)])


def prepared(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, words, shingles, numbered, fingerprint) of items with a shingle."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item"), _hashes(F.col(text_col)).alias("h")).where(F.size("h") >= SHINGLE)
    items = items.select("item", F.size("h").alias("words"), _shingles(F.col("h")).alias("shingles")).withColumn("numbered", _numbered(F.col("shingles")))
    return items.withColumn("fingerprint", F.coalesce(simhash(F.col("numbered")), F.lit(0)))


def _mask(keys: DataFrame) -> tuple[list[int], int] | None:
    """Bits set at the low bits of every key, as longs; None beyond ``BROADCAST_SHINGLES``."""
    n = keys.count()
    if n > BROADCAST_SHINGLES:
        return None
    bits = min(MASK_BITS, max(10, (16 * n).bit_length()))
    longs = [0] * (1 << bits - 6)
    for r in keys.select(F.col("s").bitwiseAND(F.lit((1 << bits) - 1)).alias("b")).distinct().collect():
        longs[r["b"] >> 6] |= 1 << (r["b"] & 63)
    return [x - (1 << 64) if x >> 63 else x for x in longs], bits


def _small(df: DataFrame, size: Column | int) -> DataFrame:
    """``df``, to be broadcast if its rows of ``size`` bytes have at most ``BROADCAST_BYTES`` altogether."""
    total = df.agg(F.sum(size if isinstance(size, Column) else F.lit(size))).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def places(docs: DataFrame, items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_hash, windows): for each text with an item's shingle, (words, start) of the windows to look at."""
    keys = items.select(F.explode("shingles").alias("s"), "words").distinct()
    mask = _mask(keys)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(common.NULL_ID)).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), _hashes(F.col(text_col)).alias("h"))
    # each step is a column of its own, and none is filtered by: else Spark works the steps before it out again
    rows = rows.select("id", "text_hash", F.size("h").alias("n"), _shingles(F.col("h")).alias("s"))
    at = F.when(F.size("s") > 0, F.sequence(F.lit(0), F.size("s") - 1)).otherwise(F.array().cast("array<int>"))
    if mask is not None:
        longs, bits = F.lit(mask[0]), mask[1]
        low = lambda x: x.bitwiseAND(F.lit((1 << bits) - 1))
        there = lambda x: F.getbit(F.get(longs, F.shiftright(low(x), 6).cast("int")), low(x).bitwiseAND(F.lit(63)).cast("int")) == 1
        at = F.filter(at, lambda p: there(F.get(F.col("s"), p)))
    found = F.transform(at, lambda p: F.struct(p.alias("p"), F.get(F.col("s"), p).alias("s")))
    hits = rows.select("id", "text_hash", "n", F.explode(found).alias("x")).select("id", "text_hash", "n", "x.p", "x.s")
    side = keys.select(F.col("s").alias("k"), "words")
    hits = hits.join(F.broadcast(side) if mask is not None else side, F.col("s") == F.col("k"))
    at = hits.groupBy("id", "text_hash", "words").agg(F.max("n").alias("n"), F.array_sort(F.collect_set("p")).alias("p"))
    # a match shares so many of the window's shingles with one item that so many places of the window must hold one
    last = F.greatest(F.lit(0), F.col("n") - F.col("words"))
    length = F.least("n", "words") - (SHINGLE - 1)
    least = F.ceil(THRESHOLD / (1 + THRESHOLD) * (length + F.col("words") - (SHINGLE - 1)) - 1e-6).cast("int")
    at = at.select("id", "text_hash", "words", "p", last.alias("last"), length.alias("length"), least.alias("least"))
    inside = F.filter("p", lambda p, i: (p < F.col("last")) & (F.coalesce(F.get("p", i + F.col("least") - 1), F.lit(2**31 - 1)) < p + F.col("length")))
    end = F.when(F.size(F.filter("p", lambda p: p >= F.col("last"))) >= F.col("least"), F.array("last")).otherwise(F.array().cast("array<int>"))
    at = at.select("id", "text_hash", "words", F.explode(F.concat(inside, end)).alias("start"))
    return at.groupBy("id", "text_hash").agg(F.collect_list(F.struct("words", "start")).alias("windows"))


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, text_hash, item, similarity): each document's best window for each item that it matches."""
    items = common.written(prepared(benchmark, item_col, item_text), "items")
    wanted = common.written(places(docs, items, id_col, text_col).withColumnsRenamed({"id": "i", "text_hash": "t"}), "places")
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(common.NULL_ID)).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    texts = texts.join(_small(wanted, 48 + 24 * F.size("windows")), (F.col("id") == F.col("i")) & (F.col("text_hash") == F.col("t")))
    texts = texts.select("id", "text_hash", _hashes(F.col("text")).alias("h"), "windows")
    cut = F.transform("windows", lambda w: F.struct(w["words"].alias("words"), F.slice("h", w["start"] + 1, F.least(w["words"], F.size("h"))).alias("h")))
    windows = texts.select("id", "text_hash", F.explode(cut).alias("x")).select("id", "text_hash", "x.words", _shingles(F.col("x.h")).alias("s"))
    windows = windows.select("id", "text_hash", "words", F.coalesce(_numbered(F.col("s")), F.array().cast("array<long>")).alias("a"))
    windows = windows.select("id", "text_hash", "words", "a", F.coalesce(simhash(F.col("a")), F.lit(0)).alias("f"))
    index = items.select("item", "words", "fingerprint", F.explode(_blocks(F.col("fingerprint"))).alias("b")).select(
        F.col("words").alias("w"), "item", "fingerprint", F.col("b.block").alias("ib"), F.explode(F.transform(F.lit(NEAR), lambda m: F.col("b.value").bitwiseXOR(m))).alias("iv"))
    keyed = windows.select("*", F.explode(_blocks(F.col("f"))).alias("b"))
    # the first of the blocks that are near stands for all: a pair is looked at once
    differ = F.col("f").bitwiseXOR(F.col("fingerprint"))
    nearest = F.coalesce(*[F.when(F.bit_count(F.shiftrightunsigned(differ, 8 * b).bitwiseAND(F.lit(255))) <= 2, F.lit(b)) for b in range(8)])
    pairs = keyed.join(_small(index, 64), (F.col("words") == F.col("w")) & (F.col("b.block") == F.col("ib")) & (F.col("b.value") == F.col("iv")))
    pairs = pairs.where((F.bit_count(differ) <= RADIUS) & (F.col("ib") == nearest)).select("id", "text_hash", "item", "a")
    sets = items.select(F.col("item").alias("of"), F.col("numbered").alias("b"))
    pairs = pairs.join(_small(sets, 32 + 8 * F.size("b")), F.col("item") == F.col("of"))
    both = F.size(F.array_intersect("a", "b"))
    scored = pairs.select("id", "text_hash", "item", (both / (F.size("a") + F.size("b") - both)).alias("similarity"))
    return scored.where(F.col("similarity") >= THRESHOLD).groupBy("id", "text_hash", "item").agg(F.max("similarity").alias("similarity"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that match no item."""
    i, t = common.unused(docs, "bad_id"), common.unused(docs, "bad_text")
    bad = matches(docs, benchmark, id_col, text_col).select(F.col("id").alias(i), F.col("text_hash").alias(t)).distinct()
    same = (F.coalesce(F.col(id_col).cast("long"), F.lit(common.NULL_ID)) == F.col(i)) & (F.xxhash64(F.col(text_col)) == F.col(t))
    return docs.join(bad, same, "left_anti")


def op5_decontaminate(spark, sf_dir) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = matches(docs, common.table(spark, sf_dir, "benchmark"))
    best = found.groupBy("id", "text_hash").agg(F.array_sort(F.collect_list("item")).alias("items"), F.max("similarity").alias("similarity"))
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(common.NULL_ID)).alias("id"), F.xxhash64("text").alias("text_hash"))
    out = rows.join(best, ["id", "text_hash"], "left")
    return out.select(
        "doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce(F.array_join("items", ","), F.lit("")).alias("items"), F.coalesce(F.round("similarity", 6), F.lit(0.0)).alias("similarity"),
    )
