"""Interval algebra: masks as rows of half-open spans (key columns, s, e).

Everything is windows, equality joins on (key, bucket) and aggregates; no pixel is ever a row of its own unless a caller
asks for it, and no plan has a range join without an equality key. Empty spans (s >= e) and null bounds count as absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _by(keys: list[str]):
    return Window.partitionBy(*keys)


def present(spans: DataFrame) -> DataFrame:
    return spans.where("s < e")


def union(spans: DataFrame, keys: list[str], reach: int = 0) -> DataFrame:
    """Disjoint spans of the union by key; spans up to ``reach`` apart are joined as well."""
    ahead = F.max("e").over(_by(keys).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1))
    islands = present(spans).select(*keys, "s", "e").withColumn("new", F.when(ahead + reach >= F.col("s"), 0).otherwise(1))
    islands = islands.withColumn("island", F.sum("new").over(_by(keys).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).select(*keys, "s", "e")


def _cut(spans: DataFrame, keys: list[str], bucket: int) -> DataFrame:
    """Spans cut at bucket edges, so that a pair of spans meets in a bucket at most once for each piece."""
    first, last = F.floor(F.col("s") / bucket), F.floor((F.col("e") - 1) / bucket)
    cut = present(spans).withColumn("bucket", F.explode(F.sequence(first, last)))
    return cut.withColumn("s", F.greatest(F.col("s"), F.col("bucket") * bucket)).withColumn("e", F.least(F.col("e"), (F.col("bucket") + 1) * bucket))


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], left_ids: list[str], right_ids: list[str], bucket: int = 4096) -> DataFrame:
    """(keys, left_ids, right_ids, inter): the common length of each pair that has any."""
    a, b = _cut(left, keys, bucket), _cut(right, keys, bucket).withColumnsRenamed({"s": "rs", "e": "re"})
    pairs = a.join(b.hint("merge"), [*keys, "bucket"]).where("s < re and rs < e")  # never collected on the driver: cuts and copies of a small file are many rows
    return pairs.groupBy(*keys, *left_ids, *right_ids).agg(F.sum(F.least("e", "re") - F.greatest("s", "rs")).alias("inter"))


def intersection(left: DataFrame, right: DataFrame, keys: list[str], bucket: int = 4096) -> DataFrame:
    """Spans of the intersection by key, disjoint."""
    a, b = _cut(union(left, keys), keys, bucket), _cut(union(right, keys), keys, bucket).withColumnsRenamed({"s": "rs", "e": "re"})
    parts = a.join(b, [*keys, "bucket"]).where("s < re and rs < e")
    return union(parts.select(*keys, F.greatest("s", "rs").alias("s"), F.least("e", "re").alias("e")), keys)


def complement(spans: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """Spans of each frame (keys, size) that no span covers; spans of keys without a frame count for nothing.

    One sweep: a frame is a span of no length at its end, and a gap lies before each span that begins beyond all ends so far.
    """
    one = lambda df, s, e, size: df.select(*keys, s.cast("long").alias("s"), e.cast("long").alias("e"), size.cast("long").alias("size"))
    both = one(present(spans), F.col("s"), F.col("e"), F.lit(None)).unionByName(one(frames, F.col("size"), F.col("size"), F.col("size")))
    order = _by(keys).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.greatest(F.coalesce(F.max("e").over(order), F.lit(0)), F.lit(0))
    swept = both.withColumn("ahead", ahead).withColumn("side", F.max("size").over(_by(keys)))
    return swept.where("side is not null").select(*keys, F.col("ahead").alias("s"), F.least("s", "side").alias("e")).where("s < e")


def area(spans: DataFrame, keys: list[str]) -> DataFrame:
    return present(spans).groupBy(*keys).agg(F.sum(F.col("e") - F.col("s")).cast("long").alias("area"))


def overlapping(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Keys any two spans of which overlap, by a sweep over starts (not a self-join)."""
    ahead = F.max("e").over(_by(keys).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1))
    return present(spans).withColumn("ahead", ahead).groupBy(*keys).agg(F.coalesce(F.max(F.col("ahead") > F.col("s")), F.lit(False)).alias("overlaps")).where("overlaps").drop("overlaps")


def depth(spans: DataFrame, keys: list[str]) -> DataFrame:
    """The step function of how many spans cover a place: (keys, s, e, depth) where any does."""
    edges = present(spans).select(*keys, F.explode(F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("d")), F.struct(F.col("e").alias("at"), F.lit(-1).alias("d")))).alias("x"))
    steps = edges.groupBy(*keys, F.col("x.at").alias("s")).agg(F.sum("x.d").alias("d"))
    order = _by(keys).orderBy("s")
    swept = steps.withColumn("depth", F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("e", F.lead("s").over(order))
    return swept.where("depth > 0 and e is not null").select(*keys, "s", "e", "depth")


def soft_target(spans: DataFrame, raters: DataFrame, keys: list[str], rater: str) -> DataFrame:
    """Share of raters whose union covers a place; raters without a span count, so ``raters`` lists (keys, rater)."""
    count = raters.groupBy(*keys).agg(F.count_distinct(rater).alias("raters"))
    steps = depth(union(spans, [*keys, rater]), keys)
    return steps.join(count, keys).select(*keys, "s", "e", (F.col("depth") / F.greatest(F.col("raters"), F.lit(1))).alias("share"))


def runs(bits: DataFrame, keys: list[str], at: str, bit: Column) -> DataFrame:
    """Run-length encoding of a 0/1 sequence given as rows: spans of ones, by gaps and islands."""
    order = _by(keys).orderBy("at")
    rows = bits.where(bit).select(*keys, F.col(at).alias("at")).withColumn("island", F.col("at") - F.row_number().over(order))
    return rows.groupBy(*keys, "island").agg(F.min("at").alias("s"), (F.max("at") + 1).alias("e")).select(*keys, "s", "e")


def by_column(spans: DataFrame, height: Column) -> DataFrame:
    """Column-major spans cut at column ends: adds x, and y0, y1 inside the column."""
    cut = present(spans).withColumn("x", F.explode(F.sequence(F.floor(F.col("s") / height), F.floor((F.col("e") - 1) / height))))
    y0, y1 = F.greatest(F.col("s") - F.col("x") * height, F.lit(0)), F.least(F.col("e") - F.col("x") * height, height)
    return cut.withColumn("y0", y0).withColumn("y1", y1)


def boxes(spans: DataFrame, keys: list[str], height: Column) -> DataFrame:
    """Area and tight box of each key's mask."""
    cut = by_column(spans, height)
    return cut.groupBy(*keys).agg(F.sum(F.col("y1") - F.col("y0")).cast("long").alias("area"), F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y0").alias("y_min"), (F.max("y1") - 1).alias("y_max"))


def dilate(spans: DataFrame, keys: list[str], height: int, width: int, reach: int) -> DataFrame:
    """Spans grown by an elliptic kernel of side 2 * reach + 1: each column's span moves by every kernel column, then merges."""
    if reach <= 0:
        return union(spans, keys)
    kernel = [(dx, half) for dx, half in ellipse(reach)]
    steps = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(half).alias("half")) for dx, half in kernel])).alias("__k")
    moved = by_column(spans, F.lit(height)).select(*keys, "x", "y0", "y1", steps).where(f"x + __k.dx >= 0 and x + __k.dx < {width}")
    x = F.col("x") + F.col("__k.dx")
    return union(moved.select(*keys, (x * height + F.greatest(F.col("y0") - F.col("__k.half"), F.lit(0))).alias("s"), (x * height + F.least(F.col("y1") + F.col("__k.half"), F.lit(height))).alias("e")), keys)


def ellipse(reach: int) -> list[tuple[int, int]]:
    """Column offset and half height of an elliptic kernel of side 2 * reach + 1.

    The kernel is made row by row: half a row's width is sqrt(reach**2 - dy**2), rounded. A column holds the rows that reach it.
    """
    width = [round((reach * reach - dy * dy) ** 0.5) for dy in range(reach + 1)]
    return [(dx, max(dy for dy in range(reach + 1) if width[dy] >= abs(dx))) for dx in range(-reach, reach + 1)]
