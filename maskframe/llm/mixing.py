"""Mix sources to target weights with an exact budget of words for each source.

Sources, by code point with null last, weigh 5, 2, 1, repeating. Together they share ``share`` times all words; a
target stops at ``most`` times its source's words and the excess is shared again by weight: that is the level at which
min(most * size, level * weight) sums to the total, found from cumulative sums over the sources' table.

Within a source documents come in the order of a hash of their id (of their text, where they have none). The hash's leading bits are the ranges of a range
sort: sums by (source, range) and their running sums give every range its offset, and a window within the range does the
rest, so neither a large source nor a large range is one task's work. The number of ranges grows with the square root of
the rows, which keeps both levels small. A source's whole repeats are floor(budget / size); the rest is cut at exactly
the remaining words, so one document of each source may be taken in part.

Null texts have no words and are never taken; rows that repeat an id and a size are interchangeable. No rows: no rows.
Reruns agree, since the order depends on nothing but ids, texts and sizes. Sources are few by nature: their own table, one
row each, is one task's work.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("ratio", F.col("cap") / F.col("weight"))
    # with the sources below a level capped, the others share what is left by weight
    up = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    before, rest = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    total = F.lit(float(share)) * F.sum("source_size").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    leveled = ranked.withColumn("level", level)
    first = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return leveled.withColumn("target", F.when(F.col("level") <= F.col("ratio"), F.least(F.col("cap"), F.col("weight") * first)).otherwise(F.col("cap"))).select("source", "source_size", "target")


def hash_key(id_: Column, text: Column) -> Column:
    """The hash that orders documents: of the id, and without one of the text, so that null ids spread too."""
    return F.md5(F.coalesce(id_.cast("string"), F.concat(F.lit("|"), text), F.lit("")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **shares) -> DataFrame:
    """(row, size, source_size, target, taken): ``row`` holds all columns of ``docs``."""
    spark = docs.sparkSession
    key = hash_key(F.col(id_col), F.col(text_col))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source_col).alias("source"), F.col(id_col).cast("long").alias("id"), key.alias("key"), word_count(F.col(text_col)).alias("size"))
    return _mixed(rows, spark, docs, **shares)


def _mixed(rows: DataFrame, spark, docs: DataFrame, **shares) -> DataFrame:
    n = docs.select(F.count("*").alias("n")).first()["n"]
    bits = max(1, math.ceil(math.log2(max(2.0, math.sqrt(n) / 2))))
    place = F.shiftrightunsigned(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), 32 - bits)
    rows = rows.withColumn("range", place)
    sums = rows.groupBy("source", "range").agg(F.sum("size").alias("words"))
    ahead = F.sum("words").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("words")
    offsets = sums.withColumn("offset", ahead)
    goals = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), **shares)
    offsets = offsets.alias("o").join(goals.alias("g"), F.col("o.source").eqNullSafe(F.col("g.source"))).select(
        F.col("o.source").alias("s"), F.col("o.range").alias("r"), "offset", "source_size", "target")
    inside = Window.partitionBy("source", "range").orderBy("key", F.col("id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("upto", F.sum("size").over(inside)).join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("offset") + F.col("upto") - F.col("size"))))
    return placed.select("row", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))


def op6_mix_sources(spark, sf_dir) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    light = docs.select("doc_id", "source", "text")
    key = hash_key(F.col("doc_id"), F.col("text"))
    rows = light.select(F.struct("doc_id").alias("row"), "source", F.col("doc_id").cast("long").alias("id"), key.alias("key"), word_count(F.col("text")).alias("size"))
    # sizes are counted once: what follows reads the light rows twice
    return _mixed(common.written(rows, "sizes"), spark, docs).select("row.doc_id", "size", "source_size", "target", "taken")


#: The same in DuckDB. Sources are few, so the level is found by trying each source as the first that isn't capped.
OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '|' || text, '')) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         source_size * 2.0::DOUBLE AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total
  FROM s),
l AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w),
t AS (
  SELECT source, source_size,
         CASE WHEN level <= cap / weight THEN least(cap, weight * max(CASE WHEN level <= cap / weight THEN level END) OVER ()) ELSE cap END AS target
  FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - ahead)) END AS BIGINT) AS taken
FROM p
"""
