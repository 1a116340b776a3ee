"""Training-corpus pipeline over ``documents``: five stages, each of which works on all that the one before kept.

1. language ID drops documents whose language can't be told (no text or no letter);
2. MinHash near-dedup keeps one row, that of the smallest id, of each group of near copies (five-word shingles, similarity 0.8);
3. suffix-array dedup removes bytes covered by 50-byte strings of smaller documents; documents that nothing is left of go;
4. benchmark decontamination drops documents with a window that matches a benchmark item;
5. mixing brings the sources to their target weights: a row for each document that the mix takes, with its words taken
   (added columns get an underscore where their name is taken).

The first four return the columns of ``documents`` with texts as far as they were kept; ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe import session
from maskframe.llm import common, decontaminate, langid, mixing, neardup, suffix_dedup


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; nothing else is dropped, and columns stay as they are.

    Without a labelled row there is nothing to tell languages by: then every text with a letter stays.
    """
    session.ship(spark)
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    if docs.where(langid.usable(docs)).isEmpty():
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.identify(docs, [others], with_text=True).where(F.col("lang_pred") != langid.UND)
    return found.select(*[F.col("__text").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: that with the smallest id (null last), then text hash. Texts without words have no group and stay.

    Rows are linked by their texts alone, whatever ids they share or lack. A row is known by id and text; of rows that share
    both, and are their group's first, one stays, whichever.
    """
    rows = neardup.groups(docs, size=5, threshold=0.8)
    keys = rows.groupBy("component", "id", "hash").agg(F.count("*").alias("copies"))
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "hash")
    first = keys.groupBy("component").agg(F.min(rank).alias("first"))
    keys = common.written(keys.join(first, "component").select("id", "hash", "copies", (rank == F.col("first")).alias("stays")), "keys")
    i, h = common.unused(docs, "key_id"), common.unused(docs, "key_hash")
    named = keys.withColumnsRenamed({"id": i, "hash": h})
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(h))
    left = docs.join(named.where("not stays").select(i, h), same, "left_anti")
    copied = named.where("stays and copies > 1").select(i, h)
    if copied.isEmpty():
        return left
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = left.join(copied, same).groupBy(i, h).agg(F.first(row).alias("row")).select("row.*")
    return left.join(copied, same, "left_anti").unionByName(one)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that smaller documents have too. Bytes of characters that were cut apart go as well."""
    found = suffix_dedup.suffix_dedup(docs, whole_characters=True)
    text = F.decode("kept", "UTF-8")
    rows = found.select("row", text.alias("left"), "n_units").where((F.col("n_units") == 0) | (F.length(F.trim("left")) > 0))

    def column(c: str):
        if c == "text":
            return F.col("left").alias(c)
        if c == "n_chars":
            return F.char_length("left").cast(docs.schema[c].dataType).alias(c)
        return F.col(f"row.`{c}`").alias(c)

    return rows.select(*map(column, docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark match."""
    return decontaminate.decontaminated(docs, common.table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document that it takes, with the words taken of it (repeats counted), its source's target and size."""
    out = mixing.mix(docs).where("taken > 0")
    return out.select("row.*", *[F.col(c).alias(common.unused(docs, c)) for c in ("size", "source_size", "target", "taken")])


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("suffix_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("mixing", mixture),
]

#: Language ID, MinHash components and suffix arrays have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    session.ship(spark)
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.written(docs, name)
    return docs
