"""Session and table helpers shared by the training-data operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete, done, scratch, shared_dir, temporary, written

#: One word: a run of anything but ASCII white space (Java and RE2 syntax alike).
WORD = r"[^\x20\x09-\x0D]+"
#: Ids are compared as longs; a null id sorts after every other one.
NULL_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of ``text`` (null: no words)."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def partitions(spark: SparkSession, rows: int, each: int) -> int:
    """How many partitions give about ``each`` rows to one; the session's number at most."""
    return max(1, min(shuffle_partitions(spark), -(-rows // each)))


def group_count(docs: DataFrame, text: str, bytes_per_group: int) -> int:
    """How many hash groups keep a group of texts near ``bytes_per_group``; follows the whole input's size."""
    total = docs.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0
    return max(2 * shuffle_partitions(docs.sparkSession), math.ceil(total / bytes_per_group), 1)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that ``df`` has no column of, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


__all__ = ["NULL_ID", "WORD", "delete", "done", "group_count", "partitions", "scratch", "shared_dir", "shuffle_partitions", "table", "temporary", "unused", "words", "written"]
