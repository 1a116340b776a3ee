"""Connected components of a link table by alternating large-star and small-star steps (Kiveris et al. 2014).

A hub's links stay where they are, and its smallest neighbour is broadcast to them; each half round is written to the
shared folder, and a round's links never exceed the round before plus one a node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


#: Links for a partition, about; so many links have their nodes' minima broadcast (32 bytes each); and of more, a node of
#: more links than ``HUB`` has.
LINKS, FEW, HUB = 20_000, 200_000, 200_000


def _with_least(rows: DataFrame, n: int, most: int) -> DataFrame:
    """``rows`` (x, y), ``n`` of them or twice so many, with the smallest y of each x as ``m``; no x has more than ``most`` rows.

    There are at most 2 * n / HUB hubs, so their broadcast is small: 32 bytes for each 3 MB of links.
    """
    same = F.col("x") == F.col("n")
    least = rows.groupBy("x").agg(F.min("y").alias("m"), F.count("*").alias("size")).withColumnRenamed("x", "n")
    if n <= FEW:
        return rows.join(F.broadcast(least), same).select("x", "y", "m")
    if most <= HUB:
        return rows.join(least.hint("merge"), same).select("x", "y", "m")
    least = common.written(least, "least")
    many = F.broadcast(least.where(F.col("size") > HUB))
    others = rows.join(many, same, "left_anti").join(least.where(F.col("size") <= HUB).hint("merge"), same)
    return rows.join(many, same).select("x", "y", "m").unionAll(others.select("x", "y", "m"))


def _large_star(links: DataFrame, n: int, most: int) -> DataFrame:
    both = links.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(links.select(F.col("v").alias("x"), F.col("u").alias("y")))
    return _with_least(both, n, most).where("y > x").select(F.col("y").alias("u"), F.least("x", "m").alias("v"))


def _small_star(links: DataFrame, n: int, most: int) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("x"), F.least("u", "v").alias("y")).where("x > y")
    # each link y of x goes to the smallest one, as does x itself
    moved = _with_least(down, n, most).select(F.when(F.col("y") > F.col("m"), F.col("y")).otherwise(F.col("x")).alias("u"), F.col("m").alias("v"))
    return moved.repartition(common.partitions(links.sparkSession, n, LINKS), "u", "v").distinct()


def _state(links: DataFrame) -> tuple[bool, int]:
    """Whether a node has more than one link down, or one and links up (else each component is a star around its smallest node); most links of a node."""
    ends = links.select(F.col("u").alias("n"), F.lit(1).alias("down")).unionAll(links.select(F.col("v").alias("n"), F.lit(0).alias("down")))
    nodes = ends.groupBy("n").agg(F.sum("down").alias("down"), F.count("*").alias("all"))
    state = nodes.agg(F.coalesce(F.bool_or(F.expr("down > 1 or (down = 1 and all > 1)")), F.lit(False)).alias("open"), F.coalesce(F.max("all"), F.lit(0)).alias("most")).first()
    return state["open"], state["most"]


def components(links: DataFrame) -> DataFrame:
    """(u, v) for each node u that isn't the smallest of its component, with that smallest node v.

    ``links``: long columns a and b, of a table that is cheap to read twice. Loops and repeated links do nothing; no links
    give no rows.
    """
    k = common.partitions(links.sparkSession, links.count(), LINKS)
    now = common.written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").repartition(k, "u", "v").distinct(), "links")
    while True:
        n = now.count()
        open_, most = _state(now)
        if not open_:
            return now
        middle = common.written(_large_star(now, n, most), "links")
        # a half round can join all of a component to one node
        after = common.written(_small_star(middle, n, n), "links")
        common.done(now, middle)
        now = after
