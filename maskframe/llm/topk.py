"""Exact top-k inner products by Fagin's threshold algorithm.

Vectors (integer components) are hashed into groups; queries into batches. In a group, long vectors come first, in blocks;
in a block every dimension has its list of vectors sorted by that component. A query reads its lists from the favourable
end (from the top where its component is positive, from the bottom where it is negative, not at all where it is 0), all to
the same depth, in growing steps. Only ids that a list has newly shown are scored, in full and exactly; the query stops
when the threshold, the score that a vector at all lists' present depth would have, is below its kth best score so far, or
when nothing is unseen. The kth best is carried from block to block, so a block whose threshold at depth 0 is too low costs
a query nothing, and long vectors first make it high early.

Groups' best k are then ranked by Spark. Equal scores go to the smaller id.

Vectors that are null, or hold null or non-finite components, take no part, nor do rows without an id. Vectors of another
length than the query's are not its candidates. Rows that repeat an id count once, with the smallest vector. A query with
fewer candidates than k gets all of them; one without any has no row. Products are integers throughout: doubles are only
used where every sum stays below 2**53, Python's own integers where one may leave 64 bits. A score outside 64 bits among a
query's best raises an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Vectors in a block, blocks in a group (at most, about), queries in a batch (at most, about).
BLOCK, BLOCKS, BATCH = 8192, 16, 16384
#: Fewer vectors than this aren't worth a group of their own: every group returns k rows a query, and lists save more the longer they are.
SMALL = 4096
#: How deep the lists are read first, and by what factor each step goes deeper.
DEPTH, DEEPER = 16, 3


def exact(vectors: np.ndarray, queries: np.ndarray) -> type:
    """The number type in which inner products of these integers, and sums of them, are exact."""
    most = lambda x: max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    bound = 2 * most(vectors) * most(queries) * max(vectors.shape[1], 1)
    return np.float64 if bound < 2**53 else np.int64 if bound < 2**63 else object


class Lists:
    """A block's sorted lists: for each dimension the vectors' places by falling component, and the components."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.order = np.argsort(-vectors, axis=0, kind="stable")
        self.falling = np.take_along_axis(vectors, self.order, axis=0)

    def threshold(self, query: np.ndarray, depth: int) -> int:
        """The best score that a vector not shown by any list before ``depth`` can have."""
        n = len(self.falling)
        return int((np.where(query > 0, self.falling[depth], self.falling[n - 1 - depth]) * query).sum())

    def shown(self, query: np.ndarray, start: int, end: int) -> np.ndarray:
        """Which vectors the query's lists show between two depths."""
        n, up, down = len(self.falling), query > 0, query < 0
        out = np.zeros(n, bool)
        if not (up.any() or down.any()):  # all scores are 0: any list shows the vectors
            out[start:end] = True
        out[self.order[start:end, up]] = True
        out[self.order[max(n - end, 0) : n - start, down]] = True
        return out


class Search:
    """The best k so far of each query of a batch, as (score, id) by rank, and how many products that took."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k, self.products = ids, queries, k, 0
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]

    def block(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        kind = exact(vectors, self.queries)
        lists, queries = Lists(vectors.astype(kind)), self.queries.astype(kind)
        # the best scores that the block's vectors can have at all
        most = np.maximum(queries, 0) @ lists.falling[0] + np.minimum(queries, 0) @ lists.falling[-1]
        for q, query in enumerate(queries):
            if len(self.best[q]) < self.k or most[q] >= self.best[q][-1][0]:
                self.one(q, query, lists, ids)

    def one(self, q: int, query: np.ndarray, lists: Lists, ids: np.ndarray) -> None:
        best, n = self.best[q], len(ids)
        seen, unseen, start, end = np.zeros(n, bool), n, 0, DEPTH
        while unseen:
            if start and len(best) == self.k and lists.threshold(query, start) < best[-1][0]:
                break
            new = np.flatnonzero(lists.shown(query, start, end) & ~seen)
            seen[new] = True
            unseen -= len(new)
            new = new[ids[new] != self.ids[q]]
            scores = lists.vectors[new] @ query
            self.products += len(new)
            if len(best) == self.k:  # equal scores may have a smaller id
                new, scores = new[scores >= best[-1][0]], scores[scores >= best[-1][0]]
            if len(new) > 4 * self.k and scores.dtype != object:
                high = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
                new, scores = new[high], scores[high]
            best += zip(map(int, scores.tolist()), ids[new].tolist(), strict=True)
            best.sort(key=lambda x: (-x[0], x[1]))
            del best[self.k :]
            start, end = end, end * DEEPER


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) from two tables of (id long, v array<long>)."""
    spark = vectors.sparkSession
    n = vectors.count()
    parts = common.shuffle_partitions(spark)
    asked = queries.count()
    # about so many tasks as partitions, with the fewest copies of vectors and queries: n * batches + asked * groups
    batches = max(1, -(-asked // BATCH), round((parts * asked / max(n, 1)) ** 0.5))
    groups = max(1, -(-n // (BLOCK * BLOCKS)), min(-(-parts // batches), -(-n // SMALL)))
    dims = F.size("v")
    place = lambda c, m, seed: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(m)).cast("int")
    left = vectors.select(dims.alias("dims"), place("id", groups, 5).alias("vb"), F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("qb"), "id", "v")
    right = queries.select(dims.alias("dims"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("vb"), place("id", batches, 6).alias("qb"), "id", "v")

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        empty = not a.num_rows or not b.num_rows
        flat = lambda t: (t.column("id").to_numpy(), t.column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1))
        found, scores, ids_ = [], [], []
        if not empty:
            ids, v = flat(a)
            order = np.lexsort((ids, -np.abs(v.astype(np.float64)).max(axis=1)))
            ids, v = ids[order], v[order]
            search = Search(*flat(b), k)
            for at in range(0, len(ids), BLOCK):
                search.block(ids[at : at + BLOCK], v[at : at + BLOCK])
            ids_, scores, found = search.ids, *([[x[j] for x in best] for best in search.best] for j in (0, 1))
        return pa.table({"query_id": pa.array(ids_, pa.int64()), "found": pa.array(found, pa.list_(pa.int64())), "scores": pa.array(scores, pa.list_(pa.int64()))})

    keys = ["dims", "vb", "qb"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query_id long, found array<long>, scores array<long>")
    rows = near.select("query_id", F.explode(F.arrays_zip("found", "scores")).alias("x")).select("query_id", F.col("x.found").alias("vec_id"), F.col("x.scores").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def whole(table: DataFrame, id_col: str, vector_col: str, scale: int = 64) -> DataFrame:
    """(id, v): floor(scale * component) as longs, one row an id, without vectors that take no part."""
    v = F.col(vector_col)
    fit = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    ints = F.transform(v, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    return table.where(F.col(id_col).isNotNull() & F.coalesce(fit, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), ints.alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def op2_topk(spark, sf_dir) -> DataFrame:
    rows = common.written(whole(common.table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "vectors")
    return top_k(rows, rows.where("id % 20 = 0"), 20)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 64) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: CAST(p[1] AS HUGEINT) * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
