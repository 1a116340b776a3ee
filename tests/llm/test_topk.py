import math

import numpy as np
import pytest

import maskframe.llm.topk as topk
from maskframe.llm.topk import Search, op2_topk


def brute(rows, k=20):
    best = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        w = [math.floor(64 * x) for x in v]
        best[i] = min(best.get(i, w), w)
    out = []
    for q, v in best.items():
        if q % 20 == 0:
            s = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in best.items() if i != q and len(w) == len(v))
            out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s[:k])]
    return sorted(out)


@pytest.mark.parametrize("seed,dims", [(1, 8), (2, 3)])
def test_against_all_products(spark, tmp_path, seed, dims):
    r = np.random.default_rng(seed)
    rows = [(int(i), [float(np.float32(x)) for x in r.normal(size=dims) / 2]) for i in range(700)]
    rows += [(1000 + k, rows[20][1]) for k in range(40)] + [(40, rows[3][1]), (40, rows[40][1]), (60, rows[60][1])]
    rows += [(2000, None), (2001, [float("nan")] * dims), (2002, [1.0] * (dims - 1) + [None]), (2003, [float("inf")] * dims), (None, rows[0][1]), (2020, [0.5] * (dims + 1)), (2021, [0.25] * (dims + 1)), (2040, [1.0]), (2060, []), (2080, [0.0] * dims)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(map(tuple, op2_topk(spark, str(tmp_path)).collect())) == brute(rows)


def exact_best(v, ids, q, k):
    return sorted((-sum(int(a) * int(b) for a, b in zip(v[q], v[i])), int(ids[i])) for i in range(len(v)) if ids[i] != ids[q])[:k]


@pytest.mark.parametrize("scale", [1, 2**17, 2**27])
def test_blocks_and_exact_integers(scale):
    """Doubles, 64-bit integers and Python's integers by turns; products beyond 2**53 keep their units."""
    r = np.random.default_rng(7)
    v = np.floor(64 * scale * r.normal(size=(900, 6)) * np.array([8, 4, 2, 1, 0.5, 0.1])).astype(np.int64)
    v[5], v[6], v[7] = 0, v[8], v[8]
    v[:, 3] = 0
    ids = np.arange(900)[::-1].copy()
    search = Search(ids[:40], v[:40], 5)
    for at in range(0, 900, 256):
        search.block(ids[at : at + 256], v[at : at + 256])
    for q in range(40):
        assert [(-s, i) for s, i in search.best[q]] == exact_best(v, ids, q, 5)
    assert topk.exact(v, v) is {1: np.float64, 2**17: np.int64, 2**27: object}[scale]


def test_lists_save_products():
    """On skewed vectors the lists are left early: far fewer products than all."""
    r = np.random.default_rng(3)
    n, k = 20_000, 20
    v = np.floor(64 * r.normal(size=(n, 16)) * np.exp(r.normal(size=(n, 1))) * 0.5 ** np.arange(16)).astype(np.int64)
    ids = np.arange(n)
    order = np.argsort(-np.abs(v).max(axis=1), kind="stable")
    queries = np.arange(0, n, 100)
    search = Search(ids[queries], v[queries], k)
    for at in range(0, n, topk.BLOCK):
        own = order[at : at + topk.BLOCK]
        search.block(ids[own], v[own])
    assert search.products < 0.05 * n * len(queries)
    for q in range(0, len(queries), 17):
        score = v @ v[queries[q]]
        best = sorted((-int(x), i) for i, x in enumerate(score) if i != queries[q])[:k]
        assert [(-s, i) for s, i in search.best[q]] == best


def test_clashing_columns(spark, tmp_path):
    rows = [(k, [float(k % 7), 1.0], k, k, "x") for k in range(60)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, id long, v long, score string").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert sorted(map(tuple, op2_topk(spark, str(tmp_path)).collect())) == brute([r[:2] for r in rows])


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert op2_topk(spark, str(tmp_path)).count() == 0
