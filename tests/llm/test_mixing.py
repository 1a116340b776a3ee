import hashlib
import math
import random
import re

import duckdb
import pytest

from maskframe.llm.mixing import OP6_SQL, mix, op6_mix_sources


def brute(rows):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    names = sorted({s for _, _, s in rows if s is not None}) + ([None] if any(s is None for _, _, s in rows) else [])
    total = {s: sum(n for n, r in zip(size, rows) if r[2] == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, capped, left = {}, set(), 1.5 * sum(total.values())
    while True:  # share by weight, stop at twice the size, share the excess again
        open_ = [s for s in names if s not in capped]
        have = left - sum(2 * total[s] for s in capped)
        target = {s: 2.0 * total[s] if s in capped else have * weight[s] / sum(weight[x] for x in open_) for s in names}
        over = {s for s in open_ if target[s] > 2 * total[s]}
        if not over:
            break
        capped |= over
    out = []
    for s in names:
        own = sorted((hashlib.md5((("" if t is None else "|" + t) if d is None else str(d)).encode()).hexdigest(), -1 if d is None else d, n, d) for (d, t, x), n in zip(rows, size) if x == s)
        budget = math.floor(target[s] + 1e-9)
        epochs, rest = divmod(budget, total[s]) if total[s] else (0, 0)
        for _, _, n, d in own:
            part = max(0, min(n, rest))
            rest -= part
            out.append((d, n, total[s], round(target[s], 6), epochs * n + part))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force_and_sql(spark, tmp_path, seed):
    r = random.Random(seed)
    rows = [(i, "w " * r.randint(0, 300) if r.random() < 0.9 else None, r.choice(["a", "a", "a", "B", "é", "zz", None, "c", "d"])) for i in range(500)]
    rows += [(7, "x y", "a"), (7, "x y", "a"), (None, "q q q", "B"), (600, None, "empty")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((x["doc_id"], x["size"], x["source_size"], round(x["target"], 6), x["taken"]) for x in op6_mix_sources(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(rows)
    sql = duckdb.sql(OP6_SQL.replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    assert sorted(((a, b, c, round(d, 6), e) for a, b, c, d, e in sql), key=str) == got
    by = {}
    for _, n, s, t, k in got:
        assert k <= 2 * n
        by[(s, t)] = by.get((s, t), 0) + k
    assert all(abs(v - t) < 1 for (_, t), v in by.items())


def test_rows_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b", "s", 9), (2, "c", None, 8)], "doc_id long, text string, source string, size int")
    got = {r["row"]["doc_id"]: r for r in mix(docs).collect()}
    assert got[1]["row"]["size"] == 9 and got[1]["size"] == 2 and got[2]["taken"] in (0, 1, 2)
    assert mix(docs.limit(0)).count() == 0
