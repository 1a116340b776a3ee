import random
import re
from collections import Counter

import pytest

from maskframe.llm import decontaminate as m
from maskframe.llm.decontaminate import decontaminated, matches, op5_decontaminate

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall((t or "").lower())


def counts(w):
    return Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))


def brute(rows, items):
    out = set()
    for d, t in rows:
        w = words(t)
        for i, x in items:
            v = words(x)
            if len(v) < 5 or len(w) < 5:
                continue
            b = counts(v)
            for s in range(max(1, len(w) - len(v) + 1)):
                a = counts(w[s : s + len(v)])
                if sum((a & b).values()) >= 0.8 * sum((a | b).values()) - 1e-12:
                    out.add((d, i))
                    break
    return out


def corpus(seed):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.randint(5, 60)))) for k in range(30)]
    items += [(50, "four words only here"), (51, None), (52, "a a a a a a a a"), (53, items[3][1]), (54, " ".join(["rep", "eat"] * 9))]
    rows = []
    for i in range(150):
        w = [r.choice(vocabulary) for _ in range(r.randint(0, 120))]
        for _ in range(r.choice([0, 0, 1, 2])):
            x = words(r.choice(items)[1])
            for _ in range(r.choice([0, 0, 1, 2, 5])):
                if x:
                    k = r.randrange(len(x))
                    x[k : k + r.choice([0, 1])] = [r.choice(vocabulary)] if r.random() < 0.7 else []
            if r.random() < 0.3:
                x = x[r.randint(0, 3) :]
            k = r.randint(0, len(w))
            w[k:k] = x
        rows.append((i, r.choice([" ", "\n"]).join(y.upper() if r.random() < 0.2 else y for y in w)))
    rows += [(500, None), (501, ""), (502, "a a a a a a a a a a"), (503, "rep eat " * 30), (504, items[0][1]), (None, items[1][1]), (7, items[2][1])]
    return rows, items


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_windows(spark, seed):
    rows, items = corpus(seed)
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(None if r["id"] == 2**63 - 1 else r["id"], r["item"]) for r in matches(docs, bench).collect()}
    assert got == brute(rows, items)


def test_shuffled_path_and_counts(spark, tmp_path, monkeypatch):
    rows, items = corpus(4)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    one = sorted(map(str, op5_decontaminate(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(m, "BROADCAST_SHINGLES", 0)
    assert sorted(map(str, op5_decontaminate(spark, str(tmp_path)).collect())) == one and len(one) == len(rows)


def test_long_items_and_texts(spark):
    """Items of more words than narrow counters hold, texts longer still, and one word over and over."""
    r = random.Random(7)
    item = [f"w{r.randint(0, 500)}" for _ in range(2_000)]
    near = list(item)
    for k in range(0, 2_000, 60):
        near[k] = "other"
    far = [f"w{r.randint(0, 500)}" for _ in range(2_000)]
    items = [(1, " ".join(item)), (2, " ".join(f"a{k}" for k in range(40))), (3, "dash " * 64 + " ".join(f"d{k}" for k in range(12)))]
    texts = [" ".join(far[:900] + near + far), " ".join(far), " ".join(f"a{k}" for k in range(34)) + " -" * 6, "x " * 30 + "dash " * 64 + " ".join(f"e{k}" for k in range(8)), "dash " * 300]
    rows = [(k, t) for k, t in enumerate(texts)]
    got = {(x["id"], x["item"]) for x in matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == brute(rows[2:], items[1:]) | {(0, 1)}


def test_empty_and_columns(spark):
    docs = spark.createDataFrame([(1, "one two three four five six", 3, "k"), (2, "p q r s t u", 4, "l"), (None, None, 5, "m")], "doc_id long, text string, words int, item string")
    bench = spark.createDataFrame([(1, "One two three four FIVE six")], "item_id long, text string")
    assert sorted(str(r["item"]) for r in decontaminated(docs, bench).collect()) == ["l", "m"]
    assert decontaminated(docs, bench.limit(0)).count() == 3 and decontaminated(docs.limit(0), bench).count() == 0


def test_fingerprint_bits(spark):
    from pyspark.sql import functions as F

    r = random.Random(3)
    rows = [(n, [r.getrandbits(64) - 2**63 for _ in range(n)]) for n in (0, 1, 2, 7, 63, 64, 300, 16_383, 16_384, 20_000)]
    got = {x["n"]: x["f"] for x in spark.createDataFrame(rows, "n int, h array<long>").select("n", m.simhash(F.col("h")).alias("f")).collect()}
    for n, h in rows:
        assert got[n] & (2**64 - 1) == sum(1 << b for b in range(64) if 2 * sum((x >> b) & 1 for x in h) > n)
