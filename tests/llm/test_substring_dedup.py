import hashlib
import random

import numpy as np
import pytest

from maskframe.llm.substring_dedup import op9_substring_dedup, resolve, substring_dedup

WINDOW = 50


def brute(rows, window=WINDOW):
    first = {}
    for i, t in rows:
        w, i = (t or "").encode().split(), 2**63 - 1 if i is None else i
        for k in range(len(w) - window + 1):
            s = tuple(w[k : k + window])
            first[s] = min(first.get(s, i), i)
    out = []
    for i, t in rows:
        w, j = (t or "").encode().split(), 2**63 - 1 if i is None else i
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < j:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    words = ["the", "The", "of", "and", "é a", "ß", "thing", "a", "\x1csh", "x" * 9]
    passages = [[r.choice(words) for _ in range(r.randint(30, 130))] for _ in range(10)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(r.randint(0, 6)):
            part = list(r.choice(passages)) if r.random() < 0.5 else [r.choice(words) for _ in range(r.randint(1, 60))]
            if r.random() < 0.3 and len(part) > 70:
                part[r.randint(51, 69)] = "edit"
            parts += part
        rows.append((i, "".join(w + r.choice([" ", "\n", "\t ", "\r\n"]) for w in parts)))
    rows += [(200 + k, rows[r.randint(0, 99)][1]) for k in range(20)]
    rows += [(300, "a " * 700), (301, "b " + "a " * 300), (5, "a " * 120), (None, rows[3][1]), (7, rows[8][1]), (400, None), (401, " \n "), (402, " ".join(passages[0]))]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, tmp_path, seed):
    rows = corpus(seed)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op9_substring_dedup(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(rows)


def test_parsing_equals_comparing_all_windows():
    r = np.random.default_rng(4)
    base = r.integers(1, 4, 60).astype(np.uint64)
    cut = [np.concatenate([base[a : a + 30], base[b : b + 25]]) for a, b in zip(r.integers(0, 30, 80), r.integers(0, 35, 80))]
    ids, w = r.integers(0, 30, 80), 12
    got = resolve(np.concatenate(cut), np.array([len(c) for c in cut]), ids, w)
    first = {}
    for c, i in zip(cut, ids):
        for k in range(len(c) - w + 1):
            s = c[k : k + w].tobytes()
            first[s] = min(first.get(s, i), i)
    assert got.tolist() == [bool(first[c[k : k + w].tobytes()] < i) for c, i in zip(cut, ids) for k in range(len(c) - w + 1)]


def thue_morse(k, a="a", b="b"):
    """Two different words of 2**k letters whose polynomial hashes modulo 2**64 agree for every odd base."""
    x, y = a, b
    for _ in range(k):
        x, y = x + y, y + x
    return x, y


@pytest.mark.parametrize("k", [8, 10, 12])
def test_words_that_polynomial_hashes_confuse(spark, tmp_path, k):
    x, y = thue_morse(k)
    rows = [(1, " ".join([x, "z"] * 30)), (2, " ".join([y, "z"] * 30)), (3, " ".join([x, "z"] * 30) + " " + y), (4, " ".join(list(x))), (5, " ".join(list(y)))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op9_substring_dedup(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(rows) and got[1][2] == 0


def test_null_and_repeated_ids_and_a_long_text(spark, tmp_path):
    """Rows of one id never remove from each other, wherever they are dealt; clashing columns change nothing."""
    r = random.Random(8)
    passage = " ".join(f"p{k}" for k in range(80))
    own = lambda n=60: " ".join(r.choice("abcdefgh") + str(r.randint(0, 10**6)) for _ in range(n))
    rows = [(None, own() + " " + passage) for _ in range(40)] + [(5, own() + " " + passage) for _ in range(40)] + [(6, own(30_000) + " " + passage), (9, passage)]
    # equal contexts of one id, in texts of their own, against a smaller id's text that has a part of them
    other = [f"q{k}" for k in range(130)]
    rows += [(20, " ".join(other[:90] + [f"z{k}"])) for k in range(12)] + [(3, " ".join(other[30:100])), (None, " ".join(other[20:])), (None, " ".join(other[20:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op9_substring_dedup(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(rows)
    more = docs.selectExpr("doc_id", "text", "1 AS g", "2 AS id", "3 AS row", "4 AS bucket", "5 AS kept")
    assert substring_dedup(more).select("row.row", "row.kept").distinct().collect() == [(3, 5)]


def test_empty_table(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
