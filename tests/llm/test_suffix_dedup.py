import hashlib
import random

import numpy as np
import pytest

from maskframe.llm.suffix_dedup import kasai, op8_suffix_dedup, resolve, suffix_array, suffix_dedup

WINDOW = 50


def brute(rows, window=WINDOW):
    """(id, text) pairs by rows: spans and kept bytes by definition."""
    first = {}
    for i, t in rows:
        b, i = (t or "").encode(), 2**63 - 1 if i is None else i
        for k in range(len(b) - window + 1):
            w = b[k : k + window]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b, i = (t or "").encode(), 2**63 - 1 if i is None else i
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if first[b[k : k + window]] < i:
                gone[k : k + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone) if not g)
        n = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i if i != 2**63 - 1 else None, len(b), sum(gone), n, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    words = ["the", "of", "and", "éa", "ß", "thing", "a", "sh", "x" * 9, "\n", "\t"]
    passages = [" ".join(r.choice(words) for _ in range(r.randint(15, 80))) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = [r.choice(passages) if r.random() < 0.4 else " ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(r.randint(0, 6))]
        rows.append((i, " ".join(parts)))
    rows += [(200 + k, rows[r.randint(0, 99)][1]) for k in range(20)]
    rows += [(300, "a" * 700), (301, "b" + "a" * 300), (302, "ab" * 200), (5, "a" * 120), (None, rows[3][1]), (7, rows[8][1]), (400, None), (401, ""), (402, passages[0] + "\0" * 60), (403, "\0" * 60)]
    r.shuffle(rows)
    return rows


def test_suffix_array_and_prefixes_against_sorting():
    r = np.random.default_rng(3)
    for n, k in ((1, 2), (5, 2), (400, 2), (3000, 3), (3000, 60), (700, 1)):
        t = r.integers(1, k + 1, n).astype(np.uint16)
        s = t.astype(">u2").tobytes()
        want = sorted(range(n), key=lambda i: s[2 * i :])
        sa = suffix_array(t, n)
        assert sa.tolist() == want
        common = [0] + [next((x for x in range(30) if a + x >= n or b + x >= n or t[a + x] != t[b + x]), 30) for a, b in zip(want[:-1], want[1:])]
        assert kasai(t, sa, 30, 7).tolist() == common
    assert len(suffix_array(np.zeros(0, np.uint16), 50)) == 0


def test_prefixes_of_a_partial_order():
    """Contexts that share 60 to 80 bytes: some pairs are tied where the suffix array stops."""
    r = np.random.default_rng(11)
    passages = [r.integers(98, 101, 84) for _ in range(40)]
    parts = []
    for _ in range(1600):
        cut = int(r.integers(60, 81))
        parts += [passages[r.integers(0, 40)][:cut], r.integers(98, 101, 84 - cut), [1]]
    t = np.concatenate(parts).astype(np.uint16)
    assert len(t) > 100_000
    sa = suffix_array(t, WINDOW)
    s = t.astype(np.uint8).tobytes()
    want = [0]
    for a, b in zip(sa[:-1].tolist(), sa[1:].tolist()):
        x, y = s[a : a + WINDOW], s[b : b + WINDOW]
        assert x <= y
        want.append(next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y))))
    assert kasai(t, sa, WINDOW, 7).tolist() == want
    assert kasai(t, sa, WINDOW).tolist() == want


def test_blocks_merge_by_binary_search(monkeypatch):
    import maskframe.llm.suffix_dedup as m

    r = np.random.default_rng(5)
    base = r.integers(97, 100, 90).astype(np.uint8)
    cut = [base[a : a + s] for a, s in zip(r.integers(0, 30, 60), r.integers(50, 61, 60))]
    ids = r.integers(0, 40, 60)
    one = resolve(np.concatenate(cut), np.array([len(c) for c in cut]), ids, 50)
    monkeypatch.setattr(m, "BLOCK", 400)
    assert (resolve(np.concatenate(cut), np.array([len(c) for c in cut]), ids, 50) == one).all()
    first = {}
    for c, i in zip(cut, ids):
        for k in range(len(c) - 49):
            first[c[k : k + 50].tobytes()] = min(first.get(c[k : k + 50].tobytes(), i), i)
    assert one.tolist() == [bool(first[c[k : k + 50].tobytes()] < i) for c, i in zip(cut, ids) for k in range(len(c) - 49)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, tmp_path, seed):
    rows = corpus(seed)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op8_suffix_dedup(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(rows)


def test_long_text_by_tiles(spark, tmp_path, monkeypatch):
    r = random.Random(8)
    long = "".join(r.choice("abcdefgh ") for _ in range(1_300_000))
    rows = [(2, long), (1, long[500_000:500_800]), (3, long[1_200_000:]), (4, "zz" + long[524_200:524_400])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op8_suffix_dedup(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(rows)


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, g int, id string")
    assert suffix_dedup(empty).count() == 0
    rows = [(1, "p" * 60, 4, "a", None), (2, "q" + "p" * 60, 5, "b", 7)]
    out = {r["row"]["doc_id"]: r for r in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string, g int, id string, row int")).collect()}
    assert out[2]["row"]["id"] == "b" and out[2]["row"]["g"] == 5 and out[2]["row"]["row"] == 7
    assert [(s["start"], s["end"]) for s in out[2]["spans"]] == [(1, 61)] and bytes(out[2]["kept"]) == b"q"


def test_ids_as_steps():
    from maskframe.llm.repeats import _ids, _steps

    for ids in ([5], [0, 0, 255], [-(2**63), 2**62], [3, 2**40, 2**63 - 1], [1, 300, 70_000, 2**33], [7] * 5):
        assert _ids(_steps(np.array(ids, np.int64))).tolist() == ids
