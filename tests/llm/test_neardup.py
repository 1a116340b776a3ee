import random
import re

import numpy as np
import pyarrow as pa
import pytest

import maskframe.llm.neardup as neardup

from maskframe.llm.components import components
from maskframe.llm.neardup import first_cells, least_equal, near_duplicates, numbered_sets, op7_minhash_forest, trees


def sets_of(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(rows, size, hundredths):
    s = [sets_of(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if both and 100 * both >= hundredths * len(s[i] | s[j]):
                root[find(i)] = find(j)
    big = 2**63 - 1
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), big), big if d is None else d)
    none = lambda x: None if x == big else x
    return sorted(((d, len(s[i]), none(least[find(i)]), (big if d is None else d) == least[find(i)]) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, n=150):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(900)]
    rows = []
    for _ in range(n):
        if rows and r.random() < 0.6:
            w = r.choice(rows[: max(3, len(rows) // 3)])[1].split()
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                if w:
                    w[r.randrange(len(w))] = r.choice(vocabulary)
            if r.random() < 0.2:
                w += [r.choice(vocabulary) for _ in range(r.randint(0, 8))]
        else:
            w = [r.choice(vocabulary) for _ in range(r.randint(1, 150))]
        rows.append((len(rows), (" " if r.random() < 0.5 else "\n").join(x.upper() if r.random() < 0.1 else x for x in w)))
    rows += [(1000, None), (1001, ""), (1002, " \t"), (1003, "one"), (1004, "One "), (1005, "one two"), (1006, "two one"), (None, rows[2][1]), (4, rows[9][1]), (1007, "É é É"), (1008, "é é é"), (None, "alone at the end")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_pairs(spark, tmp_path, seed):
    rows = corpus(seed)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op7_minhash_forest(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(rows, 3, 85)


def test_large_group_of_near_copies(spark, tmp_path):
    r = random.Random(6)
    base = [f"v{k}" for k in range(300)]
    rows = []
    for i in range(400):
        w = list(base)
        for _ in range(r.randint(1, 14)):
            w[r.randrange(300)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op7_minhash_forest(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(rows, 3, 85)


def test_five_words_and_empty_table(spark):
    rows = corpus(9, 80)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS node", "2 AS part", "3 AS digest", "4 AS n")).collect()
    assert sorted(((x.id, x.n_shingles, x.component, x.id == x.component) for x in got), key=str) == brute(rows, 5, 80)
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_ids_link_nothing(spark, tmp_path):
    """Rows that share an id or have none are linked by their texts alone."""
    r = random.Random(2)
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (None, a), (None, b), (5, c), (5, a), (None, b + " more"), (7, b), (8, None), (None, None), (None, ""), (9, c.upper())]
    rows += [(None, " ".join(r.choice("xyz") + str(r.randint(0, 999)) for _ in range(40))) for _ in range(50)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op7_minhash_forest(spark, str(tmp_path)).collect()), key=str)
    assert got == brute(rows, 3, 85)
    assert (None, 58, 7, False) in got and (5, 58, 5, True) in got and (5, 58, 1, False) in got


@pytest.mark.parametrize("k", [8, 10, 12])
def test_words_that_polynomial_hashes_confuse(spark, tmp_path, k):
    x, y = "a", "b"
    for _ in range(k):
        x, y = x + y, y + x
    rows = [(1, f"{x} p q"), (2, f"{y} p q"), (3, f"{x}\tp\nq"), (4, x), (5, y)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, op7_minhash_forest(spark, str(tmp_path)).collect()), key=str) == brute(rows, 3, 85)


def test_numbered_sets_are_the_shingles():
    r = random.Random(5)
    texts = [" ".join(r.choice("abAB") for _ in range(r.randint(0, 12))) for _ in range(60)] + [None, "a", "A", "a b", "É", "é"]
    for size in (1, 3, 5):
        flat, at = numbered_sets(texts, size)
        named = {}
        for t, a, b in zip(texts, at[:-1], at[1:], strict=True):
            want = sets_of(t, size)
            assert len(want) == b - a
            for x in flat[a:b].tolist():
                named.setdefault(x, []).append(want)
        assert all(set.intersection(*map(set, sets)) for sets in named.values())
        assert len(named) == len(set().union(*(sets_of(t, size) for t in texts)))
        by_hash = neardup.shingle_sets(pa.array(texts), size)[1]
        assert by_hash.tolist() == at.tolist()


@pytest.mark.parametrize("blocks", [1, 16])
def test_large_regions_in_blocks(spark, tmp_path, monkeypatch, blocks):
    """A group of near copies, a chain of edits and unlinked texts over one passage, with regions of many blocks."""
    monkeypatch.setattr(neardup, "CELL", 32)
    monkeypatch.setattr(neardup, "BLOCKS", blocks)
    monkeypatch.setattr(neardup, "PACK", 64)
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", 100)
    r = random.Random(3)
    new = lambda: f"x{r.randrange(10**7)}"
    base = [f"v{k}" for k in range(200)]
    rows = []
    for _ in range(150):
        w = list(base)
        for _ in range(r.randint(1, 8)):
            w[r.randrange(200)] = new()
        rows.append(w)
    chain = [f"c{k}" for k in range(200)]
    for k in range(150):
        chain = list(chain)
        chain[(k * 7) % 200 : (k * 7) % 200 + 3] = [new() for _ in range(3)]
        rows.append(chain[:200])
    rows += [base[:150] + [new() for _ in range(50)] for _ in range(150)]
    rows = [(i, " ".join(w)) for i, w in enumerate(r.sample(rows, len(rows)))]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, op7_minhash_forest(spark, str(tmp_path)).collect()), key=str) == brute(rows, 3, 85)


def test_dense_background(spark, monkeypatch):
    """24,000 texts share six tenths of their words, and no background pair is a link: planted pairs are found, and only a few texts are sent."""
    r = np.random.default_rng(12)
    passage = " ".join(f"p{k}" for k in range(75))
    own = lambda n: [f"o{x}" for x in r.integers(0, 10**9, n)]
    texts = [own(25) for _ in range(24_000)]
    pairs = r.choice(24_000, (200, 2), replace=False)
    for a, b in pairs:  # two words of the own ones differ: a similarity of about 0.9
        texts[b] = list(texts[a])
        texts[b][8], texts[b][20] = own(2)
    sent = []

    def cells(members, packs):
        sent.append(first_cells(members, packs).count())
        return first_cells(members, packs)

    monkeypatch.setattr(neardup, "first_cells", cells)
    table = pa.table({"doc_id": np.arange(24_000), "text": [passage + " " + " ".join(t) for t in texts]})
    docs = spark.createDataFrame(table).repartition(4)
    got = {x.id: x.component for x in near_duplicates(docs, size=3, threshold=0.85).collect()}
    found = sum(got[int(a)] == got[int(b)] for a, b in pairs)
    assert found >= 199 and sum(k != v for k, v in got.items()) == found
    assert sum(sent) < 4 * 24_000


@pytest.mark.parametrize("few", [0, 1000])
def test_components_with_hubs(spark, monkeypatch, few):
    import maskframe.llm.components as m

    monkeypatch.setattr(m, "HUB", 10)
    monkeypatch.setattr(m, "LINKS", 40)
    monkeypatch.setattr(m, "FEW", few)
    r = random.Random(4)
    links = [(500, k) for k in range(100, 160)] + [(k, k + 1) for k in range(60)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(40)] + [(30, 500)]
    root = {x: x for p in links for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["u"]: r["v"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 160)] + [(200, 200), (300, 301), (301, 300)]
    got = {r["u"]: r["v"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {k: 100 for k in range(101, 160)} | {301: 300}


def test_chosen_numbers():
    assert (1 - 0.85**3) ** trees(0.85) <= 1e-5 and (1 - 0.8**3) ** trees(0.8) <= 1e-5
    assert (1 - 0.85**10) ** trees(0.85, 10) <= 1e-5 and least_equal(0.85) == 193
