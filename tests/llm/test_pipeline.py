import corpus_pipeline as p
import pytest
from maskframe.llm import common


def test_stages_on_given_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = common.table(spark, sf, "documents")
    columns, kept = docs.columns, [docs.count()]
    for name, stage in p.STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf), name)
        assert docs.columns == columns
        kept.append(docs.count())
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0
    mixed = p.STAGES[-1][1](spark, docs, sf)
    assert mixed.count() > 0 and {"doc_id", "taken"} <= set(mixed.columns)


@pytest.mark.parametrize("k", range(5))
def test_nulls_and_empty_tables(spark, k):
    sf = "/root/testdata/sf0.001"
    rows = [(1, "one two three four five six seven", "en", "s", 3, "x", 1, "l", 2, 3), (None,) * 10, (2, "", "en", "s", 0, "y", 1, "l", 2, 3), (3, "1 2 3", None, None, 5, "z", None, None, None, None), (1, "one two three four five six seven", "en", "s", 3, "x", 1, "l", 2, 3)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, gone_id int, left string, taken int, bad_id int"
    docs = spark.createDataFrame(rows, schema)
    out = p.STAGES[k][1](spark, docs, sf)
    assert out.collect() is not None
    assert k == 4 or out.columns == docs.columns
    assert p.STAGES[k][1](spark, docs.limit(0), sf).count() == 0


def test_five_stages_in_order():
    assert [n for n, _ in p.STAGES] == ["language_id", "near_dedup", "suffix_dedup", "decontamination", "mixing"] and p.ORACLE_SQL is None


def test_near_dedup_by_rows_not_by_ids(spark):
    """Groups go by texts: null and repeated ids neither join rows nor keep copies apart."""
    text = lambda a, n=60: " ".join(f"{a}{k}" for k in range(n))
    rows = [(1, text("a")), (None, text("a") + " more"), (None, text("b")), (None, text("c")), (7, text("d")), (7, text("d")), (None, text("e")), (None, text("e"))]
    rows += [(8, text("f")), (8, text("g")), (9, text("f") + " x"), (None, ""), (None, None), (8, ""), (3, text("h") + " y"), (2, text("h"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, p.near_dedup(spark, docs, "").collect()), key=str)
    want = [(1, text("a")), (None, text("b")), (None, text("c")), (7, text("d")), (None, text("e")), (8, text("f")), (8, text("g")), (None, ""), (None, None), (8, ""), (2, text("h"))]
    assert got == sorted(want, key=str)


def brute_run(rows, items):
    """The five stages in plain Python over (doc_id, text, lang, source): (doc_id, text left, size, target, words taken)."""
    from .test_decontaminate import brute as contaminated
    from .test_mixing import brute as mixed
    from .test_neardup import brute as grouped

    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    number = list(enumerate(rows))
    component = {k: c for k, _, c, _ in grouped([(k, r[1]) for k, r in number], 5, 80)}
    best = {}
    for k, r in number:
        rank = (r[0] is None, r[0] or 0, k)
        best[component[k]] = min(best.get(component[k], (rank, r)), (rank, r), key=lambda x: x[0])
    rows = [r for _, r in best.values()]
    first = {}
    order = lambda r: 2**63 - 1 if r[0] is None else r[0]
    for r in rows:
        raw = r[1].encode()
        for k in range(len(raw) - 49):
            first[raw[k : k + 50]] = min(first.get(raw[k : k + 50], order(r)), order(r))
    left = []
    for r in rows:
        raw = r[1].encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 49):
            if first[raw[k : k + 50]] < order(r):
                gone[k : k + 50] = b"\x01" * 50
        text = bytes(b for b, g in zip(raw, gone) if not g).decode("utf-8", "ignore") if any(gone) else r[1]
        if text.strip(" "):
            left.append((r[0], text, r[2], r[3]))
    bad = {d for d, _ in contaminated([(k, r[1]) for k, r in enumerate(left)], items)}
    left = [r for k, r in enumerate(left) if k not in bad]
    by_id = {r[0]: r for r in left}
    return sorted(((d, by_id[d][1], n, t, taken) for d, n, _, t, taken in mixed([(r[0], r[1], r[3]) for r in left]) if taken > 0), key=str), len(left)


@pytest.mark.parametrize("seed", [1, 2])
def test_run_against_brute_force(spark, tmp_path, seed):
    """Planted copies, passages, benchmark items and texts without letters: run()'s rows are those of the plain version."""
    import random

    r = random.Random(seed)
    words = {"en": [f"w{k}the" for k in range(300)], "es": [f"ñ{k}el" for k in range(300)]}
    some = lambda lang, n: [r.choice(words[lang]) for _ in range(n)]
    items = [(k, " ".join(f"b{k}x{j}" for j in range(r.randint(5, 30)))) for k in range(8)]
    passages = [" ".join(some("es", 20)) + " é" for _ in range(3)]
    rows = []
    for i in range(90):
        lang = r.choice(["en", "es"])
        text = some(lang, r.randint(8, 120))
        kind = r.random()
        if kind < 0.25 and rows:  # a copy, exact or with an edit
            text = r.choice(rows)[1].split(" ")
            if r.random() < 0.6 and len(text) > 3:
                text[r.randrange(len(text))] = "edit"
        elif kind < 0.45:
            text[3:3] = r.choice(passages).split(" ")
        elif kind < 0.6:
            text[5:5] = r.choice(items)[1].split(" ")
        rows.append((i, " ".join(text), lang if r.random() < 0.8 else None, r.choice(["a", "b", "c", None])))
    rows += [(200, None, "en", "a"), (201, "", "en", "a"), (202, "12 34 !", "es", "b"), (203, passages[0], "es", "c"), (None, " ".join(some("en", 40)), None, "a"), (204, items[0][1], None, "b")]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) as long) AS n_chars").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = p.run(spark, str(tmp_path)).collect()
    want, kept = brute_run(rows, items)
    assert sorted(((x["doc_id"], x["text"], x["size"], round(x["target"], 6), x["taken"]) for x in got), key=str) == want
    assert all(x["n_chars"] == len(x["text"]) for x in got) and 10 < len(want) <= kept < 80


def test_no_labels_reject_nothing(spark):
    rows = [(1, "some words", None), (2, "...", None), (3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert [x["doc_id"] for x in p.language_id(spark, docs, "").collect()] == [1]
