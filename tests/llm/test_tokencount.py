import random

import pytest

from maskframe.llm.tokencount import VOCABULARY, Counter, op1_token_counts, read_vocabulary, token_counts


def exact(vocabulary, by_bytes):
    """The tokenizers library's own unigram model over the same pieces."""
    from tokenizers import Tokenizer, pre_tokenizers
    from tokenizers.models import Unigram

    t = Tokenizer(Unigram(vocabulary, 0, by_bytes))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids) if text else 0


def samples(seed):
    r = random.Random(seed)
    alphabet = "aaaabcdeethiosn  \n.,!éßñ漢字🙂▁<0x>"
    out = ["", " ", "  a", "a  b ", "▁", "▁a", "\n\n", "<0x0A>", "<s> </s>", "é" * 300, "漢字漢字 漢", "▁▁x", "a\tb\r\nc", "x" * 500]
    return out + ["".join(r.choice(alphabet) for _ in range(r.randint(1, 120))) for _ in range(600)]


def test_equals_the_library_on_a_public_vocabulary(spark):
    vocabulary = read_vocabulary(VOCABULARY)
    want = exact(vocabulary, True)
    counter = Counter(vocabulary)
    texts = samples(1) + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    assert [counter.text(t) for t in texts] == [want(t) for t in texts]


@pytest.mark.parametrize("seed", range(6))
def test_ties_and_unknown_runs(seed):
    r = random.Random(seed)
    pieces = sorted({"".join(r.choice("▁abc") for _ in range(r.randint(1, 4))) for _ in range(14)})
    vocabulary = [("<unk>", 0.0)] + [(p, -float(r.randint(1, 4))) for p in pieces]
    counter, want = Counter(vocabulary), exact(vocabulary, False)
    for _ in range(400):
        text = "".join(r.choice("abcd ") for _ in range(r.randint(1, 25)))
        assert counter.text(text) == want(text), text


def test_rows_and_columns(spark, tmp_path):
    rows = [(1, None, "n"), (2, "", None), (None, "the end", "x"), (2, "the end", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = token_counts(docs).collect()
    assert [r["n_tokens_"] for r in got] == [0, 0, 4, 4], got and [r["n_tokens"] for r in got] == ["n", None, "x", "y"]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(str, op1_token_counts(spark, str(tmp_path)).collect())) == sorted(["Row(doc_id=1, n_tokens=0, n_chars=0)", "Row(doc_id=2, n_tokens=0, n_chars=0)", "Row(doc_id=None, n_tokens=4, n_chars=7)", "Row(doc_id=2, n_tokens=4, n_chars=7)"])
    assert token_counts(docs.limit(0)).count() == 0


def test_very_long_words():
    """Held figures are cut while a word goes on; counts are those of the whole word."""
    vocabulary = read_vocabulary(VOCABULARY)
    r = random.Random(2)
    word = "".join(r.choice("abcdeé漢_") for _ in range(60_000))
    counter = Counter(vocabulary)
    counts = []
    for held in (1 << 20, 100, counter.longest + 1):
        counter.held = held
        counts.append(counter.search("▁" + word))
    assert counts[0] == counts[1] == counts[2] == exact(vocabulary, True)(word)
