"""Language identification by a mixture of languages for each document.

Training counts hashed byte n-grams of letters for each language over a bounded sample of labelled rows and smooths them.
The sample is bounded for each language, so a rare one is learned from all its rows however large the table is; and only
the ``LANGUAGES`` labels with most rows are learned (ties to the smaller name), so a dirty label column can't fill the driver.
A document is a mixture: expectation-maximisation estimates the languages' proportions from its n-grams' likelihoods, and
the set of languages is the one with the best penalised likelihood. The sets tried are nested: languages enter by their
proportion in the full mixture. The prediction is the selected set's largest language, the score its proportion.

Texts are lower-cased whole; characters that are no letters separate words. A null text, or one without a letter, is
``und`` with score 0; so is every text where no labelled row was learned from. Equal proportions go to the smaller name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, kernels

#: Labelled rows of a language that are learned from, about; a fixed hash of their ids and texts picks them. And the most
#: languages learned: each is BUCKETS floats in the model, so it has 50 MB at most.
SAMPLE, LANGUAGES = 5_000, 200
BUCKETS, SIZES = 1 << 16, (2, 3)
#: Neighbouring n-grams overlap: so much of the log likelihood counts as independent evidence.
EVIDENCE = 1 / 4
STEPS, ALPHA, UND = 25, 0.5, "und"
_CHUNK = 1 << 19


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """n-gram buckets of each text, one text after another, where each text's begin (one more at the end), and whether it has a letter."""
    low = pc.utf8_lower(column.fill_null(""))
    has = pc.match_substring_regex(low, r"\p{L}").to_numpy(zero_copy_only=False)
    data, start, end = kernels.texts(low)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(start) + 1, np.int64), has
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    clean = np.where(letter, data, 32).astype(np.uint32)
    out = []
    owner = np.repeat(np.arange(len(start)), end - start)
    lo, hi = int(start[0]), int(end[-1])
    clean, letter = clean[lo:hi], letter[lo:hi]
    for size in SIZES:
        n = len(clean) - size + 1
        if n < 1:
            continue
        code = np.zeros(n, np.uint32)
        for k in range(size):
            code = code * np.uint32(257) + clean[k : k + n]
        inside = owner[:n] == owner[size - 1 :]
        # at most one blank, at either end
        inside &= letter[: n] | letter[size - 1 :]
        for k in range(1, size - 1):
            inside &= letter[k : k + n]
        at = np.flatnonzero(inside)
        bucket = ((code[at] * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.int64)
        out.append((owner[at], bucket))
    who = np.concatenate([o for o, _ in out]) if out else np.zeros(0, np.int64)
    what = np.concatenate([b for _, b in out]) if out else np.zeros(0, np.int64)
    order = np.argsort(who, kind="stable")
    return what[order], np.searchsorted(who[order], np.arange(len(start) + 1)), has


def _chunks(batch: pa.RecordBatch, column: int):
    from .neardup import chunks

    return chunks(batch, column)


def learn(labelled: DataFrame, text_col: str, lang_col: str, id_col: str, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages, log likelihoods by language and bucket) from about ``sample`` rows of each language."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).cast("string").alias("id"))
    most = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(LANGUAGES)
    share = {r["lang"]: min(1.0, sample / r["n"]) for r in most.collect()}  # LANGUAGES rows at most
    if not share:
        return [], np.zeros((0, BUCKETS), np.float32)
    kept = F.element_at(F.create_map(*[F.lit(x) for name, s in share.items() for x in (name, int((1 << 30) * s))]), F.col("lang"))
    rows = rows.where(F.pmod(F.xxhash64("id", "text", F.lit(3)), F.lit(1 << 30)) < F.coalesce(kept, F.lit(0)))

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in _chunks(batch, 1):
                what, at, _ = grams(part.column(1))
                names = part.column(0).to_pylist()
                for name in set(names):
                    own = np.concatenate([what[at[k] : at[k + 1]] for k, x in enumerate(names) if x == name])
                    total[name] = total.get(name, 0) + np.bincount(own, minlength=BUCKETS)
        for name, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["lang", "bucket", "n"])

    counts = rows.select("lang", "text").mapInArrow(run, "lang string, bucket int, n long")
    # at most LANGUAGES languages and BUCKETS numbers each
    got = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(got.column("lang").to_pylist()))
    model = np.full((len(names), BUCKETS), ALPHA, np.float32)
    if names:
        row = np.searchsorted(np.array(names, object), np.array(got.column("lang").to_pylist(), object))
        model[row, got.column("bucket").to_numpy()] += got.column("n").to_numpy()
        model = np.log(model / model.sum(axis=1, keepdims=True, dtype=np.float64)).astype(np.float32)
    return names, model


def em(like: np.ndarray, counts: np.ndarray, start: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Proportions and mean log likelihood of a mixture; ``like`` by n-gram and language."""
    share, n, last = start, counts.sum(), -np.inf
    for _ in range(steps):
        mixed = like @ share
        now = float(counts @ np.log(mixed)) / n
        share = share * (like.T @ (counts / mixed)) / n
        if now - last < 1e-5:
            break
        last = now
    return share / share.sum(), now


def mixture(buckets: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Proportions of all languages in one document, zero outside the selected set; ``model`` by bucket and language."""
    what, counts = np.unique(buckets, return_counts=True)
    logs = model[what].astype(np.float64)
    counts = counts.astype(np.float64)
    n, k = counts.sum(), logs.shape[1]
    out = np.zeros(k)
    single = counts @ logs / n
    top = int(np.argmax(single))
    out[top] = 1.0
    if k == 1:
        return out
    base = logs.max(axis=1, keepdims=True)
    like = np.exp(logs - base)
    shift = float(counts @ base[:, 0]) / n
    share, mean = em(like, counts, np.full(k, 1 / k))
    cost = np.log(max(n * EVIDENCE, 2.0)) / 2
    # no set can beat the full mixture's likelihood, and every larger set costs one more parameter at least
    best = single[top] * n * EVIDENCE
    if (mean + shift) * n * EVIDENCE - cost <= best:
        return out
    order = np.argsort(-share, kind="stable")
    for size in range(2, k + 1):
        own = order[:size]
        part, mean = em(like[:, own], counts, share[own] / share[own].sum() if share[own].sum() else np.full(size, 1 / size))
        value = (mean + shift) * n * EVIDENCE - cost * (size - 1)
        if value > best:
            best, out = value, np.zeros(k)
            out[own] = part
    return out


def predict(docs: DataFrame, names: list[str], model: np.ndarray, text_col: str, keep: list, with_text: bool = False) -> DataFrame:
    """``keep`` columns (by alias) with lang_pred, score and langs (the selected set with proportions); ``with_text`` adds the text as ``__text``.

    The added columns get underscores where a kept one has their name.
    """
    from pyspark.sql import types as T

    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    added = [common.unused(rows, x) for x in ("lang_pred", "score", "langs")]
    by_bucket = np.ascontiguousarray(model.T)
    shared = docs.sparkSession.sparkContext.broadcast(by_bucket) if names else None

    def run(batches):
        for batch in batches:
            place = batch.num_columns - 1
            kept = place + with_text
            for part in _chunks(batch, place):
                what, at, has = grams(part.column(place))
                pred, score, sets = [], [], []
                for k in range(part.num_rows):
                    own = what[at[k] : at[k + 1]]
                    if not names or not has[k] or not len(own):
                        pred.append(UND if not names or not has[k] else names[0])
                        score.append(0.0)
                        sets.append([])
                        continue
                    share = mixture(own, shared.value)
                    top = int(np.argmax(share))
                    pred.append(names[top])
                    score.append(min(1.0, float(share[top])))
                    sets.append([{"lang": names[j], "share": float(share[j])} for j in np.flatnonzero(share > 0)])
                kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
                yield pa.RecordBatch.from_arrays([*part.columns[:kept], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, kind)], [*part.schema.names[:kept], *added])
            kernels.settle()

    langs = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())]))
    schema = T.StructType([*(rows.schema.fields if with_text else rows.schema.fields[:-1]), *[T.StructField(c, kind) for c, kind in zip(added, (T.StringType(), T.DoubleType(), langs), strict=True)]])
    return rows.mapInArrow(run, schema)


def held_out(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def usable(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"):
    """Whether a row can be learned from: it has a text and a label, and isn't held out."""
    return ~F.coalesce(held_out(id_col), F.lit(False)) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()


def identify(docs: DataFrame, keep: list, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, with_text: bool = False) -> DataFrame:
    """Learn from the labelled rows that aren't held out, then predict every row."""
    labelled = docs.where(usable(docs, id_col, text_col, lang_col))
    names, model = learn(labelled, text_col, lang_col, id_col, sample)
    return predict(docs, names, model, text_col, keep, with_text)


def op3_language_id(spark, sf_dir) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    keep = [F.col("doc_id"), F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out")]
    return identify(docs, keep).select("doc_id", "held_out", "lang_pred", "score", F.size("langs").alias("n_langs"))
