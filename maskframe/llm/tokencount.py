"""Token counts under a unigram vocabulary, by a Viterbi search that keeps only score and count.

An Aho-Corasick automaton enumerates all vocabulary pieces in a word; the dynamic programme carries, for each position,
the best score, the number of tokens on that path and whether it ends in an unknown character. Rules are those of a
unigram model behind a metaspace split: blanks become U+2581, one is put before a text that doesn't begin with one, and
each starts a word of its own; pieces' scores are added in double precision; of equal scores the path whose last piece
begins first wins; a character that is no piece may be an unknown of (smallest score - 10); neighbouring unknowns are one
token, or one for each UTF-8 byte where the vocabulary has all byte pieces.

The vocabulary comes from a sentencepiece model file, whose path is a parameter; the driver reads it and its pieces go to
the tasks. The installed one is a BPE model whose scores are negative merge ranks, not log probabilities: counts under it
are those of a unigram search over its pieces and ranks, and not the counts of the BPE model's own tokenizer. Null and
empty texts have 0 tokens. Memory for a word doesn't grow with its length beyond the word itself.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

VOCABULARY = os.path.realpath("/opt/tokenizers/piece_bpe_32k.model")
MARK, PENALTY = "▁", 10.0
#: Words whose count a worker remembers; the memory starts afresh beyond that. Longer words aren't remembered.
REMEMBERED, LONGEST = 500_000, 64


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) by id."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


class Counter(dict):
    """Tokens of a word, by word; missing ones are searched for and kept."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        super().__init__()
        self.pieces = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.pieces.add_word(piece, (len(piece), score))
        self.pieces.make_automaton()
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min((s for _, s in vocabulary), default=0.0) - PENALTY
        known = {p for p, _ in vocabulary}
        self.longest = max((len(p) for p in known), default=1)
        self.held = 1 << 16 if self.longest < 1 << 15 else 2 * self.longest
        self.by_bytes = all(f"<0x{b:02X}>" in known for b in range(256))

    def __missing__(self, word: str) -> int:
        if len(word) > LONGEST:
            return self.search(word)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = n = self.search(word)
        return n

    def search(self, word: str) -> int:
        size = len(word)
        best, count, loose, base = [0.0], [0], [False], 0
        found = self.pieces.iter(word)
        end, piece = next(found, (size, None))
        for at in range(size):
            top, tokens, open_ = None, 0, False
            while end == at:  # longest first: the earliest start wins a tie
                length, score = piece
                start = at + 1 - length - base
                candidate = score + best[start]
                if top is None or candidate > top:
                    top, tokens, open_ = candidate, count[start] + 1, False
                end, piece = next(found, (size, None))
            c = word[at]
            if c not in self.single:
                candidate = self.unknown + best[at - base]
                if top is None or candidate > top:
                    top, open_ = candidate, True
                    tokens = count[at - base] + (len(c.encode("utf-8", "surrogatepass")) if self.by_bytes else 0 if loose[at - base] else 1)
            best.append(top)
            count.append(tokens)
            loose.append(open_)
            if len(best) > self.held:  # only the longest piece looks back; very long words need no more memory than that
                gone = len(best) - self.longest - 1
                del best[:gone], count[:gone], loose[:gone]
                base += gone
        return count[size - base]

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        words = text.replace(MARK, " ").split(" ")
        if not words[0]:  # the text begins with its own mark
            del words[0]
        return sum(map(self.__getitem__, [MARK + w for w in words]))


_counters: dict[tuple, Counter] = {}


def token_counts(docs: DataFrame, text_col: str = "text", *, vocabulary: str = VOCABULARY, name: str = "n_tokens") -> DataFrame:
    """``docs`` with the token count of the whole text; other columns pass through, whatever their names."""
    name = common.unused(docs, name)
    pieces = read_vocabulary(vocabulary)
    key = (vocabulary, len(pieces), zlib.crc32(repr(pieces).encode("utf-8", "surrogatepass")))
    shared = docs.sparkSession.sparkContext.broadcast(pieces)  # a vocabulary: some MB, whatever the tables' size

    def run(batches):
        if key not in _counters:
            _counters[key] = Counter(shared.value)
        counter = _counters[key]
        place = docs_columns.index(text_col)
        for batch in batches:
            n = np.fromiter((counter.text(t.as_py()) for t in batch.column(place)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n)], [*batch.schema.names, name])

    from pyspark.sql import types as T

    docs_columns = docs.columns
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def op1_token_counts(spark, sf_dir) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs).select("doc_id", "n_tokens", F.coalesce(F.char_length("text"), F.lit(0)).cast("long").alias("n_chars"))
