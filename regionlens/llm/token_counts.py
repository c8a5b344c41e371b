"""Operator 6: token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton of the vocabulary enumerates, at every place of a text, the
pieces that end there; a dynamic programme carries the best score and its number of
pieces up to each place (no back pointers). Ties go as in the public unigram tokenizers:
at a place the piece that starts first is kept unless another scores strictly more, and
a character that is no piece of its own may be taken as unknown, for the least score of
the vocabulary less 10; it counts one piece for each of its UTF-8 bytes (byte fallback).

Spaces are written as U+2581, with one put before a non-empty text. No piece holds a
U+2581 behind another character, nor a line feed (checked when the vocabulary is read),
so the search of a text falls exactly into those of its words; words repeat, and each
worker keeps a bounded memo. Whole texts are counted, in one pass without a shuffle.

The vocabulary comes from a public model file whose path is a parameter; the driver
reads it once, and its pieces and scores are broadcast (32,000 of them).

Control, unknown and byte pieces (``<s>``, ``<unk>``, ``<0x0A>``) are symbols of their own and
never matched in a text: their strings there are ordinary text, as in sentencepiece.

Defined results: null and empty texts have 0 tokens and score 0; rows are independent,
so repeated rows and other columns (clashing names included, none is read) don't matter;
the empty table gives the empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionlens.llm.common import prepared

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
MEMO_ENTRIES = 200_000
MEMO_CHARS = 48
NEVER = float("-inf")
PARTS = re.compile(r" *[^ \n]+| +|\n")


def unigram_vocabulary(path: str) -> list[tuple[str, float]]:
    """The normal pieces of a sentencepiece model file and their scores."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [
        (sp.id_to_piece(i), sp.get_score(i))
        for i in range(sp.get_piece_size())
        if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))
    ]


class CountViterbi:
    def __init__(self, vocabulary: list[tuple[str, float]]) -> None:
        inner = re.compile(f"[^{SPACE}]{SPACE}|[ \n]")
        if any(inner.search(piece) for piece, _ in vocabulary):
            raise ValueError("a piece spans words")
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self.single = {piece for piece, _ in vocabulary if len(piece) == 1}
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.memo: dict[str, tuple[int, float]] = {}

    def search(self, text: str) -> tuple[int, float]:
        """(pieces, score) of the best path over ``text``."""
        n = len(text)
        best, pieces = [0.0] + [NEVER] * n, [0] * (n + 1)
        at = 1  # the place whose matches are coming

        def close(upto: int) -> None:
            """Offer the unknown character to the places before ``upto``."""
            nonlocal at
            while at < upto:
                char = text[at - 1]
                if char not in self.single and best[at - 1] + self.unknown > best[at]:
                    best[at], pieces[at] = best[at - 1] + self.unknown, pieces[at - 1] + len(char.encode())
                at += 1

        for last, (length, score) in self.automaton.iter(text):  # longest first at each place
            end = last + 1
            if end > at:
                close(end)
            start = end - length
            if best[start] + score > best[end]:
                best[end], pieces[end] = best[start] + score, pieces[start] + 1
        close(n + 1)
        return pieces[n], best[n]

    def part(self, text: str) -> tuple[int, float]:
        got = self.search(text.replace(" ", SPACE))
        if len(text) <= MEMO_CHARS:
            if len(self.memo) >= MEMO_ENTRIES:
                self.memo.clear()
            self.memo[text] = got
        return got

    def count(self, text: str) -> tuple[int, float]:
        """(tokens, score) of a whole text."""
        if not text:
            return 0, 0.0
        known, make = self.memo.get, self.part
        got = [known(p) or make(p) for p in PARTS.findall(" " + text.replace(SPACE, " "))]
        return sum([g[0] for g in got]), sum([g[1] for g in got])


_COUNTERS: dict[int, CountViterbi] = {}


def counter(vocabulary: list[tuple[str, float]]) -> CountViterbi:
    """One counter per worker process and vocabulary."""
    key = hash(tuple(vocabulary))
    if key not in _COUNTERS:
        _COUNTERS[key] = CountViterbi(vocabulary)
    return _COUNTERS[key]


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens long, score double) of every whole text."""
    spark = prepared(docs.sparkSession)
    shared = spark.sparkContext.broadcast(unigram_vocabulary(path))
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        viterbi = counter(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                got = [viterbi.count(t or "") for t in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.float64())], schema=out)

    return docs.select(F.col(doc_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, "doc_id long, n_tokens long, score double")
