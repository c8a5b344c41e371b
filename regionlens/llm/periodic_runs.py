"""Operator 13: periodic runs of words, by recompression.

A run is a maximal stretch of words with smallest period q whose length is at least
``max(MIN_LENGTH, MIN_EXPONENT * q)``. Documents are independent, so Spark deals the
rows and every task works through its batches in slices of bounded size:

* Candidates lie on a harmonic grid: for each q the word numbers 0, q, 2q, ... A run of
  period q holds four grid points in a row, so a point is a candidate only if its word
  recurs one, two and three periods on, and so do a few words behind it. For n words
  that are n/1 + n/2 + n/3 + ... cheap comparisons.
* The documents with candidates are turned into a run-length grammar by recompression:
  in turn every block of one symbol becomes a symbol, and every pair of a left-class and
  a right-class symbol does. Equal stretches are parsed alike but for a symbol or two at
  either end, and each round shortens the sequence by a fixed share.
* How far the words at i and i + q agree, forwards and backwards, is asked of the
  grammar: both places climb the levels while they agree and come down where they
  differ, a few symbols a level and one step a block. All queries of a slice take each
  level at once. The answers give the exact run through a candidate.
* Several periods may give one stretch; the smallest is its period (the others are its
  multiples, as the stretch is four of them long).

No suffix array and no pairs: memory is linear in a slice, or in one document where that
is longer than a slice.

Defined results: null, empty and blank texts have no words, no runs and an empty
collapsed text; repeated rows get the same row each, ties of doc_id don't matter; a null
doc_id is kept (and never rewritten); the empty table gives the empty table; columns
besides the two named and those of ``keep`` are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionlens.llm.common import prepared, row_slices, text_list, utf8_rows

MIN_LENGTH = 6
MIN_EXPONENT = 4
#: Text bytes of a slice, and grid points compared at once.
SLICE_BYTES = 1 << 20
GRID_POINTS = 1 << 21
RUNS_TYPE = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Numbers(dict):
    """Numbers words in the order they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


# ------------------------------------------------------------------ candidates
def grid_pairs(n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, q) for every period that a document of so many words has room for."""
    room = np.where(n_words >= MIN_LENGTH, n_words // MIN_EXPONENT, 0)
    doc = np.repeat(np.arange(len(n_words)), room)
    first = np.cumsum(room) - room
    return doc, np.arange(len(doc)) - first[doc] + 1


def grid_candidates(words: np.ndarray, starts: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, q, place in ``words``) of the grid points that may lie in a run, by
    document, q and place."""
    doc, q = grid_pairs(n_words)
    points = (n_words[doc] - 1) // q - 2  # the point three periods on is a word, too
    ends = np.cumsum(points)
    found, at = [], 0
    while at < len(doc):
        begin = ends[at] - points[at]
        stop = max(at + 1, int(np.searchsorted(ends, begin + GRID_POINTS, side="right")))
        count = points[at:stop]
        pair = np.repeat(np.arange(at, stop), count)
        step = np.arange(len(pair)) - (ends[pair] - points[pair] - begin)
        place = starts[doc[pair]] + step * q[pair]
        for lag in (1, 2, 3):
            same = words[place] == words[place + lag * q[pair]]
            pair, place = pair[same], place[same]
        for num, den in ((1, 2), (1, 3), (3, 4)):  # words between the grid points, up to two periods on
            for ahead in (0, 1):
                x = place + q[pair] * num // den + ahead * q[pair]
                same = words[x] == words[x + q[pair]]
                pair, place = pair[same], place[same]
        found.append((pair, place))
        at = stop
    if not found:
        return doc, q, starts[doc]
    pair = np.concatenate([f[0] for f in found])
    return doc[pair], q[pair], np.concatenate([f[1] for f in found])


# ------------------------------------------------------------------ grammar
def left_class(symbols: np.ndarray, turn: int) -> np.ndarray:
    """A coin toss for each symbol, anew in each turn."""
    toss = np.uint64(turn * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF)
    x = (symbols.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + toss
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(40)) & np.uint64(1) == 0


class Grammar:
    """The levels of a run-length grammar over ``words``. A level is (symbols, cuts,
    blocks): ``cuts[k]`` is where symbol k of the next level begins in this one (and the
    end last), ``blocks`` tells whether the next level joins blocks or pairs. The top has
    no cuts. First and last word must occur nowhere else."""

    def __init__(self, words: np.ndarray, least: int = 2) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray | None, bool]] = []
        symbols, fresh, turn, idle = words.astype(np.int64), int(words.max(initial=0)) + 1, 0, 0
        while len(symbols) > max(least, 2) and idle < 8:
            blocks = turn % 2 == 0
            new, cuts, fresh = self._blocks(symbols, fresh) if blocks else self._pairs(symbols, fresh, turn)
            turn += 1
            if len(new) == len(symbols):
                idle += 1
                continue
            idle = 0
            self.levels.append((symbols, cuts, blocks))
            symbols = new
        self.levels.append((symbols, None, False))

    @staticmethod
    def _named(keys: np.ndarray, fresh: int) -> tuple[np.ndarray, int]:
        names, which = np.unique(keys, return_inverse=True)
        return which + fresh, fresh + len(names)

    def _blocks(self, symbols: np.ndarray, fresh: int) -> tuple[np.ndarray, np.ndarray, int]:
        cuts = np.flatnonzero(np.concatenate([[True], symbols[1:] != symbols[:-1], [True]]))
        new, size = symbols[cuts[:-1]], np.diff(cuts)
        many = size > 1
        names, fresh = self._named((new[many] << np.int64(32)) | size[many], fresh)
        new = new.copy()
        new[many] = names
        return new, cuts, fresh

    def _pairs(self, symbols: np.ndarray, fresh: int, turn: int) -> tuple[np.ndarray, np.ndarray, int]:
        left = left_class(symbols, turn)
        forth, back = left[:-1] & ~left[1:], ~left[:-1] & left[1:]
        joined = forth if forth.sum() >= back.sum() else back
        cuts = np.flatnonzero(np.concatenate([[True], ~joined, [True]]))
        new = symbols[cuts[:-1]].copy()
        two = np.diff(cuts) == 2
        at = cuts[:-1][two]
        names, fresh = self._named((symbols[at] << np.int64(32)) | symbols[at + 1], fresh)
        new[two] = names
        return new, cuts, fresh

    def agree(self, x: np.ndarray, y: np.ndarray, forwards: bool) -> np.ndarray:
        """For places x < y (before a word): how many words from them on, or back, agree."""
        x0, x, y = x, x.copy(), y.copy()
        turned = np.zeros(len(x), dtype=np.int64)
        climbing = np.arange(len(x))
        top = len(self.levels) - 1
        for depth in range(top):
            _, cuts, _ = self.levels[depth]
            arrived, todo = [], climbing
            while len(todo):
                kx, ky = np.searchsorted(cuts, x[todo]), np.searchsorted(cuts, y[todo])
                up = (cuts[kx] == x[todo]) & (cuts[ky] == y[todo])
                x[todo[up]], y[todo[up]] = kx[up], ky[up]
                arrived.append(todo[up])
                todo = self._step(depth, x, y, todo[~up], forwards, turned)
            climbing = np.concatenate(arrived) if arrived else climbing[:0]
        turned[climbing] = top
        for depth in range(top, -1, -1):
            todo = here = np.flatnonzero(turned >= depth)
            while len(todo):
                todo = self._step(depth, x, y, todo, forwards, None)
            if depth:
                cuts = self.levels[depth - 1][1]
                x[here], y[here] = cuts[x[here]], cuts[y[here]]
        return x - x0 if forwards else x0 - x

    def _step(self, depth: int, x: np.ndarray, y: np.ndarray, todo: np.ndarray, forwards: bool, turned: np.ndarray | None) -> np.ndarray:
        """Move the queries whose next symbols agree past them (past all that both blocks
        hold); returns those, and notes the depth of the others in ``turned``."""
        symbols, cuts, blocks = self.levels[depth]
        back = 0 if forwards else 1
        same = symbols[x[todo] - back] == symbols[y[todo] - back]
        if turned is not None:
            turned[todo[~same]] = depth
        todo = todo[same]
        if not blocks:
            size = 1
        elif forwards:
            size = np.minimum(*(cuts[np.searchsorted(cuts, z, side="right")] - z for z in (x[todo], y[todo])))
        else:
            size = np.minimum(*(z - cuts[np.searchsorted(cuts, z, side="left") - 1] for z in (x[todo], y[todo])))
        x[todo] += size if forwards else -size
        y[todo] += size if forwards else -size
        return todo


# ------------------------------------------------------------------ runs
def slice_runs(words: np.ndarray, starts: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, start, length, period) of all runs, by document, start and period.
    ``words`` holds a word that occurs nowhere else before, between and after the documents."""
    doc, q, place = grid_candidates(words, starts, n_words)
    if not len(doc):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    # the grammar covers the documents with candidates, and a separator on either side of each
    used = np.unique(doc)
    size = n_words[used] + 1
    shift = np.cumsum(size) - size + 1  # where a document begins in the grammar's words
    which = np.searchsorted(used, doc)
    own = np.arange(size.sum()) + np.repeat(starts[used] - shift, size)
    grammar = Grammar(words[np.append(own, own[-1] + 1)], least=len(used))
    i = place - starts[doc] + shift[which]

    # neighbours on the grid mostly lie in one run: ask for the first of each chain, then for what its run leaves out
    chained = np.zeros(len(i), dtype=bool)
    chained[1:] = (doc[1:] == doc[:-1]) & (q[1:] == q[:-1]) & (i[1:] == i[:-1] + q[1:])
    head = np.flatnonzero(~chained)
    begin, end = stretches(grammar, i[head], q[head])
    of_head = np.cumsum(~chained) - 1
    rest = np.flatnonzero(chained & (i + q > end[of_head]))
    begin2, end2 = stretches(grammar, i[rest], q[rest])
    asked = np.concatenate([head, rest])
    begin, end = np.concatenate([begin, begin2]), np.concatenate([end, end2])
    doc, q, origin = doc[asked], q[asked], shift[which[asked]]
    ok = end - begin >= np.maximum(MIN_LENGTH, MIN_EXPONENT * q)
    doc, q, begin, end = doc[ok], q[ok], (begin - origin)[ok], (end - origin)[ok]
    order = np.lexsort((q, end, begin, doc))
    doc, q, begin, end = doc[order], q[order], begin[order], end[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])
    doc, q, begin, end = doc[new], q[new], begin[new], end[new]
    order = np.lexsort((q, begin, doc))
    return doc[order], begin[order], (end - begin)[order], q[order]


def stretches(grammar: Grammar, i: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[begin, end) of the longest stretches around i of which words q apart agree."""
    return i - grammar.agree(i, i + q, False), i + q + grammar.agree(i, i + q, True)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """A tenth of the documents, chosen by a checksum of doc_id, made periodic from some word on."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    cycle = words[a : a + p]
    return words[:a] + (cycle * ((n - a) // p + 1))[: n - a]


def text_runs(doc_ids: list, texts: list[bytes], rewrite: Callable | None = None) -> tuple[list[int], tuple[np.ndarray, ...], list[bytes]]:
    """(words of each text, runs as from ``slice_runs``, collapsed texts)."""
    split = [t.split() for t in texts]  # bytes: at space and \x09-\x0D only
    if rewrite:
        split = [rewrite(d, w) for d, w in zip(doc_ids, split, strict=True)]
    n_words = np.array([len(w) for w in split], dtype=np.int64)
    starts = np.cumsum(n_words + 1) - n_words
    numbers = Numbers()
    words = np.full(int(starts[-1] + n_words[-1] + 1) if len(split) else 1, -1, dtype=np.int64)
    for at, w in zip(starts.tolist(), split, strict=True):
        words[at : at + len(w)] = [*map(numbers.__getitem__, w)]
    gaps = np.flatnonzero(words < 0)
    words[gaps] = len(numbers) + np.arange(len(gaps))
    doc, start, length, period = slice_runs(words, starts, n_words)

    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, starts[doc] + start + period, 1)
    np.add.at(edge, starts[doc] + start + length, -1)
    dropped = np.cumsum(edge) > 0
    hit = set(doc.tolist())
    left = []
    for d, (at, w) in enumerate(zip(starts.tolist(), split, strict=True)):
        if d in hit:
            w = [x for x, gone in zip(w, dropped[at : at + len(w)].tolist(), strict=True) if not gone]
        left.append(b" ".join(w))
    return n_words.tolist(), (doc, start, length, period), left


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rewrite: Callable | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every document's periodic runs: doc_id, n_words, runs (by start, then period),
    collapsed (the words without those that a run repeats, one space between) and the
    columns of ``keep``. ``rewrite`` (doc_id, words) gives other words to search."""
    prepared(docs.sparkSession)
    names = [f"k{i}" for i in range(len(keep))]
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"), *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)])
    extra = "".join(f", {n} {source.schema[n].dataType.simpleString()}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in row_slices(utf8_rows(batch.column("t"))[1], SLICE_BYTES):
                rows = batch.slice(a, b - a)
                n_words, (doc, *found), left = text_runs(rows.column("doc_id").to_pylist(), text_list(rows.column("t")), rewrite)
                offsets = np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32)
                fields = pa.StructArray.from_arrays([pa.array(f, pa.int64()) for f in found], names=["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), pa.array(n_words, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), fields), pa.array(left, pa.binary()).cast(pa.string()), *[rows.column(n) for n in names]],
                    names=["doc_id", "n_words", "runs", "collapsed", *names],
                )

    got = source.mapInArrow(run, f"doc_id long, n_words long, runs {RUNS_TYPE}, collapsed string{extra}")
    return got.select("doc_id", "n_words", "runs", "collapsed", *[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)])


def run_digest(found: DataFrame) -> DataFrame:
    """``periodic_runs`` as numbers and digests: how many runs, the longest (ties: first,
    then smallest period), its exponent in thousandths, and sha256 of all runs and of the
    collapsed text."""
    best = F.element_at(F.sort_array(F.transform("runs", lambda r: F.struct((-r["length"]).alias("size"), r["start"].alias("start"), r["period"].alias("period")))), 1)
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    return found.withColumn("best", F.when(F.size("runs") > 0, best)).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.size")).alias("length"),
        F.col("best.period").alias("period"),
        F.expr("-1000 * best.size div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
