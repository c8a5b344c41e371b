"""Operator 2: exact substring dedup by two-stage suffix sorting.

Every byte that lies in a string of ``LENGTH`` bytes which also starts somewhere else
is removed. The work is cut so that equal strings meet and others don't:

* Each window of ``LENGTH`` bytes is owned by the smallest of its ``GRAM``-byte hashes
  (leftmost of equals), its anchor. Equal windows have equal anchors at equal offsets.
  Windows in a row with the same anchor form a run; its bytes are the run's context.
* Runs are counted by anchor. An anchor seen once has no repeated window.
* The distinct contexts of the other anchors are fetched from the texts, dealt by anchor
  and suffix-sorted in buffers of bounded size: only suffixes smaller than their
  successors are sorted directly, the rest is induced by one scan over the buckets of
  first bytes, and adjacent common prefixes of ``LENGTH`` show the repeated windows (a
  context counts as often as it occurs).
* An anchor with more than ``HOT_CONTEXTS`` distinct contexts (the edge of a passage that
  very many documents share) doesn't fit a buffer. Its contexts are cut into blocks of
  ``BLOCKS[0]`` windows, which share a core of bytes; the distinct blocks whose core
  recurs are dealt by core and suffix-sorted in the same way. A core with too many
  distinct blocks is cut again, down to single windows, where a group is one string. So
  every repeated window is found by the sort, whatever the size of its group.

Only anchors (one per about 85 bytes) are shuffled, and deflated texts twice: to fetch
contexts and to cut the spans. Contexts and blocks are told apart by 64 bits twice (anchor
and context, core and block); windows are compared byte by byte.

Defined results: a null text is empty; texts shorter than ``LENGTH`` keep everything;
rows equal in doc_id and text are separate places, so their long strings repeat; a null
doc_id is a value like any other.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionlens.llm.common import packed_texts, prepared, row_slices, store, text_hash, utf8_rows
from regionlens.llm.shingles import mixed, powers

LENGTH = 200
GRAM = 32
HOT_CONTEXTS = 1000
#: Windows of a block, level by level; the last level is 1, whose groups can't be too large.
BLOCKS = (8, 1)
BUFFER = 512 << 10
#: Stands for a null doc_id.
NO_DOC = -(1 << 63)
_NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)
_PLACE = np.uint64((1 << 22) - 1)


def gram_hashes(sums: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all strings of ``width`` bytes, from the prefix sums of a text."""
    _, inverse = powers(len(sums))
    n = len(sums) - width
    return mixed((sums[width:] - sums[:n]) * inverse[:n])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours: block-wise prefix and suffix minima."""
    n = len(x) - width + 1
    rows = -(-len(x) // width)
    padded = np.full(rows * width, _NEVER, dtype=np.uint64)
    padded[: len(x)] = x
    grid = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def runs_of(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, start in its text, windows, anchor hash, context hash) of every run in ``raw``,
    whose rows begin at ``offsets``; at most 2^22 bytes."""
    if len(raw) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    power, inverse = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=sums[1:])
    hashes = gram_hashes(sums, gram)
    ranked = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    least = sliding_least(ranked, length - gram + 1)
    n = len(least)
    row = np.searchsorted(offsets, np.arange(n), side="right") - 1
    valid = np.arange(n) + length <= offsets[row + 1]
    begins = valid.copy()
    begins[1:] &= (least[1:] != least[:-1]) | ~valid[:-1] | (row[1:] != row[:-1])
    start = np.flatnonzero(begins)
    ends = valid.copy()
    ends[:-1] &= begins[1:] | ~valid[1:]
    last = np.flatnonzero(ends)
    stop = last + length
    # a second hash family for contexts: other byte values, same powers
    other = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(mixed(raw.astype(np.uint64) + np.uint64(977)) * power[: len(raw)], out=other[1:])
    context = mixed((other[stop] - other[start]) * inverse[start] + (stop - start).astype(np.uint64))
    anchor = hashes[(least[start] & _PLACE).astype(np.int64)]
    return row[start], start - offsets[row[start]], last - start + 1, anchor.view(np.int64), context.view(np.int64)


def anchor_rows(docs: DataFrame, doc_id: str, text: str, length: int, gram: int) -> DataFrame:
    """(doc_id, th, start, windows, h, c): every run of every text."""
    prepared(docs.sparkSession)
    names = ("doc_id", "th", "start", "windows", "h", "c")
    piece = 1 << 20

    def pieces(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, shift of its start, bytes, offsets): rows in groups, a long row in
        pieces that overlap so that each window is in one of them."""
        for a, b in row_slices(offsets, piece):
            lo, hi = int(offsets[a]), int(offsets[b])
            if hi - lo <= 2 * piece:
                yield a, 0, raw[lo:hi], offsets[a : b + 1] - lo
                continue
            for at in range(lo, hi - length + 1, piece):
                end = min(hi, at + piece + length - 1)
                yield a, at - lo, raw[at:end], np.array([0, end - at], dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8_rows(batch.column(2))
            for first, shift, part, cuts in pieces(raw, offsets):
                row, start, windows, h, c = runs_of(part, cuts, length, gram)
                if len(row):
                    at = pa.array(row + first)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(at), batch.column(1).take(at), pa.array(start + shift, pa.int64()), pa.array(windows, pa.int32()), pa.array(h, pa.int64()), pa.array(c, pa.int64())], names=list(names)
                    )

    source = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_DOC)), text_hash(text), F.col(text).cast("string")).where(F.octet_length(F.col(text).cast("string")) >= length)
    return source.mapInArrow(run, "doc_id long, th long, start long, windows int, h long, c long")


def suffix_order(text: bytes, depth: int, wanted: np.ndarray) -> np.ndarray:
    """The ``wanted`` suffixes of ``text`` in the order of their first ``depth`` bytes, by
    two-stage sorting. With them come those that follow them up to the next one that is
    sorted directly, as a suffix gets its place from its successor's."""
    t = np.frombuffer(text, dtype=np.uint8)
    n = len(t)
    # a suffix is smaller than its successor if the next different byte is larger
    rise = np.zeros(n, dtype=bool)
    differ = np.flatnonzero(t[1:] != t[:-1])
    up = t[differ + 1] > t[differ]
    following = np.searchsorted(differ, np.arange(n))
    inside = following < len(differ)
    rise[inside] = up[following[inside]]
    last = wanted.copy()
    last[:-1] &= ~wanted[1:]
    last = np.flatnonzero(last)
    sorted_first = np.concatenate([np.flatnonzero(rise), [n - 1]])
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, last, 1)
    np.add.at(edge, sorted_first[np.searchsorted(sorted_first, last)] + 1, -1)
    wanted = wanted | (np.cumsum(edge[:n]) > 0)
    direct = sorted(np.flatnonzero(rise & wanted).tolist(), key=lambda i: text[i : i + depth])
    direct = np.array(direct, dtype=np.int64)
    bounds = np.searchsorted(t[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    if wanted[-1]:
        induced[t[-1]].append(np.array([n - 1], dtype=np.int64))
    out = [np.zeros(0, np.int64)]
    for c in np.flatnonzero(np.bincount(t, minlength=256)).tolist():
        wave = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        waves = [wave]
        while len(wave):  # runs of one byte: each suffix gives its predecessor a place behind
            before = wave[wave > 0] - 1
            wave = before[(t[before] == c) & ~rise[before] & wanted[before]]
            waves.append(wave)
        order = np.concatenate([*waves, direct[bounds[c] : bounds[c + 1]]])
        out.append(order)
        before = order[order > 0] - 1
        before = before[(t[before] > c) & wanted[before]]
        heads = t[before]
        sort = np.argsort(heads, kind="stable")
        cuts = np.flatnonzero(np.diff(heads[sort])) + 1
        for group in np.split(before[sort], cuts):
            if len(group):
                induced[t[group[0]]].append(group)
    return np.concatenate(out)


def adjacent_prefixes(text: bytes, order: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``order``, up to ``most``
    (exact below it, in steps of eight bytes compared as words)."""
    n, m = len(text), len(order)
    t = np.zeros(n + most + 8, dtype=np.uint64)
    t[:n] = np.frombuffer(text, dtype=np.uint8)
    word = np.zeros(n + most, dtype=np.uint64)
    for k in range(8):
        word |= t[k : k + n + most] << np.uint64(8 * k)
    prefix = np.zeros(m, dtype=np.int64)
    alive = np.arange(1, m)
    for step in range(0, most, 8):
        x = word[order[alive] + step] ^ word[order[alive - 1] + step]
        same = x == 0
        rest = x[~same]
        low = rest & (~rest + np.uint64(1))
        prefix[alive[~same]] = step + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        alive = alive[same]
    prefix[alive] = most
    room = n - np.maximum(order[1:], order[:-1])
    prefix[1:] = np.minimum(prefix[1:], room)
    return prefix


def repeated_windows(contexts: list[bytes], counts: list[int], length: int) -> list[np.ndarray]:
    """For each context which of its windows occur twice or more, each context standing
    for ``counts`` equal ones."""
    text = b"".join(contexts)
    sizes = np.array([len(c) for c in contexts])
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(contexts)), sizes)
    whole = np.arange(len(text)) + length <= ends[owner]  # the window doesn't leave its context
    order = suffix_order(text, length, whole)
    group = np.cumsum(adjacent_prefixes(text, order, length) < length)
    weight = np.where(whole, np.array(counts)[owner], 0)
    held = np.bincount(group, weights=weight[order])
    found = np.zeros(len(text), dtype=bool)
    found[order] = held[group] >= 2
    found &= whole
    return [found[e - s : e - length + 1] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


def as_runs(flags: np.ndarray) -> tuple[list[int], list[int]]:
    """First and last places of the stretches of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edges[::2].tolist(), (edges[1::2] - 1).tolist()


def cut_contexts(wanted: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """(h, c, copies, hot, at, body): the bytes of each context in ``wanted`` (doc, text_h,
    h, c, copies, hot, start, windows), which are grouped by document; ``at`` is the anchor's
    place in the context."""
    per_doc = wanted.groupBy("doc", "text_h").agg(F.collect_list(F.struct("h", "c", "copies", "hot", "start", "windows")).alias("w"))
    parts = [F.col(f"w.{n}").alias(n) for n in ("h", "c", "copies", "hot", "start", "windows")]
    met = texts.join(per_doc, (texts["doc_id"] == per_doc["doc"]) & (texts["th"] == per_doc["text_h"])).select("body", *parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                cols = batch.slice(at, 64).to_pydict()
                out: dict[str, list] = {n: [] for n in ("h", "c", "copies", "hot", "body")}
                for body, start, windows, *rest in zip(*(cols[n] for n in ("body", "start", "windows", "h", "c", "copies", "hot")), strict=True):
                    raw = zlib.decompress(body)
                    out["body"] += [raw[s : s + w + length - 1] for s, w in zip(start, windows, strict=True)]
                    for n, values in zip(("h", "c", "copies", "hot"), rest, strict=True):
                        out[n] += values
                yield pa.RecordBatch.from_arrays([pa.array(out["h"], pa.int64()), pa.array(out["c"], pa.int64()), pa.array(out["copies"], pa.int64()), pa.array(out["hot"], pa.bool_()), pa.array(out["body"], pa.binary())], names=list(out))

    return met.mapInArrow(run, "h long, c long, copies long, hot boolean, body binary").dropDuplicates(["h", "c"])


def sorted_marks(contexts: DataFrame, length: int, buffer: int) -> DataFrame:
    """(h, c, first, last): repeated windows of ``contexts`` (h, c, copies, body), by suffix sorting."""
    parts = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = contexts.select("h", "c", "copies", "body").repartition(parts, "h").sortWithinPartitions("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def marks(held: list[tuple]) -> pa.RecordBatch:
            flags = repeated_windows([x[3] for x in held], [x[2] for x in held], length)
            kept = [(x[0], x[1], *as_runs(f)) for x, f in zip(held, flags, strict=True) if f.any()]
            return pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in kept], pa.int64()), pa.array([x[1] for x in kept], pa.int64()), pa.array([x[2] for x in kept], pa.list_(pa.int32())), pa.array([x[3] for x in kept], pa.list_(pa.int32()))],
                names=["h", "c", "first", "last"],
            )

        held, filled = [], 0
        for batch in batches:
            for row in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if filled >= buffer and row[0] != held[-1][0]:
                    yield marks(held)
                    held, filled = [], 0
                held.append(row)
                filled += len(row[3])
        if held:
            yield marks(held)

    return dealt.mapInArrow(run, "h long, c long, first array<int>, last array<int>")


def anchor_place(body: bytes, length: int, gram: int) -> int:
    raw = np.frombuffer(body, dtype=np.uint8)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(len(raw) + 1)[0][: len(raw)], out=sums[1:])
    ranked = (gram_hashes(sums, gram) & ~_PLACE) | np.arange(len(raw) - gram + 1, dtype=np.uint64)
    return int(ranked[: length - gram + 1].min() & _PLACE)


def digest(body: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little", signed=True)


def flagged(rows: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """``rows`` with a column ``hot``: whether more than ``most`` rows have its h; and if any has."""
    hot = store(rows.groupBy(F.col("h").alias("hot_h")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("hot_h"), "hot-groups")
    return rows.join(hot, F.col("h") == F.col("hot_h"), "left").withColumn("hot", F.col("hot_h").isNotNull()).drop("hot_h"), not hot.isEmpty()


def recurring(rows: DataFrame) -> DataFrame:
    """``rows`` (h, copies, ...) whose h stands for two or more places."""
    often = rows.groupBy("h").agg(F.sum("copies").alias("places")).where("places > 1")
    often = store(often.select(F.col("h").alias("often_h")), "recurring")
    return rows.join(often, F.col("h") == F.col("often_h")).drop("often_h")


def cut_blocks(contexts: DataFrame, length: int, gram: int, block: int) -> DataFrame:
    """(h, c, copies, of_h, of_c, lo, body): the blocks of ``block`` windows of ``contexts``
    (h, c, copies, body). h is a hash of the block's core, c of its bytes, ``lo`` its first
    window in its context. Equal windows are in blocks of one core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for h, c, copies, body in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                place = anchor_place(body, length, gram)
                # windows by their anchor's offset in them, which equal windows share
                last = len(body) - length
                for b in range((place - last) // block, place // block + 1):
                    lo, hi = max(0, place - b * block - block + 1), min(last, place - b * block)
                    core = body[place - b * block : place - b * block - block + 1 + length]
                    whole = body[lo : hi + length]
                    found.append((digest(b"%d " % b + core), digest(b"%d %d " % (place - lo, place - hi) + whole), copies, h, c, lo, whole))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*found, strict=True), (*[pa.int64()] * 5, pa.int32(), pa.binary()), strict=True)], names=["h", "c", "copies", "of_h", "of_c", "lo", "body"]
                )

    return contexts.select("h", "c", "copies", "body").mapInArrow(run, "h long, c long, copies long, of_h long, of_c long, lo int, body binary")


def group_marks(contexts: DataFrame, any_hot: bool, length: int, gram: int, hot_contexts: int, buffer: int, blocks: tuple[int, ...]) -> DataFrame:
    """(h, c, first, last): repeated windows of ``contexts`` (h, c, copies, hot, body). Groups
    that are ``hot`` are cut into blocks, which are sorted by their cores."""
    marks = sorted_marks(contexts.where("not hot"), length, buffer)
    if not any_hot:
        return marks
    live = store(recurring(store(cut_blocks(contexts.where("hot"), length, gram, blocks[0]), "blocks")), "recurring-blocks")
    distinct = store(live.groupBy("h", "c").agg(F.sum("copies").alias("copies"), F.first("body").alias("body")), "distinct-blocks")
    distinct, more = flagged(distinct, hot_contexts) if blocks[1:] else (distinct.withColumn("hot", F.lit(False)), False)
    found = group_marks(distinct, more, length, gram, hot_contexts, buffer, blocks[1:])
    found = store(found.withColumnsRenamed({"h": "m_h", "c": "m_c"}), "block-marks")
    met = live.join(found, (F.col("h") == F.col("m_h")) & (F.col("c") == F.col("m_c")))
    shifted = [F.flatten(F.collect_list(F.transform(n, lambda x: x + F.col("lo")))).alias(n) for n in ("first", "last")]
    return marks.unionByName(met.groupBy(F.col("of_h").alias("h"), F.col("of_c").alias("c")).agg(*shifted))


def dedup_substrings(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, hot_contexts: int = HOT_CONTEXTS, buffer: int = BUFFER, blocks: tuple[int, ...] = BLOCKS
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary, spans) of every row of ``docs``;
    spans lists the removed stretches as (first byte, byte behind the last)."""
    spans = repeated_spans(docs, doc_id, text, length, gram, hot_contexts, buffer, blocks)
    texts = packed_texts(docs, doc_id, text, NO_DOC)
    met = texts.join(spans, (texts["doc_id"] == spans["doc"]) & (texts["th"] == spans["text_h"]), "left").select("doc_id", "body", "lo", "hi")
    pair = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64)
                out: list[tuple] = []
                for body, lo, hi in zip(*(rows.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                    raw = zlib.decompress(body)
                    gone: list[list[int]] = []
                    for a, b in sorted(zip(lo or (), hi or (), strict=True)):
                        if gone and a <= gone[-1][1]:
                            gone[-1][1] = max(gone[-1][1], b)
                        else:
                            gone.append([a, b])
                    places = [0, *(x for g in gone for x in g), len(raw)]
                    kept = b"".join(raw[a:b] for a, b in zip(places[::2], places[1::2], strict=True))
                    out.append((len(raw), len(raw) - len(kept), len(gone), kept, [{"first": a, "stop": b} for a, b in gone]))
                n_bytes, n_removed, n_spans, kept, spans_ = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans_, pair)],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"],
                )

    got = met.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<first: long, stop: long>>")
    return got.withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(NO_DOC)))


def repeated_spans(docs: DataFrame, doc_id: str, text: str, length: int, gram: int, hot_contexts: int, buffer: int, blocks: tuple[int, ...]) -> DataFrame:
    """(doc, text_h, lo, hi): for each document with repeated strings, its runs of them."""
    anchors = store(anchor_rows(docs, doc_id, text, length, gram), "anchors")
    seen = anchors.groupBy("h").agg(F.count(F.lit(1)).alias("runs")).where("runs > 1")
    seen = store(seen.select(F.col("h").alias("its_h")), "anchors-seen")
    again = store(anchors.join(seen, F.col("h") == F.col("its_h")).drop("its_h"), "anchors-again")
    contexts = again.groupBy("h", "c").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "th", "start", "windows")).alias("w"))
    contexts = store(contexts.select("h", "c", "copies", F.col("w.doc_id").alias("doc"), F.col("w.th").alias("text_h"), F.col("w.start").alias("start"), F.col("w.windows").alias("windows")), "contexts")
    wanted, any_hot = flagged(contexts, hot_contexts)
    bodies = store(cut_contexts(wanted, packed_texts(docs, doc_id, text, NO_DOC), length), "context-bodies")
    marks = group_marks(bodies, any_hot, length, gram, hot_contexts, buffer, blocks)
    marks = store(marks.select(F.col("h").alias("m_h"), F.col("c").alias("m_c"), "first", "last"), "marks")
    met = again.join(marks, (F.col("h") == F.col("m_h")) & (F.col("c") == F.col("m_c")))
    marked = met.select("doc_id", "th", "start", F.explode(F.arrays_zip("first", "last")).alias("x"))
    marked = marked.select("doc_id", "th", (F.col("start") + F.col("x.first")).alias("lo"), (F.col("start") + F.col("x.last") + length).alias("hi"))
    ranges = marked.groupBy(F.col("doc_id").alias("doc"), F.col("th").alias("text_h")).agg(F.collect_set(F.struct("lo", "hi")).alias("r"))
    return store(ranges.select("doc", "text_h", F.transform("r", lambda x: x["lo"]).alias("lo"), F.transform("r", lambda x: x["hi"]).alias("hi")), "spans")
