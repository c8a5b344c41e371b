"""Operator 9: benchmark decontamination by size-partitioned MinHash containment search.

A document contains a test item if it holds at least 80 % of the item's distinct
five-word shingles. Items are partitioned by the size of their shingle set, and each
partition keeps per item as many of its smallest hashes (a MinHash sketch) as the
containment limit lets a document miss, plus one: a document that contains the item
then holds at least one of them, so the search loses nothing. A document with n distinct
shingles looks them up in the partitions only whose smallest item asks for n or fewer
of them; an item that is hit is verified at once by the exact share of its whole set.

Items go through in blocks of ``block_bytes`` of sketches and sets, each block being
broadcast (its size is bounded by construction) and met by one pass over the
documents, so long texts are never shuffled and no pairs are built. Items are taken
to the driver one block at a time only. An item larger than a block stays on the
executors: only documents that have enough shingles to contain one send theirs to a join
with the items' on the hash, counted by document and item.

Defined results: null or empty texts contain nothing; null or empty items are never
contained; items with fewer than five words count as one shingle, as documents of
that length do; equal items and repeated documents each get their own rows; empty tables
of either kind give the empty table; other columns of both tables are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionlens.llm.common import prepared, row_slices, store, text_hash, utf8_rows
from regionlens.llm.shingles import shingle_sets

CONTAINMENT_PERCENT = 80
BLOCK_BYTES = 32 << 20
#: Shingle hashes of one row batch.
HASHES = 1 << 16


def item_sets(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, size, part, hashes): the sorted shingle set of each item as bytes, and its size class."""
    out = pa.schema([("item_id", pa.int64()), ("size", pa.int64()), ("part", pa.int32()), ("hashes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8_rows(batch.column(1))
            for a, b in row_slices(offsets):
                sets = list(shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a).cast(pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([len(s).bit_length() for s in sets], pa.int32()),
                        pa.array([s.tobytes() for s in sets], pa.binary()),
                    ],
                    schema=out,
                )

    return items.select(F.col(item_id).cast("long"), F.col(text).cast("string")).mapInArrow(run, "item_id long, size long, part int, hashes binary").where("size > 0")


def least(size: int, percent: int) -> int:
    """Shingles of an item of ``size`` that a document must hold."""
    return max(1, -(-size * percent // 100))


class Partition:
    """Sketches and whole sets of a block's items of one size class."""

    def __init__(self, sets: list[tuple[int, bytes]], percent: int) -> None:
        self.ids = [i for i, _ in sets]
        self.sets = [np.frombuffer(h, dtype=np.uint64) for _, h in sets]
        self.need = [least(len(s), percent) for s in self.sets]
        sketches = [s[: len(s) - n + 1] for s, n in zip(self.sets, self.need, strict=True)]
        owners = np.repeat(np.arange(len(sets)), [len(s) for s in sketches])
        hashes = np.concatenate(sketches)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owners = hashes[order], owners[order]

    def found(self, shingles: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, its size, shingles held) for every item that the set contains."""
        lo, hi = np.searchsorted(self.hashes, shingles, side="left"), np.searchsorted(self.hashes, shingles, side="right")
        hit = np.flatnonzero(hi > lo)
        for k in sorted({int(o) for i in hit for o in self.owners[lo[i] : hi[i]]}):
            own = self.sets[k]
            at = np.minimum(np.searchsorted(shingles, own), len(shingles) - 1)
            held = int((shingles[at] == own).sum())
            if held >= self.need[k]:
                yield self.ids[k], len(own), held


class ItemIndex:
    """A block's partitions, from the least shingles they ask of a document upwards."""

    def __init__(self, sets: list[tuple[int, bytes]], percent: int) -> None:
        classes: dict[int, list[tuple[int, bytes]]] = {}
        for item in sets:
            classes.setdefault((len(item[1]) // 8).bit_length(), []).append(item)
        parts = [Partition(c, percent) for c in classes.values()]
        self.parts = sorted(((min(p.need), p) for p in parts), key=lambda x: x[0])

    def found(self, shingles: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, its size, shingles held) for every item that the set contains."""
        for need, part in self.parts:
            if need > len(shingles):
                return
            yield from part.found(shingles)


def in_large_items(docs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Rows of ``contaminated`` for the items of ``sets``, each too large to broadcast: the
    shingles of documents that are large enough meet the items' in a join."""
    smallest = sets.agg(F.min("size")).first()[0]
    need = least(int(smallest), percent)
    out = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("row", pa.int64()), ("h", pa.int64())])

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = utf8_rows(batch.column(3))
            for a, b in row_slices(offsets):
                for k, found in enumerate(shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), a):
                    for at in range(0, len(found) if len(found) >= need else 0, HASHES):
                        part = found[at : at + HASHES].view(np.int64)
                        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(np.full(len(part), k))) for c in range(3)), pa.array(part)], schema=out)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, raw in enumerate(batch.column(2).to_pylist()):
                own = np.frombuffer(raw, dtype=np.int64)
                for at in range(0, len(own), HASHES):
                    part = own[at : at + HASHES]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(np.full(len(part), k))) for c in range(2)), pa.array(part)], names=["item", "size", "own"])

    numbered = store(sets.withColumn("item", F.monotonically_increasing_id()), "large-items")
    own = numbered.select("item", "size", "hashes").mapInArrow(opened, "item long, size long, own long").join(numbered.select("item", "item_id"), "item")
    rows = store(docs.withColumn("row", F.monotonically_increasing_id()).select("doc_id", "th", "row", "t").mapInArrow(shingled, "doc_id long, th long, row long, h long"), "large-documents")
    met = rows.join(own, F.col("h") == F.col("own")).groupBy("doc_id", "th", "row", "item", "item_id", "size").agg(F.count(F.lit(1)).alias("n_shared"))
    return met.where(100 * F.col("n_shared") >= percent * F.col("size")).select("doc_id", "th", "item_id", F.col("size").alias("n_item"), "n_shared")


def blocks(sets: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, bytes]]]:
    """Items, none above ``block_bytes`` of hashes, in lists of at most that, partition by partition."""
    found, filled = [], 0
    for row in sets.orderBy("part", "item_id").toLocalIterator():
        if found and filled + len(row["hashes"]) > block_bytes:
            yield found
            found, filled = [], 0
        found.append((row["item_id"], bytes(row["hashes"])))
        filled += len(row["hashes"])
    if found:
        yield found


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    percent: int = CONTAINMENT_PERCENT,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, th, item_id, n_item, n_shared) for each document and test item it contains;
    th is ``common.text_hash`` of the document."""
    spark = prepared(docs.sparkSession)
    schema = "doc_id long, th long, item_id long, n_item long, n_shared long"
    out = pa.schema([(n, pa.int64()) for n in ("doc_id", "th", "item_id", "n_item", "n_shared")])
    source = docs.select(F.col(doc_id).cast("long"), text_hash(text), F.col(text).cast("string"))

    def search(block: list[tuple[int, bytes]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(shared.value, percent)
            for batch in batches:
                raw, offsets = utf8_rows(batch.column(2))
                rows: list[tuple[int, int, int, int]] = []
                for a, b in row_slices(offsets):
                    for k, shingles in enumerate(shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), a):
                        if len(shingles):
                            rows += [(k, *f) for f in index.found(shingles)]
                if rows:
                    at = pa.array([r[0] for r in rows], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array([r[c] for r in rows], pa.int64()) for c in (1, 2, 3))], schema=out)

        return source.mapInArrow(run, schema)

    sets = store(item_sets(items, item_id, item_text), "items")
    result = None
    for block in blocks(sets.where(F.length("hashes") <= block_bytes), block_bytes):
        found = search(block)
        # further blocks: written one by one, so that each pass ends before the next is built
        result = found if result is None else store(result, "leaks").unionByName(store(found, "leaks"))
    large = sets.where(F.length("hashes") > block_bytes)
    if large.limit(1).count():
        found = in_large_items(source.toDF("doc_id", "th", "t"), large, percent)
        result = found if result is None else result.unionByName(found)
    return spark.createDataFrame([], schema) if result is None else result
