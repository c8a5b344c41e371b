"""Operator 7: line dedup over levelled sorted runs of line hashes.

The state is two sets of runs: bucketed tables sorted by line hash, each with one entry
per hash: the number of documents that hold the line and the largest doc_id among
them. A batch of documents is reduced to one entry per hash and merge-anti-joined with
the runs of lines. Its fresh lines are added there as a run of level 0, so that every
line is in one of these runs only, that of its first batch; what is left, the entries of
lines seen before, goes to the runs of repeats in the same way. When a level holds
``fanout`` runs they are merged into one run of the next level, so a store of B batches
has O(log B) runs. Runs are bucketed by the whole hash, so anti-joins and merges of two
runs need no shuffle. The runs' files lie in the shared scratch folder, and their
catalogue entries go when the totals are written, or when a step fails.

Batches are slices of the documents by doc_id hash, so a document (all rows of its
doc_id) is in one batch and document counts add up over runs. A line that a third of
all documents hold is reduced map-side to one entry per task, and the verdict meets
the documents' lines in a join with a written table, which Spark splits where skewed.

Defined results: null or empty text is one empty line (a null text stays null); a null doc_id counts as a
document (all null rows as one) smaller than any other; lines of one key in the
largest document all stay; repeated rows are one document and get the same result each.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionlens.llm.common import prepared, store, text_hash, text_list
from regionlens.session import shared_path

STRIP = b" \t\n\x0b\x0c\r"
MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FANOUT = 2
#: Stands for a null doc_id: smaller than any.
NO_DOC = -(1 << 63)


def line_key(line: bytes) -> bytes:
    return line.strip(STRIP).lower()  # bytes.lower() changes A-Z only


def long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars)


def line_digest(key: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(key, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def line_rows(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """(doc_id, th, h1, h2): the distinct long line keys of each document, as 128-bit hashes."""
    prepared(docs.sparkSession)
    out = pa.schema([(n, pa.int64()) for n in ("doc_id", "th", "h1", "h2")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                found = []
                for k, raw in enumerate(text_list(rows.column(2))):
                    keys = {key for line in raw.split(b"\n") if long_enough(key := line_key(line), min_chars)}
                    found += [(k, *line_digest(key)) for key in keys]
                index = pa.array([f[0] for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(index), rows.column(1).take(index), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64())], schema=out
                )

    source = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_DOC)), text_hash(text), F.col(text).cast("string"))
    return source.mapInArrow(run, "doc_id long, th long, h1 long, h2 long")


@dataclass
class LineRuns:
    """The levelled runs. ``add`` takes a batch of (doc_id, h1, h2), distinct in a document."""

    spark: SparkSession
    fanout: int = FANOUT
    #: Runs by kind (lines, repeats) and level.
    levels: dict[tuple[str, int], list[str]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"llm_lines_{uuid.uuid4().hex}"
        self.made: list[str] = []

    def entries(self, batch: DataFrame) -> DataFrame:
        per_doc = batch.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
        return per_doc.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("max_doc"))

    def write(self, entries: DataFrame) -> str:
        """Write a run. ``entries`` are already dealt by (h1, h2) into ``buckets`` parts, by
        their aggregation or a join of runs, so each task writes whole buckets."""
        table = f"{self.name}_{len(self.made)}"
        self.made.append(table)
        path = shared_path(self.spark, f"llm-{table}")
        entries.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").format("parquet").option("path", path).saveAsTable(table)
        return table

    def keep(self, table: str, kind: str, level: int = 0) -> None:
        self.levels.setdefault((kind, level), []).append(table)

    def runs(self, kind: str) -> list[str]:
        return [t for k, level in sorted(self.levels, reverse=True) if k == kind for t in self.levels[k, level]]

    def lacking(self, table: str, runs: list[str]) -> DataFrame:
        """Entries of ``table`` whose line is in none of ``runs``, by merge joins of their buckets."""
        left = self.spark.table(table)
        for run in runs:
            r = self.spark.table(run).select(F.col("h1").alias("r1"), F.col("h2").alias("r2"))
            left = left.join(r.hint("merge"), (F.col("h1") == F.col("r1")) & (F.col("h2") == F.col("r2")), "left_anti")
        return left

    def add(self, batch: DataFrame) -> DataFrame:
        """Add a batch; returns the entries of its lines that no earlier batch had."""
        own = fresh = self.write(self.entries(batch))
        if earlier := self.runs("lines"):
            fresh = self.write(self.lacking(own, earlier))
            self.keep(self.write(self.lacking(own, [fresh])), "repeats")
        self.keep(fresh, "lines")
        new = self.spark.table(fresh)
        self.compact("lines")
        self.compact("repeats")
        return new

    def merged(self, tables: list[str]) -> DataFrame:
        """The runs as one, by merge joins that keep the buckets."""
        one = self.spark.table(tables[0])
        for t in tables[1:]:
            two = self.spark.table(t).select(*[F.col(c).alias(f"r_{c}") for c in ("h1", "h2", "n_docs", "max_doc")])
            met = one.join(two.hint("merge"), (F.col("h1") == F.col("r_h1")) & (F.col("h2") == F.col("r_h2")), "full_outer")
            one = met.select(
                F.coalesce("h1", "r_h1").alias("h1"),
                F.coalesce("h2", "r_h2").alias("h2"),
                (F.coalesce("n_docs", F.lit(0)) + F.coalesce("r_n_docs", F.lit(0))).alias("n_docs"),
                F.greatest("max_doc", "r_max_doc").alias("max_doc"),
            )
        return one

    def compact(self, kind: str, level: int = 0) -> None:
        """Merge full levels into the next ones."""
        while len(tables := self.levels.get((kind, level), [])) >= self.fanout:
            self.keep(self.write(self.merged(tables)), kind, level + 1)
            self.levels[kind, level] = []
            level += 1

    def totals(self) -> DataFrame:
        """(h1, h2, n_docs, max_doc) over all runs: the lines with their repeats."""
        return store(self.merged(self.runs("lines") + self.runs("repeats")), "line-totals")

    def close(self) -> None:
        """Take the runs out of the catalogue."""
        for t in self.made:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        self.made.clear()
        self.levels.clear()


def line_totals(lines: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Totals of ``line_rows`` taken in as ``batches`` batches."""
    runs = LineRuns(lines.sparkSession)
    try:
        for k in range(batches):
            runs.add(lines.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k).select("doc_id", "h1", "h2"))
        return runs.totals()
    finally:
        runs.close()


def dedup_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Every document without its repeated lines: doc_id, n_lines, n_dropped, clean_text,
    and the columns named in ``keep``."""
    lines = store(line_rows(docs, doc_id, text, min_chars), "lines")
    often = store(line_totals(lines, batches).where(F.col("n_docs") >= min_docs).select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), "max_doc"), "line-often")
    hits = lines.join(often, (F.col("h1") == F.col("o1")) & (F.col("h2") == F.col("o2")) & (F.col("doc_id") != F.col("max_doc")))
    drops = hits.groupBy(F.col("doc_id").alias("d_doc"), F.col("th").alias("d_th")).agg(F.collect_set(F.struct("h1", "h2")).alias("drops"))
    drops = store(drops.select("d_doc", "d_th", F.transform("drops", lambda x: x["h1"]).alias("d1"), F.transform("drops", lambda x: x["h2"]).alias("d2")), "line-drops")

    names = [f"k{i}" for i in range(len(keep))]
    source = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_DOC)).alias("doc_id"), text_hash(text).alias("th"), F.col(text).cast("string").alias("t"), *[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)])
    met = source.join(drops, (F.col("doc_id") == F.col("d_doc")) & (F.col("th") == F.col("d_th")), "left").drop("d_doc", "d_th", "th")
    out = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("n_lines", T.LongType()), ("n_dropped", T.LongType()), ("clean_text", T.StringType()))])
    out = T.StructType([*out.fields, *[met.schema[n] for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                n_lines, n_dropped, texts = [], [], []
                for raw, d1, d2 in zip(text_list(rows.column("t")), rows.column("d1").to_pylist(), rows.column("d2").to_pylist(), strict=True):
                    whole = raw.split(b"\n")
                    left = whole
                    if d1:
                        gone = set(zip(d1, d2, strict=True))
                        left = [x for x in whole if not (long_enough(key := line_key(x), min_chars) and line_digest(key) in gone)]
                    n_lines.append(len(whole))
                    n_dropped.append(len(whole) - len(left))
                    texts.append(raw if left is whole else b"\n".join(left))
                # a null text stays null
                null = rows.column("t").is_null().to_numpy(zero_copy_only=False)
                ids = rows.column("doc_id")
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(texts, pa.binary(), mask=null).cast(pa.string()), *[rows.column(n) for n in names]],
                    names=["doc_id", "n_lines", "n_dropped", "clean_text", *names],
                )

    got = met.mapInArrow(run, out)
    return got.select(F.nullif(F.col("doc_id"), F.lit(NO_DOC)).alias("doc_id"), "n_lines", "n_dropped", "clean_text", *[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)])
