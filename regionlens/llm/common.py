"""Helpers shared by the operators of this subpackage.

Intermediate tables go below ``spark.checkpoint.dir`` (``store``), so a later
stage reads files that every executor can reach instead of recomputing a Python
pass or depending on one executor's disk. Rows are told apart by ``doc_id`` and a
hash of the text: rows that agree in both get the same verdict, and a null
``doc_id`` is a value like any other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regionlens.session import shared_path, ship_package

#: White space of the word contracts: space and \x09-\x0D.
SPACES = " \t\n\x0b\x0c\r"

#: Rows of an Arrow batch; texts may be long, and both sides of the transfer hold a batch.
ARROW_ROWS = 1000


def store(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` to a fresh folder of the shared scratch space and read it back;
    ``codec`` names another Parquet compression than the session's."""
    spark = df.sparkSession
    path = shared_path(spark, f"llm-{name}")
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def prepared(spark: SparkSession) -> SparkSession:
    """Make this package importable in the executors' Python workers, and keep Arrow
    batches of whole texts small (``ARROW_ROWS``, unless the session sets fewer)."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, ARROW_ROWS)
    return spark


def text_hash(text: str = "text") -> Column:
    """64-bit hash of a text; null and empty differ."""
    return F.xxhash64(F.col(text).isNull(), F.col(text))


def same_row(left: DataFrame, right: DataFrame, doc_id: str, text_h: str, right_id: str, right_h: str) -> Column:
    return left[doc_id].eqNullSafe(right[right_id]) & (left[text_h] == right[right_h])


def without(docs: DataFrame, dropped: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows named in ``dropped`` (``_id``, ``_th``: doc_id and ``text_hash``).

    ``dropped`` is written first: Spark then knows its size and broadcasts it
    only below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    d = store(dropped.select("_id", "_th").distinct(), "dropped")
    return docs.join(d, docs[doc_id].eqNullSafe(d["_id"]) & (text_hash(text) == d["_th"]), "left_anti")


def utf8_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null counts as empty. No copy but for nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_slices(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``most`` bytes each (one row at least), so that
    the work arrays of a batch stay small whatever the batch holds."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        end = min(max(end, at + 1), n)
        yield at, end
        at = end


def text_list(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each row; null counts as empty."""
    raw, offsets = utf8_rows(column)
    view = raw.tobytes()
    return [view[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def packed_texts(docs: DataFrame, doc_id: str, text: str, no_doc: int) -> DataFrame:
    """(doc_id, th, body): every text deflated, so that a join by document moves less.
    A null doc_id becomes ``no_doc``; a null text is packed as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([zlib.compress(x, 1) for x in text_list(rows.column(2))], pa.binary())], names=["doc_id", "th", "body"])

    source = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(no_doc)), text_hash(text), F.col(text).cast("string"))
    return source.mapInArrow(run, "doc_id long, th long, body binary")
