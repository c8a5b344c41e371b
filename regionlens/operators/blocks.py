"""One small block of numbers per task, merged by a tree of tasks (OP-29, 70).

A task folds its Arrow batches into one block (a matrix and a row count); blocks travel
as one binary row a task and are merged ``FAN_IN`` partitions a step, so what is shuffled
is tasks x block and no single task or the driver merges more than ``FAN_IN`` blocks at
once.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionlens.session import ship_package

FAN_IN = 32
Block = tuple[np.ndarray, int]


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as doubles x0, x1, ...; rows with a null or NaN in any are left out."""
    return df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{k}") for k, c in enumerate(columns)]).na.drop()


def merged_block(rows: DataFrame, fold: Callable[[np.ndarray, np.ndarray], np.ndarray], merge: Callable[[np.ndarray, np.ndarray], np.ndarray], empty: np.ndarray) -> Block:
    """``fold(matrix, rows)`` over the rows (n, columns) of every batch, starting from
    ``empty``; ``merge`` of the tasks' matrices; and the number of rows."""
    ship_package(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, n = empty, 0
        for batch in batches:
            if batch.num_rows:
                got = fold(got, np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
                n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((got, n))], pa.binary())], names=["block"])

    parts = rows.mapInArrow(run, "block binary").rdd.map(lambda r: pickle.loads(r["block"]))
    if not parts.getNumPartitions():
        return empty, 0
    depth = 1
    while FAN_IN**depth < parts.getNumPartitions():
        depth += 1
    return parts.treeReduce(lambda a, b: (merge(a[0], b[0]), a[1] + b[1]), depth)


def cross_products(df: DataFrame, columns: Sequence[str]) -> Block:
    """(X^T X, rows) of the complete rows."""
    p = len(columns)
    return merged_block(complete_rows(df, columns), lambda g, x: g + x.T @ x, np.add, np.zeros((p, p)))


def triangular(a: np.ndarray) -> np.ndarray:
    return np.linalg.qr(a, mode="r") if len(a) else a


def tall_qr(df: DataFrame, columns: Sequence[str]) -> Block:
    """(R, rows): the triangular factor of the complete rows (TSQR). Every batch is stacked
    under the task's R and reduced again, and so are the tasks' factors. R has the inner
    products of the columns without ever squaring them."""
    stack = lambda a, b: triangular(np.vstack([a, b]))
    return merged_block(complete_rows(df, columns), stack, stack, np.zeros((0, len(columns))))
