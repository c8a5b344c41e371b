"""Global and per-column aggregates (OP-25..29, 40).

Each statistic is one ``agg`` pass: Spark computes partial aggregates in every
task and merges a single row, so the shuffle is one row per task whatever the
data size. Per-column results are reshaped to long form with ``stack``.
Results that feed later row-wise expressions (a colour range, scaling bounds)
are a handful of numbers and are brought to the driver as literals rather than
cross-joined back onto the data.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from regionlens.functions.scalar import clamp, log10_positive
from regionlens.operators.blocks import complete_rows, cross_products
from regionlens.session import shared_path


def _stack(wide: DataFrame, names: Sequence[str], stats: Sequence[str], label: str = "column") -> DataFrame:
    """1-row frame with columns ``{stat}__{i}`` -> one row per name."""
    parts = []
    for i, n in enumerate(names):
        parts.append("'" + n.replace("'", "\\'") + "'")
        parts.extend(f"`{s}__{i}`" for s in stats)
    expr = f"stack({len(names)}, {', '.join(parts)}) as ({label}, {', '.join(stats)})"
    return wide.selectExpr(expr)


def count_positive(df: DataFrame, column: str, name: str = "n_positive") -> DataFrame:
    return df.agg(F.count_if(F.col(column) > 0).cast("long").alias(name))


def scalar_max(df: DataFrame, expr: Column) -> float | None:
    """One number to the driver (the upper end of a display range)."""
    return df.agg(F.max(expr).alias("m")).first()["m"]


def written_with_max(df: DataFrame, column: str) -> tuple[DataFrame, float | None]:
    """(``df`` written and read back, the largest value of ``column``): the maximum is
    observed while the rows are written, so ``df`` runs once."""
    spark = df.sparkSession
    path, seen = shared_path(spark, "observed"), Observation()
    df.observe(seen, F.max(column).alias("most")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get["most"]


def map_layer(df: DataFrame, key: str, value: str, scale: str = "log10", fixed_hi: float = 0.1, divisor: float = 5.0) -> DataFrame:
    """Value per key clamped to the display range of a choropleth layer.

    ``scale='log10'``: log10(value), range [0, max log10]; ``'fraction'``: the
    raw value, range [0, max/divisor]; ``'fixed'``: range [0, fixed_hi].
    """
    if scale not in ("log10", "fraction", "fixed"):
        raise ValueError(scale)
    v = log10_positive(value) if scale == "log10" else F.col(value).cast("double")
    layer, hi = df.select(key, v.alias("value")), fixed_hi
    if scale != "fixed":
        layer, most = written_with_max(layer, "value")
        hi = 0.0 if most is None else most / (divisor if scale == "fraction" else 1.0)
    hi_lit = F.lit(hi).cast("double")
    return layer.select(key, "value", hi_lit.alias("range_hi"), clamp(F.col("value"), 0.0, hi_lit).alias("color"))


def minmax_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, min, max)`` per column in one pass."""
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`").cast("double")
        aggs += [F.min(x).alias(f"min__{i}"), F.max(x).alias(f"max__{i}")]
    return _stack(df.agg(*aggs), columns, ["min", "max"])


def column_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, n, mean, std_samp, std_pop)`` per column in one pass."""
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(f"`{c}`").cast("double")
        aggs += [
            F.count(x).cast("long").alias(f"n__{i}"),
            F.avg(x).alias(f"mean__{i}"),
            F.stddev_samp(x).alias(f"std_samp__{i}"),
            F.stddev_pop(x).alias(f"std_pop__{i}"),
        ]
    return _stack(df.agg(*aggs), columns, ["n", "mean", "std_samp", "std_pop"])


def collect_stats(stats: DataFrame) -> dict[str, dict[str, float]]:
    """Per-column statistics as a dict (p rows reach the driver)."""
    return {r["column"]: r.asDict() for r in stats.collect()}


# --------------------------------------------------------------------------- Gram matrix
def gram_matrix(df: DataFrame, columns: Sequence[str], method: str = "arrow") -> DataFrame:
    """Cross-product sums ``Σ x_i x_j`` for i <= j as ``(i, j, col_i, col_j, value)``.

    Every task adds its batches' X^T X to one matrix, a binary row; a tree of tasks adds
    those up (``blocks.cross_products``). ``method="sql"`` makes the same sums as
    p(p+1)/2 SQL aggregates, for comparison on few columns. Rows with a null or NaN in any
    column are left out, as a regression would leave them out.
    """
    cols = list(columns)
    p = len(cols)
    if method == "sql":
        clean = complete_rows(df, cols)
        aggs = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"v__{i}_{j}") for i in range(p) for j in range(i, p)]
        wide = clean.agg(*aggs)
        parts = []
        for i in range(p):
            for j in range(i, p):
                parts += [str(i), str(j), f"`v__{i}_{j}`"]
        long = wide.selectExpr(f"stack({p * (p + 1) // 2}, {', '.join(parts)}) as (i, j, value)")
    else:
        g, _ = cross_products(df, cols)
        rows = [(i, j, float(g[i, j])) for i in range(p) for j in range(i, p)]
        long = df.sparkSession.createDataFrame(rows, "i int, j int, value double")
    names = F.array(*[F.lit(c) for c in cols])
    return long.select(
        F.col("i").cast("int").alias("i"),
        F.col("j").cast("int").alias("j"),
        F.element_at(names, F.col("i").cast("int") + 1).alias("col_i"),
        F.element_at(names, F.col("j").cast("int") + 1).alias("col_j"),
        F.col("value").cast("double").alias("value"),
    )


def gram_to_numpy(gram: DataFrame, p: int) -> np.ndarray:
    """Symmetric p x p matrix on the driver (p(p+1)/2 numbers)."""
    g = np.zeros((p, p))
    for r in gram.select("i", "j", "value").collect():
        g[r["i"], r["j"]] = r["value"]
        g[r["j"], r["i"]] = r["value"]
    return g
