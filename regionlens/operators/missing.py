"""Missing-data operators (OP-17..22).

The reference turned nulls into the text ``'None'`` and then hunted for it;
here missing values stay null. Text that already holds a missing marker is
accepted on input and mapped to null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionlens.functions.scalar import is_missing_text

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC)]


def fill_numeric(df: DataFrame, value: float = 0, subset: Sequence[str] | None = None) -> DataFrame:
    """Replace null and NaN in numeric columns; text columns are untouched."""
    cols = list(subset) if subset is not None else numeric_columns(df)
    if not cols:
        return df
    return df.na.fill(value, subset=cols)


def nullify_missing_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Map missing markers ('None', 'nan', '') in the given text columns to null."""
    cols = set(columns)
    return df.select(
        *[
            F.when(~is_missing_text(c), F.col(c)).alias(c) if c in cols else F.col(c)
            for c in df.columns
        ]
    )


def drop_missing(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with any missing value (null, NaN or a missing marker) in ``subset``."""
    cols = list(subset) if subset is not None else df.columns
    text_cols = [f.name for f in df.schema.fields if f.name in cols and isinstance(f.dataType, T.StringType)]
    cleaned = nullify_missing_text(df, text_cols) if text_cols else df
    return cleaned.na.drop("any", subset=cols)


def missing_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column: ``(column, n_rows, n_missing, has_missing)``.

    A single aggregation pass computes every count; the wide 1-row result is
    turned into rows with ``stack`` (no second pass over the data).
    """
    cols = list(columns) if columns is not None else df.columns
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(cols):
        dtype = df.schema[c].dataType
        if isinstance(dtype, T.StringType):
            cond = is_missing_text(c)
        elif isinstance(dtype, (T.FloatType, T.DoubleType)):
            cond = F.col(c).isNull() | F.isnan(c)
        else:
            cond = F.col(c).isNull()
        aggs.append(F.count_if(cond).alias(f"__m{i}"))
    wide = df.agg(*aggs)
    pairs = ", ".join(f"'{c}', `__m{i}`" for i, c in enumerate(cols))
    long = wide.selectExpr("__n", f"stack({len(cols)}, {pairs}) as (column, n_missing)")
    return long.select(
        "column",
        F.col("__n").cast("long").alias("n_rows"),
        F.col("n_missing").cast("long").alias("n_missing"),
        (F.col("n_missing") > 0).alias("has_missing"),
    )
