"""Projection and schema operators (OP-07..15).

All of them are name-based ``select``s, so Catalyst prunes unused columns down
to the scan and collapses consecutive projections.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionlens.functions.scalar import clean_text


def keep_columns(df: DataFrame, keep: Iterable[str]) -> DataFrame:
    """Keep the listed columns in source order (drop the complement)."""
    wanted = set(keep)
    missing = wanted - set(df.columns)
    if missing:
        raise KeyError(f"columns not found: {sorted(missing)}")
    return df.select(*[c for c in df.columns if c in wanted])


def latest_column(df: DataFrame) -> str:
    """Name of the last column (the latest date of a wide series file)."""
    return df.columns[-1]


def latest_measure(df: DataFrame, keys: Sequence[str], name: str, column: str | None = None) -> DataFrame:
    """Keys plus the latest (or the given) date column renamed to ``name``."""
    col = column or latest_column(df)
    if col not in df.columns:
        raise KeyError(f"date column {col!r} is not in this file")
    return df.select(*keys, F.col(f"`{col}`").alias(name))


def latest_from_long(long_df: DataFrame, keys: Sequence[str], date_col: str, value_col: str, name: str) -> DataFrame:
    """Long form: value at the latest date per key (``max_by``), one partial aggregate."""
    return long_df.groupBy(*keys).agg(
        F.max_by(value_col, date_col).alias(name), F.max(date_col).alias("as_of")
    )


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def columns_by_token(df: DataFrame, key: str, token: str) -> DataFrame:
    """Key first, then every column whose name contains ``token``."""
    return df.select(key, *[c for c in df.columns if token in c and c != key])


def map_columns(df: DataFrame, fn: Callable[[Column], Column], columns: Sequence[str] | None = None) -> DataFrame:
    """Apply one native expression to every (or the listed) column, keeping names."""
    cols = set(columns) if columns is not None else set(df.columns)
    return df.select(*[fn(F.col(f"`{c}`")).alias(c) if c in cols else F.col(f"`{c}`") for c in df.columns])


def clean_all_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Strip ``,`` and ``$`` from every value; missing texts become null."""
    return map_columns(df, clean_text, columns)


def feature_frame(df: DataFrame, keys: Sequence[str], start: int | None = None, features: Sequence[str] | None = None) -> DataFrame:
    """Keys plus features cast to double.

    ``features`` names the columns; ``start`` is the parity form "every column
    from position ``start``", resolved to names on the driver from the schema.
    Texts that are no numbers become null; so does a column of a type without a cast
    to double (dates, arrays), as a whole and without being read.
    """
    names = list(features) if features is not None else [c for c in df.columns[start or 0 :] if c not in keys]
    return df.select(*keys, *[_number(df, c).alias(c) for c in names])


def _number(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    if not isinstance(df.schema[name].dataType, (T.NumericType, T.StringType, T.BooleanType)):
        return F.lit(None).cast("double")
    return c.try_cast("double")
