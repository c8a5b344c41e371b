"""Wide <-> long reshaping of date series (OP-41, 44, 50).

Long ``(keys..., date, t, value)`` is the canonical form: it scales with the
number of dates without widening the schema, and every later step (latest
value, growth fits, curves) is a group-by or window on the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionlens.functions.scalar import parse_header_date


def wide_to_long(
    wide: DataFrame,
    ids: Sequence[str],
    date_cols: Sequence[str] | None = None,
    value_name: str = "value",
    first_date=None,
) -> DataFrame:
    """Unpivot the date columns; parse ``M/d/yy`` headers; add the day index ``t``.

    ``t`` counts days from ``first_date`` (default: the first date header), so
    day 1 is the first column, as ``linspace(1, n, n)`` would number it.
    """
    cols = list(date_cols) if date_cols is not None else [c for c in wide.columns if c not in ids]
    if not cols:
        raise ValueError("no date columns")
    long = wide.unpivot(list(ids), [F.col(f"`{c}`") for c in cols], "header", value_name)
    long = long.withColumn("date", parse_header_date("header"))
    first = F.lit(first_date) if first_date is not None else parse_header_date(F.lit(cols[0]))
    return long.select(
        *ids,
        "date",
        (F.datediff("date", first) + 1).cast("int").alias("t"),
        F.col(value_name).cast("double").alias(value_name),
    )


def long_to_wide(long: DataFrame, ids: Sequence[str], header_col: str, value_col: str, headers: Sequence[str]) -> DataFrame:
    """Pivot with explicit headers (no extra pass to find them)."""
    return long.groupBy(*ids).pivot(header_col, list(headers)).agg(F.first(value_col))
