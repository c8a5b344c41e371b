"""Top-k by a measure (OP-45..49).

``orderBy(...).limit(k)`` plans as ``TakeOrderedAndProject``: each task keeps
its own k best rows and only k rows per task reach the final merge, so the cost
is one scan with no full sort or shuffle. A key tie-break makes ties
deterministic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: str, k: int, tiebreak: Sequence[str] = (), ascending: bool = False) -> DataFrame:
    order = F.asc_nulls_last(f"`{by}`") if ascending else F.desc_nulls_last(f"`{by}`")
    return df.orderBy(order, *[F.asc(c) for c in tiebreak]).limit(k)


def top_k_series(wide: DataFrame, k: int, tiebreak: Sequence[str] = ("FIPS",), positive_only: bool = True) -> DataFrame:
    """Top-k rows of a wide series file by its latest date column; rows whose
    latest value is 0 are dropped (only those can be fitted)."""
    last = wide.columns[-1]
    ranked = top_k(wide, last, k, tiebreak)
    return ranked.filter(F.col(f"`{last}`") > 0) if positive_only else ranked
