"""Attribute panel: rates joined to several attribute tables on one key (OP-09, 11, 24).

The reference joins the attribute tables to each other first (bushy) and then
to the rates. We keep that shape. No side is forced to broadcast: attribute
tables grow with the number of regions, so the decision is left to AQE, which
broadcasts a side only when its measured size is under
``spark.sql.adaptive.autoBroadcastJoinThreshold`` and otherwise keeps a
sort-merge join.

Rows without a key share the key ``MISSING_KEY``, which may so hold any part of the rows.
They are dealt over ``SALTS`` parts: on the left by a hash of the row, on the right each
such row once a part; all other rows have salt 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a missing key is padded to, and over how many parts its rows are dealt.
MISSING_KEY = "00000"
SALTS = 32


def salted_join(left: DataFrame, right: DataFrame, key: str, missing: str = MISSING_KEY, salts: int = SALTS) -> DataFrame:
    """Inner join on ``key`` in which the rows of the ``missing`` key meet in ``salts`` parts."""
    lost = F.col(key) == F.lit(missing)
    part = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(salts)).cast("int")
    every = F.when(lost, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = left.withColumn("__salt", F.when(lost, part).otherwise(0))
    right = right.withColumn("__salt", F.explode(every))
    return left.join(right, [key, "__salt"], "inner").drop("__salt")


def attribute_join(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Nested inner join of attribute tables: t0 ⋈ (t1 ⋈ (t2 ⋈ ...))."""
    acc = tables[-1]
    for t in reversed(tables[:-1]):
        acc = salted_join(t, acc, key)
    return acc


def panel(
    rates: DataFrame,
    attributes: Sequence[DataFrame],
    key: str = "FIPS",
    drop: Sequence[str] = (),
) -> DataFrame:
    """Rates ⋈ (attribute join), then drop the listed columns."""
    joined = salted_join(rates, attribute_join(attributes, key), key)
    return joined.drop(*drop) if drop else joined
