"""Feature preparation (OP-21, 22, 36, 37, 55-57).

Scaling needs two numbers per column. They come from one aggregation pass and
reach the driver as literals (p numbers); the scaling itself is then a plain
projection, so no cross join and no second shuffle. Split and fold membership
come from a hash of the key, so they do not change with partitioning and
DuckDB computes the same assignment.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionlens.functions.scalar import hash_bits, hash_unit
from regionlens.operators.aggregates import collect_stats, column_moments, minmax_stats
from regionlens.session import cut_lineage

HASH_RANGE = 2**32


def standardize(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), ddof: int = 1, fit_on: DataFrame | None = None) -> DataFrame:
    """z = (x - mean) / std. ``ddof=1`` is the sample std (MLlib), ``ddof=0``
    the population std. A zero-variance column gives 0.0. Statistics come from
    ``fit_on`` (e.g. the training slice) when given."""
    stats = collect_stats(column_moments(fit_on if fit_on is not None else df, columns))
    std_key = "std_samp" if ddof == 1 else "std_pop"
    out = []
    for c in columns:
        m, s = stats[c]["mean"], stats[c][std_key]
        x = F.col(f"`{c}`").cast("double")
        out.append((F.lit(0.0) if not s else (x - F.lit(m)) / F.lit(s)).alias(c))
    return df.select(*keep, *out)


def minmax_scale(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """(x - min) / (max - min) per column. Constant columns are dropped and
    returned as the second value (their scaled value would be 0/0)."""
    stats = collect_stats(minmax_stats(df, columns))
    out, constant = [], []
    for c in columns:
        lo, hi = stats[c]["min"], stats[c]["max"]
        if lo is None or hi is None or hi == lo:
            constant.append(c)
            continue
        out.append(((F.col(f"`{c}`").cast("double") - F.lit(lo)) / F.lit(hi - lo)).alias(c))
    return df.select(*keep, *out), constant


def hash_split(df: DataFrame, key: str, test_fraction: float, seed: int, name: str = "split") -> DataFrame:
    """Adds ``split`` = 'test' for about ``test_fraction`` of keys, else 'train'."""
    threshold = int(test_fraction * HASH_RANGE)
    return df.withColumn(name, F.when(hash_unit(key, seed) < F.lit(threshold), "test").otherwise("train"))


def smallest_hashes(hashes: DataFrame, name: str, k: int, bits: int = 60, step: int = 12) -> int:
    """The k-th smallest value of ``name`` (numbers below 2^bits, k from 1 to the rows): counts
    by the upper bits, then by the next bits of the one bucket in which the k-th lies. Every
    step is one aggregate with 2^step counts at most."""
    low, left = 0, k
    for shift in range(bits - step, -step, -step):
        shift, width = max(shift, 0), step + min(shift, 0)
        inside = hashes.filter(F.shiftright(name, shift + width) == F.lit(low >> (shift + width)))
        bucket = F.shiftright(name, shift).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
        for b, n in sorted(inside.groupBy(bucket).count().collect()):
            if left <= n:
                low += b << shift
                break
            left -= n
    return low


def exact_split(df: DataFrame, key: str, test_fraction: float, seed: int, name: str = "split") -> DataFrame:
    """Adds ``split`` = 'test' for the ceil(test_fraction * n) rows with the smallest key
    hashes, else 'train'. Which rows those are is found without sorting; rows of one key
    go together, so the number is exact where keys are unique. A null key is a train row."""
    hashes = cut_lineage(df.filter(F.col(key).isNotNull()).select(hash_bits(key, seed).alias("h")))
    n = hashes.count()
    k = min(n, math.ceil(round(test_fraction * df.count(), 9)))
    if not k:
        return df.withColumn(name, F.lit("train"))
    return df.withColumn(name, F.when(hash_bits(key, seed) <= F.lit(smallest_hashes(hashes, "h", k)), "test").otherwise("train"))


def hash_fold(key: str, seed: int, k: int):
    """Fold number in [0, k) from the same hash (for cross-validation)."""
    return (hash_unit(key, seed) % F.lit(k)).cast("int")


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    """MLlib feature vector; missing values become 0 first (``nan_to_num``)."""
    filled = df.na.fill(0.0, subset=list(columns))
    return VectorAssembler(inputCols=list(columns), outputCol=out, handleInvalid="keep").transform(filled)
