"""Entity rates: composite-key join, ratios, key padding, validity filter (OP-12, 16, 23, 33-35).

The plan is one lazy chain: join -> ratios -> fill -> pad -> filter. Catalyst
moves ``Population != 0`` below the join and turns the cross-side comparisons
into join conditions; everything else is a codegen'd projection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionlens.functions.scalar import pad_key, rate
from regionlens.operators.missing import fill_numeric

RATE_COLUMNS = ("FIPS", "County", "Cases", "Population", "Deaths", "InfectionRate", "Fatality")
# Decimals kept for the two rates.
INFECTION_DIGITS = 5
FATALITY_DIGITS = 4


def validity(cases: str = "Cases", deaths: str = "Deaths", population: str = "Population") -> Column:
    """Population != 0 AND Cases >= Deaths AND Population >= Cases."""
    c, d, p = F.col(cases), F.col(deaths), F.col(population)
    return (p != 0) & (c >= d) & (p >= c)


def valid_rows(df: DataFrame, cases: str = "Cases", deaths: str = "Deaths", population: str = "Population") -> DataFrame:
    return df.filter(validity(cases, deaths, population))


def add_rates(df: DataFrame, method: str = "rint", cases: str = "Cases", deaths: str = "Deaths", population: str = "Population") -> DataFrame:
    """InfectionRate = cases/population (5 d.p.), Fatality = deaths/cases (4 d.p.).

    ``method='rint'`` rounds half to even; ``'format_number'`` is the parity
    form (fixed-decimal text cast back). A zero denominator gives 0.
    """
    return df.withColumns(
        {
            "InfectionRate": rate(cases, population, INFECTION_DIGITS, method),
            "Fatality": rate(deaths, cases, FATALITY_DIGITS, method),
        }
    )


def join_composite(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("FIPS", "Combined_Key")) -> DataFrame:
    """Inner equi-join on several keys. Both sides hash-partition on the keys;
    when both come from aggregations on the same keys the join adds no shuffle,
    and AQE turns it into a broadcast join when one side is small at run time."""
    return left.join(right, list(keys), "inner")


def _has_key(df: DataFrame, key: str) -> Column:
    present = F.col(key).isNotNull()
    return present & ~F.isnan(key) if df.schema[key].dataType.typeName() in ("float", "double") else present


def entity_rates(
    cases: DataFrame,
    deaths: DataFrame,
    keys: Sequence[str] = ("FIPS", "Combined_Key"),
    method: str = "rint",
    drop_missing_key: bool = False,
) -> DataFrame:
    """The reference's rates table: ``FIPS, County, Cases, Population, Deaths, InfectionRate, Fatality``.

    Missing numbers (including a missing FIPS) become 0 before the join, so a
    missing key is reported as ``'00000'`` unless ``drop_missing_key``.
    """
    key_col, name_col = keys
    if drop_missing_key:
        cases, deaths = (d.filter(_has_key(d, key_col)) for d in (cases, deaths))
    joined = join_composite(fill_numeric(cases), fill_numeric(deaths), keys)
    out = add_rates(joined, method).withColumnRenamed(name_col, "County")
    out = fill_numeric(out).withColumn(key_col, pad_key(key_col))
    return valid_rows(out).select(
        F.col(key_col).alias("FIPS"), "County", "Cases", "Population", "Deaths", "InfectionRate", "Fatality"
    )
