"""E1: entity rates and rankings.

scan -> two aggregates (cases file, deaths file) -> composite-key join ->
rates -> validity filter -> top-k / map layers. One lazy plan; ``persist`` is
left to the caller because several actions may share the rates table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from regionlens.operators.rates import entity_rates
from regionlens.operators.topk import top_k
from regionlens.sources import standins


def supplier_rates(spark: SparkSession, base: str, method: str = "rint") -> DataFrame:
    return entity_rates(standins.supplier_cases(spark, base), standins.supplier_deaths(spark, base), method=method)


def ranking(rates: DataFrame, by: str, k: int = 10) -> DataFrame:
    """Top-k entities by ``Cases``, ``InfectionRate`` or ``Fatality`` (FIPS breaks ties)."""
    return top_k(rates, by, k, tiebreak=("FIPS",))
