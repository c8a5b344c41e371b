"""E3: growth curves for every series.

wide or long series -> long form -> per-series fit in one grouped map
(closed-form start from the linear recurrence, then Levenberg-Marquardt) ->
ceiling and growth rate; the top-k series by latest value are a report on top of the fits
of all series, not a restriction of what is fitted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionlens.operators import growth, projection, topk
from regionlens.operators.series import wide_to_long


def fit_all(long: DataFrame, key: str, t: str = "t", y: str = "value", p0=growth.CASES_P0) -> DataFrame:
    """Parameters of every series: ``(key, a, n, tau, rss, iters, n_points, status, growth_rate)``."""
    fits = growth.logistic_fit(long, key, t, y, p0=p0)
    return fits.withColumn("growth_rate", F.when(F.col("status") == "ok", 1.0 / F.col("tau")))


def fit_wide(wide: DataFrame, ids: Sequence[str], key: str, p0=growth.CASES_P0) -> DataFrame:
    """Same, from a wide file (one column per date)."""
    return fit_all(wide_to_long(wide, ids), key, "t", "value", p0)


def top_series_report(long: DataFrame, fits: DataFrame, key: str, k: int = 8, t: str = "t", y: str = "value") -> DataFrame:
    """Latest value, fitted parameters and growth rate of the top-k series."""
    latest = projection.latest_from_long(long, [key], t, y, "latest").filter(F.col("latest") > 0)
    ranked = topk.top_k(latest, "latest", k, tiebreak=(key,))
    return ranked.join(fits, key, "left")
