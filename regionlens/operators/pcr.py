"""Principal-component regression (OP-43, 58-62).

The covariance comes from one pass for the means and one for the products, and is
eigen-decomposed on the driver (p x p, as MLlib ``PCA`` does; that estimator
is kept as ``method="mllib"``); scores are an Arrow-batched
matrix product inside ``mapInPandas`` (a k-by-p native projection would not fit
in generated code for wide inputs). The R^2 curve
for the first 1..k components comes from one QR pass over ``[scores, y, 1]``, whose
columns are swept out of y one after another.

Components have arbitrary sign; each is flipped so that its largest-magnitude
entry is positive, which makes scores and loadings reproducible.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionlens.operators.aggregates import collect_stats, column_moments
from regionlens.operators.blocks import cross_products
from regionlens.operators.features import assemble
from regionlens.operators.stepwise import nested_fits, regression_gram, solve_subset
from regionlens.session import ship_package


@dataclass
class PcaFit:
    names: list[str]
    mean: np.ndarray
    components: np.ndarray  # p x k, columns are components
    ratio: np.ndarray  # explained variance ratio per component
    total_variance: float

    @property
    def eigenvalues(self) -> np.ndarray:
        return self.ratio * self.total_variance

    @property
    def loadings(self) -> np.ndarray:
        return self.components * np.sqrt(np.maximum(self.eigenvalues, 0.0))


def centred(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, DataFrame]:
    """(column means, the columns minus their means): a missing value (null or NaN) counts
    as the mean of its column, as in ``scores``. One pass for the means."""
    xs = [F.col(f"`{c}`").cast("double") for c in columns]
    xs = [F.when(~F.isnan(x), x) for x in xs]
    row = df.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(xs)]).first()
    mean = np.array([0.0 if m is None else m for m in row], dtype=float)
    return mean, df.select(*[(F.coalesce(x, F.lit(float(m))) - F.lit(float(m))).alias(c) for x, m, c in zip(xs, mean, columns)])


def covariance(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(column means, sample covariance matrix) from cross products of centred columns, so
    that large means cancel nothing."""
    cols = list(columns)
    p = len(cols)
    mean, frame = centred(df, cols)
    g, n = cross_products(frame.withColumn("__one__", F.lit(1.0)), cols + ["__one__"])
    rest = g[:p, p]
    return mean, (g[:p, :p] - np.outer(rest, rest) / n) / (n - 1)


def fit_pca(df: DataFrame, columns: Sequence[str], k: int | None = None, method: str = "gram") -> PcaFit:
    """Principal components of the sample covariance.

    ``gram`` (default): eigen-decomposition of ``covariance`` on the driver (p^2 numbers).
    ``mllib`` uses ``pyspark.ml.feature.PCA`` on the centred columns.
    """
    cols = list(columns)
    p = len(cols)
    k = k or p
    if method == "mllib":
        mean, frame = centred(df, cols)
        stats = collect_stats(column_moments(frame, cols))
        total = float(sum(stats[c]["std_samp"] ** 2 for c in cols))
        model = PCA(k=k, inputCol="features", outputCol="pca").fit(assemble(frame, cols))
        comp = model.pc.toArray().copy()
        ratio = np.asarray(model.explainedVariance.toArray(), dtype=float)
    else:
        mean, cov = covariance(df, cols)
        w, v = np.linalg.eigh(cov)
        order = np.argsort(w)[::-1]
        w, v = w[order], v[:, order]
        total = float(np.trace(cov))
        comp = v[:, :k].copy()
        ratio = w[:k] / w.sum() if w.sum() > 0 else np.zeros(k)
    for j in range(comp.shape[1]):
        i = int(np.argmax(np.abs(comp[:, j])))
        if comp[i, j] < 0:
            comp[:, j] = -comp[:, j]
    return PcaFit(cols, mean, comp, ratio, total)


def scores(df: DataFrame, fit: PcaFit, keep: Sequence[str] = (), k: int | None = None, prefix: str = "pc") -> DataFrame:
    """Centred projection onto the first k components as columns pc1..pck.

    Each Arrow batch is multiplied by the p x k component matrix with NumPy
    inside ``mapInPandas``; the matrix is a few KB and travels with the task.
    A missing feature value is replaced by the column mean (contributes 0).
    """
    k = k or fit.components.shape[1]
    keep = list(keep)
    w = fit.components[:, :k].copy()
    mean = fit.mean.copy()
    names = list(fit.names)
    src = df.select(*keep, *[F.col(f"`{c}`").cast("double").alias(f"__x{i}") for i, c in enumerate(names)])
    in_fields = {f.name: f for f in src.schema.fields}
    schema = T.StructType(
        [in_fields[c] for c in keep] + [T.StructField(f"{prefix}{j + 1}", T.DoubleType()) for j in range(k)]
    )
    xcols = [f"__x{i}" for i in range(len(names))]

    def project(batches):
        for b in batches:
            x = b[xcols].to_numpy(dtype=float)
            x = np.where(np.isnan(x), mean, x) - mean
            s = x @ w
            out = b[keep].copy() if keep else b.iloc[:, :0].copy()
            for j in range(k):
                out[f"{prefix}{j + 1}"] = s[:, j]
            yield out

    ship_package(df.sparkSession)
    return src.mapInPandas(project, schema)


def variance_frame(spark: SparkSession, fit: PcaFit) -> DataFrame:
    ratio = fit.ratio
    rows = [(j + 1, float(r), float(np.sum(ratio[: j + 1])), float(fit.eigenvalues[j])) for j, r in enumerate(ratio)]
    return spark.createDataFrame(rows, "component int, ratio double, cumulative double, eigenvalue double")


def loadings_frame(spark: SparkSession, fit: PcaFit) -> DataFrame:
    lo = fit.loadings
    rows = [(c, j + 1, float(lo[i, j])) for i, c in enumerate(fit.names) for j in range(lo.shape[1])]
    return spark.createDataFrame(rows, "feature string, component int, loading double")


def r2_curve(scored: DataFrame, y: str, k: int) -> list[dict]:
    """Centred R^2 of y on the first i components (with intercept), i = 1..k."""
    gram = regression_gram(scored, [f"pc{j + 1}" for j in range(k)], y)
    rss, rank = nested_fits(gram)
    return [{"components": i, "r2": 1.0 - rss[i] / rss[0] if rss[0] > 0 else float("nan"), "rank": rank[i]} for i in range(1, k + 1)]


def fit_linear(scored: DataFrame, names: Sequence[str], y: str) -> tuple[np.ndarray, float]:
    """OLS with intercept from one QR pass: (coefficients, intercept)."""
    gram = regression_gram(scored, list(names), y)
    beta, _, _ = solve_subset(gram, list(range(len(names))), intercept=True)
    return beta[:-1], float(beta[-1])


R2_SCHEMA = T.StructType(
    [T.StructField("components", T.IntegerType()), T.StructField("r2", T.DoubleType()), T.StructField("rank", T.IntegerType())]
)
