"""No-intercept OLS and forward stepwise selection (OP-70..78).

One Spark pass builds the triangular factor R of ``[x_1..x_p, y, 1]`` (``blocks.tall_qr``:
a QR per task, factors merged by a tree). Every model is solved from that (p+2)^2 matrix
on the driver -- the reference refits on all rows p(p+1)/2 times; here the data is read
once. R holds the columns' inner products without squaring them, so a residual sum of
squares far below the sum of squares is right, too. Singular designs are handled with a
rank-revealing solve, and the rank (not the count) enters the criteria.

Criteria for a model of rank k on n rows, without intercept (R^2 uncentred):
R^2 = 1 - RSS/sum(y^2); adjR^2 = 1 - n/(n-k) (1 - R^2);
llf = -n/2 (ln(2 pi RSS/n) + 1); AIC = -2 llf + 2k; BIC = -2 llf + k ln n.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionlens.operators.blocks import tall_qr
from regionlens.operators.leaps import DEPENDENT, leaps

ONE = "__one__"


@dataclass
class Gram:
    """Triangular factor of ``names + [y, 1]`` over ``n`` rows, and its cross products."""

    r: np.ndarray
    names: list[str]
    y: str
    n: float

    @property
    def g(self) -> np.ndarray:
        return self.r.T @ self.r

    @property
    def p(self) -> int:
        return len(self.names)

    @property
    def response(self) -> np.ndarray:
        return self.r[:, self.p]

    @property
    def yty(self) -> float:
        return float(self.response @ self.response)


def regression_gram(df: DataFrame, features: Sequence[str], y: str) -> Gram:
    cols = list(features) + [y]
    frame = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols], F.lit(1.0).alias(ONE))
    r, n = tall_qr(frame, cols + [ONE])
    return Gram(r, list(features), y, float(n))


def _solved(gram: Gram, cols: Sequence[int]) -> tuple[np.ndarray, float, int, np.ndarray]:
    """Coefficients, RSS, rank and (pseudo-)inverse cross products for columns of R."""
    a, y = gram.r[:, list(cols)], gram.response
    # unit columns for a better-conditioned rank decision
    d = np.linalg.norm(a, axis=0)
    d = np.where(d > 0, d, 1.0)
    u, s, vt = np.linalg.svd(a / d, full_matrices=False)
    keep = s > DEPENDENT * (s[0] if len(s) else 1.0)
    u, s, vt = u[:, keep], s[keep], vt[keep]
    along = u.T @ y
    rest = y - u @ along
    rest -= u @ (u.T @ rest)
    return (vt.T @ (along / s)) / d, float(rest @ rest), int(keep.sum()), ((vt.T / s**2) @ vt) / np.outer(d, d)


def solve_subset(gram: Gram, idx: Sequence[int], intercept: bool = False) -> tuple[np.ndarray, float, int]:
    """Coefficients, RSS and rank of y on the columns ``idx`` (optionally + 1)."""
    cols = list(idx) + ([gram.p + 1] if intercept else [])
    if not cols:
        return np.zeros(0), gram.yty, 0
    return _solved(gram, cols)[:3]


def nested_fits(gram: Gram) -> tuple[list[float], list[int]]:
    """(RSS, rank) of y on 1, on 1 and the first column, on 1 and the first two, ...: the
    columns are made orthogonal in turn and taken out of y."""
    rest, w = gram.response.copy(), gram.r.copy()
    out, rank = [], 0
    for c in [gram.p + 1, *range(gram.p)]:
        rank += _take_out(w, rest, c, np.linalg.norm(gram.r[:, c]))
        out.append((float(rest @ rest), rank))
    return [x[0] for x in out], [x[1] for x in out]


def _take_out(w: np.ndarray, rest: np.ndarray, c: int, norm: float) -> int:
    """Sweep column c of ``w`` out of all columns and of ``rest``, in place; 1 if it was
    independent of those swept before, else 0 and nothing changes."""
    size = np.linalg.norm(w[:, c])
    if norm == 0 or size <= DEPENDENT * norm:
        return 0
    q = w[:, c] / size
    for _ in range(2):  # twice: what rounding left the first time
        w -= np.outer(q, q @ w)
        rest -= q * (q @ rest)
    return 1


def criteria(rss: float, n: float, k: int, yty: float) -> dict[str, float]:
    r2 = 1.0 - rss / yty if yty else float("nan")
    adj = 1.0 - n / (n - k) * (1.0 - r2) if n > k else float("nan")
    llf = -n / 2.0 * (math.log(2.0 * math.pi * rss / n) + 1.0) if rss > 0 else float("inf")
    return {"r2": r2, "adj_r2": adj, "llf": llf, "aic": -2 * llf + 2 * k, "bic": -2 * llf + k * math.log(n)}


def forward_path(gram: Gram) -> list[dict]:
    """Sizes 1..rank: at each step add the predictor with the lowest RSS (first in
    column order on ties) of those that raise the rank; the path ends when none does.

    The columns not yet chosen are kept orthogonal to the chosen ones: a candidate lowers
    the RSS by (w.rest)^2 / w.w, and a step sweeps the chosen one out of all others in place."""
    chosen: list[int] = []
    path = []
    w, rest = gram.r[:, : gram.p].copy(), gram.response.copy()
    norms = np.linalg.norm(w, axis=0)
    for size in range(1, gram.p + 1):
        own = np.linalg.norm(w, axis=0)
        able = own > DEPENDENT * norms
        able[chosen] = False
        if not able.any():
            break
        gains = np.where(able, (rest @ w / np.where(able, own, 1.0)) ** 2, -1.0)
        c = int(gains.argmax())
        _take_out(w, rest, c, norms[c])
        chosen.append(c)
        row = {
            "size": size,
            "added": gram.names[c],
            "predictors": [gram.names[i] for i in chosen],
            "rss": float(rest @ rest),
            "rank": size,
        }
        row.update(criteria(row["rss"], gram.n, size, gram.yty))
        path.append(row)
    return path


PATH_SCHEMA = T.StructType(
    [
        T.StructField("size", T.IntegerType()),
        T.StructField("added", T.StringType()),
        T.StructField("predictors", T.ArrayType(T.StringType())),
        T.StructField("rss", T.DoubleType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("r2", T.DoubleType()),
        T.StructField("adj_r2", T.DoubleType()),
        T.StructField("aic", T.DoubleType()),
        T.StructField("bic", T.DoubleType()),
    ]
)


def forward_path_frame(spark: SparkSession, path: Sequence[dict]) -> DataFrame:
    """A ``forward_path`` as a DataFrame (at most p rows)."""
    rows = [{k: r[k] for k in PATH_SCHEMA.names} for r in path]
    return spark.createDataFrame(rows, PATH_SCHEMA)


def choose(path: Sequence[dict], criterion: str) -> dict:
    """Model with max adj_r2 or min aic / bic (smallest size on ties)."""
    if criterion == "adj_r2":
        return max(path, key=lambda r: (r["adj_r2"], -r["size"]))
    return min(path, key=lambda r: (r[criterion], r["size"]))


# --------------------------------------------------------------------------- single-predictor models, Spark-side
def single_predictor_models(df: DataFrame, features: Sequence[str], y: str) -> DataFrame:
    """Per predictor x (no intercept): coef = Σxy/Σx², RSS = Σy² − (Σxy)²/Σx²,
    and the criteria with k = 1. Computed by one aggregation and a ``stack``."""
    aggs = [F.sum(F.col(y) * F.col(y)).alias("yy"), F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(features):
        aggs += [F.sum(F.col(c) * F.col(c)).alias(f"xx{i}"), F.sum(F.col(c) * F.col(y)).alias(f"xy{i}")]
    wide = df.select(*features, y).na.drop().agg(*aggs)
    parts = ", ".join(f"'{c}', xx{i}, xy{i}" for i, c in enumerate(features))
    long = wide.selectExpr("yy", "n", f"stack({len(features)}, {parts}) as (predictor, xx, xy)")
    n = F.col("n").cast("double")
    rss = F.col("yy") - F.col("xy") * F.col("xy") / F.col("xx")
    r2 = 1.0 - F.col("rss") / F.col("yy")
    llf = -n / 2.0 * (F.log(2.0 * math.pi * F.col("rss") / n) + 1.0)
    return (
        long.select("predictor", "n", "yy", (F.col("xy") / F.col("xx")).alias("coef"), rss.alias("rss"))
        .withColumn("r2", r2)
        .withColumn("adj_r2", 1.0 - n / (n - 1.0) * (1.0 - F.col("r2")))
        .withColumn("aic", -2.0 * llf + 2.0)
        .withColumn("bic", -2.0 * llf + F.log(n))
    )


# --------------------------------------------------------------------------- best subset of size k
def unrank_combination(idx: int, p: int, k: int) -> list[int]:
    """The idx-th k-subset of range(p) in lexicographic order."""
    out, start = [], 0
    for slot in range(k):
        for c in range(start, p):
            cnt = math.comb(p - c - 1, k - slot - 1)
            if idx < cnt:
                out.append(c)
                start = c + 1
                break
            idx -= cnt
    return out


def best_subset(spark: SparkSession, gram: Gram, k: int) -> DataFrame:
    """Lowest-RSS model with exactly k predictors, by leaps and bounds over Spark tasks.

    The forward path gives the first bound. Where fewer than k columns are independent,
    the path's columns are filled up with the first others, which change nothing."""
    path = forward_path(gram)
    sub = [gram.names.index(c) for c in path[min(k, len(path)) - 1]["predictors"]] if path and k else []
    if k <= len(path) and k:
        sub = leaps(spark, gram.r[:, : gram.p], gram.response, k, path[k - 1]["rss"], sub)
    sub = sorted(sub + [i for i in range(gram.p) if i not in sub][: k - len(sub)])
    _, rss, rank = solve_subset(gram, sub)
    return spark.createDataFrame([(",".join(gram.names[i] for i in sub), rss, rank)], "predictors string, rss double, rank int")


def all_subsets_small(gram: Gram, k: int) -> list[tuple[list[str], float]]:
    """Driver-side enumeration for tests."""
    subsets = [unrank_combination(i, gram.p, k) for i in range(math.comb(gram.p, k))]
    return [([gram.names[i] for i in s], solve_subset(gram, s)[1]) for s in subsets]


# --------------------------------------------------------------------------- coefficient table
def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction for the regularized incomplete beta (Lentz)."""
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < 1e-15:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbeta = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
    front = math.exp(lbeta + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * _betacf(a, b, x) / a
    return 1.0 - front * _betacf(b, a, 1.0 - x) / b


def t_two_sided_p(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    if not math.isfinite(t):
        return 0.0
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def ols_summary(gram: Gram, predictors: Sequence[str]) -> list[dict]:
    """coef, std err, t and p per predictor of a full-rank no-intercept model."""
    idx = [gram.names.index(c) for c in predictors]
    beta, rss, rank, inv = _solved(gram, idx)
    if rank < len(idx):
        raise ValueError("design is rank deficient; drop dependent columns first")
    n = gram.n
    dof = n - rank
    sigma2 = rss / dof
    out = []
    for j, c in enumerate(predictors):
        se = math.sqrt(sigma2 * inv[j, j])
        t = float(beta[j] / se) if se > 0 else float("inf")
        out.append({"predictor": c, "coef": float(beta[j]), "std_err": float(se), "t": t, "p_value": float(t_two_sided_p(t, dof))})
    return out


def fitted_column(coefs: dict[str, float]):
    """Σ coef·x as a native column expression."""
    expr = F.lit(0.0)
    for c, b in coefs.items():
        expr = expr + F.lit(float(b)) * F.col(f"`{c}`")
    return expr
