"""Logistic growth per series (OP-38, 51-54, 80).

Model: ``y(t) = a / (1 + n * exp(-t / tau))``.

* ``growth_linear`` -- closed-form start values. A logistic obeys
  ``1/y[t+1] = q * (1/y[t]) + (1 - q) / a`` with ``q = exp(-1/tau)``, so a
  per-key linear regression of ``1/y`` on its lag gives ``q`` and the
  intercept ``b``: ``tau = -1/ln q``, ``a = (1 - q)/b``. Pure window + aggregate.
* ``logistic_fit`` -- nonlinear least squares per key. A series becomes one row of
  arrays (at most one point per date however skewed the raw events are), by the
  partitioning on the key that it already has; a task fits all series of an Arrow batch
  at once (``fit_batch``): Levenberg-Marquardt on (series, points) matrices with a damping
  of each series' own, from several starts each.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionlens.functions.scalar import logistic
from regionlens.session import ship_package

# The starting points of the reference's fits (cases, deaths).
CASES_P0 = (70000.0, 500000.0, 6.0)
DEATHS_P0 = (4500.0, 600000.0, 6.0)
MIN_POINTS = 4


def growth_linear(long: DataFrame, key: str, t: str, y: str, min_fraction: float = 0.0) -> DataFrame:
    """``(key, q, b, tau, a, n, n_points, status)`` from the linear recurrence.

    Only points with y > 0 (and y >= ``min_fraction`` * the key's maximum) are
    used. ``n`` makes the curve pass through the key's first used point (early
    points are far from saturation, so a/y - 1 is well conditioned). Status is
    ``ok`` when 0 < q < 1 and b > 0, else ``no_fit``.
    """
    w = Window.partitionBy(key).orderBy(t)
    pts = long.select(key, t, F.col(y).cast("double").alias("y")).filter(F.col("y") > 0)
    if min_fraction > 0:
        pts = pts.withColumn("ymax", F.max("y").over(Window.partitionBy(key))).filter(
            F.col("y") >= F.lit(min_fraction) * F.col("ymax")
        )
    z = pts.select(key, t, "y", (1.0 / F.col("y")).alias("z")).withColumn("z0", F.lag("z").over(w))
    agg = z.groupBy(key).agg(
        F.regr_slope(F.when(F.col("z0").isNotNull(), F.col("z")), "z0").alias("q"),
        F.regr_intercept(F.when(F.col("z0").isNotNull(), F.col("z")), "z0").alias("b"),
        F.count("z0").cast("long").alias("n_points"),
        F.min_by("y", t).alias("y_first"),
        F.min(t).alias("t_first"),
    )
    ok = (F.col("q") > 0) & (F.col("q") < 1) & (F.col("b") > 0)
    tau = F.when(ok, -1.0 / F.log("q"))
    a = F.when(ok, (1.0 - F.col("q")) / F.col("b"))
    out = agg.select(key, "q", "b", "n_points", "y_first", "t_first", tau.alias("tau"), a.alias("a"), F.when(ok, "ok").otherwise("no_fit").alias("status"))
    n = F.when(
        (F.col("status") == "ok") & (F.col("a") > F.col("y_first")),
        (F.col("a") / F.col("y_first") - 1.0) * F.exp(F.col("t_first") / F.col("tau")),
    )
    return out.select(key, "q", "b", "tau", "a", n.alias("n"), "n_points", "status")


def logistic_curve(long: DataFrame, params: DataFrame, key: str, t: str) -> DataFrame:
    """Fitted value per (key, t): params joined to the series on the key."""
    joined = long.join(params.select(key, "a", "n", "tau"), key, "inner")
    return joined.withColumn("fitted", logistic(t, "a", "n", "tau"))


def growth_summary(params: DataFrame, key: str) -> DataFrame:
    """Ceiling ``a`` and growth rate ``1/tau`` of the fitted keys."""
    ok = params.filter(F.col("status") == "ok")
    return ok.select(key, "a", (1.0 / F.col("tau")).alias("growth_rate"))


# --------------------------------------------------------------------------- nonlinear fit
#: Iterations of a fit; one that needs as many has status ``max_iter``.
MAX_ITER = 500
#: Cells (series x points) of the matrices of one vectorised fit.
CELLS = 1 << 19


def _model(t: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(curve, n e^(-t/tau)) of every row of log-parameters ``p`` (rows, 3)."""
    a, n, tau = np.exp(p).T[:, :, None]
    with np.errstate(over="ignore", invalid="ignore"):
        e = n * np.exp(-t / tau)
        return a / (1.0 + e), e


def levenberg_marquardt(t: np.ndarray, y: np.ndarray, used: np.ndarray, p0: np.ndarray, max_iter: int = MAX_ITER, tol: float = 1e-15) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least squares in log-parameters (keeps a, n, tau > 0) of every row of ``t``, ``y``
    (rows, points; ``used`` marks the points that count) from ``p0`` (rows, 3).

    Returns (parameters, rss, iterations) by row. A step that doesn't lower a row's RSS
    is tried again with ten times that row's damping; a row leaves when its RSS, its step
    or its damping says so."""
    p = np.log(p0)
    with np.errstate(invalid="ignore", over="ignore"):
        r = np.where(used, _model(t, p)[0] - y, 0.0)
        cost = (r * r).sum(axis=1)
    lam, iters = np.full(len(p), 1e-3), np.zeros(len(p), dtype=int)
    live = np.flatnonzero(np.isfinite(cost))
    cost[~np.isfinite(cost)] = np.inf
    while len(live):
        f, e = _model(t[live], p[live])
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            share = np.where(np.isfinite(e), e / (1.0 + e), 1.0)
            slope = -f * share
            jac = np.stack([f, slope, np.where(share > 0, slope * t[live] / np.exp(p[live, 2])[:, None], 0.0)], axis=2) * used[live][:, :, None]
        sound = np.isfinite(jac).all(axis=(1, 2))
        live, jac = live[sound], jac[sound]
        g = np.einsum("rtk,rt->rk", jac, r[live])
        h = np.einsum("rtk,rtm->rkm", jac, jac)
        diagonal = np.einsum("rkk->rk", h) + 1e-18
        iters[live] += 1
        trying, tried, last = np.arange(len(live)), np.zeros(len(live), dtype=bool), np.zeros(len(live))
        step = np.zeros((len(live), 3))
        while len(trying):
            at = live[trying]
            damped = h[trying] + lam[at, None, None] * diagonal[trying][:, :, None] * np.eye(3)
            try:
                new = np.linalg.solve(damped, -g[trying][:, :, None])[:, :, 0]
            except np.linalg.LinAlgError:
                new = (np.linalg.pinv(damped) @ -g[trying][:, :, None])[:, :, 0]
            with np.errstate(invalid="ignore", over="ignore"):
                rn = np.where(used[at], _model(t[at], p[at] + new)[0] - y[at], 0.0)
                cn = (rn * rn).sum(axis=1)
                better = np.isfinite(cn) & (cn < cost[at])
            won, to = trying[better], at[better]
            step[won], tried[won] = new[better], True
            last[won] = (cost[to] - cn[better]) / np.maximum(cost[to], 1e-300)
            p[to], r[to], cost[to] = p[to] + new[better], rn[better], cn[better]
            lam[to] = np.maximum(lam[to] / 10, 1e-15)
            trying = trying[~better]
            lam[live[trying]] *= 10
            trying = trying[lam[live[trying]] < 1e16]
        on = tried & (last >= tol) & (np.abs(step).max(axis=1, initial=0.0) >= 1e-12) & (iters[live] < max_iter)
        live = live[on]
    return np.exp(p), cost, iters


def linear_starts(t: np.ndarray, y: np.ndarray, used: np.ndarray) -> np.ndarray:
    """The ``growth_linear`` start of every row (a, n, tau; NaN where there is none): regress
    1/y on its lag over the positive points, q = slope, b = intercept, tau = -1/ln q,
    a = (1-q)/b, n through the first positive point."""
    pos = used & (y > 0)
    front = np.argsort(~pos, axis=1, kind="stable")
    m = pos.sum(axis=1)
    tp, yp = np.take_along_axis(t, front, 1), np.take_along_axis(y, front, 1)
    with np.errstate(all="ignore"):
        z = np.where(np.arange(t.shape[1]) < m[:, None], 1.0 / yp, 0.0)
        pair = np.arange(t.shape[1] - 1) < (m - 1)[:, None]
        k = np.maximum(m - 1, 1)
        x, w = np.where(pair, z[:, :-1], 0.0), np.where(pair, z[:, 1:], 0.0)
        mx, mw = x.sum(axis=1) / k, w.sum(axis=1) / k
        dx, dw = np.where(pair, x - mx[:, None], 0.0), np.where(pair, w - mw[:, None], 0.0)
        q = (dx * dw).sum(axis=1) / (dx * dx).sum(axis=1)
        b = mw - q * mx
        tau = -1.0 / np.log(q)
        a = (1.0 - q) / b
        n = (a / yp[:, 0] - 1.0) * np.exp(tp[:, 0] / tau)
        ok = (m >= 3) & (q > 0) & (q < 1) & (b > 0) & (a > yp[:, 0]) & np.isfinite(n) & (n > 0)
    return np.where(ok[:, None], np.column_stack([a, n, tau]), np.nan)


def heuristic_starts(t: np.ndarray, y: np.ndarray, used: np.ndarray) -> np.ndarray:
    """A ceiling a fifth above the largest value, a tenth of the span as tau, n through the
    first positive point."""
    pos = used & (y > 0)
    top = np.where(used, y, -np.inf).max(axis=1)
    span = np.where(used, t, -np.inf).max(axis=1) - np.where(used, t, np.inf).min(axis=1)
    tau = np.where(span > 0, span, 1.0) / 10.0
    a = np.where(top > 0, 1.2 * top, 1.0)
    first = pos.argmax(axis=1)
    row = np.arange(len(t))
    some = pos.any(axis=1)
    y1, t1 = np.where(some, y[row, first], 1.0), np.where(some, t[row, first], 1.0)
    n = np.maximum((a / y1 - 1.0) * np.exp(np.minimum(t1 / tau, 700.0)), 1e-6)
    return np.column_stack([a, n, tau])


def fit_batch(t: np.ndarray, y: np.ndarray, used: np.ndarray, starts: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Every row's best fit over its starts (each (rows, 3), NaN for none) on y scaled by its
    maximum: (parameters, rss, iterations, status). ``no_fit`` where a row has fewer than
    MIN_POINTS positive values or is flat, or nothing came of any start."""
    rows = len(t)
    fit, rss, iters = np.full((rows, 3), np.nan), np.full(rows, np.inf), np.zeros(rows, dtype=int)
    low, high = np.where(used, y, np.inf).min(axis=1, initial=np.inf), np.where(used, y, -np.inf).max(axis=1, initial=-np.inf)
    able = ((used & (y > 0)).sum(axis=1) >= MIN_POINTS) & (high > low)
    scale = np.where(able, high, 1.0)
    for s in starts:
        at = np.flatnonzero(able & np.isfinite(s).all(axis=1) & (s > 0).all(axis=1))
        if not len(at):
            continue
        begin = s[at].copy()
        begin[:, 0] /= scale[at]
        p, c, it = levenberg_marquardt(t[at], y[at] / scale[at, None], used[at], begin)
        won = c < rss[at]
        fit[at[won]], rss[at[won]], iters[at[won]] = p[won], c[won], it[won]
    fit[:, 0] *= scale
    ok = able & np.isfinite(fit).all(axis=1)
    fit[~ok] = np.nan
    status = np.where(~ok, "no_fit", np.where(iters < MAX_ITER, "ok", "max_iter"))
    return fit, np.where(ok, rss * scale * scale, np.nan), iters, status


def _one(t: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t, y = np.asarray(t, dtype=float)[None], np.asarray(y, dtype=float)[None]
    return t, y, np.ones(t.shape, dtype=bool)


def fit_one(t: np.ndarray, y: np.ndarray, starts) -> tuple[np.ndarray | None, float, int, str]:
    """``fit_batch`` of one series."""
    p, rss, it, status = fit_batch(*_one(t, y), [np.array([s], dtype=float) for s in starts])
    return (None if status[0] == "no_fit" else p[0]), float(rss[0]), int(it[0]), str(status[0])


FIT_SCHEMA = T.StructType(
    [
        T.StructField("a", T.DoubleType()),
        T.StructField("n", T.DoubleType()),
        T.StructField("tau", T.DoubleType()),
        T.StructField("rss", T.DoubleType()),
        T.StructField("iters", T.IntegerType()),
        T.StructField("n_points", T.IntegerType()),
        T.StructField("status", T.StringType()),
    ]
)


def linear_start(t: np.ndarray, y: np.ndarray):
    """``linear_starts`` of one series; None when the recurrence does not give 0<q<1, b>0."""
    s = linear_starts(*_one(t, y))[0]
    return tuple(s) if np.isfinite(s).all() else None


def _heuristic_start(t: np.ndarray, y: np.ndarray):
    return tuple(heuristic_starts(*_one(t, y))[0])


def logistic_fit(
    long: DataFrame,
    key: str,
    t: str,
    y: str,
    starts: DataFrame | None = None,
    p0=CASES_P0,
) -> DataFrame:
    """``(key, a, n, tau, rss, iters, n_points, status)`` per key.

    ``starts`` (e.g. ``growth_linear`` output with columns a, n, tau) supplies a
    per-key start; without it (or for a key it lacks) the same closed-form start is computed
    beside the fit (no second pass over the series, no join). The fixed ``p0`` and a
    data-driven start are always tried too.
    """
    key_field = long.schema[key]
    series = long.select(F.col(key).alias("k"), F.col(t).cast("double").alias("t"), F.coalesce(F.col(y).cast("double"), F.lit(0.0)).alias("y"))
    points = F.sort_array(F.collect_list(F.struct("t", F.nanvl("y", F.lit(0.0)).alias("y"))))
    rows = series.groupBy("k").agg(points.alias("points"))
    rows = rows.select("k", F.col("points.t").alias("t"), F.col("points.y").alias("y"))
    if starts is not None:
        s = starts.select(F.col(key).alias("s_k"), F.col("a").alias("a0"), F.col("n").alias("n0"), F.col("tau").alias("tau0"))
        rows = rows.join(s, F.col("k") == F.col("s_k"), "left").drop("s_k")
    else:
        rows = rows.select("*", *[F.lit(None).cast("double").alias(c) for c in ("a0", "n0", "tau0")])
    out_schema = T.StructType([T.StructField(key, key_field.dataType, True)] + list(FIT_SCHEMA.fields))
    fixed = np.array([float(v) for v in p0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(batch.column(1).offsets.to_numpy())
            at = 0
            while at < batch.num_rows:
                # as many series as fit the matrices, padded to the longest
                widest = np.maximum.accumulate(size[at:]) * np.arange(1, len(size) - at + 1)
                take = max(1, int(np.searchsorted(widest, CELLS, side="right")))
                yield fitted(batch.slice(at, take), size[at : at + take])
                at += take

    def fitted(batch: pa.RecordBatch, size: np.ndarray) -> pa.RecordBatch:
        used = np.arange(max(int(size.max()), 2)) < size[:, None]
        tt, yy = np.zeros(used.shape), np.zeros(used.shape)
        tt[used], yy[used] = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (1, 2))
        given = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in (3, 4, 5)])
        own = linear_starts(tt, yy, used)
        first = np.where(np.isfinite(given).all(axis=1)[:, None], given, own)
        p, rss, iters, status = fit_batch(tt, yy, used, [first, np.broadcast_to(fixed, first.shape), heuristic_starts(tt, yy, used)])
        number = lambda x, ok: pa.array(x, pa.float64(), mask=~ok)
        found, exact = status != "no_fit", status == "ok"
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                *[number(p[:, i], found) for i in range(3)],
                number(rss, exact),
                pa.array(iters.astype(np.int32)),
                pa.array((used & (yy > 0)).sum(axis=1).astype(np.int32)),
                pa.array(status.tolist(), pa.string()),
            ],
            names=out_schema.names,
        )

    # the series keep the partitioning on their key (a window's or an aggregate's): grouping
    # them adds no exchange, and the fits run in the same stage
    ship_package(long.sparkSession)
    return rows.mapInArrow(run, out_schema)
