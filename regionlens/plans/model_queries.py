"""Registered queries for growth curves, feature preparation and the models.

Stand-ins (see ``sources.standins``): the regression frame is ``lineitem`` with
min-max scaled ``l_quantity, l_discount, l_tax, l_linenumber`` and response
``log10(1 + l_extendedprice)``; PCA uses the 64 coordinates of
``embeddings``; the classifier predicts ``labels.quality`` from text-shape
features of ``documents``; growth curves use the cumulative ``events`` series.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionlens.functions.scalar import log10_1p, log10_positive, round_to
from regionlens.operators import aggregates, boost, features, growth, metrics, newton_trees, pcr, stepwise
from regionlens.plans.registry import _SERIES_SQL, PANEL_SQL, register
from regionlens.session import cut_lineage
from regionlens.sources import standins
from regionlens.sources.tables import load

# ============================================================================ growth
_GROWTH_SQL = (
    _SERIES_SQL
    + """
, pts AS (SELECT user_id, t, cases::DOUBLE AS y FROM ser WHERE cases > 0),
z AS (SELECT user_id, t, y, 1 / y AS z, lag(1 / y) OVER (PARTITION BY user_id ORDER BY t) AS z0 FROM pts),
agg AS (
  SELECT user_id, regr_slope(z, z0) AS q, regr_intercept(z, z0) AS b, count(z0)::BIGINT AS n_points,
         arg_min(y, t) AS y_first, min(t) AS t_first
  FROM z GROUP BY user_id),
fit AS (
  SELECT *, (q > 0 AND q < 1 AND b > 0) AS ok FROM agg),
par AS (
  SELECT user_id, q, b, n_points, y_first, t_first,
         CASE WHEN ok THEN -1.0 / ln(q) END AS tau,
         CASE WHEN ok THEN (1.0 - q) / b END AS a,
         CASE WHEN ok THEN 'ok' ELSE 'no_fit' END AS status
  FROM fit),
params AS (
  SELECT *, CASE WHEN status = 'ok' AND a > y_first THEN (a / y_first - 1.0) * exp(t_first / tau) END AS n FROM par)
"""
)


def _series(spark: SparkSession, base: str) -> DataFrame:
    return standins.event_series(spark, base)


def _linear(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    s = _series(spark, base)
    return s, growth.growth_linear(s, "user_id", "t", "cases")


@register(
    "growth_linear",
    _GROWTH_SQL
    + """
SELECT user_id, round_even(q * 1e10, 0) / 1e10 AS q, round_even(b * 1e12, 0) / 1e12 AS b,
       round_even(tau * 1e6, 0) / 1e6 AS tau, round_even(a * 1e4, 0) / 1e4 AS a, n_points, status
FROM params
""",
)
def q_growth_linear(spark, base):
    _, p = _linear(spark, base)
    return p.select(
        "user_id",
        round_to("q", 10).alias("q"),
        round_to("b", 12).alias("b"),
        round_to("tau", 6).alias("tau"),
        round_to("a", 4).alias("a"),
        "n_points",
        "status",
    )


@register(
    "growth_summary",
    _GROWTH_SQL
    + """
SELECT user_id, round_even(a * 1e4, 0) / 1e4 AS a, round_even(1.0 / tau * 1e9, 0) / 1e9 AS growth_rate
FROM params WHERE status = 'ok'
""",
)
def q_growth_summary(spark, base):
    _, p = _linear(spark, base)
    g = growth.growth_summary(p, "user_id")
    return g.select("user_id", round_to("a", 4).alias("a"), round_to("growth_rate", 9).alias("growth_rate"))


@register(
    "logistic_curve",
    _GROWTH_SQL
    + """
SELECT s.user_id, s.t, s.cases::DOUBLE AS actual,
       round_even(p.a / (1.0 + p.n * exp(-s.t / p.tau)) * 1e6, 0) / 1e6 AS fitted
FROM ser s JOIN params p ON s.user_id = p.user_id
WHERE p.n IS NOT NULL
""",
)
def q_logistic_curve(spark, base):
    s, p = _linear(spark, base)
    curve = growth.logistic_curve(s, p.filter(F.col("n").isNotNull()), "user_id", "t")
    return curve.select("user_id", "t", F.col("cases").cast("double").alias("actual"), round_to("fitted", 6).alias("fitted"))


@register("logistic_fit")
def q_logistic_fit(spark, base):
    return growth.logistic_fit(_series(spark, base), "user_id", "t", "cases")


@register("logistic_fit_deaths")
def q_logistic_fit_deaths(spark, base):
    return growth.logistic_fit(_series(spark, base), "user_id", "t", "deaths", p0=growth.DEATHS_P0)


def _fit_sql(measure: str, trials: int = 250) -> str:
    """Levenberg-Marquardt for every user in a recursive query, a trial step a round, from a
    ceiling a fifth above the last value and a tenth of the span as tau. Logs of the
    parameters to 4 places."""
    dot = lambda x, y: f"list_dot_product({x}, {y})"
    curve = "list_transform(ts, lambda t: exp(a{0}) / (1 + exp(n{0} - t * exp(-u{0}))))"
    cost = lambda f: f"list_sum(list_transform(list_zip({f}, ys), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    det = "({0}11 * ({0}22 * {0}33 - {0}23 * {0}23) - {0}12 * ({0}12 * {0}33 - {0}23 * {0}13) + {0}13 * ({0}12 * {0}23 - {0}22 * {0}13))"
    return (
        _SERIES_SQL.replace("WITH b AS", "WITH RECURSIVE b AS", 1)
        + f""",
s AS (SELECT user_id, list(t::DOUBLE ORDER BY t) AS ts, max({measure})::DOUBLE AS top, list({measure}::DOUBLE ORDER BY t) AS raw,
        (max(t) - min(t)) / 10.0 AS tau0, arg_min({measure}, t) FILTER (WHERE {measure} > 0)::DOUBLE AS y1, (min(t) FILTER (WHERE {measure} > 0))::DOUBLE AS t1
      FROM ser GROUP BY user_id HAVING count(*) FILTER (WHERE {measure} > 0) >= 4 AND max({measure}) > min({measure})),
y AS (SELECT user_id, ts, top, list_transform(raw, lambda v: v / top) AS ys, ln(1.2) AS a, ln(greatest((1.2 * top / y1 - 1) * exp(t1 / tau0), 1e-6)) AS n, ln(tau0) AS u FROM s),
lm AS (
  SELECT user_id, 0 AS it, a, n, u, 1e-3::DOUBLE AS lam, {cost(curve.format(''))} AS cost FROM y
  UNION ALL
  SELECT user_id, it + 1, CASE WHEN won THEN a2 ELSE a END, CASE WHEN won THEN n2 ELSE n END, CASE WHEN won THEN u2 ELSE u END,
         CASE WHEN won THEN greatest(lam / 10, 1e-15) ELSE least(lam * 10, 1e16) END, CASE WHEN won THEN cost2 ELSE cost END
  FROM (SELECT *, coalesce(isfinite(cost2) AND cost2 < cost, false) AS won FROM (SELECT *, {cost(curve.format('2'))} AS cost2 FROM (
    SELECT *, a - (g1 * (d22 * d33 - d23 * d23) - d12 * (g2 * d33 - d23 * g3) + d13 * (g2 * d23 - d22 * g3)) / det AS a2,
           n - (d11 * (g2 * d33 - d23 * g3) - g1 * (d12 * d33 - d23 * d13) + d13 * (d12 * g3 - g2 * d13)) / det AS n2,
           u - (d11 * (d22 * g3 - g2 * d23) - d12 * (d12 * g3 - g2 * d13) + g1 * (d12 * d23 - d22 * d13)) / det AS u2
    FROM (SELECT *, {det.format('d')} AS det FROM (
      SELECT *, {dot('j1', 'j1')} * (1 + lam) AS d11, {dot('j1', 'j2')} AS d12, {dot('j1', 'j3')} AS d13, {dot('j2', 'j2')} * (1 + lam) AS d22,
             {dot('j2', 'j3')} AS d23, {dot('j3', 'j3')} * (1 + lam) AS d33, {dot('j1', 'r')} AS g1, {dot('j2', 'r')} AS g2, {dot('j3', 'r')} AS g3
      FROM (SELECT *, list_transform(list_zip(j2, ts), lambda z: z[1] * z[2] * exp(-u)) AS j3 FROM (
        SELECT *, f AS j1, list_transform(f, lambda v: -v * (1 - v / exp(a))) AS j2, list_transform(list_zip(f, ys), lambda z: z[1] - z[2]) AS r
        FROM (SELECT lm.*, ts, ys, {curve.format('').replace('exp(a)', 'exp(lm.a)').replace('exp(n ', 'exp(lm.n ').replace('exp(-u)', 'exp(-lm.u)')} AS f
              FROM lm JOIN y USING (user_id) WHERE it < {trials})))))))))
SELECT user_id, round_even((lm.a + ln(top)) * 1e4, 0) / 1e4 AS log_a, round_even(lm.n * 1e4, 0) / 1e4 AS log_n, round_even(lm.u * 1e4, 0) / 1e4 AS log_tau
FROM lm JOIN y USING (user_id) WHERE it = {trials}
"""
    )


def _fit_logs(spark, base, measure: str, p0) -> DataFrame:
    fits = growth.logistic_fit(_series(spark, base), "user_id", "t", measure, p0=p0).filter(F.col("status") == "ok")
    return fits.select("user_id", *[round_to(F.log(c), 4).alias(f"log_{c}") for c in ("a", "n", "tau")])


@register("logistic_params", _fit_sql("cases"))
def q_logistic_params(spark, base):
    """The fitted parameters of every series of cases (their logs)."""
    return _fit_logs(spark, base, "cases", growth.CASES_P0)


@register("logistic_params_deaths", f"SELECT * FROM ({_fit_sql('deaths')}) WHERE log_a < 10")
def q_logistic_params_deaths(spark, base):
    """Series of deaths whose ceiling the data determine; where they are still growing
    exponentially, a and n run off together and only their ratio is known."""
    return _fit_logs(spark, base, "deaths", growth.DEATHS_P0).filter("log_a < 10")


# ============================================================================ descriptive statistics
_STAT_COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@register(
    "minmax_stats",
    "\nUNION ALL\n".join(f"SELECT '{c}' AS \"column\", min({c})::DOUBLE AS min, max({c})::DOUBLE AS max FROM lineitem" for c in _STAT_COLS),
)
def q_minmax_stats(spark, base):
    return aggregates.minmax_stats(load(spark, base, "lineitem"), _STAT_COLS)


@register(
    "column_moments",
    "\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", count({c})::BIGINT AS n, round_even(avg({c}) * 1e6, 0) / 1e6 AS mean, "
        f"round_even(stddev_samp({c}) * 1e6, 0) / 1e6 AS std_samp, round_even(stddev_pop({c}) * 1e6, 0) / 1e6 AS std_pop FROM lineitem"
        for c in _STAT_COLS
    ),
)
def q_column_moments(spark, base):
    m = aggregates.column_moments(load(spark, base, "lineitem"), _STAT_COLS)
    return m.select("column", "n", *[round_to(c, 6).alias(c) for c in ("mean", "std_samp", "std_pop")])


# ============================================================================ regression frame
REG_FEATURES = ("l_quantity", "l_discount", "l_tax", "l_linenumber")
REG_KEYS = ("l_orderkey", "k_line")

_REG_SQL = """
WITH b AS (
  SELECT min(l_quantity) AS q0, max(l_quantity) AS q1, min(l_discount) AS d0, max(l_discount) AS d1,
         min(l_tax) AS t0, max(l_tax) AS t1, min(l_linenumber)::DOUBLE AS n0, max(l_linenumber)::DOUBLE AS n1
  FROM lineitem),
x AS (
  SELECT l_orderkey, l_linenumber AS k_line,
         (l_quantity - q0) / (q1 - q0) AS l_quantity, (l_discount - d0) / (d1 - d0) AS l_discount,
         (l_tax - t0) / (t1 - t0) AS l_tax, (l_linenumber::DOUBLE - n0) / (n1 - n0) AS l_linenumber,
         log10(1 + l_extendedprice) AS y
  FROM lineitem, b),
s AS (
  SELECT sum(y * y) AS yy, count(*)::BIGINT AS n,
         sum(l_quantity * l_quantity) AS xx0, sum(l_quantity * y) AS xy0,
         sum(l_discount * l_discount) AS xx1, sum(l_discount * y) AS xy1,
         sum(l_tax * l_tax) AS xx2, sum(l_tax * y) AS xy2,
         sum(l_linenumber * l_linenumber) AS xx3, sum(l_linenumber * y) AS xy3,
         sum(l_quantity * l_discount) AS x01, sum(l_quantity * l_tax) AS x02, sum(l_quantity * l_linenumber) AS x03,
         sum(l_discount * l_tax) AS x12, sum(l_discount * l_linenumber) AS x13, sum(l_tax * l_linenumber) AS x23
  FROM x),
m AS (
  SELECT 'l_quantity' AS predictor, xx0 AS xx, xy0 AS xy, yy, n FROM s UNION ALL
  SELECT 'l_discount', xx1, xy1, yy, n FROM s UNION ALL
  SELECT 'l_tax', xx2, xy2, yy, n FROM s UNION ALL
  SELECT 'l_linenumber', xx3, xy3, yy, n FROM s),
r AS (
  SELECT predictor, n, yy, xy / xx AS coef, yy - xy * xy / xx AS rss FROM m),
c AS (
  SELECT *, 1 - rss / yy AS r2, -n / 2.0 * (ln(2 * pi() * rss / n) + 1) AS llf FROM r),
crit AS (
  SELECT predictor, coef, rss, r2, 1 - n / (n - 1.0) * (1 - r2) AS adj_r2, -2 * llf + 2 AS aic, -2 * llf + ln(n) AS bic FROM c)
"""


def regression_frame(spark: SparkSession, base: str) -> DataFrame:
    li = load(spark, base, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").alias("k_line"), *REG_FEATURES, log10_1p("l_extendedprice").alias("y")
    )
    scaled, _constant = features.minmax_scale(li, REG_FEATURES, keep=(*REG_KEYS, "y"))
    return scaled


def _singles(spark, base):
    return stepwise.single_predictor_models(regression_frame(spark, base), REG_FEATURES, "y")


@register("ols_fit", _REG_SQL + "SELECT predictor, round_even(coef * 1e9, 0) / 1e9 AS coef FROM crit")
def q_ols_fit(spark, base):
    return _singles(spark, base).select("predictor", round_to("coef", 9).alias("coef"))


@register("single_predictor_rss", _REG_SQL + "SELECT predictor, round_even(rss * 1e4, 0) / 1e4 AS rss FROM crit")
def q_single_predictor_rss(spark, base):
    return _singles(spark, base).select("predictor", round_to("rss", 4).alias("rss"))


@register(
    "forward_step1",
    _REG_SQL + "SELECT predictor, round_even(rss * 1e4, 0) / 1e4 AS rss FROM crit ORDER BY rss, predictor LIMIT 1",
)
def q_forward_step1(spark, base):
    best = _singles(spark, base).orderBy("rss", "predictor").limit(1)
    return best.select("predictor", round_to("rss", 4).alias("rss"))


@register(
    "selection_criteria",
    _REG_SQL
    + """
SELECT predictor, round_even(r2 * 1e9, 0) / 1e9 AS r2, round_even(adj_r2 * 1e9, 0) / 1e9 AS adj_r2,
       round_even(aic * 1e4, 0) / 1e4 AS aic, round_even(bic * 1e4, 0) / 1e4 AS bic
FROM crit
""",
)
def q_selection_criteria(spark, base):
    s = _singles(spark, base)
    return s.select(
        "predictor",
        round_to("r2", 9).alias("r2"),
        round_to("adj_r2", 9).alias("adj_r2"),
        round_to("aic", 4).alias("aic"),
        round_to("bic", 4).alias("bic"),
    )


@register(
    "selection_choice",
    _REG_SQL
    + """
SELECT 'adj_r2' AS criterion, arg_max(predictor, adj_r2) AS predictor FROM crit UNION ALL
SELECT 'aic', arg_min(predictor, aic) FROM crit UNION ALL
SELECT 'bic', arg_min(predictor, bic) FROM crit
""",
)
def q_selection_choice(spark, base):
    s = _singles(spark, base)
    return s.agg(
        F.max_by("predictor", "adj_r2").alias("adj_r2"),
        F.min_by("predictor", "aic").alias("aic"),
        F.min_by("predictor", "bic").alias("bic"),
    ).selectExpr("stack(3, 'adj_r2', adj_r2, 'aic', aic, 'bic', bic) as (criterion, predictor)")


@register(
    "ols_residuals",
    _REG_SQL
    + """
, best AS (SELECT predictor, coef FROM crit ORDER BY rss, predictor LIMIT 1)
SELECT l_orderkey, k_line, round_even(y * 1e9, 0) / 1e9 AS y,
       round_even(fitted * 1e6, 0) / 1e6 AS fitted, round_even((y - fitted) * 1e6, 0) / 1e6 AS residual
FROM (
  SELECT x.*, best.coef * CASE best.predictor WHEN 'l_quantity' THEN x.l_quantity WHEN 'l_discount' THEN x.l_discount
                                WHEN 'l_tax' THEN x.l_tax ELSE x.l_linenumber END AS fitted
  FROM x, best)
""",
)
def q_ols_residuals(spark, base):
    frame = regression_frame(spark, base)
    best = stepwise.single_predictor_models(frame, REG_FEATURES, "y").orderBy("rss", "predictor").first()
    fitted = stepwise.fitted_column({best["predictor"]: best["coef"]})
    out = frame.select(*REG_KEYS, "y", fitted.alias("fitted"))
    return out.select(
        *REG_KEYS,
        round_to("y", 9).alias("y"),
        round_to("fitted", 6).alias("fitted"),
        round_to(F.col("y") - F.col("fitted"), 6).alias("residual"),
    )


def _pair_sql() -> str:
    names = list(REG_FEATURES)
    rows = []
    for i in range(len(names)):
        for j in range(i + 1, len(names)):
            a, c, b = f"xx{i}", f"xx{j}", f"x{i}{j}"
            ay, by = f"xy{i}", f"xy{j}"
            rows.append(
                f"SELECT '{names[i]},{names[j]}' AS predictors, "
                f"yy - ({c} * {ay} * {ay} - 2 * {b} * {ay} * {by} + {a} * {by} * {by}) / ({a} * {c} - {b} * {b}) AS rss FROM s"
            )
    return "\nUNION ALL\n".join(rows)


@register(
    "best_subset_k2",
    _REG_SQL
    + f", pairs AS ({_pair_sql()})\nSELECT predictors, round_even(rss * 1e4, 0) / 1e4 AS rss FROM pairs ORDER BY rss LIMIT 1",
)
def q_best_subset_k2(spark, base):
    gram = stepwise.regression_gram(regression_frame(spark, base), REG_FEATURES, "y")
    best = stepwise.best_subset(spark, gram, 2)
    return best.select("predictors", round_to("rss", 4).alias("rss"))


@register(
    "gram_matrix",
    _REG_SQL
    + """
SELECT * FROM (VALUES (0, 0, 'l_quantity', 'l_quantity'), (0, 1, 'l_quantity', 'l_discount'), (0, 2, 'l_quantity', 'l_tax'),
  (0, 3, 'l_quantity', 'l_linenumber'), (0, 4, 'l_quantity', 'y'), (1, 1, 'l_discount', 'l_discount'),
  (1, 2, 'l_discount', 'l_tax'), (1, 3, 'l_discount', 'l_linenumber'), (1, 4, 'l_discount', 'y'),
  (2, 2, 'l_tax', 'l_tax'), (2, 3, 'l_tax', 'l_linenumber'), (2, 4, 'l_tax', 'y'),
  (3, 3, 'l_linenumber', 'l_linenumber'), (3, 4, 'l_linenumber', 'y'), (4, 4, 'y', 'y')) AS v(i, j, col_i, col_j)
JOIN (
  SELECT unnest([xx0, x01, x02, x03, xy0, xx1, x12, x13, xy1, xx2, x23, xy2, xx3, xy3, yy]) AS value,
         unnest([0, 0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2, 3, 3, 4]) AS i, unnest([0, 1, 2, 3, 4, 1, 2, 3, 4, 2, 3, 4, 3, 4, 4]) AS j
  FROM s) AS g USING (i, j)
""".replace(
        "SELECT * FROM (VALUES", "SELECT i::INTEGER AS i, j::INTEGER AS j, col_i, col_j, round_even(value * 1e4, 0) / 1e4 AS value FROM (VALUES"
    ),
)
def q_gram_matrix(spark, base):
    g = aggregates.gram_matrix(regression_frame(spark, base), (*REG_FEATURES, "y"))
    return g.select("i", "j", "col_i", "col_j", round_to("value", 4).alias("value"))


def _sweep_sql(tables: str, names: Sequence[str]) -> str:
    """Forward selection in SQL: the matrix of ``s`` (the last of ``tables``) as a list, swept
    at the predictor that lowers the RSS most, step by step. After a sweep at c, row c holds
    the coefficients, the diagonal the inverse, the last cell the RSS."""
    p = len(names)
    w = p + 1
    name = [[f"xx{i}" if i == j else f"x{min(i, j)}{max(i, j)}" for j in range(p)] + [f"xy{i}"] for i in range(p)]
    cells = ", ".join(c for row in [*name, [f"xy{i}" for i in range(p)] + ["yy"]] for c in row)
    return (
        tables.replace("WITH ", "WITH RECURSIVE ", 1)
        + f""",
step AS (
  SELECT 0 AS size, 0::BIGINT AS c, []::BIGINT[] AS chosen, [{cells}] AS m, n, yy FROM s
  UNION ALL
  SELECT size + 1, c, list_append(chosen, c), list_transform(range(0, {w * w}), lambda k: CASE
      WHEN k // {w} = c - 1 AND k % {w} = c - 1 THEN 1 / m[(c - 1) * {w} + c]
      WHEN k // {w} = c - 1 THEN m[k + 1] / m[(c - 1) * {w} + c]
      WHEN k % {w} = c - 1 THEN -m[k + 1] / m[(c - 1) * {w} + c]
      ELSE m[k + 1] - m[(k // {w}) * {w} + c] * m[(c - 1) * {w} + k % {w} + 1] / m[(c - 1) * {w} + c] END), n, yy
  FROM (SELECT *, list_position(gains, list_max(gains))::BIGINT AS c FROM (
    SELECT size, chosen, m, n, yy, list_transform(range(1, {w}), lambda i:
      CASE WHEN list_contains(chosen, i) THEN -1.0 ELSE m[i * {w}] * m[i * {w}] / m[(i - 1) * {w} + i] END) AS gains
    FROM step WHERE size < {p}))),
path AS (
  SELECT size, c, chosen, m, n, yy, m[{w * w}] AS rss, 1 - m[{w * w}] / yy AS r2,
         -n / 2.0 * (ln(2 * pi() * m[{w * w}] / n) + 1) AS llf FROM step WHERE size > 0),
sized AS (
  SELECT *, 1 - n / (n - size::DOUBLE) * (1 - r2) AS adj_r2, -2 * llf + 2 * size AS aic, -2 * llf + size * ln(n) AS bic,
         {list(names)} AS names FROM path)
"""
    )


_PATH_SQL = _sweep_sql(_REG_SQL, REG_FEATURES)


def _path(spark, base):
    gram = stepwise.regression_gram(regression_frame(spark, base), REG_FEATURES, "y")
    return gram, stepwise.forward_path(gram)


@register(
    "forward_path",
    _PATH_SQL
    + """
SELECT size::INTEGER AS size, names[c] AS added, array_to_string(list_transform(chosen, lambda i: names[i]), ',') AS predictors,
       round_even(rss * 1e4, 0) / 1e4 AS rss, size::INTEGER AS rank, round_even(r2 * 1e9, 0) / 1e9 AS r2,
       round_even(adj_r2 * 1e9, 0) / 1e9 AS adj_r2, round_even(aic * 1e4, 0) / 1e4 AS aic, round_even(bic * 1e4, 0) / 1e4 AS bic
FROM sized
""",
)
def q_forward_path(spark, base):
    path = stepwise.forward_path_frame(spark, _path(spark, base)[1])
    return path.select(
        "size",
        "added",
        F.concat_ws(",", "predictors").alias("predictors"),
        round_to("rss", 4).alias("rss"),
        "rank",
        *[round_to(c, 9).alias(c) for c in ("r2", "adj_r2")],
        *[round_to(c, 4).alias(c) for c in ("aic", "bic")],
    )


@register(
    "selection_size",
    _PATH_SQL
    + """
SELECT 'adj_r2' AS criterion, arg_max(size, adj_r2)::INTEGER AS size FROM sized UNION ALL
SELECT 'aic', arg_min(size, aic)::INTEGER FROM sized UNION ALL
SELECT 'bic', arg_min(size, bic)::INTEGER FROM sized
""",
)
def q_selection_size(spark, base):
    _, path = _path(spark, base)
    return spark.createDataFrame([(c, stepwise.choose(path, c)["size"]) for c in ("adj_r2", "aic", "bic")], "criterion string, size int")


def _summary(spark, base):
    gram, path = _path(spark, base)
    rows = stepwise.ols_summary(gram, stepwise.choose(path, "bic")["predictors"])
    return spark.createDataFrame(rows, "predictor string, coef double, std_err double, t double, p_value double")


@register("ols_summary")
def q_ols_summary(spark, base):
    return _summary(spark, base)


@register(
    "ols_coefficients",
    _PATH_SQL
    + f"""
, best AS (SELECT * FROM sized ORDER BY bic, size LIMIT 1),
coefs AS (
  SELECT names[i] AS predictor, m[i * {len(REG_FEATURES) + 1}] AS coef,
         sqrt(rss / (n - size) * m[(i - 1) * {len(REG_FEATURES) + 1} + i]) AS std_err
  FROM (SELECT *, unnest(chosen) AS i FROM best))
SELECT predictor, round_even(coef * 1e9, 0) / 1e9 AS coef, round_even(std_err * 1e9, 0) / 1e9 AS std_err,
       round_even(coef / std_err * 1e4, 0) / 1e4 AS t FROM coefs
""",
)
def q_ols_coefficients(spark, base):
    return _summary(spark, base).select("predictor", round_to("coef", 9).alias("coef"), round_to("std_err", 9).alias("std_err"), round_to("t", 4).alias("t"))


def _student_sql(t: str, dof: str, steps: int = 4000) -> str:
    """Two-sided p-value of Student's t: 1 less the density's integral (Simpson) over [-|t|, |t|]."""
    density = f"exp(lgamma(({dof} + 1) / 2.0) - lgamma({dof} / 2.0) - 0.5 * ln({dof} * pi()) - ({dof} + 1) / 2.0 * ln(1 + pow(abs({t}) * k / {steps}, 2) / {dof}))"
    weight = f"CASE WHEN k = 0 OR k = {steps} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END"
    return f"1 - 2 * abs({t}) / {steps} / 3 * list_sum(list_transform(range(0, {steps + 1}), lambda k: {weight} * {density}))"


@register(
    "ols_p_values",
    _PATH_SQL
    + f"""
, last AS (SELECT * FROM sized ORDER BY size DESC LIMIT 1),
coefs AS (
  SELECT names[i] AS predictor, m[i * {len(REG_FEATURES) + 1}] / sqrt(rss / (n - size) * m[(i - 1) * {len(REG_FEATURES) + 1} + i]) AS t, (n - size)::DOUBLE AS dof
  FROM (SELECT *, unnest(chosen) AS i FROM last))
SELECT predictor, round_even(least(abs(t), 30.0) * 1e4, 0) / 1e4 AS t_size, round_even(({_student_sql("least(abs(t), 30.0)", "dof")}) * 1e6, 0) / 1e6 AS p_value FROM coefs
""",
)
def q_ols_p_values(spark, base):
    """p-values of the model with all predictors (|t| shown up to 30)."""
    gram, path = _path(spark, base)
    rows = stepwise.ols_summary(gram, path[-1]["predictors"])
    table = spark.createDataFrame(rows, "predictor string, coef double, std_err double, t double, p_value double")
    return table.select("predictor", round_to(F.least(F.abs("t"), F.lit(30.0)), 4).alias("t_size"), round_to("p_value", 6).alias("p_value"))


@register(
    "chosen_residuals",
    _PATH_SQL
    + f"""
, best AS (SELECT * FROM sized ORDER BY bic, size LIMIT 1),
coefs AS (SELECT {", ".join(f"CASE WHEN list_contains(chosen, {k + 1}) THEN m[{(k + 1) * (len(REG_FEATURES) + 1)}] ELSE 0 END AS b{k}" for k in range(len(REG_FEATURES)))} FROM best)
SELECT l_orderkey, k_line, round_even(y * 1e9, 0) / 1e9 AS y, round_even(fitted * 1e6, 0) / 1e6 AS fitted, round_even((y - fitted) * 1e6, 0) / 1e6 AS residual
FROM (SELECT x.*, {" + ".join(f"b{k} * {c}" for k, c in enumerate(REG_FEATURES))} AS fitted FROM x, coefs)
""",
)
def q_chosen_residuals(spark, base):
    """Fitted values and residuals of the model that BIC chooses."""
    frame = regression_frame(spark, base)
    gram = stepwise.regression_gram(frame, REG_FEATURES, "y")
    rows = stepwise.ols_summary(gram, stepwise.choose(stepwise.forward_path(gram), "bic")["predictors"])
    fitted = stepwise.fitted_column({r["predictor"]: r["coef"] for r in rows})
    out = frame.select(*REG_KEYS, "y", fitted.alias("fitted"))
    return out.select(*REG_KEYS, round_to("y", 9).alias("y"), round_to("fitted", 6).alias("fitted"), round_to(F.col("y") - F.col("fitted"), 6).alias("residual"))


# ============================================================================ feature preparation
@register(
    "standardize",
    "SELECT l_orderkey, l_linenumber AS k_line, "
    + ", ".join(
        f"round_even(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () * 1e9, 0) / 1e9 AS {c}" for c in _STAT_COLS
    )
    + " FROM lineitem",
)
def q_standardize(spark, base):
    li = load(spark, base, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("k_line"), *_STAT_COLS)
    z = features.standardize(li, _STAT_COLS, keep=REG_KEYS)
    return z.select(*REG_KEYS, *[round_to(c, 9).alias(c) for c in _STAT_COLS])


@register(
    "minmax_scale",
    _REG_SQL
    + "SELECT l_orderkey, k_line, "
    + ", ".join(f"round_even({c} * 1e12, 0) / 1e12 AS {c}" for c in REG_FEATURES)
    + " FROM x",
)
def q_minmax_scale(spark, base):
    f = regression_frame(spark, base)
    return f.select(*REG_KEYS, *[round_to(c, 12).alias(c) for c in REG_FEATURES])


@register(
    "hash_split",
    "SELECT o_orderkey, CASE WHEN ('0x' || substr(md5('7:' || o_orderkey::VARCHAR), 1, 8))::BIGINT < 1417339207 "
    "THEN 'test' ELSE 'train' END AS split FROM orders",
)
def q_hash_split(spark, base):
    return features.hash_split(load(spark, base, "orders").select("o_orderkey"), "o_orderkey", 0.33, 7)


@register(
    "exact_split",
    "SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY ('0x' || substr(md5('7:' || o_orderkey::VARCHAR), 1, 15))::BIGINT) <= ceil(round(0.33 * count(*) OVER (), 9)) "
    "THEN 'test' ELSE 'train' END AS split FROM orders",
)
def q_exact_split(spark, base):
    return features.exact_split(load(spark, base, "orders").select("o_orderkey"), "o_orderkey", 0.33, 7)


@register(
    "log_response",
    "SELECT l_orderkey, l_linenumber, round_even(log10(l_extendedprice) * 1e12, 0) / 1e12 AS log_y FROM lineitem WHERE l_extendedprice > 0",
)
def q_log_response(spark, base):
    li = load(spark, base, "lineitem").filter(F.col("l_extendedprice") > 0)
    return li.select("l_orderkey", "l_linenumber", round_to(log10_positive("l_extendedprice"), 12).alias("log_y"))


@register(
    "log1p_response",
    "SELECT l_orderkey, l_linenumber, round_even(log10(1 + l_extendedprice) * 1e12, 0) / 1e12 AS log1p_y FROM lineitem",
)
def q_log1p_response(spark, base):
    li = load(spark, base, "lineitem")
    return li.select("l_orderkey", "l_linenumber", round_to(log10_1p("l_extendedprice"), 12).alias("log1p_y"))


# ============================================================================ classification metrics
@register(
    "classifier_metrics",
    """
WITH p AS (
  SELECT l.quality AS label, (d.n_chars >= 1000)::INTEGER AS prediction
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
c AS (
  SELECT count_if(label = 1 AND prediction = 1)::BIGINT AS tp, count_if(label = 0 AND prediction = 1)::BIGINT AS fp,
         count_if(label = 1 AND prediction = 0)::BIGINT AS fn, count_if(label = 0 AND prediction = 0)::BIGINT AS tn FROM p)
SELECT tp, fp, fn, tn, (tp + tn)::DOUBLE / nullif(tp + fp + fn + tn, 0) AS accuracy,
       tp::DOUBLE / nullif(tp + fp, 0) AS precision, tp::DOUBLE / nullif(tp + fn, 0) AS recall,
       2.0 * tp / nullif(2 * tp + fp + fn, 0) AS f1
FROM c
""",
)
def q_classifier_metrics(spark, base):
    d = load(spark, base, "documents").select("doc_id", "n_chars")
    lab = load(spark, base, "labels").select("doc_id", F.col("quality").alias("label"))
    pred = d.join(lab, "doc_id").select("label", (F.col("n_chars") >= 1000).cast("int").alias("prediction"))
    return metrics.classifier_metrics(pred)


# ============================================================================ PCA / PCR
def embedding_frame(spark: SparkSession, base: str) -> DataFrame:
    """One column per coordinate; as many as the longest vector has (null where one is shorter)."""
    e = load(spark, base, "embeddings")
    dims = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    return e.select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(dims)])


def coordinates(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in ("vec_id", "label", "split", "y")]


@register(
    "covariance_matrix",
    """
WITH e AS (SELECT r, unnest(range(0, len(embedding)))::INTEGER AS i, unnest(embedding)::DOUBLE AS x
  FROM (SELECT row_number() OVER () AS r, embedding FROM embeddings))
SELECT a.i AS i, b.i AS j, round_even(covar_samp(a.x, b.x) * 1e9, 0) / 1e9 AS cov
FROM e a JOIN e b ON a.r = b.r AND a.i <= b.i GROUP BY a.i, b.i
""",
)
def q_covariance_matrix(spark, base):
    e = embedding_frame(spark, base)
    _, cov = pcr.covariance(e, coordinates(e))
    rows = [(i, j, float(cov[i, j])) for i in range(len(cov)) for j in range(i, len(cov))]
    return spark.createDataFrame(rows, "i int, j int, cov double").select("i", "j", round_to("cov", 9).alias("cov"))


def _pca_train(spark, base):
    e = features.hash_split(embedding_frame(spark, base), "vec_id", 0.2, 0)
    train = e.filter(F.col("split") == "train")
    return e, train, pcr.fit_pca(train, coordinates(train))


@register(
    "pca_reconstruction",
    """
WITH e AS (SELECT r, unnest(range(0, len(embedding)))::INTEGER AS i, unnest(embedding)::DOUBLE AS x
  FROM (SELECT row_number() OVER () AS r, embedding FROM embeddings
        WHERE ('0x' || substr(md5('0:' || vec_id::VARCHAR), 1, 8))::BIGINT >= 858993459))
SELECT a.i AS i, b.i AS j, round_even(covar_samp(a.x, b.x) * 1e9, 0) / 1e9 AS cov
FROM e a JOIN e b ON a.r = b.r AND a.i <= b.i GROUP BY a.i, b.i
""",
)
def q_pca_reconstruction(spark, base):
    """Loadings times their transpose: the covariance of the training rows."""
    _, _, fit = _pca_train(spark, base)
    cov = fit.loadings @ fit.loadings.T
    rows = [(i, j, float(cov[i, j])) for i in range(len(cov)) for j in range(i, len(cov))]
    return spark.createDataFrame(rows, "i int, j int, cov double").select("i", "j", round_to("cov", 9).alias("cov"))


_TRAIN_COV_SQL = """
WITH e AS (SELECT r, unnest(range(0, len(embedding)))::INTEGER AS i, unnest(embedding)::DOUBLE AS x
  FROM (SELECT row_number() OVER () AS r, embedding FROM embeddings
        WHERE ('0x' || substr(md5('0:' || vec_id::VARCHAR), 1, 8))::BIGINT >= 858993459)),
c AS (SELECT a.i AS i, b.i AS j, covar_samp(a.x, b.x) AS v FROM e a JOIN e b ON a.r = b.r GROUP BY a.i, b.i)
"""


@register(
    "pca_variance_sums",
    _TRAIN_COV_SQL
    + """,
c2 AS (SELECT a.i AS i, b.j AS j, sum(a.v * b.v) AS v FROM c a JOIN c b ON a.j = b.i GROUP BY a.i, b.j)
SELECT 1 AS power, round_even(sum(v) * 1e9, 0) / 1e9 AS total FROM c WHERE i = j UNION ALL
SELECT 2, round_even(sum(v * v) * 1e9, 0) / 1e9 FROM c UNION ALL
SELECT 3, round_even(sum(c.v * c2.v) * 1e9, 0) / 1e9 FROM c JOIN c2 USING (i, j) UNION ALL
SELECT 4, round_even(sum(v * v) * 1e9, 0) / 1e9 FROM c2
""",
)
def q_pca_variance_sums(spark, base):
    """Sums of the eigenvalues' first four powers: the traces of the covariance's powers."""
    _, _, fit = _pca_train(spark, base)
    rows = [(k, float((fit.eigenvalues**k).sum())) for k in range(1, 5)]
    return spark.createDataFrame(rows, "power int, total double").select("power", round_to("total", 9).alias("total"))


@register(
    "pca_loadings_products",
    "WITH d AS (SELECT unnest(range(0, max(len(embedding))))::INTEGER AS i FROM embeddings) SELECT a.i, b.i AS j, 0.0::DOUBLE AS product FROM d a, d b WHERE a.i < b.i",
)
def q_pca_loadings_products(spark, base):
    """Inner products of different loadings: with ``pca_reconstruction`` (L L' is the covariance),
    their being 0 makes L the eigenvectors, up to the sign that the largest entry fixes."""
    _, _, fit = _pca_train(spark, base)
    lo = fit.loadings
    products = lo.T @ lo
    rows = [(i, j, float(products[i, j])) for i in range(len(products)) for j in range(i + 1, len(products))]
    return spark.createDataFrame(rows, "i int, j int, product double").select("i", "j", F.abs(round_to("product", 9)).alias("product"))


@register("pca_variance")
def q_pca_variance(spark, base):
    _, _, fit = _pca_train(spark, base)
    return pcr.variance_frame(spark, fit)


@register("pca_loadings")
def q_pca_loadings(spark, base):
    _, _, fit = _pca_train(spark, base)
    return pcr.loadings_frame(spark, fit)


@register("pca_scores")
def q_pca_scores(spark, base):
    e, _, fit = _pca_train(spark, base)
    return pcr.scores(e, fit, keep=("vec_id", "split"))


def _pcr_response(df: DataFrame) -> DataFrame:
    """Rows with a positive response, y = log10(label)."""
    return df.filter(F.col("label") > 0).withColumn("y", log10_positive("label"))


@register("pcr_r2_curve")
def q_pcr_r2_curve(spark, base):
    _, train, fit = _pca_train(spark, base)
    scored = pcr.scores(_pcr_response(train), fit, keep=("y",))
    rows = pcr.r2_curve(scored, "y", len(fit.names))
    return spark.createDataFrame(rows, pcr.R2_SCHEMA)


@register("pcr_holdout")
def q_pcr_holdout(spark, base, n_pc: int = 15):
    e, train, fit = _pca_train(spark, base)
    names = [f"pc{j + 1}" for j in range(n_pc)]
    beta, b0 = pcr.fit_linear(pcr.scores(_pcr_response(train), fit, keep=("y",), k=n_pc), names, "y")
    test = pcr.scores(_pcr_response(e.filter(F.col("split") == "test")), fit, keep=("vec_id", "y"), k=n_pc)
    pred = F.lit(b0)
    for c, b in zip(names, beta):
        pred = pred + F.lit(float(b)) * F.col(c)
    return test.select("vec_id", F.col("y").alias("actual"), pred.alias("predicted"))


_EMBEDDING_ROWS_SQL = """
WITH v AS (SELECT vec_id, log10(label) AS y, ('0x' || substr(md5('0:' || vec_id::VARCHAR), 1, 8))::BIGINT < 858993459 AS test,
    list_append(list_prepend(1.0, list_transform(embedding, lambda x: x::DOUBLE)), log10(label)) AS x FROM embeddings WHERE label > 0)"""


def _full_width_sql(select: str, rows: str = _EMBEDDING_ROWS_SQL, key: str = "vec_id", dims: int = 64) -> str:
    """OLS of the response on 1 and all coordinates of the training rows, by sweeps: then the
    last column holds the coefficients and the last cell the RSS. ``rows`` ends with the
    table v (``key``, y, test, x: 1, coordinates, y)."""
    w = dims + 2
    return f"""{rows.replace("WITH ", "WITH RECURSIVE ", 1)},
p AS (SELECT {key}, unnest(range(1, {w + 1})) AS i, unnest(x) AS x FROM v WHERE NOT test),
g AS (SELECT a.i, b.i AS j, sum(a.x * b.x) AS v FROM p a JOIN p b USING ({key}) GROUP BY a.i, b.i),
st AS (
  SELECT 0::BIGINT AS c, list(v ORDER BY i, j) AS m FROM g
  UNION ALL
  SELECT c + 1, list_transform(range(0, {w * w}), lambda k: CASE
      WHEN k // {w} = c AND k % {w} = c THEN 1 / m[c * {w} + c + 1]
      WHEN k // {w} = c THEN m[k + 1] / m[c * {w} + c + 1]
      WHEN k % {w} = c THEN -m[k + 1] / m[c * {w} + c + 1]
      ELSE m[k + 1] - m[(k // {w}) * {w} + c + 1] * m[c * {w} + k % {w} + 1] / m[c * {w} + c + 1] END)
  FROM st WHERE c < {dims + 1}),
f AS (SELECT m[{w * w}] AS rss, list_transform(range(1, {dims + 2}), lambda i: m[i * {w}]) AS b FROM st WHERE c = {dims + 1})
{select}"""


@register(
    "pcr_holdout_full",
    _full_width_sql(
        "SELECT vec_id, round_even(y * 1e6, 0) / 1e6 AS actual, round_even(list_dot_product(b, x[1:65]) * 1e6, 0) / 1e6 AS predicted FROM v, f WHERE test"
    ),
)
def q_pcr_holdout_full(spark, base):
    """The holdout with all components: what the regression on all coordinates predicts."""
    found = q_pcr_holdout(spark, base, n_pc=len(coordinates(embedding_frame(spark, base))))
    return found.select("vec_id", round_to("actual", 6).alias("actual"), round_to("predicted", 6).alias("predicted"))


@register(
    "pcr_r2_full",
    _full_width_sql("SELECT 64 AS components, round_even((1 - rss / (SELECT sum(y * y) - sum(y) * sum(y) / count(*) FROM v WHERE NOT test)) * 1e9, 0) / 1e9 AS r2 FROM f"),
)
def q_pcr_r2_full(spark, base):
    """The last point of the R^2 curve: the regression on all coordinates."""
    return q_pcr_r2_curve(spark, base).orderBy(F.desc("components")).limit(1).select("components", round_to("r2", 9).alias("r2"))


# ============================================================================ boosted trees
def document_frame(spark: SparkSession, base: str, target: str = "quality") -> DataFrame:
    """Labelled documents with text-shape features and the 0.33 hash split.

    The features read whole texts; the result (a few numbers per labelled
    document) is written once to the shared checkpoint folder, so boosting,
    validation and prediction read it instead of re-scanning the texts."""
    d = load(spark, base, "documents").select("doc_id", "text")
    lab = load(spark, base, "labels").select("doc_id", F.col(target).cast("double").alias("label"))
    f = boost.text_shape_features(d).drop("text").join(lab, "doc_id")
    return cut_lineage(features.hash_split(f, "doc_id", 0.33, 7))


def _gbt_model(spark, base, target: str = "quality"):
    """The labelled documents and the model of their training rows: all 500 rounds."""
    df = document_frame(spark, base, target)
    params = boost.INFECTION_PARAMS if target == "toxic" else boost.FATALITY_PARAMS
    return df, boost.fit(df.filter(F.col("split") == "train"), boost.TEXT_FEATURES, "doc_id", **params)


def _gbt_scores(spark, base, target: str = "quality") -> DataFrame:
    df, model = _gbt_model(spark, base, target)
    pred = boost.predict(model, df.filter(F.col("split") == "test"), boost.TEXT_FEATURES, keep=("label",))
    return metrics.classifier_metrics(pred, "label", "prediction").withColumn("n_trees", F.lit(len(model.trees)))


@register("gbt_predict")
def q_gbt_predict(spark, base):
    df, model = _gbt_model(spark, base)
    test = df.filter(F.col("split") == "test")
    return boost.predict(model, test, boost.TEXT_FEATURES, keep=("doc_id", "label"))


@register("gbt_metrics")
def q_gbt_metrics(spark, base):
    return _gbt_scores(spark, base)


@register("gbt_metrics_toxic")
def q_gbt_metrics_toxic(spark, base):
    return _gbt_scores(spark, base, "toxic")


@register("gbt_importance")
def q_gbt_importance(spark, base):
    _, model = _gbt_model(spark, base)
    return spark.createDataFrame(boost.importance(model, boost.TEXT_FEATURES), "feature string, gain double, weight int")


@register("gbt_rounds")
def q_gbt_rounds(spark, base):
    """Early stopping at every step size of the search: log-loss of the watched slice by
    round, and whether the model keeps the round."""
    df = document_frame(spark, base)
    specs = [boost.spec(step_size=eta, max_depth=6, subsample=0.8, colsample=0.8, patience=boost.PATIENCE) for eta in boost.eta_grid()]
    train = df.filter(F.col("split") == "train")
    got = newton_trees.train(spark, train, boost.TEXT_FEATURES, "doc_id", ["label"], specs, checked=boost.validation_slice("doc_id", 0.2, 0), trees=False)
    rows = [(t.spec.step_size, k + 1, loss, k < t.n_trees) for t in got for k, loss in enumerate(t.losses)]
    return spark.createDataFrame(rows, "step_size double, round int, log_loss double, kept boolean")


TREE_FEATURES = ("l_quantity", "l_discount", "l_tax", "l_linenumber")
TREE_DEPTH = 3


def _first_tree_sql() -> str:
    """A tree from margin 0 (gradient 1/2 - y, Hessian 1/4), level by level."""
    score = lambda g, h: f"{g} * {g} / ({h} + 1)"
    sql = ["WITH r0 AS (SELECT 1::BIGINT AS node, 0.5::DOUBLE - (l_returnflag = 'R')::INT AS g, " + ", ".join(f"{c}::DOUBLE AS {c}" for c in TREE_FEATURES) + " FROM lineitem WHERE l_returnflag IS NOT NULL)"]
    made = []
    for d in range(TREE_DEPTH + 1):
        sql.append(f"t{d} AS (SELECT node, sum(g) AS g, count(*) * 0.25::DOUBLE AS h FROM r{d} GROUP BY node)")
        if d == TREE_DEPTH:
            made.append(f"SELECT node, NULL AS feature, NULL::DOUBLE AS threshold, NULL::DOUBLE AS gain, -0.3::DOUBLE * g / (h + 1) AS weight FROM t{d}")
            break
        values = " UNION ALL ".join(f"SELECT node, {k} AS f, {c} AS v, sum(g) AS g, count(*) * 0.25::DOUBLE AS h FROM r{d} GROUP BY node, {c}" for k, c in enumerate(TREE_FEATURES))
        sql.append(f"v{d} AS ({values})")
        sql.append(
            f"c{d} AS (SELECT node, f, v, sum(g) OVER w AS gl, sum(h) OVER w AS hl FROM v{d} WINDOW w AS (PARTITION BY node, f ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"
        )
        gain = f"({score('gl', 'hl')} + {score('(t.g - gl)', '(t.h - hl)')} - {score('t.g', 't.h')})"
        sql.append(
            f"s{d} AS (SELECT * FROM (SELECT c.node, f, v, {gain} AS gain, row_number() OVER (PARTITION BY c.node ORDER BY {gain} DESC, f, v) AS k"
            f" FROM c{d} c JOIN t{d} t ON c.node = t.node WHERE hl >= 1 AND t.h - hl >= 1) WHERE k = 1 AND gain > 1e-6)"
        )
        name = " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(TREE_FEATURES))
        value = " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(TREE_FEATURES))
        made.append(f"SELECT t.node, CASE f {name} END AS feature, v AS threshold, gain, -0.3::DOUBLE * t.g / (t.h + 1) AS weight FROM t{d} t LEFT JOIN s{d} s ON t.node = s.node")
        sql.append(f"r{d + 1} AS (SELECT 2 * r.node + (CASE s.f {value} END >= s.v)::INT AS node, g, {', '.join(TREE_FEATURES)} FROM r{d} r JOIN s{d} s ON r.node = s.node)")
    rounded = "round_even({0} * 1e6, 0) / 1e6 AS {0}"
    return ",\n".join(sql) + f"\nSELECT node, feature, threshold, {rounded.format('gain')}, {rounded.format('weight')} FROM (\n" + "\nUNION ALL\n".join(made) + ")"


@register("gbt_first_tree", _first_tree_sql())
def q_gbt_first_tree(spark, base):
    """The first tree for returned line items, over every row of the table."""
    li = load(spark, base, "lineitem").filter(F.col("l_returnflag").isNotNull())
    rows = li.select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id"), *TREE_FEATURES, (F.col("l_returnflag") == "R").cast("double").alias("label"))
    model = boost.fit(rows, TREE_FEATURES, "id", max_iter=1, max_depth=TREE_DEPTH, step_size=0.3)
    tree = spark.createDataFrame(boost.tree_rows(model, 0), "node long, feature string, threshold double, gain double, weight double")
    return tree.select("node", "feature", "threshold", round_to("gain", 6).alias("gain"), round_to("weight", 6).alias("weight"))


@register("param_search")
def q_param_search(spark, base):
    df = document_frame(spark, base)
    train, holdout = [df.filter(F.col("split") == s) for s in ("train", "test")]
    rows = boost.search_report(train, holdout, boost.TEXT_FEATURES, "doc_id", seed=0)
    return spark.createDataFrame(
        rows, "max_depth int, colsample double, subsample double, step_size double, draw int, accuracy double, n_trees double, holdout_accuracy double"
    )


# ============================================================================ E2 on the regional panel
@register("panel_stepwise_path")
def q_panel_stepwise_path(spark, base):
    """Forward path of log10(1 + Cases) on the min-max scaled panel attributes."""
    from regionlens.plans.panel_models import build_panel, stepwise_report

    return stepwise_report(spark, build_panel(spark, base), "Cases")["path"]


@register("panel_stepwise_path_deaths")
def q_panel_stepwise_path_deaths(spark, base):
    from regionlens.plans.panel_models import build_panel, stepwise_report

    return stepwise_report(spark, build_panel(spark, base), "Deaths")["path"]


@register("panel_stepwise_summary")
def q_panel_stepwise_summary(spark, base):
    """Coefficient tables of the chosen models of cases and deaths."""
    from regionlens.plans.panel_models import build_panel, stepwise_report

    panel = build_panel(spark, base)
    cases, deaths = [stepwise_report(spark, panel, r)["summary"].select(F.lit(r).alias("response"), "*") for r in ("Cases", "Deaths")]
    return cases.unionByName(deaths)


@register("panel_classifiers")
def q_panel_classifiers(spark, base):
    """Holdout metrics of the fatality and the infection classifier."""
    from regionlens.plans.panel_models import FATALITY_THRESHOLD, INFECTION_THRESHOLD, build_panel, classifier_reports

    models = {"Fatality": (FATALITY_THRESHOLD, boost.FATALITY_PARAMS), "InfectionRate": (INFECTION_THRESHOLD, boost.INFECTION_PARAMS)}
    report = classifier_reports(build_panel(spark, base), models)
    fatality, infection = [report[rate]["metrics"].select(F.lit(rate).alias("rate"), "*") for rate in models]
    return fatality.unionByName(infection)


@register("panel_pcr_r2_curve")
def q_panel_pcr_r2_curve(spark, base):
    from regionlens.plans.panel_models import build_panel, pcr_report

    return pcr_report(spark, build_panel(spark, base))["r2_curve"]


# ============================================================================ panel models against SQL
PANEL_FEATURES = ("ACCTBAL_2018", "QTY_2018", "PRICE_2018", "DISC_2018")


def _panel_path_sql(response: str) -> str:
    """Forward path of log10(1 + response) on the panel's min-max scaled attributes."""
    p = len(PANEL_FEATURES)
    scaled = ", ".join(f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) AS {c}" for c in PANEL_FEATURES)
    complete = " AND ".join(f"{c} IS NOT NULL" for c in PANEL_FEATURES)
    sums = ["sum(y * y) AS yy", "count(*)::BIGINT AS n"]
    for i, a in enumerate(PANEL_FEATURES):
        sums += [f"sum({a} * {a}) AS xx{i}", f"sum({a} * y) AS xy{i}"]
        sums += [f"sum({a} * {PANEL_FEATURES[j]}) AS x{i}{j}" for j in range(i + 1, p)]
    tables = PANEL_SQL + f"""
, x AS (SELECT FIPS, {scaled}, log10(1 + {response}) AS y FROM panel WHERE {complete}),
s AS (SELECT {", ".join(sums)} FROM x)"""
    return _sweep_sql(tables, PANEL_FEATURES)


def _each_response(sql: Callable[[str], str]) -> str:
    return " UNION ALL ".join(f"SELECT '{r}' AS response, * FROM ({sql(r)})" for r in ("Cases", "Deaths"))


def _panel_reports(spark, base) -> dict[str, dict]:
    from regionlens.plans.panel_models import build_panel, stepwise_report

    panel = build_panel(spark, base)
    return {r: stepwise_report(spark, panel, r) for r in ("Cases", "Deaths")}


@register(
    "panel_selection",
    _each_response(
        lambda r: _panel_path_sql(r)
        + """
SELECT size::INTEGER AS size, names[c] AS added, round_even(rss * 1e4, 0) / 1e4 AS rss, round_even(r2 * 1e6, 0) / 1e6 AS r2,
       round_even(adj_r2 * 1e6, 0) / 1e6 AS adj_r2, round_even(aic * 1e3, 0) / 1e3 AS aic, round_even(bic * 1e3, 0) / 1e3 AS bic,
       size = (SELECT arg_min(size, bic) FROM sized) AS chosen
FROM sized"""
    ),
)
def q_panel_selection(spark, base):
    """Forward paths of cases and deaths on the panel's attributes, their criteria and the model that BIC chooses."""
    parts = []
    for response, report in _panel_reports(spark, base).items():
        rounded = [round_to(c, d).alias(c) for c, d in (("rss", 4), ("r2", 6), ("adj_r2", 6), ("aic", 3), ("bic", 3))]
        parts.append(report["path"].select(F.lit(response).alias("response"), "size", "added", *rounded, (F.col("size") == report["chosen"]["size"]).alias("chosen")))
    return parts[0].unionByName(parts[1])


@register(
    "panel_residuals",
    _each_response(
        lambda r: _panel_path_sql(r)
        + f"""
, best AS (SELECT * FROM sized ORDER BY bic, size LIMIT 1),
coefs AS (SELECT {", ".join(f"CASE WHEN list_contains(chosen, {k + 1}) THEN m[{(k + 1) * (len(PANEL_FEATURES) + 1)}] ELSE 0 END AS b{k}" for k in range(len(PANEL_FEATURES)))} FROM best)
SELECT FIPS, round_even(y * 1e5, 0) / 1e5 AS y, round_even(fitted * 1e5, 0) / 1e5 AS fitted, round_even((y - fitted) * 1e5, 0) / 1e5 AS residual
FROM (SELECT x.*, {" + ".join(f"b{k} * {c}" for k, c in enumerate(PANEL_FEATURES))} AS fitted FROM x, coefs)"""
    ),
)
def q_panel_residuals(spark, base):
    """Fitted values and residuals of the chosen models of cases and deaths on the panel."""
    parts = [report["residuals"].select(F.lit(response).alias("response"), "FIPS", *[round_to(c, 5).alias(c) for c in ("y", "fitted", "residual")]) for response, report in _panel_reports(spark, base).items()]
    return parts[0].unionByName(parts[1])


def _panel_pcr(spark, base, n_pc: int | None = None) -> dict[str, DataFrame]:
    from regionlens.plans.panel_models import build_panel, pcr_report

    return pcr_report(spark, build_panel(spark, base), n_pc)


_PANEL_ROWS_SQL = PANEL_SQL + f"""
, split AS (SELECT *, ('0x' || substr(md5('0:' || FIPS), 1, 8))::BIGINT < 858993459 AS test FROM panel WHERE {" AND ".join(f"{c} IS NOT NULL" for c in PANEL_FEATURES)}),
mo AS (SELECT {", ".join(f"avg({c}) AS m{k}, stddev_samp({c}) AS s{k}" for k, c in enumerate(PANEL_FEATURES))} FROM split WHERE NOT test),
v AS (SELECT FIPS, test, log10(Cases) AS y, [1.0::DOUBLE, {", ".join(f"({c} - m{k}) / s{k}" for k, c in enumerate(PANEL_FEATURES))}, log10(Cases)] AS x FROM split, mo WHERE Cases > 0)"""


@register(
    "panel_pcr_holdout",
    _full_width_sql(
        f"SELECT FIPS, round_even(y * 1e5, 0) / 1e5 AS actual, round_even(list_dot_product(b, x[1:{len(PANEL_FEATURES) + 1}]) * 1e5, 0) / 1e5 AS predicted FROM v, f WHERE test",
        _PANEL_ROWS_SQL,
        "FIPS",
        len(PANEL_FEATURES),
    ),
)
def q_panel_pcr_holdout(spark, base):
    """Cases of the panel's holdout regions, predicted from all components of its training regions."""
    found = _panel_pcr(spark, base)["holdout"]
    return found.select("FIPS", *[round_to(c, 5).alias(c) for c in ("actual", "predicted")])


def _jacobi_sql(d: int, sweeps: int = 10) -> str:
    """Table pc (component, value, vec): eigenvalues of the covariance of the training rows of
    ``z``, largest first, and their vectors with a positive largest entry, by Jacobi rotations."""
    pairs = [(i, j) for i in range(d) for j in range(i + 1, d)]
    cells = ", ".join(f"covar_samp(z[{i + 1}], z[{j + 1}])" for i in range(d) for j in range(d))
    unit = ", ".join("1.0" if i == j else "0.0" for i in range(d) for j in range(d))

    def turned(m: str, at: str, other_p: str, other_q: str) -> str:
        return f"""list_transform(range(0, {d * d}), lambda e: CASE
      WHEN {at} = p THEN c * {m}[e + 1] - s * {m}[{other_q}] WHEN {at} = q THEN s * {m}[{other_p}] + c * {m}[e + 1] ELSE {m}[e + 1] END)"""

    columns = (f"e % {d}", f"e // {d} * {d} + p + 1", f"e // {d} * {d} + q + 1")
    rows = (f"e // {d}", f"p * {d} + e % {d} + 1", f"q * {d} + e % {d} + 1")
    return f"""
jac AS (
  SELECT 0::BIGINT AS k, [{cells}] AS a, [{unit}]::DOUBLE[] AS v FROM z WHERE NOT test
  UNION ALL
  SELECT k + 1, {turned("b", *rows)}, v
  FROM (SELECT k, p, q, c, s, {turned("a", *columns)} AS b, {turned("v", *columns)} AS v
  FROM (SELECT *, 1 / sqrt(1 + t * t) AS c, t / sqrt(1 + t * t) AS s
  FROM (SELECT *, CASE WHEN abs(apq) < 1e-18 THEN 0 ELSE (CASE WHEN dif >= 0 THEN 1 ELSE -1 END) * 2 * apq / (abs(dif) + sqrt(4 * apq * apq + dif * dif)) END AS t
  FROM (SELECT *, a[p * {d} + q + 1] AS apq, a[q * {d} + q + 1] - a[p * {d} + p + 1] AS dif
  FROM (SELECT *, {[i for i, _ in pairs]}[k % {len(pairs)} + 1] AS p, {[j for _, j in pairs]}[k % {len(pairs)} + 1] AS q FROM jac WHERE k < {sweeps * len(pairs)})))))),
axis AS (SELECT a[j * {d + 1} + 1] AS value, list_transform(range(0, {d}), lambda i: v[i * {d} + j + 1]) AS vec
  FROM jac, (SELECT unnest(range(0, {d})) AS j) WHERE k = {sweeps * len(pairs)}),
pc AS (SELECT (row_number() OVER (ORDER BY value DESC))::INTEGER AS component, value,
  CASE WHEN list_max(vec) >= -list_min(vec) THEN vec ELSE list_transform(vec, lambda x: -x) END AS vec FROM axis)"""


_PANEL_PCA_SQL = (
    PANEL_SQL.replace("WITH ", "WITH RECURSIVE ", 1)
    + f"""
, split AS (SELECT *, ('0x' || substr(md5('0:' || FIPS), 1, 8))::BIGINT < 858993459 AS test FROM panel WHERE {" AND ".join(f"{c} IS NOT NULL" for c in PANEL_FEATURES)}),
mo AS (SELECT {", ".join(f"avg({c}) AS m{k}, stddev_samp({c}) AS s{k}" for k, c in enumerate(PANEL_FEATURES))} FROM split WHERE NOT test),
z AS (SELECT FIPS, test, Cases, [{", ".join(f"({c} - m{k}) / s{k}" for k, c in enumerate(PANEL_FEATURES))}] AS z FROM split, mo),"""
    + _jacobi_sql(len(PANEL_FEATURES))
)


def _panel_scores_sql(select: str) -> str:
    """Sweeps of log10(Cases) on 1 and the panel's components, one after another (table st)."""
    rows = _PANEL_PCA_SQL + """,
v AS (SELECT FIPS, test, log10(Cases) AS y, list_append(list_prepend(1.0, list_transform(vecs, lambda w: list_dot_product(w, z))), log10(Cases)) AS x
  FROM z, (SELECT list(vec ORDER BY component) AS vecs FROM pc) WHERE Cases > 0)"""
    return _full_width_sql(select, rows.replace("WITH RECURSIVE ", "WITH ", 1), "FIPS", len(PANEL_FEATURES))


@register(
    "panel_pca",
    _PANEL_PCA_SQL
    + f"""
SELECT component, {list(PANEL_FEATURES)}[i] AS feature, round_even(vec[i] * sqrt(value) * 1e6, 0) / 1e6 AS loading, round_even(value * 1e6, 0) / 1e6 AS eigenvalue,
       round_even(value / sum(value) OVER (PARTITION BY i) * 1e6, 0) / 1e6 AS ratio,
       round_even(sum(value) OVER (PARTITION BY i ORDER BY component) / sum(value) OVER (PARTITION BY i) * 1e6, 0) / 1e6 AS cumulative
FROM pc, (SELECT unnest(range(1, {len(PANEL_FEATURES) + 1})) AS i)""",
)
def q_panel_pca(spark, base):
    """Explained variance and signed loadings of the panel's standardised attributes."""
    report = _panel_pcr(spark, base)
    found = report["loadings"].join(report["variance"], "component")
    return found.select("component", "feature", *[round_to(c, 6).alias(c) for c in ("loading", "eigenvalue", "ratio", "cumulative")])


_LAST = (len(PANEL_FEATURES) + 2) ** 2


@register(
    "panel_pcr_curve",
    _panel_scores_sql(f"SELECT (c - 1)::INTEGER AS components, c::INTEGER AS rank, round_even((1 - m[{_LAST}] / (SELECT m[{_LAST}] FROM st WHERE c = 1)) * 1e6, 0) / 1e6 AS r2 FROM st WHERE c > 1"),
)
def q_panel_pcr_curve(spark, base):
    """R^2 of log10(cases) on the panel's first components, for every number of them."""
    return _panel_pcr(spark, base)["r2_curve"].select("components", "rank", round_to("r2", 6).alias("r2"))


@register(
    "panel_pcr_holdout_2",
    _panel_scores_sql(
        f"""SELECT FIPS, round_even(y * 1e5, 0) / 1e5 AS actual,
  round_even(list_dot_product(list_transform(range(1, 4), lambda i: m[i * {len(PANEL_FEATURES) + 2}]), x[1:3]) * 1e5, 0) / 1e5 AS predicted FROM v, st WHERE test AND c = 3"""
    ),
)
def q_panel_pcr_holdout_2(spark, base):
    """Cases of the panel's holdout regions, predicted from the first two components."""
    found = _panel_pcr(spark, base, 2)["holdout"]
    return found.select("FIPS", *[round_to(c, 5).alias(c) for c in ("actual", "predicted")])
