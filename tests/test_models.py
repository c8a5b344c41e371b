"""Known-answer and property tests for growth fits, OLS/stepwise, PCA and metrics (F4, F6, F7)."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionlens.operators import growth, metrics, pcr, stepwise
from regionlens.operators.aggregates import gram_matrix, gram_to_numpy


# ----------------------------------------------------------------------------- F4 growth
def _f4(spark):
    t = np.arange(1, 201, dtype=float)
    rows = []
    for key, (a, n, tau) in {"s1": (70000, 500, 6), "s2": (250000, 60, 22), "s3": (9000, 2000, 10)}.items():
        rows += [(key, int(ti), float(a / (1 + n * math.exp(-ti / tau)))) for ti in t]
    rows += [("s4", int(ti), 5.0) for ti in t]
    rows += [("s5", int(ti), 0.0) for ti in t]
    rows += [("s6", 1, 1.0), ("s6", 2, 2.0)]
    return spark.createDataFrame(rows, "key string, t int, y double")


def test_growth_linear_recovers_tau_and_a(spark):
    p = {r.key: r for r in growth.growth_linear(_f4(spark), "key", "t", "y").collect()}
    assert p["s1"].status == "ok"
    assert p["s1"].tau == pytest.approx(6, rel=1e-6)
    assert p["s1"].a == pytest.approx(70000, rel=1e-6)
    assert p["s4"].status == "no_fit"


def test_logistic_fit_known_parameters(spark):
    series = _f4(spark)
    starts = growth.growth_linear(series, "key", "t", "y")
    out = {r.key: r for r in growth.logistic_fit(series, "key", "t", "y", starts=starts).collect()}
    for key, (a, n, tau) in {"s1": (70000, 500, 6), "s2": (250000, 60, 22), "s3": (9000, 2000, 10)}.items():
        r = out[key]
        assert r.status == "ok"
        assert r.a == pytest.approx(a, rel=1e-6)
        assert r.n == pytest.approx(n, rel=1e-6)
        assert r.tau == pytest.approx(tau, rel=1e-6)
    for key in ("s4", "s5", "s6"):
        assert out[key].status == "no_fit" and out[key].a is None


def test_logistic_fit_noisy_rss_not_worse_than_truth():
    rng = np.random.default_rng(1)
    t = np.arange(1, 201, dtype=float)
    y = 70000 / (1 + 500 * np.exp(-t / 6))
    yn = y * (1 + 0.02 * rng.standard_normal(len(t)))
    p, rss, _, status = growth.fit_one(t, yn, [growth.CASES_P0, growth._heuristic_start(t, yn)])
    assert status == "ok" and np.all(p > 0)
    assert rss <= float(((y - yn) ** 2).sum()) * (1 + 1e-9)


def test_curve_and_summary(spark):
    series = _f4(spark).filter(F.col("key") == "s1")
    p = growth.growth_linear(series, "key", "t", "y")
    curve = growth.logistic_curve(series, p, "key", "t").collect()
    assert max(abs(r.fitted - r.y) / r.y for r in curve) < 1e-6
    s = growth.growth_summary(p, "key").collect()[0]
    assert s.growth_rate == pytest.approx(1 / 6, rel=1e-6)


# ----------------------------------------------------------------------------- F6 regression
def _f6(spark):
    rng = np.random.default_rng(42)
    x = rng.uniform(0, 1, size=(200, 5))
    x6 = x[:, 0] + x[:, 1]
    y = 2 * x[:, 0] - x[:, 2] + 0.05 * rng.standard_normal(200)
    rows = [tuple(float(v) for v in (*x[i], x6[i], y[i])) for i in range(200)]
    cols = ["x1", "x2", "x3", "x4", "x5", "x6", "y"]
    return spark.createDataFrame(rows, cols), np.column_stack([x, x6]), y


def test_gram_sql_and_arrow_agree(spark):
    df, _, _ = _f6(spark)
    cols = ["x1", "x2", "x3", "x4", "x5", "x6", "y"]
    a = gram_to_numpy(gram_matrix(df, cols, method="sql"), 7)
    b = gram_to_numpy(gram_matrix(df.repartition(3), cols, method="arrow"), 7)
    assert np.allclose(a, b, rtol=1e-12)


def test_forward_path_f6(spark):
    df, x, y = _f6(spark)
    gram = stepwise.regression_gram(df, ["x1", "x2", "x3", "x4", "x5", "x6"], "y")
    path = stepwise.forward_path(gram)
    assert [r["added"] for r in path[:2]] == ["x1", "x3"]
    rss = [r["rss"] for r in path]
    assert all(b <= a + 1e-9 for a, b in zip(rss, rss[1:]))
    assert path[-1]["rank"] == 5
    # coefficients of an independent subset equal lstsq
    beta, r, rank = stepwise.solve_subset(gram, [0, 2, 3])
    ref, res, *_ = np.linalg.lstsq(x[:, [0, 2, 3]], y, rcond=None)
    assert np.allclose(beta, ref, rtol=1e-8)
    assert r == pytest.approx(float(res[0]), rel=1e-8)
    assert rank == 3


def test_criteria_match_formulas(spark):
    df, x, y = _f6(spark)
    gram = stepwise.regression_gram(df, ["x1", "x3"], "y")
    _, rss, k = stepwise.solve_subset(gram, [0, 1])
    c = stepwise.criteria(rss, 200, k, float(y @ y))
    llf = -100 * (math.log(2 * math.pi * rss / 200) + 1)
    assert c["aic"] == pytest.approx(-2 * llf + 4)
    assert c["bic"] == pytest.approx(-2 * llf + 2 * math.log(200))
    assert c["adj_r2"] == pytest.approx(1 - 200 / 198 * (rss / float(y @ y)))


def test_single_predictor_models_match_gram(spark):
    df, _, _ = _f6(spark)
    feats = ["x1", "x2", "x3"]
    s = {r.predictor: r for r in stepwise.single_predictor_models(df, feats, "y").collect()}
    gram = stepwise.regression_gram(df, feats, "y")
    for i, c in enumerate(feats):
        beta, rss, _ = stepwise.solve_subset(gram, [i])
        assert s[c].coef == pytest.approx(beta[0], rel=1e-10)
        assert s[c].rss == pytest.approx(rss, rel=1e-9)


def test_best_subset_matches_brute_force(spark):
    df, _, _ = _f6(spark)
    gram = stepwise.regression_gram(df, ["x1", "x2", "x3", "x4", "x5"], "y")
    best = stepwise.best_subset(spark, gram, 2).collect()[0]
    brute = min(stepwise.all_subsets_small(gram, 2), key=lambda r: r[1])
    assert best.predictors == ",".join(brute[0])
    assert best.rss == pytest.approx(brute[1], rel=1e-9)
    assert stepwise.unrank_combination(0, 5, 2) == [0, 1]
    assert stepwise.unrank_combination(9, 5, 2) == [3, 4]


def test_ols_summary_against_mllib(spark):
    from pyspark.ml.regression import LinearRegression

    from regionlens.operators.features import assemble

    df, _, _ = _f6(spark)
    feats = ["x1", "x3"]
    gram = stepwise.regression_gram(df, feats, "y")
    ours = stepwise.ols_summary(gram, feats)
    model = LinearRegression(fitIntercept=False, solver="normal", labelCol="y").fit(assemble(df, feats))
    assert [r["coef"] for r in ours] == pytest.approx(list(model.coefficients), rel=1e-8)
    assert [r["std_err"] for r in ours] == pytest.approx(model.summary.coefficientStandardErrors, rel=1e-6)
    assert [r["p_value"] for r in ours] == pytest.approx(model.summary.pValues, abs=1e-9)
    with pytest.raises(ValueError):
        stepwise.ols_summary(stepwise.regression_gram(df, ["x1", "x2", "x6"], "y"), ["x1", "x2", "x6"])


def test_student_t_p_value():
    assert stepwise.t_two_sided_p(0.0, 10) == pytest.approx(1.0)
    assert stepwise.t_two_sided_p(2.228138851986, 10) == pytest.approx(0.05, abs=1e-9)


# ----------------------------------------------------------------------------- F7 metrics
def test_confusion_metrics_f7(spark):
    rows = [(1, 1)] * 30 + [(0, 1)] * 10 + [(1, 0)] * 20 + [(0, 0)] * 40
    m = metrics.classifier_metrics(spark.createDataFrame(rows, "label int, prediction int")).collect()[0]
    assert (m.tp, m.fp, m.fn, m.tn) == (30, 10, 20, 40)
    assert m.accuracy == pytest.approx(0.70)
    assert m.precision == pytest.approx(0.75)
    assert m.recall == pytest.approx(0.60)
    assert m.f1 == pytest.approx(2 / 3)
    none = metrics.classifier_metrics(spark.createDataFrame([(1, 0), (0, 0)], "label int, prediction int")).collect()[0]
    assert none.precision is None


# ----------------------------------------------------------------------------- PCA
def test_pca_properties(spark):
    rng = np.random.default_rng(3)
    z = rng.standard_normal((300, 3))
    x = np.column_stack([z[:, 0] * 3, z[:, 0] + 0.1 * z[:, 1], z[:, 2], z[:, 1]])
    cols = ["a", "b", "c", "d"]
    df = spark.createDataFrame([tuple(float(v) for v in r) for r in x], cols)
    fit = pcr.fit_pca(df, cols)
    assert fit.ratio.sum() == pytest.approx(1.0)
    assert all(a >= b - 1e-12 for a, b in zip(fit.ratio, fit.ratio[1:]))
    ev = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert fit.eigenvalues == pytest.approx(ev, rel=1e-8)
    sc = np.array([[r.pc1, r.pc2] for r in pcr.scores(df, fit, k=2).collect()])
    assert np.allclose(sc.mean(axis=0), 0, atol=1e-9)
    assert np.var(sc[:, 0], ddof=1) == pytest.approx(ev[0], rel=1e-8)
    yv = x[:, 0] * 2 + rng.standard_normal(300)
    scored = pcr.scores(spark.createDataFrame([(float(v),) + tuple(float(u) for u in r) for v, r in zip(yv, x)], ["y", *cols]), fit, keep=("y",))
    curve = pcr.r2_curve(scored, "y", 4)
    r2 = [c["r2"] for c in curve]
    assert all(0 <= v <= 1 for v in r2) and all(b >= a - 1e-12 for a, b in zip(r2, r2[1:]))


def test_linear_start_matches_spark_growth_linear(spark):
    series = _f4(spark)
    p = {r.key: r for r in growth.growth_linear(series, "key", "t", "y").collect()}
    t = np.arange(1, 201, dtype=float)
    y = 70000 / (1 + 500 * np.exp(-t / 6))
    a, n, tau = growth.linear_start(t, y)
    assert a == pytest.approx(p["s1"].a, rel=1e-9)
    assert tau == pytest.approx(p["s1"].tau, rel=1e-9)
    assert n == pytest.approx(p["s1"].n, rel=1e-6)
    fits = {r.key: r for r in growth.logistic_fit(series, "key", "t", "y").collect()}
    assert fits["s2"].tau == pytest.approx(22, rel=1e-6)
    assert fits["s6"].status == "no_fit"


def test_forward_path_skips_dependent_columns(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(size=(80, 2))
    rows = [(float(a), float(b), float(a + b), float(2 * a), float(a - b + e)) for (a, b), e in zip(x, rng.normal(size=80))]
    df = spark.createDataFrame(rows, "a double, b double, s double, d double, y double")
    gram = stepwise.regression_gram(df, ["a", "b", "s", "d"], "y")
    path = stepwise.forward_path(gram)
    assert [r["rank"] for r in path] == [1, 2]
    assert len(stepwise.ols_summary(gram, stepwise.choose(path, "adj_r2")["predictors"])) <= 2
