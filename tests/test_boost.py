"""Boosted trees: separable fixture, reproducible search, importance, text features."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from regionlens.operators import boost, metrics


def _separable(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(-1, 1, size=(300, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0.3).astype(float)
    rows = [(i, float(x[i, 0]), float(x[i, 1]), float(x[i, 2]), float(y[i])) for i in range(300)]
    return spark.createDataFrame(rows, "k long, a double, b double, c double, label double")


def test_gbt_beats_majority_and_importance(spark):
    df = _separable(spark)
    feats = ["a", "b", "c"]
    model = boost.fit(df, feats, "k", validation_fraction=0.2, max_iter=15, max_depth=3, step_size=0.3, seed=1)
    pred = boost.predict(model, df, feats, keep=("k", "label"))
    m = metrics.classifier_metrics(pred).collect()[0]
    majority = max(df.filter(F.col("label") == 1).count(), df.filter(F.col("label") == 0).count()) / 300
    assert m.accuracy > majority + 0.1
    imp = {r["feature"]: r for r in boost.importance(model, feats)}
    assert imp["a"]["gain"] > imp["c"]["gain"]
    assert imp["a"]["weight"] >= 1
    assert sum(r["gain"] for r in imp.values()) == pytest.approx(1.0)


def test_search_reproducible(spark):
    df = _separable(spark).coalesce(2)
    a = boost.random_search(df, ["a", "b", "c"], "k", n_draws=2, folds=2, max_iter=3, seed=3)
    b = boost.random_search(df, ["a", "b", "c"], "k", n_draws=2, folds=2, max_iter=3, seed=3)
    assert [r["max_depth"] for r in a] == [r["max_depth"] for r in b]
    assert [r["accuracy"] for r in a] == pytest.approx([r["accuracy"] for r in b])
    draws = boost.sample_params(50, 0)
    assert {d["max_depth"] for d in draws} <= set(boost.SEARCH_MAX_DEPTH)
    assert all(0.01 - 1e-12 <= d["step_size"] <= 1.0 + 1e-12 for d in draws)


def test_text_shape_features(spark):
    df = spark.createDataFrame([(1, "Ab1!\nc d"), (2, "")], "doc_id long, text string")
    r = {x.doc_id: x for x in boost.text_shape_features(df).collect()}
    assert r[1].f_chars == 8 and r[1].f_words == 3 and r[1].f_lines == 2
    assert r[1].f_digit_share == pytest.approx(1 / 8)
    assert r[1].f_punct_share == pytest.approx(1 / 8)
    assert r[1].f_upper_share == pytest.approx(1 / 8)
    assert r[2].f_digit_share == 0.0


def test_draws_differ_and_search_returns_the_best_model(spark):
    draws = [tuple(d.values()) for d in boost.sample_params(800, 1)]
    assert len(set(draws)) == 800 and len(boost.sample_params(5000, 1)) == 800
    df = _separable(spark)
    feats = ["a", "b", "c"]
    rows, best = boost.search(df, feats, "k", n_draws=2, folds=2, max_iter=3, seed=3)
    top = max(rows, key=lambda r: r["accuracy"])
    assert best.spec.max_depth == top["max_depth"] and best.spec.step_size == top["step_size"]
    assert boost.predict(best, df, feats, keep=("k",)).count() == 300


def test_search_report_has_the_best_models_holdout_score(spark):
    df = _separable(spark).coalesce(2)
    train, holdout = df.where("k < 200"), df.where("k >= 200")
    rows = boost.search_report(train, holdout, ["a", "b", "c"], "k", n_draws=2, folds=2, max_iter=3, seed=3)
    best = max(rows, key=lambda r: r["accuracy"])
    assert 0.5 < best["holdout_accuracy"] <= 1 and sum(r["holdout_accuracy"] is not None for r in rows) == 1
