"""Second-order trees: the first tree against an exhaustive one, the same model however
the rows are dealt, round counts with and without early stopping."""

import pickle

import numpy as np
import pytest
from pyspark import RDD
from pyspark.sql import functions as F

from regionlens.operators import boost, newton_trees
from regionlens.operators.newton_trees import Spec

FEATS = ["a", "b", "c"]


def _rows(n=400, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 12, size=(n, 3)).astype(float)
    y = (x[:, 0] + 0.5 * x[:, 1] + rng.normal(0, 2, n) > 9).astype(float)
    return x, y


def _frame(spark, x, y, partitions=3):
    rows = [(i, *map(float, x[i]), float(y[i]), float(1 - y[i])) for i in range(len(x))]
    return spark.createDataFrame(rows, "k long, a double, b double, c double, label double, other double").repartition(partitions)


def _plain_tree(x, g, h, spec, depth=0, node=1):
    """Nested (node, feature, threshold, weight) of exhaustive search."""
    t = lambda v: np.sign(v) * max(abs(v) - spec.reg_alpha, 0.0)
    score = lambda a, b: t(a) ** 2 / (b + spec.reg_lambda)
    best = (max(spec.gamma, 1e-6), None, None)
    if depth < spec.max_depth:
        for f in range(x.shape[1]):
            for v in np.unique(x[:, f])[1:]:
                left = x[:, f] < v
                hl, hr = h[left].sum(), h[~left].sum()
                if min(hl, hr) >= spec.min_child_weight:
                    gain = score(g[left].sum(), hl) + score(g[~left].sum(), hr) - score(g.sum(), h.sum())
                    if gain > best[0] + 1e-9:
                        best = (gain, f, v)
    weight = -spec.step_size * t(g.sum()) / (h.sum() + spec.reg_lambda)
    out = [(node, None if best[1] is None else FEATS[best[1]], best[2], pytest.approx(weight))]
    if best[1] is not None:
        left = x[:, best[1]] < best[2]
        out += _plain_tree(x[left], g[left], h[left], spec, depth + 1, 2 * node) + _plain_tree(x[~left], g[~left], h[~left], spec, depth + 1, 2 * node + 1)
    return out


@pytest.mark.parametrize("extra", [{}, {"reg_lambda": 3.0, "reg_alpha": 2.0}, {"gamma": 4.0}, {"min_child_weight": 15.0}])
def test_first_tree_is_the_exhaustive_one(spark, extra):
    x, y = _rows()
    spec = Spec(rounds=1, max_depth=3, **extra)
    model = newton_trees.train(spark, _frame(spark, x, y), FEATS, "k", ["label"], [spec])[0]
    got = sorted((r["node"], r["feature"], r["threshold"], r["weight"]) for r in boost.tree_rows(model, 0))
    want = sorted(_plain_tree(x, 0.5 - y, np.full(len(y), 0.25), spec), key=lambda r: r[0])
    assert got == want and len(got) > 1


def _same(one, two):
    assert len(one.trees) == len(two.trees) and one.losses == two.losses and one.held_out == two.held_out
    for s, t in zip(one.trees, two.trees, strict=True):
        for c in ("feature", "cut", "left", "value", "gain"):
            assert np.array_equal(getattr(s, c), getattr(t, c))


def test_same_models_in_one_block_and_in_many(spark):
    x, y = _rows(300)
    specs = [
        Spec(rounds=5, max_depth=3, subsample=0.7, colsample=0.7, fold=1, seed=3),
        Spec(rounds=6, max_depth=2, patience=2, step_size=2.0),
        Spec(label=1, rounds=4, max_depth=4, min_child_weight=0.0, reg_alpha=0.5),
    ]
    common = {"fold": F.col("k") % 3, "checked": F.col("k") % 5 == 0}
    args = (FEATS, "k", ["label", "other"], specs)
    one = newton_trees.train(spark, _frame(spark, x, y), *args, **common)
    many = newton_trees.train(spark, _frame(spark, x, y, 4), *args, **common, block_rows=40)
    for a, b in zip(one, many, strict=True):
        _same(a, b)
    assert one[0].held_out[1] == 100 and one[1].held_out == (0, 0)
    again = newton_trees.train(spark, _frame(spark, x, y, 1), *args, **common)
    for a, b in zip(one, again, strict=True):
        _same(a, b)


def test_all_rounds_without_patience(spark):
    x, y = _rows()
    model = boost.fit(_frame(spark, x, y), FEATS, "k", max_iter=120, max_depth=3, step_size=0.01)
    assert len(model.trees) == model.rounds == 120 and model.losses == []


@pytest.mark.parametrize("eta", [0.01, 0.3, 1.0])
def test_patience_counts_rounds(spark, eta):
    x, y = _rows()
    model = boost.fit(_frame(spark, x, y), FEATS, "k", validation_fraction=0.3, max_iter=90, max_depth=3, step_size=eta, patience=20)
    best = int(np.argmin(model.losses))
    assert len(model.losses) == model.rounds == min(90, best + 21) and len(model.trees) == best + 1
    if eta == 0.01:
        assert model.rounds == 90  # small steps train on
    else:
        assert model.rounds < 90


def test_scores_are_the_sum_of_the_trees(spark):
    x, y = _rows(200)
    df = _frame(spark, x, y)
    model = boost.fit(df, FEATS, "k", max_iter=10, max_depth=3, step_size=0.3)
    got = {r["k"]: r["probability"] for r in boost.predict(model, df, FEATS, keep=("k",)).collect()}
    assert [got[i] for i in range(200)] == pytest.approx(list(1 / (1 + np.exp(-newton_trees.margins(model, x)))))
    right = np.mean([(got[i] > 0.5) == (y[i] > 0.5) for i in range(200)])
    assert right > max(y.mean(), 1 - y.mean()) + 0.05
    with pytest.raises(ValueError):
        boost.predict(model, df, ["a"], keep=("k",))


def test_missing_features_no_rows_and_one_class(spark):
    schema = "k long, a double, b double, c double, label double"
    rows = [(i, None if i % 2 else float(i), float("nan"), 1.0, float(i % 2)) for i in range(60)]
    df = spark.createDataFrame(rows, schema)
    model = boost.fit(df, FEATS, "k", max_iter=3, max_depth=2)
    assert boost.predict(model, df, FEATS, keep=("k",)).where("prediction is null or probability is null").count() == 0
    assert boost.fit(df.limit(0), FEATS, "k", max_iter=3).trees == []
    flat = boost.fit(df.where("label = 1"), FEATS, "k", max_iter=3)
    assert boost.predict(flat, df, FEATS, keep=("k",)).where("prediction <> 1").count() == 0


def test_quantile_edges(spark):
    x = np.arange(1000.0)
    df = spark.createDataFrame([(i, float(v), 0.0) for i, v in enumerate(x)], "k long, a double, b double")
    a, b = newton_trees.bin_edges(df, ["a", "b"], ["k"], 10)
    assert a.tolist() == [99.0, 199.0, 299.0, 399.0, 499.0, 599.0, 699.0, 799.0, 899.0] and b.tolist() == []


def test_only_splits_come_to_the_driver(spark, monkeypatch):
    """F2 to F6: what the driver collects doesn't grow with the blocks, and is some bytes a node."""
    x, y = _rows(600)
    df, sizes, collect = _frame(spark, x, y), [], RDD.collect

    def kept(self):
        sizes.append(len(pickle.dumps(out := collect(self))))
        return out

    monkeypatch.setattr(RDD, "collect", kept)
    sent = []
    for block_rows in (200, 25):
        sizes.clear()
        model = newton_trees.train(spark, df, FEATS, "k", ["label"], [Spec(rounds=6, max_depth=4)], block_rows=block_rows)[0]
        sent.append(sum(sizes))
    nodes = sum(len(t.feature) for t in model.trees)
    assert sent[1] < 1.2 * sent[0] and sent[1] < 150 * nodes + 400 * 6 * 4


def test_a_job_a_level(spark):
    """rounds need no jobs besides those of their levels."""
    x, y = _rows(300)
    df, sc = _frame(spark, x, y), spark.sparkContext
    jobs = []
    for rounds in (2, 6):
        sc.setJobGroup(f"rounds-{rounds}", "")
        newton_trees.train(spark, df, FEATS, "k", ["label"], [Spec(rounds=rounds, max_depth=3, patience=20)], checked=F.col("k") % 5 == 0, block_rows=60)
        jobs.append(len(sc.statusTracker().getJobIdsForGroup(f"rounds-{rounds}")))
    sc.setJobGroup("", "")
    assert jobs[1] - jobs[0] <= 4 * 3


def test_models_of_a_search_are_dealt_over_tasks_and_come_without_trees(spark):
    """F1: few blocks and many models make many tasks; only scores come back from the folds."""
    x, y = _rows(200)
    specs = [Spec(rounds=3, max_depth=2, fold=k % 2, seed=k) for k in range(6)]
    common = {"fold": F.col("k") % 2, "trees": False}
    args = (FEATS, "k", ["label"], specs)
    one = newton_trees.train(spark, _frame(spark, x, y), *args, **common)
    many = newton_trees.train(spark, _frame(spark, x, y), *args, **common, block_rows=120)
    assert [(m.held_out, m.n_trees, m.trees) for m in one] == [(m.held_out, 3, []) for m in many]
    assert all(m.held_out[1] == 100 for m in one)
    rows = spark.createDataFrame([(pickle.dumps(newton_trees.Block(*[np.zeros((1, 1))] * 5)),)] * 2, "block binary").repartition(2)
    groups = newton_trees.dealt(rows, 2, 6, 8).map(lambda b: b.models).glom().collect()
    assert sorted(m for part in groups for models in part for m in models) == sorted(2 * [*range(6)])
    assert len(groups) == 8 and all(len(models) <= 2 for part in groups for models in part)


def test_rows_with_the_smallest_keys(spark):
    rows = spark.range(2000).select(F.xxhash64("id").alias("b_key"))
    near = [r[0] for r in newton_trees.first_by_key(rows, 2000, 50).collect()]
    assert len(near) < 300 and sorted(near)[:50] == sorted(r[0] for r in rows.collect())[:50]
    assert newton_trees.first_by_key(rows.withColumn("b_key", F.lit(1 << 62)), 2000, 50).count() == 2000
