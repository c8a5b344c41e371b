"""TSQR, sweeps, leaps and bounds, packed cross products."""

import itertools

import numpy as np
import pytest

from regionlens.operators import blocks, leaps, stepwise


def _frame(spark, x, y, parts=5):
    names = [f"x{i}" for i in range(x.shape[1])]
    rows = [tuple(map(float, (*r, v))) for r, v in zip(x, y, strict=True)]
    return spark.createDataFrame(rows, [*names, "y"]).repartition(parts), names


def test_rss_far_below_the_sum_of_squares(spark):
    # RSS / sum(y^2) is 1e-13: the cross products hold no digit of it
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 4)) + 3.0
    noise = rng.normal(size=400) * 1e-6
    y = x @ np.array([2.0, -1.0, 0.5, 3.0]) + noise
    df, names = _frame(spark, x, y)
    gram = stepwise.regression_gram(df, names, "y")
    q, _ = np.linalg.qr(x)
    rest = noise - q @ (q.T @ noise)
    beta, rss, rank = stepwise.solve_subset(gram, range(4))
    assert rank == 4 and rss / gram.yty < 1e-12
    assert rss == pytest.approx(float(rest @ rest), rel=1e-6)
    assert stepwise.forward_path(gram)[-1]["rss"] == pytest.approx(float(rest @ rest), rel=1e-6)
    # what the normal equations make of it
    by_products = gram.g[4, 4] - gram.g[4, :4] @ np.linalg.solve(gram.g[:4, :4], gram.g[:4, 4])
    assert abs(by_products - rss) > 0.01 * rss


def test_factor_under_any_partitioning(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(150, 3)), rng.normal(size=150)
    df, names = _frame(spark, x, y, 40)  # more partitions than one merge step takes
    r, n = blocks.tall_qr(df, [*names, "y"])
    a = np.column_stack([x, y])
    assert n == 150 and np.allclose(r.T @ r, a.T @ a, rtol=1e-12)
    g, n = blocks.cross_products(df, [*names, "y"])
    assert n == 150 and np.allclose(g, a.T @ a, rtol=1e-12)
    r, n = blocks.tall_qr(df.limit(0), names)
    assert n == 0 and r.shape == (0, 3)
    few = spark.createDataFrame([(1.0, 2.0, None), (1.0, 2.0, float("nan")), (1.0, 2.0, 3.0)], "a double, b double, c double")
    assert blocks.cross_products(few, ["a", "b", "c"])[1] == 1


def test_forward_path_equals_refits(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(120, 9)) @ rng.normal(size=(9, 9))
    y = x[:, 2] * 2 - x[:, 7] + rng.normal(size=120)
    df, names = _frame(spark, x, y)
    path = stepwise.forward_path(stepwise.regression_gram(df, names, "y"))
    chosen = []
    for row in path:
        rss = {c: float(np.linalg.lstsq(x[:, [*chosen, c]], y, rcond=None)[1][0]) for c in range(9) if c not in chosen}
        best = min(rss, key=rss.get)
        chosen.append(best)
        assert row["added"] == names[best] and row["rss"] == pytest.approx(rss[best], rel=1e-9)
    assert len(path) == 9


@pytest.mark.parametrize("seed", range(4))
def test_leaps_equal_enumeration(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(60, 8)) @ rng.normal(size=(8, 8))
    y = rng.normal(size=60) + (x[:, 1] if seed % 2 else 0)
    if seed == 3:  # dependent columns, one of them zero
        x[:, 4], x[:, 6], x[:, 7] = x[:, 0] + x[:, 1], 2 * x[:, 2], 0.0
    df, names = _frame(spark, x, y)
    gram = stepwise.regression_gram(df, names, "y")
    for k in (1, 3, 5):
        got = stepwise.best_subset(spark, gram, k).first()
        least = min(rss for _, rss in stepwise.all_subsets_small(gram, k))
        assert got["rss"] == pytest.approx(least, rel=1e-9) and len(got["predictors"].split(",")) == k
    r, resp = gram.r[:, :8], gram.response
    if seed < 3:  # in waves of a few nodes a task
        every = leaps.leaps(spark, r, resp, 4, np.inf, [], most=5)
        least = min(itertools.combinations(range(8), 4), key=lambda s: stepwise.solve_subset(gram, s)[1])
        assert every == list(least)


def test_more_predictors_than_independent_columns(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 2))
    df, names = _frame(spark, np.column_stack([x, x.sum(axis=1)]), x[:, 0] + rng.normal(size=30))
    got = stepwise.best_subset(spark, stepwise.regression_gram(df, names, "y"), 3).first()
    assert got["predictors"] == "x0,x1,x2" and got["rank"] == 2


def test_best_eight_of_forty(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 40)) + rng.normal(size=(500, 1))
    true = [1, 5, 8, 13, 21, 30, 34, 39]
    y = x[:, true] @ np.linspace(1.0, 0.4, 8) + rng.normal(size=500)
    df, names = _frame(spark, x, y)
    got = stepwise.best_subset(spark, stepwise.regression_gram(df, names, "y"), 8).first()
    assert got["predictors"] == ",".join(names[i] for i in true)


def test_nested_fits(spark):
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(80, 4)) + 5, rng.normal(size=80) + 2
    df, names = _frame(spark, x, y)
    rss, rank = stepwise.nested_fits(stepwise.regression_gram(df, names, "y"))
    for i in range(5):
        a = np.column_stack([np.ones(80), x[:, :i]])
        assert rss[i] == pytest.approx(float(np.linalg.lstsq(a, y, rcond=None)[1][0]), rel=1e-9) and rank[i] == i + 1
