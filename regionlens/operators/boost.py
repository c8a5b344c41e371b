"""Boosted-tree classification (OP-63..66): fit, predict, search, importance.

The trees are those of ``newton_trees`` (second-order, with L1 / L2 leaf penalties,
least child weight, least gain, row and column draws per tree). The main fits grow all
their rounds. The search stops each fit after ``PATIENCE`` rounds without a better
log-loss on a slice of the *training* rows (by hash, never the test rows) and cuts it to
its best round; its folds are a hash of the key. All of it, models included, is the same
under any partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionlens.functions.scalar import hash_unit
from regionlens.operators import newton_trees
from regionlens.operators.features import HASH_RANGE, hash_fold
from regionlens.operators.newton_trees import Spec, Trained

# The reference's random-search space.
SEARCH_MAX_DEPTH = (5, 6, 7, 8, 9)
SEARCH_COLSAMPLE = (0.6, 0.7, 0.8, 0.9)
SEARCH_SUBSAMPLE = (0.6, 0.7, 0.8, 0.9)
SEARCH_ETA_RANGE = (-2.0, 0.0, 10)  # log10 start, stop, count
PATIENCE = 20
# The reference's two main fits, 500 rounds each.
FATALITY_PARAMS = {"max_iter": 500, "max_depth": 6, "step_size": 0.027825594022071243, "subsample": 0.6, "colsample": 0.8}
INFECTION_PARAMS = {"max_iter": 500, "max_depth": 8, "step_size": 0.01, "subsample": 0.7, "colsample": 0.7}


def eta_grid() -> list[float]:
    lo, hi, n = SEARCH_ETA_RANGE
    return [float(v) for v in np.logspace(lo, hi, int(n))]


# The character classes counted in a text (ASCII, as POSIX defines them).
DIGIT_CHARS = "0123456789"
UPPER_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PUNCT_CHARS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def text_shape_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """Length, word and line counts, and digit / punctuation / upper-case shares
    of the whole text. Class counts use ``translate`` (a character map, no
    regular expression): count = length - length(text without the class)."""
    t = F.col(text)
    n = F.length(t).cast("double")

    def share(chars: str):
        return F.coalesce(F.try_divide((F.length(t) - F.length(F.translate(t, chars, ""))).cast("double"), n), F.lit(0.0))

    return docs.withColumns(
        {
            "f_chars": n,
            "f_words": F.when(F.trim(t) == "", 0).otherwise(F.size(F.split(F.trim(t), r"\s+"))).cast("double"),
            "f_lines": F.size(F.split(t, "\n")).cast("double"),
            "f_digit_share": share(DIGIT_CHARS),
            "f_punct_share": share(PUNCT_CHARS),
            "f_upper_share": share(UPPER_CHARS),
        }
    )


TEXT_FEATURES = ("f_chars", "f_words", "f_lines", "f_digit_share", "f_punct_share", "f_upper_share")


def validation_slice(key: str, fraction: float, seed: int) -> Column:
    return hash_unit(key, f"val:{seed}") < F.lit(int(fraction * HASH_RANGE))


def with_validation(df: DataFrame, key: str, fraction: float, seed: int, name: str = "is_validation") -> DataFrame:
    return df.withColumn(name, validation_slice(key, fraction, seed))


def spec(max_iter: int = 500, step_size: float = 0.1, **params) -> Spec:
    return Spec(rounds=max_iter, step_size=step_size, **params)


def fit_each(train: DataFrame, features: Sequence[str], key: str, models: dict[str, dict], **options) -> dict[str, Trained]:
    """A model for each label column of ``models`` by its parameters, over one set of blocks."""
    specs = [spec(label=k, **params) for k, params in enumerate(models.values())]
    got = newton_trees.train(train.sparkSession, train, features, key, list(models), specs, **options)
    return dict(zip(models, got, strict=True))


def fit(train: DataFrame, features: Sequence[str], key: str, label: str = "label", validation_fraction: float = 0.0, seed: int = 0, patience: int = PATIENCE, **params) -> Trained:
    """Fit on ``train``: all rounds, or with a ``validation_fraction`` above 0 until the
    log-loss of that slice has not fallen for ``patience`` rounds."""
    stop = validation_fraction > 0
    model = {"seed": seed, "patience": patience if stop else 0} | params
    return fit_each(train, features, key, {label: model}, checked=validation_slice(key, validation_fraction, seed) if stop else None)[label]


def predict(model: Trained, df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``keep`` columns, class and probability; ``features`` are those of the fit."""
    if list(features) != model.features:
        raise ValueError(f"the model was fitted on {model.features}")
    return newton_trees.scored(model, df, keep)


def sample_params(n_draws: int, seed: int) -> list[dict]:
    """Seeded draws from the grid of the search space, without replacement (the whole
    grid if more are asked for)."""
    grid = list(product(SEARCH_MAX_DEPTH, SEARCH_COLSAMPLE, SEARCH_SUBSAMPLE, eta_grid()))
    drawn = np.random.RandomState(seed).choice(len(grid), size=min(n_draws, len(grid)), replace=False)
    return [dict(zip(("max_depth", "colsample", "subsample", "step_size"), grid[i], strict=True)) for i in drawn]


def search(
    train: DataFrame,
    features: Sequence[str],
    key: str,
    label: str = "label",
    n_draws: int = 20,
    folds: int = 5,
    max_iter: int = 500,
    seed: int = 0,
    validation_fraction: float = 0.2,
    patience: int = PATIENCE,
    **options,
) -> tuple[list[dict], Trained]:
    """(k-fold CV accuracy of each draw, the best draw fitted on all of ``train``).

    All draws and folds are grown in one pass over one set of blocks. Folds come from a
    hash of ``key``; every fit stops early on a validation slice of its own training rows
    (none if ``validation_fraction`` is 0)."""
    draws = sample_params(n_draws, seed)
    common = {"max_iter": max_iter, "seed": seed, "patience": patience if validation_fraction > 0 else 0}
    specs = [spec(**common, **d, fold=k) for d in draws for k in range(folds)]
    checked = validation_slice(key, validation_fraction, seed) if validation_fraction > 0 else None
    got = newton_trees.train(train.sparkSession, train, features, key, [label], specs, fold=hash_fold(key, seed, folds), checked=checked, trees=False, **options)
    rows = []
    for i, d in enumerate(draws):
        fits = got[i * folds : (i + 1) * folds]
        scores = [t.held_out[0] / t.held_out[1] for t in fits if t.held_out[1]]
        rows.append(dict(d, draw=i + 1, accuracy=float(np.mean(scores)) if scores else None, n_trees=float(np.mean([t.n_trees for t in fits]))))
    best = max(range(len(draws)), key=lambda i: (rows[i]["accuracy"] or 0.0, -i))
    model = newton_trees.train(train.sparkSession, train, features, key, [label], [spec(**common, **draws[best])], checked=checked, **options)[0]
    return rows, model


def random_search(train: DataFrame, features: Sequence[str], key: str, **options) -> list[dict]:
    """The scores of ``search`` alone."""
    return search(train, features, key, **options)[0]


def search_report(train: DataFrame, holdout: DataFrame, features: Sequence[str], key: str, label: str = "label", **options) -> list[dict]:
    """The scores of ``search``; the best draw's has its model's accuracy on ``holdout``, the others' null."""
    rows, model = search(train, features, key, label, **options)
    pred = predict(model, holdout, features, keep=(label,))
    score = pred.agg(F.avg((F.col("prediction") == F.col(label)).cast("double"))).first()[0]
    best = max(range(len(rows)), key=lambda i: (rows[i]["accuracy"] or 0.0, -i))
    return [dict(r, holdout_accuracy=score if i == best else None) for i, r in enumerate(rows)]


def importance(model: Trained, features: Sequence[str]) -> list[dict]:
    """Total gain (as a share of all) and number of splits per feature."""
    gain, counts = np.zeros(len(features)), np.zeros(len(features), dtype=int)
    for tree in model.trees:
        inner = tree.feature >= 0
        np.add.at(gain, tree.feature[inner], tree.gain[inner])
        np.add.at(counts, tree.feature[inner], 1)
    total = gain.sum() or 1.0
    return [{"feature": f, "gain": float(gain[i] / total), "weight": int(counts[i])} for i, f in enumerate(features)]


def tree_rows(model: Trained, number: int) -> list[dict]:
    """Tree ``number`` as rows: node (1 the root, 2n and 2n + 1 the children of n), feature and
    threshold (null in a leaf; rows below it go to 2n), gain, weight."""
    tree, out, todo = model.trees[number], [], [(0, 1)]
    while todo:
        at, node = todo.pop()
        f = int(tree.feature[at])
        inner = f >= 0
        out.append(
            {
                "node": node,
                "feature": model.features[f] if inner else None,
                "threshold": float(model.edges[f][tree.cut[at]]) if inner else None,
                "gain": float(tree.gain[at]) if inner else None,
                "weight": float(tree.value[at]),
            }
        )
        if inner:
            todo += [(int(tree.left[at]) + k, 2 * node + k) for k in (0, 1)]
    return out
