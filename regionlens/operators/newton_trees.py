"""Second-order boosted trees for two classes (OP-63, 65).

Each round fits a tree to the gradient and Hessian of the log-loss. Features are binned
once; a node's split follows from the sums of gradients and Hessians by feature and bin:

    gain = s(GL, HL) + s(GR, HR) - s(G, H),  s(g, h) = t(g)^2 / (h + reg_lambda),
    leaf weight = -step_size * t(G) / (H + reg_lambda),  t shrinks g by reg_alpha,

for children with a Hessian sum of ``min_child_weight`` at least, where the gain is above
``gamma``. Rows and columns of a tree are drawn by hashes of the row's key and the column.
Gradients are summed as integers (units of 2^-24), so sums, splits and trees don't depend
on how the rows are dealt.

Rows lie in blocks of at most ``block_rows``. The loop over rounds and levels is one and
the same wherever it runs (``Grower``): it asks for the best splits of a level's nodes and
goes on. Where the rows are several blocks, it runs on the driver: every level is one job
for all live models together. The blocks' sums per (model, nodes) are shuffled and added
up, and each node's split is chosen where its sums are; only the splits (``SPLIT``, some
fifty bytes a node, however many the rows and blocks) come to the driver. Margins stay
with the blocks on the executors; a block is held once by each group of models, so that
few blocks and many models give many tasks. Where one block holds all rows, sums need no
adding up, so the loop runs beside the block in a task, one task a model.

Early stopping watches the log-loss on a slice of the training rows, round by round:
after ``patience`` rounds without a new least value training ends, and the model is cut
to the best round. Without ``patience`` all rounds are grown.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionlens.session import cut_lineage, ship_package

UNIT = float(1 << 24)
LEAST_GAIN = 1e-6
BLOCK_ROWS = 1 << 18
#: Rows (those with the smallest key hashes) from which the bins' edges are taken.
EDGE_ROWS = 20_000
#: Rounds between checkpoints of the margins; numbers of a shuffled piece of sums, and of all that one task adds up.
CHECKPOINT_ROUNDS = 25
PIECE = 1 << 17
ADDED = 1 << 20
#: The best split of a node: bins up to ``cut`` of ``feature`` (-1: no split) go left, with sums ``gl`` and ``hl`` of the node's ``g`` and ``h``.
SPLIT = np.dtype([("feature", "i4"), ("cut", "i4"), ("gain", "f8"), ("gl", "i8"), ("hl", "i8"), ("g", "i8"), ("h", "i8")])


@dataclass(frozen=True)
class Spec:
    """One model's parameters. Rows of ``fold`` are held out (-1: none)."""

    label: int = 0
    rounds: int = 500
    max_depth: int = 6
    step_size: float = 0.3
    subsample: float = 1.0
    colsample: float = 1.0
    reg_lambda: float = 1.0
    reg_alpha: float = 0.0
    gamma: float = 0.0
    min_child_weight: float = 1.0
    seed: int = 0
    fold: int = -1
    patience: int = 0


@dataclass
class Tree:
    """Node k is a leaf of ``value`` if ``feature`` is -1; else rows with bin > ``cut``
    (values of ``edge`` and above) go to ``left`` + 1, the others to ``left``."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def root(cls) -> Tree:
        whole = lambda v: np.array([v], dtype=np.int32)
        return cls(whole(-1), whole(0), whole(0), np.zeros(1), np.zeros(1))

    def step(self, bins: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The nodes of the rows of ``bins`` (features, rows) one level below ``node``; a leaf's rows stay."""
        inner = self.feature >= 0
        start = np.where(inner, self.feature, 0).astype(np.int64) * bins.shape[1]
        cut = np.where(inner, self.cut, np.iinfo(np.int32).max)
        left = np.where(inner, self.left, np.arange(len(inner)))
        at = start[node]
        at += np.arange(bins.shape[1])
        return left[node] + (bins.ravel()[at] > cut[node])

    @property
    def depth(self) -> int:
        level, depth = np.array([0]), 0
        while len(inner := level[self.feature[level] >= 0]):
            level, depth = np.concatenate([self.left[inner], self.left[inner] + 1]), depth + 1
        return depth

    def leaves(self, bins: np.ndarray) -> np.ndarray:
        """The leaf (or open node) of every row of ``bins`` (features, rows)."""
        node = np.zeros(bins.shape[1], dtype=np.int64)
        for _ in range(self.depth):
            node = self.step(bins, node)
        return node


@dataclass
class Block:
    """Rows on one executor, for the models numbered ``models``. ``labels`` is (labels,
    rows), ``bins`` (features, rows)."""

    bins: np.ndarray
    labels: np.ndarray
    keys: np.ndarray
    folds: np.ndarray
    checked: np.ndarray
    models: range = range(1)
    margins: dict[int, np.ndarray] = field(default_factory=dict)

    def margin(self, model: int) -> np.ndarray:
        got = self.margins.get(model)
        return np.zeros(len(self.keys)) if got is None else got

    def in_training(self, spec: Spec) -> np.ndarray:
        return (self.folds != spec.fold) & (~self.checked if spec.patience else True)


# ------------------------------------------------------------------ row side
def spread(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def drawn(keys: np.ndarray, seed: int, turn: int) -> np.ndarray:
    """Numbers in [0, 1) by key, seed and turn."""
    salt = spread(np.array([seed * 0x9E3779B97F4A7C15 + turn * 0xD6E8FEB86659FD93 + 1 & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64))
    return spread(keys ^ salt) / 2.0**64


def tree_columns(spec: Spec, turn: int, n_features: int) -> np.ndarray:
    n = max(1, int(spec.colsample * n_features + 1e-9))
    order = np.argsort(drawn(spread(np.arange(n_features, dtype=np.uint64) + np.uint64(1)), spec.seed + 1, turn), kind="stable")
    return np.sort(order[:n])


class Sample:
    """The rows of a block that one tree is grown on, with their gradients, Hessians and
    bins. ``draws`` keeps the draws that models of one seed share."""

    def __init__(self, block: Block, model: int, spec: Spec, turn: int, draws: dict) -> None:
        use = block.in_training(spec)
        if spec.subsample < 1.0:
            if (spec.seed, turn) not in draws:
                draws[spec.seed, turn] = drawn(block.keys, spec.seed, turn)
            use = use & (draws[spec.seed, turn] < spec.subsample)
        self.rows = np.flatnonzero(use)
        self.bins = [block.bins[c][self.rows] for c in tree_columns(spec, turn, len(block.bins))]
        p = 1.0 / (1.0 + np.exp(-block.margin(model)[self.rows]))
        self.g = np.rint((p - block.labels[spec.label, self.rows]) * UNIT)
        self.h = np.rint(np.maximum(p * (1.0 - p), 1e-16) * UNIT)

    def sums(self, tree: Tree, node: np.ndarray, live: np.ndarray, n_bins: int) -> np.ndarray:
        """(2, live nodes, columns of the tree, bins): sums of gradients and of Hessians.
        ``node`` has the node of every row of the block."""
        slot_of = np.full(len(tree.feature), -1)
        slot_of[live] = np.arange(len(live)) * n_bins
        slot, bins, weights = slot_of[node[self.rows]], self.bins, (self.g, self.h)
        if len(inside := np.flatnonzero(slot >= 0)) < len(slot):
            slot, bins, weights = slot[inside], [b[inside] for b in bins], [w[inside] for w in weights]
        out = np.empty((2, len(live), len(bins), n_bins), dtype=np.int64)
        for k, b in enumerate(bins):
            cell = slot + b
            for w, x in enumerate(weights):
                # a block's sums are whole numbers below 2^53: exact as doubles
                out[w, :, k] = np.bincount(cell, weights=x, minlength=len(live) * n_bins).reshape(len(live), n_bins)
        return out


def watched(block: Block, model: int, spec: Spec) -> np.ndarray:
    """(sum of the log-loss in units, rows) over the rows that early stopping watches, and
    (rows classified right, rows) of the held-out fold."""
    rows = np.flatnonzero(block.checked & (block.folds != spec.fold))
    margin, label = block.margin(model), block.labels[spec.label]
    m, y = margin[rows], label[rows]
    loss = np.logaddexp(0.0, m) - y * m
    out = np.flatnonzero(block.folds == spec.fold)
    return np.array([np.rint(loss * UNIT).sum(), len(rows), ((margin[out] > 0) == (label[out] > 0.5)).sum(), len(out)]).astype(np.int64)


# ------------------------------------------------------------------ loop side
def shrunk(spec: Spec, g: np.ndarray) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - spec.reg_alpha, 0.0)


def score(spec: Spec, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    t = shrunk(spec, g)
    return t * t / (h + spec.reg_lambda)


def weight(spec: Spec, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return -spec.step_size * shrunk(spec, g) / (h + spec.reg_lambda)


def best_splits(spec: Spec, turn: int, n_features: int, sums: np.ndarray) -> np.ndarray:
    """The best split (``SPLIT``) of every node by its sums (first feature, then lowest edge on ties)."""
    nodes, n_bins = sums.shape[1], sums.shape[3]
    left = np.cumsum(sums, axis=3)
    total = left[:, :, :1, -1:]
    (gl, hl), (gr, hr), (g, h) = left / UNIT, (total - left) / UNIT, total / UNIT
    gain = score(spec, gl, hl) + score(spec, gr, hr) - score(spec, g, h)
    fit = (hl >= spec.min_child_weight) & (hr >= spec.min_child_weight) & (left[1] > 0) & (left[1] < total[1])
    gain = np.where(fit, gain, -np.inf).reshape(nodes, -1)
    best = gain.argmax(axis=1)
    node = np.arange(nodes)
    column, cut = np.divmod(best, n_bins)
    out = np.empty(nodes, dtype=SPLIT)
    out["feature"], out["cut"], out["gain"] = tree_columns(spec, turn, n_features)[column], cut, gain[node, best]
    out["gl"], out["hl"] = left[:, node, column, cut]
    out["g"], out["h"] = total[:, :, 0, 0]
    return out


class Grower:
    """The growth of one model: asks for the splits of its open nodes, takes them in."""

    def __init__(self, spec: Spec) -> None:
        self.spec = spec
        self.trees: list[Tree] = []
        self.losses: list[float] = []
        self.best = -1
        self.held_out = (0, 0)
        self.done = spec.rounds <= 0

    def begin(self) -> None:
        self.tree, self.live, self.depth = Tree.root(), np.array([0]), 0

    @property
    def growing(self) -> bool:
        return not self.done and len(self.live) > 0

    def absorb(self, best: np.ndarray) -> np.ndarray:
        """Split the live nodes where it pays; the numbers (in ``best``) of those split."""
        spec, tree, live = self.spec, self.tree, self.live
        if self.depth == 0:  # the root's own weight
            tree.value[:] = weight(spec, best["g"] / UNIT, best["h"] / UNIT)
        split = (best["gain"] > max(spec.gamma, LEAST_GAIN)) & (self.depth < spec.max_depth)
        split = np.flatnonzero(split)
        at, best = live[split], best[split]
        n = len(tree.feature)
        tree.feature[at], tree.cut[at], tree.gain[at] = best["feature"], best["cut"], best["gain"]
        tree.left[at] = n + 2 * np.arange(len(at))
        two = lambda a: np.column_stack([best[f"{a}l"], best[a] - best[f"{a}l"]]).ravel() / UNIT
        value = weight(spec, two("g"), two("h"))
        new = 2 * len(at)
        tree.feature = np.concatenate([tree.feature, np.full(new, -1, dtype=np.int32)])
        tree.cut, tree.left = (np.concatenate([x, np.zeros(new, dtype=x.dtype)]) for x in (tree.cut, tree.left))
        tree.value, tree.gain = np.concatenate([tree.value, value]), np.concatenate([tree.gain, np.zeros(new)])
        self.depth += 1
        self.live = n + np.arange(new) if self.depth < spec.max_depth else self.live[:0]
        return split

    @property
    def watching(self) -> bool:
        return self.spec.patience > 0 or self.spec.fold >= 0

    def end(self, seen: np.ndarray | None) -> None:
        """After a round's tree; ``seen`` as from ``watched`` of a model that is ``watching``."""
        if self.spec.patience and seen[1]:
            self.losses.append(float(seen[0] / UNIT / seen[1]))
            if self.best < 0 or self.losses[-1] < self.losses[self.best]:
                self.best = len(self.losses) - 1
            self.done = len(self.losses) - 1 - self.best >= self.spec.patience
        if seen is not None and self.best in (-1, len(self.trees) - 1):
            self.held_out = (int(seen[2]), int(seen[3]))
        self.done = self.done or len(self.trees) >= self.spec.rounds

    def kept(self) -> list[Tree]:
        return self.trees[: self.best + 1] if self.best >= 0 else self.trees


def train_beside(block: Block, spec: Spec, n_bins: int) -> Grower:
    """The loop beside the one block that holds all rows."""
    grower = Grower(spec)
    whole = not np.isnan(block.labels[spec.label]).any()
    if grower.done:
        grower.held_out = tuple(watched(block, 0, spec)[2:].tolist())
    while not grower.done:
        grower.begin()
        turn, node = len(grower.trees), np.zeros(len(block.keys), dtype=np.int64)
        sample, above = Sample(block, 0, spec, turn, {}), None
        while grower.growing:
            tree, live = grower.tree, grower.live
            if above is None or not whole:
                sums = sample.sums(tree, node, live, n_bins)
            else:  # of two siblings one has the parent's sums less the other's
                parents, lesser = above
                sums = np.repeat(parents, 2, axis=1)
                got = sample.sums(tree, node, live[lesser], n_bins)
                sums[:, lesser ^ 1] -= got
                sums[:, lesser] = got
            best = best_splits(spec, turn, len(block.bins), sums)
            split = grower.absorb(best)
            above = sums[:, split], 2 * np.arange(len(split)) + (2 * best["hl"][split] > best["h"][split])
            node = tree.step(block.bins, node)
        block.margins[0] = block.margin(0) + grower.tree.value[node]
        grower.trees.append(grower.tree)
        grower.end(watched(block, 0, spec) if grower.watching else None)
    return grower


def level(state: RDD, growers: dict[int, Grower], watch: dict[int, Spec], turn: int, n_features: int, n_bins: int, slots: int) -> tuple[dict, dict]:
    """One job: the splits of the live nodes of ``growers`` by model, and what ``watched``
    has of the models of ``watch``. Sums are shuffled in pieces of some nodes of a model."""
    asked = {m: (g.spec, g.tree, g.live) for m, g in growers.items()}
    specs = {m: g.spec for m, g in growers.items()}
    numbers = sum(2 * len(g.live) * n_features * n_bins for g in growers.values())

    def sums(block: Block) -> Iterator[tuple]:
        draws: dict = {}
        for m in block.models:
            if m in watch:
                yield (m, -1), watched(block, m, watch[m])
            if m in asked:
                spec, tree, live = asked[m]
                got = Sample(block, m, spec, turn, draws).sums(tree, tree.leaves(block.bins), live, n_bins)
                step = max(1, PIECE * len(live) // got.size)
                for k in range(0, len(live), step):
                    yield (m, k), got[:, k : k + step]

    def best(parts: Iterator[tuple]) -> Iterator[tuple]:
        for (m, k), x in parts:
            yield m, k, x if k < 0 else best_splits(specs[m], turn, n_features, x)

    added = state.flatMap(sums).reduceByKey(np.add, min(slots, 1 + numbers // ADDED))
    splits: dict[int, list] = {}
    seen = {}
    for m, k, x in sorted(added.mapPartitions(best).collect(), key=lambda r: r[:2]):
        if k < 0:
            seen[m] = x
        else:
            splits.setdefault(m, []).append(x)
    return {m: np.concatenate(x) for m, x in splits.items()}, seen


def train_across(blocks: RDD, specs: Sequence[Spec], n_features: int, n_bins: int, slots: int) -> list[Grower]:
    """The loop over rows in many blocks: a job a level, for all live models. The first job
    of a round also adds the last round's trees to the margins and watches them."""
    growers = [Grower(s) for s in specs]
    live = {m: g for m, g in enumerate(growers) if not g.done}
    if idle := {m: s for m, s in enumerate(specs) if m not in live and s.fold >= 0}:
        for m, seen in level(blocks, {}, idle, 0, n_features, n_bins, slots)[1].items():
            growers[m].held_out = tuple(seen[2:].tolist())
    state, turn = blocks, 0
    while live:
        before = state
        if turn:
            grown = {m: g.trees[-1] for m, g in live.items()}

            def advance(block: Block, grown=grown) -> Block:
                # the margins of finished models go
                block.margins = {m: block.margin(m) + grown[m].value[grown[m].leaves(block.bins)] for m in block.models if m in grown}
                return block

            state = state.map(advance).persist(StorageLevel.MEMORY_AND_DISK)
            if turn % CHECKPOINT_ROUNDS == 0:
                state.checkpoint()
        watch = {m: g.spec for m, g in live.items() if turn and g.watching}
        more = {m: g for m, g in live.items() if turn < g.spec.rounds}
        for g in more.values():
            g.begin()
        splits, seen = level(state, more, watch, turn, n_features, n_bins, slots) if more or watch else ({}, {})
        if before is not state and before is not blocks:
            before.unpersist()
        if turn:
            for m, g in live.items():
                g.end(seen.get(m))
        live = {m: g for m, g in more.items() if not g.done}
        for m, g in live.items():
            g.absorb(splits[m])
        while some := {m: g for m, g in live.items() if g.growing}:
            splits, _ = level(state, some, {}, turn, n_features, n_bins, slots)
            for m, g in some.items():
                g.absorb(splits[m])
        for g in live.values():
            g.trees.append(g.tree)
        turn += 1
    if state is not blocks:
        state.unpersist()
    return growers


# ------------------------------------------------------------------ Spark side
@dataclass
class Trained:
    """A model: its trees (cut to the best round) and their number, the edges of its bins,
    the watched log-losses, rounds grown, and (right, all) rows of its held-out fold."""

    spec: Spec
    features: list[str]
    edges: list[np.ndarray]
    trees: list[Tree]
    n_trees: int
    losses: list[float]
    rounds: int
    held_out: tuple[int, int]

    @classmethod
    def of(cls, grower: Grower, features: list[str], edges: list[np.ndarray], trees: bool) -> Trained:
        kept = grower.kept()
        return cls(grower.spec, features, edges, kept if trees else [], len(kept), grower.losses, len(grower.trees), grower.held_out)


def bin_edges(df: DataFrame, features: Sequence[str], order: Sequence[str], max_bins: int, sample: int = EDGE_ROWS) -> list[np.ndarray]:
    """Per feature the values at which a new bin begins: every value but the least if there
    are at most ``max_bins``, else the values at every 1/max_bins of the rows. Of more than
    ``sample`` rows those first in ``order`` (key hashes) count."""
    rows = df.orderBy(*order).limit(sample).select(*[F.col(f"`{c}`") for c in features]).toPandas()
    out = []
    for c in features:
        v = np.sort(rows[c].to_numpy(dtype=float))
        values = np.unique(v)
        if len(values) > max_bins:
            ranks = -(-np.arange(1, max_bins) * len(v) // max_bins)
            values = np.unique(np.concatenate([v[:1], v[ranks - 1]]))
        out.append(values[1:])
    return out


def first_by_key(rows: DataFrame, n: int, sample: int = EDGE_ROWS) -> DataFrame:
    """Rows of ``rows`` (``n``) among which are the ``sample`` with the smallest b_key: those
    up to a key that twice as many should have, or all if they turn out to be too few. So
    a sort by b_key needs no more than these."""
    if n <= 4 * sample:
        return rows
    near = rows.filter(F.col("b_key") < F.lit(-(1 << 63) + (2 * sample << 64) // n))
    return near if near.limit(sample).count() == sample else rows


def packed(df: DataFrame, features: Sequence[str], labels: Sequence[str], edges: list[np.ndarray], block_rows: int) -> DataFrame:
    """(block): the rows of ``df`` (features, labels, b_key, b_fold, b_checked), binned, in
    blocks of at most ``block_rows``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def pack(rows: pa.Table) -> pa.RecordBatch:
            cols = [rows.column(k).to_numpy() for k in range(rows.num_columns)]
            n = len(features)
            small = np.min_scalar_type(max((len(e) for e in edges), default=0))
            bins = np.array([np.searchsorted(e, x, side="right").astype(small) for e, x in zip(edges, cols[:n], strict=True)])
            block = Block(bins, np.array(cols[n : n + len(labels)], dtype=float), cols[-3].astype(np.int64).view(np.uint64), cols[-2], cols[-1].astype(bool))
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], names=["block"])

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= block_rows:
                rows = pa.Table.from_batches(held)
                yield pack(rows.slice(0, block_rows))
                held = rows.slice(block_rows).to_batches()
        if sum(b.num_rows for b in held):
            yield pack(pa.Table.from_batches(held))

    return df.select(*[F.col(f"`{c}`") for c in (*features, *labels)], "b_key", "b_fold", "b_checked").mapInArrow(run, "block binary")


def dealt(blocks: DataFrame, n_blocks: int, n_models: int, slots: int) -> RDD:
    """The blocks of ``packed``, each once for every group of models: so many groups that
    blocks and groups make about ``slots`` partitions."""
    groups = min(n_models, -(-slots // n_blocks))
    copies = blocks.rdd.zipWithIndex().flatMap(lambda r: [(r[1] * groups + g, (g, r[0]["block"])) for g in range(groups)])

    def unpacked(part: tuple) -> Block:
        block = pickle.loads(part[1][1])
        block.models = range(part[1][0], n_models, groups)
        return block

    return copies.partitionBy(n_blocks * groups, lambda k: k).map(unpacked)


def train(
    spark: SparkSession, df: DataFrame, features: Sequence[str], key: str, labels: Sequence[str], specs: Sequence[Spec],
    fold=None, checked=None, max_bins: int = 64, block_rows: int = BLOCK_ROWS, trees: bool = True,
) -> list[Trained]:
    """A model for every one of ``specs``. ``fold`` (int) and ``checked`` (boolean) are
    column expressions: a row's fold (from 0), and whether early stopping watches it. Missing
    features count as 0; rows without a label must not be in ``df``. Without ``trees`` the
    models come without them, for their losses and scores."""
    ship_package(spark)
    number = lambda c: F.nanvl(F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c)
    rows = cut_lineage(
        df.select(
            *[number(c) for c in features],
            *[F.col(f"`{c}`").cast("double").alias(c) for c in labels],
            F.xxhash64(F.col(key).cast("string")).alias("b_key"),
            (F.lit(0) if fold is None else fold.cast("int")).alias("b_fold"),
            (F.lit(False) if checked is None else checked).alias("b_checked"),
        )
    )
    n = rows.count()
    edges = bin_edges(first_by_key(rows, n), features, ["b_key", *[f"`{c}`" for c in features]], max_bins)
    n_bins = max((len(e) for e in edges), default=0) + 1
    made = lambda grower: Trained.of(grower, list(features), edges, trees)
    if n > block_rows:
        slots = 2 * spark.sparkContext.defaultParallelism
        n_blocks = -(-n * 21 // (block_rows * 20))  # partitions differ by a few rows
        raw = cut_lineage(packed(rows.repartition(n_blocks), features, labels, edges, block_rows))
        blocks = dealt(raw, n_blocks, len(specs), slots).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            return [made(g) for g in train_across(blocks, specs, len(features), n_bins, slots)]
        finally:
            blocks.unpersist()
    if n:
        return _train_in_tasks(packed(rows.coalesce(1), features, labels, edges, block_rows), specs, n_bins, made)
    return [made(Grower(s)) for s in specs]


def _train_in_tasks(block: DataFrame, specs: Sequence[Spec], n_bins: int, made) -> list[Trained]:
    """A task a model, each with the one block; those with the most rounds to come begin."""
    order = sorted(range(len(specs)), key=lambda m: (specs[m].step_size, -specs[m].max_depth))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                model = pickle.dumps(made(train_beside(pickle.loads(raw), specs[order[k]], n_bins)))
                yield pa.RecordBatch.from_arrays([pa.array([order[k]], pa.int32()), pa.array([model], pa.binary())], names=["m", "model"])

    tasks = block.select(F.explode(F.array([F.lit(k) for k in range(len(specs))])).alias("k"), "block")
    done = tasks.repartitionByRange(len(specs), "k").mapInArrow(run, "m int, model binary")
    return [pickle.loads(r["model"]) for r in sorted(done.collect(), key=lambda r: r["m"])]


def margins(model: Trained, x: np.ndarray) -> np.ndarray:
    """Log-odds of the rows of ``x`` (rows, features)."""
    bins = np.array([np.searchsorted(e, np.nan_to_num(c), side="right") for e, c in zip(model.edges, x.T, strict=True)])
    out = np.zeros(len(x))
    for tree in model.trees:
        out += tree.value[tree.leaves(bins)]
    return out


def scored(model: Trained, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """``keep`` columns of ``df``, the class by ``model`` and the probability of class 1."""
    spark = df.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast(model)  # at most rounds * 2^(depth + 1) nodes
    n = len(model.features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(n)]) if batch.num_rows else np.zeros((0, n))
            m = margins(sent.value, x.astype(float))
            extra = [pa.array((m > 0).astype(np.int32)), pa.array(1.0 / (1.0 + np.exp(-m)))]
            yield pa.RecordBatch.from_arrays([*[batch.column(n + k) for k in range(len(keep))], *extra], names=[*keep, "prediction", "probability"])

    filled = [F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(f"f{k}") for k, c in enumerate(model.features)]
    source = df.select(*filled, *keep)
    fields = "".join(f"`{c}` {source.schema[c].dataType.simpleString()}, " for c in keep)
    return source.mapInArrow(run, f"{fields}prediction int, probability double")
