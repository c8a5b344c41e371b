"""Best subset by leaps and bounds (OP-74).

Of p predictors, the k with the least residual sum of squares. The search starts from
all of them and deletes: a node is a set of columns of which the first ``kept`` stay; its
own RSS is a lower bound for every subset of it, and deleting column j adds
b_j^2 / C_jj, from the coefficients b and the inverse C of its cross products, which a
deletion updates in O(p^2). With the free columns in falling order of that cost, child i
deletes the i-th and keeps those before it, so every subset is reached once and whole
branches fall away by the bound.

Spark deals the open nodes to tasks in waves. A task searches depth-first for a number of
nodes, and returns the best it found and what it left open; the least bound of a wave
holds for all tasks of the next one.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession

from regionlens.session import ship_package

DEPENDENT = 1e-10
#: Nodes of a task in a wave, and open nodes a slot at the start of one.
NODES = 20_000
PER_SLOT = 4

Node = tuple[tuple[int, ...], int]


def circuit(r: np.ndarray, columns: Sequence[int]) -> list[int]:
    """Columns among ``columns`` that depend on each other linearly; none if all are independent."""
    basis = np.zeros((len(r), 0))
    for at, c in enumerate(columns):
        x = r[:, c]
        rest = x - basis @ (basis.T @ x)
        rest -= basis @ (basis.T @ rest)
        norm = np.linalg.norm(x)
        if np.linalg.norm(rest) <= DEPENDENT * norm or norm == 0:
            if norm == 0 or at == 0:
                return [c]
            scale = np.linalg.norm(r[:, columns[:at]], axis=0)
            b = np.linalg.lstsq(r[:, columns[:at]] / scale, x / norm, rcond=None)[0]
            return [columns[i] for i in range(at) if abs(b[i]) > 1e-7] + [c]
        basis = np.column_stack([basis, rest / np.linalg.norm(rest)])
    return []


def starts(r: np.ndarray, p: int, k: int) -> list[Node]:
    """Sets of independent columns that hold every independent subset of k, each once."""
    todo, out = [(tuple(range(p)), 0)], []
    while todo:
        columns, kept = todo.pop()
        loop = circuit(r, columns)
        if not loop:
            out.append((columns, kept))
            continue
        fixed, free = columns[:kept], [c for c in columns[kept:] if c not in loop]
        able = [c for c in loop if c not in fixed]  # one of these must go
        for i, c in enumerate(able):
            if len(columns) - 1 >= k:
                todo.append(((*fixed, *able[:i], *able[i + 1 :], *free), kept + i))
    return out


class State:
    """Coefficients, inverse and RSS of a set of independent columns of R."""

    def __init__(self, r: np.ndarray, y: np.ndarray, columns: Sequence[int]) -> None:
        a = r[:, list(columns)]
        scale = np.linalg.norm(a, axis=0)
        q, t = np.linalg.qr(a / scale)
        inverse = np.linalg.inv(t)
        self.columns = np.array(columns)
        self.c = inverse @ inverse.T
        self.b = inverse @ (q.T @ y)
        rest = y - q @ (q.T @ y)
        rest -= q @ (q.T @ rest)
        self.rss = float(rest @ rest)

    def costs(self) -> np.ndarray:
        return self.b**2 / np.diag(self.c)

    def without(self, j: int, order: np.ndarray) -> State:
        """Without column j, the others in ``order``."""
        new = object.__new__(State)
        col, pivot = self.c[order, j], self.c[j, j]
        new.columns = self.columns[order]
        new.c = self.c[np.ix_(order, order)] - np.outer(col, col) / pivot
        new.b = self.b[order] - col * (self.b[j] / pivot)
        new.rss = self.rss + float(self.b[j] ** 2 / pivot)
        return new


def search(r: np.ndarray, y: np.ndarray, k: int, nodes: Sequence[Node], bound: float, most: int) -> tuple[float, list[int], list[Node]]:
    """(least RSS below ``bound``, its columns, nodes left open) after at most ``most`` nodes."""
    best, chosen, seen = bound, [], 0
    stack = [(State(r, y, columns), kept) for columns, kept in nodes]
    while stack and seen < most:
        state, kept = stack.pop()
        seen += 1
        d = len(state.columns) - k
        if state.rss >= best:
            continue
        if d == 0:
            best, chosen = state.rss, state.columns.tolist()
            continue
        cost = state.costs()[kept:]
        if len(cost) < d or state.rss + np.partition(cost, d - 1)[d - 1] >= best:
            continue
        if d == 1:
            j = kept + int(cost.argmin())
            best, chosen = state.rss + float(cost.min()), np.delete(state.columns, j).tolist()
            continue
        order = kept + np.argsort(-cost, kind="stable")
        ahead = np.concatenate([np.arange(kept), order])
        # the cheapest deletion is pushed last and searched first
        for i in range(len(order) - d + 1):
            if state.rss + cost[order[i] - kept] < best:
                stack.append((state.without(int(order[i]), np.delete(ahead, kept + i)), kept + i))
    return best, chosen, [(tuple(s.columns.tolist()), kept) for s, kept in stack if s.rss < best]


def leaps(spark: SparkSession, r: np.ndarray, y: np.ndarray, k: int, bound: float, chosen: list[int], most: int = NODES) -> list[int]:
    """The k columns of ``r`` with the least RSS of ``y``; ``chosen`` is a subset to beat, ``bound`` its RSS."""
    slots = max(spark.sparkContext.defaultParallelism, 1)
    best, open_ = bound, starts(r, r.shape[1], k)
    ship_package(spark)
    while open_:
        # enough nodes for all tasks: a few steps here, breadth-first
        while open_ and len(open_) < PER_SLOT * slots:
            got, cols, left = search(r, y, k, [open_[0]], best, 1)
            if cols:
                best, chosen = got, cols
            open_ = open_[1:] + left
            if not left and not open_:
                break
            if len(left) == 1 and len(open_) == 1:
                break
        if not open_:
            break
        rows = [(i % slots, list(c), kept) for i, (c, kept) in enumerate(open_)]
        table = spark.createDataFrame(rows, "slot int, cols array<int>, kept int").repartitionByRange(slots, "slot")

        def run(batches, best=best):
            mine = [(tuple(int(x) for x in c), int(n)) for b in batches for c, n in zip(b["cols"], b["kept"], strict=True)]
            if mine:
                got, cols, left = search(r, y, k, mine, best, most)
                yield pd.DataFrame({"rss": [got], "found": [cols], "cols": [[]], "kept": [-1]})
                if left:
                    yield pd.DataFrame({"rss": [got] * len(left), "found": [[]] * len(left), "cols": [list(c) for c, _ in left], "kept": [n for _, n in left]})

        done = table.mapInPandas(run, "rss double, found array<int>, cols array<int>, kept int").collect()
        for row in done:
            if row["found"] and row["rss"] < best:
                best, chosen = row["rss"], list(row["found"])
        open_ = [(tuple(row["cols"]), row["kept"]) for row in done if row["kept"] >= 0]
    return sorted(chosen)
