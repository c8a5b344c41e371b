"""Filter audit, source mix and periodic runs against plain versions."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import brute
import numpy as np
import pytest

from regionlens.llm import filter_audit, periodic_runs, source_mix

RNG = random.Random(11)
LONG = " ".join(f"w{RNG.randrange(300)}" for _ in range(260))
TEXTS = [LONG, LONG, LONG, LONG.upper(), LONG + " #", None, "", " \n", "same " * 300, "x", "é ŋ\x1f b" * 80, LONG + " $", "a b " * 1500]
SCHEMA = "doc_id long, text string, source string, n long, h long, k string, size long, bits int"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "clash", 3, 4) for r in rows], SCHEMA)


# ---------------------------------------------------------------- filter audit
def fails(text):
    t = text or ""
    w = brute.raw_of(t).split()
    out = "A" if len(w) < 200 else ""
    out += "B" if 100 * len(set(w)) < 50 * len(w) else ""
    out += "C" if 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t) else ""
    return out + ("D" if set(t) & set("#$%&*|") else "")


def plain_audit(rows, labels):
    good, toxic = defaultdict(int), defaultdict(int)
    for d, q, x in labels:
        if d is not None:
            good[d] |= q == 1
            toxic[d] |= x == 1
    docs = []
    for d, t, s in rows:
        same = d is not None and any((t2 or "") == (t or "") and d2 is not None and d2 < d for d2, t2, _ in rows)
        docs.append((s or "", set(fails(t) + ("E" if same else "")), int(good[d]), int(toxic[d])))
    out, total = [], Counter()
    for part in {x[0] for x in docs}:
        for order in permutations("ABCDE"):
            for k, x in enumerate(order):
                c = Counter()
                for p, f, g, tox in docs:
                    if p != part:
                        continue
                    gone = bool(f & set(order[:k]))
                    c["kept"] += not gone and x not in f
                    c["unique"] += f == {x}
                    c["redundant"] += gone and x in f
                    if x in f and not gone:
                        c.update(removed=1, good=g, toxic=tox)
                total[part, x] += c["removed"]
                out.append((part, "".join(order), k + 1, c["kept"], c["removed"], c["redundant"], c["unique"], c["good"], c["toxic"], x))
    return sorted((*r[:-1], total[r[0], r[-1]]) for r in out)


def test_audit(spark):
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(TEXTS)] + [(None, LONG, "s0"), (0, LONG, None), (2, LONG, ""), (2, LONG, ""), (40, "", "s1")]
    labels = [(0, 1, 0), (1, 1, 1), (1, 0, 0), (2, None, 1), (None, 1, 1), (9, 0, None), (9, 1, None)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit_filters(table(spark, rows), marks)
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, labels)
    assert filter_audit.audit_filters(table(spark, []), marks).count() == 0
    assert filter_audit.audit_filters(table(spark, rows), marks.limit(0)).agg({"good_lost": "sum", "toxic_lost": "sum"}).first()[:] == (0, 0)


# ---------------------------------------------------------------- source mix
def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = dict.fromkeys(sizes, 0.0), set(sizes), share * sum(sizes.values())
    while open_ and left > 1e-9:
        unit = left / sum(weight[s] for s in open_)
        for s in open_:
            target[s] += unit * weight[s]
        left = sum(max(0.0, target[s] - most * sizes[s]) for s in sizes)
        for s in sizes:
            target[s] = min(target[s], float(most * sizes[s]))
        open_ = {s for s in open_ if target[s] < most * sizes[s]}
    return target


def checked_mix(rows, got):
    size = lambda t: len(brute.raw_of(t).split())
    sizes, source = defaultdict(int), {}
    for d, t, s in rows:
        sizes[s] += size(t)
    target = plain_targets(sizes)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d, size(t)) for d, t, _ in rows)
    for d, _, s in rows:
        source.setdefault(d, s)
    taken = defaultdict(int)
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
    for s, n in taken.items():
        assert abs(n - target[s]) <= max(size(t) for _, t, x in rows if x == s) / 2 + 1e-6


def test_mix(spark):
    rows = [(k, " ".join(["w"] * RNG.randrange(1, 40)), RNG.choice(["a", "b", "B", "é", "z", None])) for k in range(400)]
    rows += [(1000 + k, "hot " * 20, "a") for k in range(300)] + [(5000, None, "a"), (5001, "", "empty"), (5002, " \t", None)]
    df = table(spark, rows)
    got = source_mix.mix_sources(df).collect()
    checked_mix(rows, got)
    again = source_mix.mix_sources(df.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert source_mix.mix_sources(table(spark, [])).count() == 0
    assert [tuple(r) for r in source_mix.mix_sources(table(spark, [(1, None, "a")])).collect()] == [(1, 0, 0, 0.0, 0)]


def test_mix_of_repeated_rows(spark):
    # one row repeated: the threshold falls among rows that share a hash
    rows = [(None, "one two three", "a")] * 200 + [(7, "w " * 10, "b")] * 60 + [(8, "w " * 10, "c")] * 30
    checked_mix(rows, source_mix.mix_sources(table(spark, rows)).collect())


def test_selections_are_nested(spark):
    df = table(spark, [(k, "w " * (1 + k % 9), "ab"[k % 2]) for k in range(300)])
    small, large = ({r["doc_id"]: r["taken"] for r in source_mix.mix_sources(df, weights=(1, 1), share=x).collect()} for x in (0.3, 0.7))
    assert all(n <= large[d] for d, n in small.items()) and sum(small.values()) < sum(large.values())


# ---------------------------------------------------------------- periodic runs
def plain_runs(w):
    n, found = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def plain_planted(doc_id, w):
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not w:
        return w
    a = (h // 10) % len(w)
    p = 1 + (len(w) - a) // (3 + h // 10 % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]


def plain_digest(doc_id, text):
    w = plain_planted(doc_id, brute.raw_of(text).split())
    runs = plain_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return (
        doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2],
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)),
    )


def periodic_text():
    n, letters = RNG.choice([0, 5, 6, 9, 40, 200]), RNG.choice([1, 2, 3, 12])
    w = [f"{RNG.randrange(letters)}" for _ in range(n)]
    if n and RNG.random() < 0.5:
        a, p = RNG.randrange(n), RNG.randint(1, max(1, n // 4))
        w = [w[i] if i < a else w[min(a + (i - a) % p, n - 1)] for i in range(n)]
    return " ".join(w)


def test_runs(spark):
    texts = TEXTS + ["a\x0bb\x1fc " * 9, "A a " * 7, "word " * 4000] + [periodic_text() for _ in range(150)]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(None, "p q " * 12, "s"), (3, texts[3], "s"), (3, texts[3], "s")]
    got = periodic_runs.run_digest(periodic_runs.periodic_runs(table(spark, rows), rewrite=periodic_runs.planted, keep=("k",))).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((plain_digest(d, t) for d, t, _ in rows), key=repr)
    assert periodic_runs.run_digest(periodic_runs.periodic_runs(table(spark, []))).count() == 0


def test_grammar_queries():
    for _ in range(60):
        n = RNG.randint(2, 400)
        w = [RNG.randrange(RNG.choice([1, 2, 4])) for _ in range(n)]
        words = np.array([98, *w, 99])
        grammar = periodic_runs.Grammar(words)
        x, y = np.array([sorted(RNG.sample(range(1, n + 1), 2)) for _ in range(50)]).T
        ahead = [next(k for k in range(n + 1) if words[a + k] != words[b + k]) for a, b in zip(x, y, strict=True)]
        back = [next(k for k in range(n + 1) if words[a - 1 - k] != words[b - 1 - k]) for a, b in zip(x, y, strict=True)]
        assert grammar.agree(x, y, True).tolist() == ahead and grammar.agree(x, y, False).tolist() == back


def test_grammar_is_small():
    # repetition is what a grammar shortens: a block is one symbol, and levels are logarithmic
    grammar = periodic_runs.Grammar(np.array([7, *[0, 1, 2] * 30000, 8]))
    assert len(grammar.levels) < 40 and len(grammar.levels[-1][0]) <= 4
