"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

SPACES = b" \t\n\x0b\x0c\r"


def sha(raw: bytes) -> str:
    return hashlib.sha256(raw).hexdigest()


def raw_of(text: str | None) -> bytes:
    return (text or "").encode()


def substrings(texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    """n_bytes, n_removed, n_spans, kept_sha256 of each text."""
    raws = [raw_of(t) for t in texts]
    seen = Counter(hash(r[i : i + length]) for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[hash(r[i : i + length])] > 1:
                gone[i : i + length] = b"\x01" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(r), sum(gone), spans, sha(bytes(b for b, g in zip(r, gone, strict=True) if not g))))
    return out


def shingles(text: str | None) -> set[tuple[bytes, ...]]:
    words = raw_of(text).lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def near_groups(rows: list[tuple[int, str | None]], percent: int = 85) -> list[tuple[int, int, int, bool]]:
    """doc_id, n_shingles, component_id, kept; doc_ids distinct."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    shared = Counter((a, b) for h in holders.values() for k, a in enumerate(h) for b in h[k + 1 :])
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y, key=lambda i: rows[i][0])] = min(x, y, key=lambda i: rows[i][0])
    return [(d, len(sets[i]), rows[find(i)][0], rows[find(i)][0] == d) for i, (d, _) in enumerate(rows)]


def line_dedup(rows: list[tuple[int | None, str | None]], min_chars: int = 40, min_docs: int = 5) -> list[tuple]:
    """doc_id, n_lines, n_dropped, text left."""

    def key(line: bytes) -> bytes | None:
        k = line.strip(SPACES).lower()
        return k if len(k.decode()) >= min_chars else None

    rank = lambda d: float("-inf") if d is None else d
    docs = defaultdict(set)
    for d, t in rows:
        for line in raw_of(t).split(b"\n"):
            if key(line):
                docs[key(line)].add(rank(d))
    out = []
    for d, t in rows:
        lines = raw_of(t).split(b"\n")
        left = [x for x in lines if not (key(x) and len(docs[key(x)]) >= min_docs and rank(d) != max(docs[key(x)]))]
        out.append((d, len(lines), len(lines) - len(left), b"\n".join(left).decode()))
    return out


def contaminated(rows: list[tuple], items: list[tuple], percent: int = 80) -> list[tuple]:
    """doc_id, item_id, n_item, n_shared."""
    sets = [(i, shingles(t)) for i, t in items]
    out = []
    for d, t in rows:
        own = shingles(t)
        out += [(d, i, len(s), len(s & own)) for i, s in sets if s and 100 * len(s & own) >= percent * len(s)]
    return out


def quality(rows: list[tuple], min_docs: int = 20, share: float = 0.1) -> list[tuple]:
    """(doc_id, text left) of the documents (doc_id, text, host) that pass."""
    lines = lambda t: [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    words = lambda t: [w.decode() for w in raw_of(t).split()]
    norm = lambda x: " ".join(words(x)).lower()
    texts, holders = defaultdict(set), defaultdict(set)
    for _, t, h in rows:
        texts[h].add(t)
        for x in lines(t):
            holders[h, norm(x)].add(t)
    often = {k for k, v in holders.items() if len(v) > min_docs and len(v) > share * len(texts[k[0]])}
    out = []
    for d, t, h in rows:
        w = words(t)
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        repeated = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
        left = None if t is None else "\n".join(x for x in t.split("\n") if (h, norm(x)) not in often or not lines(x))
        if len(w) >= 50 and 100 * len(repeated) <= 50 * len(w) and len(w) - len(words(left)) <= 0.5 * len(w):
            out.append((d, left))
    return out
