"""Operator 3: near-duplicate groups by one-permutation MinHash.

Every document's set of shingle hashes is cut into ``bands * rows`` bins by the leading
bits of a second hash; the smallest hash of a bin is its value, and empty bins copy the
value of a bin drawn by a universal hash (optimal densification). The values of a band
make one bucket key.

Equal sets form a class first (128-bit digest), so copies never meet each other. In
each bucket every class is tied only to the bucket's centre, the class that meets most
others (a star), and the ties are verified on the full sets, which are made again from
the texts. Linked classes are joined to components. A star can miss a link between two
of its rays; so the rays of a centre that are still in several components are searched
once more, by how they differ from the centre: a linked pair must share a certain number
of differences (``delta_prefixes``), so only rays that share one of few, rare differences
are verified as pairs. How rare a difference is, a count sketch of fixed size says; it
only sets the order in which differences are looked at. Nothing is capped. The search is probabilistic only in the bucket
keys: a pair at the limit of 0.85 shares no bucket with probability (1 - 0.85^5)^30,
about 2e-8.

Texts travel compressed, once per use; buckets are skinny rows; all steps with a key
that may be hot are pre-aggregated or meet a written table.

Defined results: a document without words has an empty set and is its own component;
repeated rows (equal doc_id) are one document and get a row each; a null doc_id takes
part as the largest id, and is returned as null.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionlens.llm.common import packed_texts, prepared, row_slices, store, text_hash, utf8_rows
from regionlens.llm.shingles import mixed, shingle_sets

LINK_PERCENT = 85
BANDS, ROWS = 30, 5
#: The sketch that orders differences has 2^SKETCH_BITS counts (2 MB).
SKETCH_BITS = 18
#: Stands for a null doc_id: larger than any.
NO_DOC = (1 << 63) - 1


def probes(bins: int) -> np.ndarray:
    """Bins that an empty bin looks at, one row per attempt (the same for every document)."""
    attempt = np.arange(1, 4 * bins, dtype=np.uint64)[:, None]
    return (mixed(attempt * np.uint64(0x9E3779B97F4A7C15) + np.arange(bins, dtype=np.uint64)) % np.uint64(bins)).astype(np.int64)


class OnePermutation:
    """Band keys of sets of hashes."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS) -> None:
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        self.probes = probes(self.bins)
        self.weights = mixed(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
        self.tags = mixed(np.arange(1001, 1001 + bands, dtype=np.uint64))

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """The smallest hash of each bin of a non-empty set, empty bins densified."""
        h = mixed(hashes + np.uint64(0x632BE59BD9B4E019))
        bin_of = ((h >> np.uint64(40)) * np.uint64(self.bins) >> np.uint64(24)).astype(np.int64)
        values = np.full(self.bins, np.iinfo(np.uint64).max, dtype=np.uint64)
        np.minimum.at(values, bin_of, h)
        full = np.zeros(self.bins, dtype=bool)
        full[bin_of] = True
        empty = np.flatnonzero(~full)
        for row in self.probes:
            if not len(empty):
                break
            drawn = row[empty]
            found = full[drawn]
            values[empty[found]] = values[drawn[found]]
            empty = empty[~found]
        values[empty] = h.min()  # never seen: thousands of draws all missed
        return values

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """One 64-bit bucket key per band."""
        v = self.signature(hashes).reshape(self.bands, self.rows)
        return mixed((v * self.weights).sum(axis=1, dtype=np.uint64) + self.tags)


def sketches(docs: DataFrame, doc_id: str, text: str, bands: int, rows: int) -> DataFrame:
    """(doc_id, th, n_shingles, g, keys): ``text_hash``, the set's size and digest, and its
    band keys; digest and keys of an empty set are null."""
    prepared(docs.sparkSession)
    out = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n_shingles", pa.int64()), ("g", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        oph = OnePermutation(bands, rows)
        for batch in batches:
            raw, offsets = utf8_rows(batch.column(2))
            for a, b in row_slices(offsets):
                sizes, digests, keys = [], [], []
                for s in shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                    sizes.append(len(s))
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    keys.append(oph.keys(s).view(np.int64) if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], schema=out
                )

    source = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_DOC)), text_hash(text), F.col(text).cast("string"))
    return source.mapInArrow(run, "doc_id long, th long, n_shingles long, g binary, keys array<long>")


def class_texts(docs: DataFrame, classes: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(c, body): a deflated text of each class in ``classes`` (c, first, first_th)."""
    packed = packed_texts(docs.where(F.col(text).isNotNull()), doc_id, text, NO_DOC)
    # repeated rows of a class's first document would bring the same text twice
    return packed.join(classes, (packed["doc_id"] == classes["first"]) & (packed["th"] == classes["first_th"])).select("c", "body").dropDuplicates(["c"])


def met_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, a_body, b_body) of pairs (a, b) of classes."""
    left = texts.select(F.col("c").alias("a"), F.col("body").alias("a_body"))
    right = texts.select(F.col("c").alias("b"), F.col("body").alias("b_body"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "a_body", "b_body")


def paired_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[np.ndarray, np.ndarray]]]]:
    """Slices of ``met_texts`` with the full shingle sets of both sides of each row."""
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            rows = batch.slice(at, 64)
            ids = rows.column(0).to_pylist() + rows.column(1).to_pylist()
            bodies = rows.column(2).to_pylist() + rows.column(3).to_pylist()
            once = {c: k for k, c in enumerate(dict.fromkeys(ids))}
            whole = dict(zip(ids, bodies, strict=True))
            parts = [zlib.decompress(whole[c]) for c in once]
            offsets = np.cumsum([0, *map(len, parts)])
            sets = list(shingle_sets(np.frombuffer(b"".join(parts), dtype=np.uint8), offsets))
            yield rows, [(sets[once[a]], sets[once[b]]) for a, b in zip(ids[: len(rows)], ids[len(rows) :], strict=True)]


def members(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the elements of ``y`` are in ``x`` (both sorted, x not empty)."""
    return x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y


def differences(centre: int, x: np.ndarray, y: np.ndarray) -> tuple[int, np.ndarray]:
    """(number of shingles that the ray y has not of its centre x, keys of all its differences)."""
    lost, more = x[~members(y, x)], y[~members(x, y)]
    tag = mixed(np.array([centre], dtype=np.int64).view(np.uint64))
    return len(lost), np.concatenate([mixed(more ^ tag), mixed(lost + tag + np.uint64(1))])


def cells(keys: np.ndarray) -> np.ndarray:
    """The cell of the count sketch that each difference falls into."""
    return (keys >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, shared, joined): intersection and union size of each pair (a, b) of classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, sets in paired_sets(batches):
            shared = [int(members(x, y).sum()) for x, y in sets]
            joined = [len(x) + len(y) - n for (x, y), n in zip(sets, shared, strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(shared, pa.int64()), pa.array(joined, pa.int64())], names=["a", "b", "shared", "joined"])

    return met_texts(pairs, texts).mapInArrow(run, "a long, b long, shared long, joined long")


def verified_ties(ties: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, shared, joined, cell, n): ``verified`` of every tie, and in rows of their own
    (a is null) how many differences of a task's ties fell into each cell of the sketch."""
    out = pa.schema([(c, pa.int64()) for c in ("a", "b", "shared", "joined", "cell", "n")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for rows, sets in paired_sets(batches):
            shared, joined, seen = [], [], []
            for centre, (x, y) in zip(rows.column(0).to_pylist(), sets, strict=True):
                n_lost, keys = differences(centre, x, y)
                shared.append(len(x) - n_lost)
                joined.append(len(x) + len(keys) - n_lost)
                seen.append(cells(keys))
            counts += np.bincount(np.concatenate(seen), minlength=len(counts))
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(shared, pa.int64()), pa.array(joined, pa.int64()), none, none], schema=out)
        held = np.flatnonzero(counts)
        none = pa.nulls(len(held), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(held, pa.int64()), pa.array(counts[held], pa.int64())], schema=out)

    return met_texts(ties, texts).mapInArrow(run, "a long, b long, shared long, joined long, cell long, n long")


def sketch_counts(found: DataFrame) -> np.ndarray:
    """The count of every cell, of ``verified_ties``: 2^SKETCH_BITS numbers whatever the input."""
    counts = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
    total = found.where("a is null").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts[total["cell"].to_numpy()] = total["n"].to_numpy()
    return counts


def delta_prefixes(ties: DataFrame, texts: DataFrame, percent: int, counts: np.ndarray) -> DataFrame:
    """(c, away, short, size, cost, free, delta): prefixes of how a ray b differs from its centre a.

    Let a ray have l shingles of its centre less and m more, and D = 100 l + percent m.
    Two rays x and y of a centre of n shingles are linked only if they share
    at least (Dx + Dy - T) / (100 + percent) of their differences, T = (100 - percent) n; a ray
    is linked to the centre if D <= T. Of rays x and y with y not linked to the centre,
    the share needed is thus over Dx / (100 + percent); and as D is at least percent times the
    number of differences, it is also at least (Dx - T) / 100 and (Dy - T) / 100. In one
    fixed order of differences (rarest first by ``counts``, equal counts by key) two such
    prefixes of what remains must meet. ``delta`` is the longer one (the one of y if the ray is
    ``away`` from the centre), its first ``short`` entries the one of x. ``size``, ``cost``
    and ``free`` are the number of differences, D and T."""
    often = ties.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = 100 + percent
        for rows, sets in paired_sets(batches):
            out: list[tuple] = []
            for k, (x, y) in enumerate(sets):
                n_lost, own = differences(rows.column(0)[k].as_py(), x, y)
                size = len(own)
                cost, free = 100 * n_lost + percent * (size - n_lost), (100 - percent) * len(x)
                own = own[np.lexsort((own, often.value[cells(own)]))]
                far = -((free - cost) // 100)  # (D - T) / 100, rounded up
                short = size + 1 - max(cost // unit + 1, far)
                out.append((cost > free, short, size, cost, free, own[: size + 1 - far if cost > free else short].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [rows.column(1), *(pa.array([o[i] for o in out], t) for i, t in enumerate((pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()))))],
                names=["c", "away", "short", "size", "cost", "free", "delta"],
            )

    return met_texts(ties, texts).mapInArrow(run, "c long, away boolean, short int, size int, cost int, free int, delta array<long>")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node reachable.

    Alternates large-star and small-star steps on written edge tables until the
    edges are stars; both pre-aggregate the minimum, so hubs are no hot keys of a task."""
    edges = store(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")

    def signature(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def least_neighbour(e: DataFrame) -> DataFrame:
        return store(e.groupBy(F.col("n").alias("k")).agg(F.least(F.min("m"), F.col("k")).alias("low")), "stars")

    before = signature(edges)
    while before[0]:
        both = edges.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("m")))
        low = least_neighbour(both)
        large = both.where("m > n").join(low, F.col("n") == F.col("k")).select(F.col("m").alias("n"), F.col("low").alias("m"))
        large = store(large.where("n != m").distinct(), "large")
        low = least_neighbour(large)
        small = large.join(low, F.col("n") == F.col("k")).select(F.col("m").alias("n"), F.col("low").alias("m")).unionByName(low.select(F.col("k").alias("n"), F.col("low").alias("m")))
        edges = store(small.where("n != m").select(F.col("n").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        after = signature(edges)
        if after == before:
            break
        before = after
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return store(nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "roots")


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = LINK_PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, th, n_shingles, component_id, kept) of every row of ``docs``; th is its ``text_hash``."""
    sk = store(sketches(docs, doc_id, text, bands, rows), "sketches")
    classes = sk.where("g is not null").groupBy("g").agg(F.min(F.struct("doc_id", "th")).alias("f"), F.first("keys").alias("keys"))
    classes = store(classes.select(F.monotonically_increasing_id().alias("c"), "g", F.col("f.doc_id").alias("first"), F.col("f.th").alias("first_th"), "keys"), "classes")
    buckets = classes.select(F.explode("keys").alias("key"), "c")
    # the centre of a bucket is the class that meets most others over all its buckets
    held = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    held = store(held.withColumnRenamed("key", "h_key"), "held")
    met = store(buckets.join(held, F.col("key") == F.col("h_key")).select("key", "c", "held"), "met")
    degree = store(met.groupBy(F.col("c").alias("d_c")).agg(F.sum(F.col("held") - 1).alias("degree")), "degrees")
    met = store(met.join(degree, F.col("c") == F.col("d_c")).select("key", "c", "degree"), "met-degrees")
    centres = met.groupBy("key").agg(F.max(F.struct("degree", (-F.col("c")).alias("minus"))).alias("m"))
    centres = store(centres.select(F.col("key").alias("c_key"), (-F.col("m.minus")).alias("centre")), "centres")
    shared = store(met.join(centres, F.col("key") == F.col("c_key")).select("key", "c", "centre"), "shared-buckets")
    pairs = store(shared.where("c != centre").select(F.col("centre").alias("a"), F.col("c").alias("b")).distinct(), "ties")
    tied = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    texts = store(class_texts(docs, classes.select("c", "first", "first_th").join(tied, "c"), doc_id, text), "class-texts")
    found = store(verified_ties(pairs, texts), "verified")
    near = found.where("a is not null").select("a", "b", "shared", "joined")
    linked = 100 * F.col("shared") >= percent * F.col("joined")
    roots = components(near.where(linked).select("a", "b"))

    # links between rays of a centre that are in several components still
    placed = shared.where("c != centre").select("centre", "c").distinct().join(roots, F.col("c") == F.col("node"), "left").select("centre", "c", F.coalesce("root", "c").alias("comp"))
    placed = store(placed, "placed")
    several = placed.groupBy("centre").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi")
    several = store(several.select(F.col("centre").alias("s_centre")), "several")
    ties = placed.join(several, F.col("centre") == F.col("s_centre")).select(F.col("centre").alias("a"), F.col("c").alias("b"))
    deltas = store(delta_prefixes(ties, texts, percent, sketch_counts(found)), "deltas")
    deltas = deltas.select("c", "away", "short", "size", "cost", "free", F.posexplode("delta").alias("at", "key"))
    often = deltas.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max("away").alias("any_away")).where("lo != hi and any_away")
    often = store(often.select(F.col("key").alias("o_key")), "shared-deltas")
    live = deltas.join(often, F.col("key") == F.col("o_key")).withColumn("first", F.col("at") < F.col("short")).withColumn("left", F.col("size") - F.col("at"))
    live = live.join(roots, F.col("c") == F.col("node"), "left").select("key", "c", "away", "first", "left", "cost", "free", F.coalesce("root", "c").alias("comp"))
    live = store(live, "live-deltas")
    seen = live.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("away").alias("any_away")).where("lo != hi and any_away")
    live = store(live.join(store(seen.select(F.col("key").alias("o_key")), "mixed-deltas"), F.col("key") == F.col("o_key")).drop("o_key"), "mixed-live")
    x = live.where("first").select(F.col("key").alias("x_key"), F.col("c").alias("x"), F.col("comp").alias("x_comp"), F.col("left").alias("x_left"), F.col("cost").alias("x_cost"))
    # at the first difference that two rays share, enough of both must be left
    enough = (100 + percent) * F.least("left", "x_left") >= F.col("cost") + F.col("x_cost") - F.col("free")
    across = live.where("away").join(x, (F.col("key") == F.col("x_key")) & (F.col("comp") != F.col("x_comp")) & enough)
    across = across.select(F.least("c", "x").alias("a"), F.greatest("c", "x").alias("b")).distinct()
    known = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = store(verified(store(across.join(known, ["a", "b"], "left_anti"), "across"), texts), "verified-across")
    links = reduce(DataFrame.unionByName, [near.where(linked).select("a", "b"), more.where(linked).select("a", "b")])
    roots = components(links)

    ids = classes.select("c", "g", "first").join(roots, F.col("c") == F.col("node"), "left").select("g", F.coalesce("root", "c").alias("root"), "first")
    least = ids.groupBy("root").agg(F.min("first").alias("component"))
    ids = store(ids.join(least, "root").select(F.col("g").alias("its_g"), "component"), "class-components")
    done = sk.join(ids, sk["g"] == ids["its_g"], "left").withColumn("component", F.coalesce("component", "doc_id"))
    return done.select(
        F.nullif(F.col("doc_id"), F.lit(NO_DOC)).alias("doc_id"),
        "th",
        "n_shingles",
        F.nullif(F.col("component"), F.lit(NO_DOC)).alias("component_id"),
        (F.col("component") == F.col("doc_id")).alias("kept"),
    )
