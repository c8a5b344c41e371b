"""Operator 12: mixing sources to target weights, by hash-threshold histograms.

Every source gets a share of a budget of words by its weight, at most ``MOST`` times its
own size; what the limit cuts off goes to the others by weight, again and again, until
nothing is above. A source's target is so many whole copies of it and a rest. The rest is
met by a threshold: a document is taken once more if its hash lies below its source's.

The threshold is found without sorting: sum the words by source and by the upper bits of
the hash, add up the buckets, and only the one bucket in which the rest runs out is
looked at again by its next bits, until one document is left in it. That one is taken if
this brings the sum nearer. Hashes don't depend on the budget, so the selections for two
budgets are nested, and depend on nothing but doc_id, source and text, so reruns agree.
Rows alike in all three share a hash; they are told apart by a number within their table,
which decides how many of them are taken and, as they are alike, no more.

Texts are read once, into a written table of sizes and hashes. A source that holds a
third of all rows is reduced map-side to its buckets; the thresholds, one row a source,
come back in a join that Spark broadcasts while they are few and splits where skewed.

Defined results: null, empty and blank texts have size 0 and are taken 0; a null source
is a source like any other, last in order; a source without words has target 0; repeated
rows count one by one; the empty table gives the empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionlens.llm.common import store

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Bits of the hash (from md5), of the number that tells equal rows apart, and of one refinement.
HASH_BITS = 60
ROW_BITS = 63
STEP_BITS = 15


def hash_of(*values: Column) -> Column:
    """The first 60 bits of the md5 of the values, each with its length before it."""
    parts = [F.coalesce(F.concat(F.length(v), F.lit(":"), v), F.lit("-")) for v in (v.cast("string") for v in values)]
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, HASH_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """(doc_id, source, size, h, u) of every document, written once."""
    t = F.col(text).cast("string")
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.coalesce(F.regexp_count(t, F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.md5(t).alias("m"))
    d = d.select("doc_id", "source", "size", hash_of(F.col("doc_id"), F.col("source"), F.col("m")).alias("h"), F.monotonically_increasing_id().alias("u"))
    return store(d, "mix-sizes")


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with their place (``rank``, from 0) by code point, null last. Sorted in
    parts; only the parts' row counts are gathered."""
    s = store(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()), "mix-sources")
    part = F.shiftright("at", 33)
    counts = dict(s.groupBy(part.cast("int")).count().collect())
    first, n = [], 0
    for k in range(max(counts, default=-1) + 1):
        first.append(n)
        n += counts.get(k, 0)
    begin = F.get(F.array(*[F.lit(x).cast("long") for x in first or [0]]), part.cast("int"))
    return s.withColumn("rank", begin + (F.col("at") - F.shiftleft(part, 33))).drop("at")


def water_level(sources: DataFrame, share: float, most: float) -> float | None:
    """Words a unit of weight gets: budget not yet used up by limited sources over the weight
    of the others, until no further source comes to its limit (each round one small
    aggregate over the sources). None if every source is at its limit or there is no weight."""
    level, limited = 0.0, -1
    budget = sources.agg(F.sum("source_size")).first()[0] or 0
    while True:
        over = F.col("weight") * F.lit(level) > most * F.col("source_size")
        n, used, weight = sources.agg(F.count_if(over), F.sum(F.when(over, most * F.col("source_size"))), F.sum(F.when(~over, F.col("weight")))).first()
        if n == limited or not weight:
            return level if weight else None
        limited, level = n, (share * budget - (used or 0)) / weight


def targets(sizes: DataFrame, weights: Sequence[int], share: float, most: int) -> DataFrame:
    """(source, source_size, target) of every source."""
    sources = ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    turn = F.pmod(F.col("rank"), F.lit(len(weights))).cast("int")
    sources = sources.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), turn))
    level = water_level(sources, share, most)
    limit = (most * F.col("source_size")).cast("double")
    target = limit if level is None else F.least(limit, F.col("weight") * F.lit(level))
    return sources.select("source", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(b_source, h_most, u_most) by source: rows of ``rows`` (source, size, h, u) with
    (h, u) up to that come as near to the source's budget (``rest`` of ``budgets``) as they can."""
    found = budgets.select(F.col("source").alias("b_source"), "rest", F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("h_low"), F.lit(0).cast("long").alias("u_low"), F.lit(2).cast("long").alias("n"))
    levels = [("h", b) for b in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS)] + [("u", b) for b in range(max(0, ROW_BITS - STEP_BITS), -1, -STEP_BITS)]
    levels += [("u", 0)] if levels[-1][1] else []
    high = {"h": HASH_BITS, "u": ROW_BITS}
    for name, bit in levels:
        width = min(high[name] - bit, STEP_BITS)
        high[name] = bit
        top = {"h": high["h"], "u": high["u"]}
        top[name] = bit + width
        # the rows of the one bucket that is still open
        open_ = found.where("n > 1")
        inside = rows.join(open_, F.col("source").eqNullSafe(F.col("b_source")) & (F.shiftright("h", top["h"]) == F.shiftright("h_low", top["h"])) & (F.shiftright("u", top["u"]) == F.shiftright("u_low", top["u"])))
        bucket = F.shiftright(name, bit).bitwiseAND(F.lit((1 << width) - 1))
        sums = inside.groupBy("b_source", "rest", "before", "h_low", "u_low", bucket.alias("k")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"), F.min("h").alias("h"), F.min("u").alias("u"))
        found = store(found.where("n <= 1").unionByName(boundary(sums, name, bit)), "mix-level")
        if not found.where("n > 1").limit(1).count():
            break
    # every open bucket holds one row now (or none is open): with it or without, whichever is nearer
    return found.select("b_source", F.col("h_low").alias("h_most"), F.col("u_low").alias("u_most"), "before", "rest")


def boundary(sums: DataFrame, name: str, bit: int) -> DataFrame:
    """Of every source's buckets, that in which ``rest`` runs out (the last if none)."""
    per = F.sort_array(F.collect_list(F.struct("k", "words", "n", "h", "u")))
    grouped = sums.groupBy("b_source", "rest", "before", "h_low", "u_low").agg(per.alias("buckets"))
    start = F.struct(F.col("before").alias("before"), *[F.lit(x).cast("long").alias(c) for c, x in (("k", -1), ("words", 0), ("n", 0), ("h", 0), ("u", 0))])

    def add(a: Column, x: Column) -> Column:
        stay = (a["k"] >= 0) & (a["before"] + a["words"] >= F.col("rest"))
        return F.when(stay, a).otherwise(F.struct((a["before"] + a["words"]).alias("before"), *[x[c].alias(c) for c in ("k", "words", "n", "h", "u")]))

    got = grouped.withColumn("at", F.aggregate("buckets", start, add))
    low = {x: F.col(f"{x}_low") for x in ("h", "u")}
    low[name] = low[name] + F.shiftleft(F.col("at.k"), bit)
    # a bucket with one row is that row's own hash
    low = {x: F.when(F.col("at.n") == 1, F.col(f"at.{x}")).otherwise(c) for x, c in low.items()}
    return got.select("b_source", "rest", F.col("at.before").alias("before"), low["h"].alias("h_low"), low["u"].alias("u_low"), F.col("at.n").alias("n"))


def mix_sources(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST
) -> DataFrame:
    """Every document with its size, its source's size and target, and the words that the
    mix takes of it (``size`` times 0 to ``most``)."""
    rows = sized(docs, doc_id, text, source)
    aims = targets(rows, weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.try_divide(F.col("target"), F.col("source_size")))).otherwise(0).cast("long")
    aims = store(aims.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")
    cut = thresholds(rows, aims.where("rest > 0").select("source", "rest"))
    aims = aims.withColumnRenamed("source", "a_source").join(cut.drop("rest"), F.col("a_source").eqNullSafe(F.col("b_source")), "left")
    aims = store(aims.drop("b_source"), "mix-thresholds")
    met = rows.join(aims, F.col("source").eqNullSafe(F.col("a_source")))
    below = (F.col("h") < F.col("h_most")) | ((F.col("h") == F.col("h_most")) & (F.col("u") < F.col("u_most")))
    last = (F.col("h") == F.col("h_most")) & (F.col("u") == F.col("u_most")) & ((F.col("rest") - F.col("before")) * 2 >= F.col("size"))
    extra = F.when(F.coalesce(below | last, F.lit(False)), 1).otherwise(0)
    return met.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("whole") + extra)).alias("taken"))
