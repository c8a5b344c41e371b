"""Operator 11: how filters interact, over all orders in which they can be applied.

Every document fails some of five filters; its failures are five bits. Filters A to D
look at the text alone, E at the whole table: a left-semi join on text hash, exact text
and smaller doc_id marks the documents whose text a smaller doc_id has. The ids that fail
E are united with those that fail the others, one row a failure, and added up to a bit
combination per document. Documents are counted by part and combination, and from the at
most 32 counts of a part every order of the filters follows: a document is removed by the
first of its failing filters.

The copies' texts meet their like only: hashes (8 bytes a document) are counted first,
and the semi join takes the documents whose hash recurs. Its right side holds one row per
text, the smallest doc_id that has it, found map-side first, so a group of copies that a
third of all rows belong to meets one row, and no pairs arise. Nothing is collected; the
tables broadcast at the end (combinations by case, orders by step) have a fixed size.

Defined results: a null text is empty, and equals an empty one; a null part is the part
"" (with a part of that name, the same); a null doc_id is neither smaller nor larger than
any, so it fails E never and makes none fail; repeated rows count one by one, and rows
with one doc_id are not copies of each other; several labels of a doc_id count as its
best quality and its worst toxicity; the empty table has no parts, so no rows; columns
besides those named are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionlens.llm.common import store

WORD_GAP = r"[\x20\x09-\x0D]+"
FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITAL_PERCENT = 2
MARKS = r"[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COMBINATIONS = 1 << len(FILTERS)


def bit(name: str) -> int:
    return 1 << FILTERS.index(name)


def own_failures(text: Column) -> Column:
    """Bits of the filters that a (non-null) text fails by itself."""
    words = F.filter(F.split(text, WORD_GAP), lambda w: w != "")
    failed = {
        "A": F.size(words) < MIN_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < MIN_DISTINCT_PERCENT * F.size(words),
        "C": 100 * (F.length(text) - F.length(F.translate(text, CAPITALS, ""))) > MAX_CAPITAL_PERCENT * F.length(text),
        "D": text.rlike(MARKS),
    }
    total = F.lit(0)
    for name, condition in failed.items():
        total = total + F.when(condition, bit(name)).otherwise(0)
    return total


def later_copies(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, part, h) of the rows of ``docs`` (doc_id, part, h, t) whose text a smaller doc_id
    has; ``ids`` are its written (doc_id, part, h)."""
    again = store(ids.groupBy("h").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select(F.col("h").alias("again_h")), "audit-hashes")
    likely = docs.where("doc_id is not null").join(again, F.col("h") == F.col("again_h"), "left_semi")
    # written, so that Spark broadcasts it while it is small, and else splits the hot texts on the left of the join
    first = store(likely.groupBy(F.col("h").alias("first_h"), F.col("t").alias("first_t")).agg(F.min("doc_id").alias("first_id")), "audit-first")
    smaller = (F.col("h") == F.col("first_h")) & (F.col("t") == F.col("first_t")) & (F.col("first_id") < F.col("doc_id"))
    return likely.join(first, smaller, "left_semi").select("doc_id", "part", "h")


def failure_bits(docs: DataFrame, doc_id: str, text: str, part: str) -> DataFrame:
    """(doc_id, part, bits, n): the documents' failures; rows alike in doc_id, part and text are one row with their number ``n``."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    d = d.withColumn("h", F.xxhash64("t"))
    own = store(d.select("doc_id", "part", "h", own_failures(F.col("t")).alias("bits")), "audit-own")
    copies = later_copies(d, own.select("doc_id", "part", "h"))
    # one row a failing filter, and one row for each document itself
    each = F.array([F.struct(F.when(F.col("bits").bitwiseAND(F.lit(bit(x))) > 0, bit(x)).alias("bits"), F.lit(0).cast("long").alias("n")) for x in FILTERS[:-1]])
    each = F.concat(F.array(F.struct(F.lit(0).alias("bits"), F.lit(1).cast("long").alias("n"))), F.filter(each, lambda x: x["bits"].isNotNull()))
    failures = own.select("doc_id", "part", "h", F.inline(each))
    failures = failures.unionByName(copies.withColumns({"bits": F.lit(bit("E")), "n": F.lit(0).cast("long")}))
    return failures.groupBy("doc_id", "part", "h").agg(F.bit_or("bits").alias("bits"), F.sum("n").alias("n")).drop("h")


def combination_counts(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, bits, n, good, toxic): documents by combination of failures, and how many of
    them are labelled good or toxic."""
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("label_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    met = failure_bits(docs, doc_id, text, part).join(marks, F.col("doc_id") == F.col("label_id"), "left")
    return met.groupBy("part", "bits").agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")])


def steps() -> list[tuple[str, int, int, int]]:
    """(order, step, bit of its filter, bits of the filters before it) of all orders."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for k, name in enumerate(order):
            out.append(("".join(order), k + 1, bit(name), before))
            before |= bit(name)
    return out


def roles() -> list[tuple[int, int, int, int, int, int, int, int]]:
    """(combination, filter's bit, bits of the filters before it, and whether its documents are
    then kept, removed, redundant, fail this filter only; their part in its Shapley sum)."""
    orders = sum(1 for _ in permutations(FILTERS))
    out = []
    for b in range(COMBINATIONS):
        for x in (bit(name) for name in FILTERS):
            for before in range(COMBINATIONS):
                if not before & x:
                    fails, gone = bool(b & x), bool(b & before)
                    out.append((b, x, before, int(not fails and not gone), int(fails and not gone), int(fails and gone), int(b == x), orders // b.bit_count() if fails else 0))
    return out


def audit(counts: DataFrame) -> DataFrame:
    """One row per part, filter order and step, from ``combination_counts``: every
    combination plays its role in the 5 * 16 cases of a filter after a set of others, and the
    orders' steps look their case up."""
    spark = counts.sparkSession
    names = ("kept", "removed", "redundant", "unique_fails", "shapley")
    role = spark.createDataFrame(roles(), "role_bits int, x int, before int, " + ", ".join(f"is_{c} long" for c in names))
    met = counts.join(F.broadcast(role), F.col("bits") == F.col("role_bits"))
    sums = [F.sum(F.col("n") * F.col(f"is_{c}")).alias(c) for c in names]
    sums += [F.sum(F.col(c) * F.col("is_removed")).alias(f"{c}_lost") for c in ("good", "toxic")]
    cases = met.groupBy("part", "x", "before").agg(*sums)
    plan = spark.createDataFrame(steps(), "filter_order string, step int, plan_x int, plan_before int")
    done = cases.join(F.broadcast(plan), (F.col("x") == F.col("plan_x")) & (F.col("before") == F.col("plan_before")))
    return done.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit_filters(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """What each of the filters keeps and removes in every order, by part."""
    return audit(store(combination_counts(docs, labels, doc_id, text, part), "audit-counts"))
