"""Operator 5: quality rules with cross-document line frequency (native).

Base measures come from each text alone. The cross-document part hashes every
normalised line (outer white space stripped, inner runs made one space, lower
case), counts per host in how many different documents it stands, takes lines
above the limits as boilerplate, removes them, and rejects documents that lose
more than half of their words by it. Copies of one text count as one document, so
a group of copies doesn't make its own lines look like boilerplate.

Only DataFrame functions: one pass over the documents with arrays for the base
measures and line hashes, written with the texts. A line that a third of all
documents share is pre-aggregated map-side. The lines above the limits come back as
one list per host, which Spark broadcasts while it is small, and then no text is
shuffled; a host's list holds at most 1 / ``line_share`` times the mean number of
different lines in its documents. Only texts that hold such a line are split again.

Defined results: a null or blank text has no words (all counts 0, base_failed) and
stays as it is; base measures and base_failed are those of the text as it came; a
null host is a host like any other; repeated rows get the same row each; the empty
table gives the empty table; columns besides those named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionlens.llm.common import SPACES, store, text_hash

WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
REPEAT_PERCENT = 50
#: A line is boilerplate in more than this many documents of its host ...
LINE_MIN_DOCS = 20
#: ... and in more than this share of them.
LINE_SHARE = 0.1
#: A document is depleted if it loses more than this share of its words with the boilerplate.
DEPLETED_SHARE = 0.5


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, WORD_GAP), lambda w: w != "")


def by_hash(windows: Column) -> Column:
    """(h, i) of every window, equal hashes side by side, in order of position."""
    return F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def repeated_positions(ranked: Column) -> Column:
    """Ascending positions of the windows that occur at least twice; ``ranked`` is a column
    of ``by_hash`` (a column, not an expression: the lambda would evaluate that per element)."""
    at = F.transform(ranked, lambda x, k: F.when((x["h"] == F.get(ranked, k - 1)["h"]) | (x["h"] == F.get(ranked, k + 1)["h"]), x["i"]))
    return F.sort_array(F.filter(at, lambda p: p.isNotNull()))


def covered(positions: Column, width: int) -> Column:
    """Number of places that windows of ``width`` at ascending ``positions`` cover."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-width).alias("last"))
    return F.aggregate(
        positions,
        start,
        lambda a, p: F.struct((a["n"] + F.least(F.lit(width), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )


def is_line(x: Column) -> Column:
    return F.btrim(x, F.lit(SPACES)) != ""


def line_hash(x: Column) -> Column:
    """(h1, h2) of a line's normal form."""
    key = F.lower(F.regexp_replace(F.btrim(x, F.lit(SPACES)), WORD_GAP, " "))
    return F.struct(F.xxhash64(key).alias("h1"), F.hash(key).alias("h2"))


def frequent_lines(rows: DataFrame, min_docs: int, share: float) -> DataFrame:
    """(host, h1, h2, n_docs) of lines above both limits; ``rows`` from ``measures``."""
    by_host = rows.groupBy("host").agg(F.count_distinct("th").alias("host_docs")).withColumnRenamed("host", "its_host")
    lines = rows.select("host", "th", F.explode(F.array_distinct("lines")).alias("x"))
    counts = lines.groupBy("host", F.col("x.h1").alias("h1"), F.col("x.h2").alias("h2")).agg(F.count_distinct("th").alias("n_docs")).where(F.col("n_docs") > min_docs)
    return counts.join(by_host, F.col("host").eqNullSafe(F.col("its_host"))).where(F.col("n_docs") > share * F.col("host_docs")).select("host", "h1", "h2", "n_docs")


def measures(docs: DataFrame, doc_id: str, text: str, host: str, keep: dict[str, str]) -> DataFrame:
    """One row per document: base measures, its text, the hashes of its lines
    and the columns of ``keep`` by their new names."""
    d = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(host).cast("string").alias("host"),
        text_hash(text).alias("th"),
        F.col(text).cast("string").alias("text"),
        *[F.col(c).alias(n) for n, c in keep.items()],
    )
    d = d.withColumn("t", F.coalesce(F.col("text"), F.lit(""))).withColumn("w", words_of(F.col("t"))).withColumn("l", F.filter(F.split("t", "\n"), is_line))
    w = F.col("w")
    d = d.withColumn("n", F.size(w)).withColumn(
        "win",
        F.when(
            F.col("n") > 3,
            F.transform(F.sequence(F.lit(0), F.col("n") - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))),
        ),
    )
    d = d.withColumn("ranked", F.when(F.size(F.array_distinct("win")) < F.size("win"), by_hash(F.col("win"))))
    d = d.withColumn("at", F.when(F.col("ranked").isNotNull(), repeated_positions(F.col("ranked"))))
    return d.select(
        "doc_id",
        "host",
        "th",
        "text",
        F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.when(F.col("at").isNotNull(), covered(F.col("at"), 3)), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.transform("l", line_hash).alias("lines"),
        *keep,
    )


def without_lines(text: Column, bad: Column) -> Column:
    """``text`` without the lines whose hash is in ``bad``."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(bad, line_hash(x))), "\n")


def quality_rules(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    line_min_docs: int = LINE_MIN_DOCS,
    line_share: float = LINE_SHARE,
    depleted_share: float = DEPLETED_SHARE,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Measures, verdict and text left per document: doc_id, th (``text_hash``), n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words, n_boilerplate_words (words of the
    lines removed), base_failed, kept, clean_text, and the columns named in ``keep``."""
    names = [f"k{i}" for i in range(len(keep))]
    rows = store(measures(docs, doc_id, text, host, dict(zip(names, keep, strict=True))), "quality-measures", "zstd")
    bad = store(frequent_lines(rows, line_min_docs, line_share), "quality-lines")
    bad = bad.groupBy(F.col("host").alias("b_host")).agg(F.collect_list(F.struct("h1", "h2")).alias("bad"), F.collect_list("h1").alias("bad1"))
    d = rows.join(store(bad, "quality-hosts"), F.col("host").eqNullSafe(F.col("b_host")), "left")
    # by the first hash alone, in one pass over both lists; the whole hash decides per line
    d = d.withColumn("hit", F.coalesce(F.arrays_overlap(F.col("lines.h1"), F.col("bad1")), F.lit(False)))
    d = d.withColumn("clean_text", F.when(F.col("hit"), without_lines(F.col("text"), F.col("bad"))).otherwise(F.col("text")))
    d = d.withColumn("n_left", F.when(F.col("hit"), F.size(words_of(F.col("clean_text")))).otherwise(F.col("n_words")).cast("long"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    gone = F.col("n_words") - F.col("n_left")
    return d.select(
        "doc_id",
        "th",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        gone.alias("n_boilerplate_words"),
        failed.alias("base_failed"),
        (~failed & (gone <= depleted_share * F.col("n_words"))).alias("kept"),
        "clean_text",
        *[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)],
    )
