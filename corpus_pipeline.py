"""The corpus pipeline: STAGES applied one after another to ``documents``.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before kept, and
returns a DataFrame that is written and read again as the next stage's docs. The
stages before the last return the columns of ``documents``:

1. quality rules: rejected documents go, the others lose their host's boilerplate lines;
2. line dedup: texts lose their repeated lines, all documents stay;
3. MinHash near-dedup: one document of each group stays (all rows of its doc_id);
4. benchmark decontamination: documents that contain a test item go;
5. BPE encoding and decoding of what is left.

A document's columns other than text pass unchanged, whatever their names; ``n_chars`` is
set to the new length where the first or second stage changed a text. An empty table
passes every stage as an empty table; null and empty texts fail the quality rules; rows
of one doc_id and text are kept or dropped together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regionlens.llm import queries
from regionlens.llm.bpe import encode_decode
from regionlens.llm.common import prepared, without
from regionlens.llm.decontamination import contaminated
from regionlens.llm.line_dedup import dedup_lines
from regionlens.llm.near_dedup import near_groups
from regionlens.llm.quality_rules import quality_rules
from regionlens.session import shared_path
from regionlens.sources.tables import load


#: Holds a document's other columns on their way through an operator, whatever their names.
REST = "rest_of_document"


def packed(docs: DataFrame, *also: str) -> DataFrame:
    """doc_id, text, the columns ``also`` and all columns of ``docs`` but the text in one struct."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    return docs.select("doc_id", "text", *also, rest.alias(REST))


def rewritten(found: DataFrame, docs: DataFrame, changed: Column) -> DataFrame:
    """The columns of ``docs`` from ``found`` (``clean_text`` and the packed others)."""
    cols = {c: F.col(f"{REST}.`{c}`") for c in docs.columns if c != "text"} | {"text": F.col("clean_text")}
    if "n_chars" in docs.columns:
        cols["n_chars"] = F.when(changed, F.length("clean_text").cast(docs.schema["n_chars"].dataType)).otherwise(cols["n_chars"])
    return found.select([cols[c].alias(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    found = quality_rules(packed(docs, "source"), keep=(REST,)).where("kept")
    return rewritten(found, docs, F.col("n_boilerplate_words") > 0)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return rewritten(dedup_lines(packed(docs), keep=(REST,)), docs, F.col("n_dropped") > 0)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    return without(docs, near_groups(docs).where("not kept").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepared(spark)
    found = contaminated(docs, load(spark, sf_dir, "benchmark"))
    return without(docs, found.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_decode(docs, queries.tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: BPE merges can't be said in SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; every stage's result is written and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
