"""Operator 1: content-addressed WARC archive.

An archive is a folder of two Parquet tables. ``payloads`` holds each distinct
payload once, under its SHA-256 and length; ``headers`` holds one row per record
with the exact header bytes (WARC header and HTTP header) and the address of the
payload. Records are rebuilt by joining the two; where the archive is also in the
catalogue (``table``), both are bucketed by the address and meet without a shuffle. Records with equal payloads refer
to the one of the smallest page id (``revisit``, profile identical-payload-digest).

Equal addresses are taken as equal payloads; ``read_records`` digests every stored
payload again and raises if an address doesn't hold.

A payload that a third of all pages share is reduced map-side to one row per task,
in the choice of the response as in the payload table; the join back on the address
meets a written table, so that Spark can split the hot address.

Defined results: a null payload is empty; a null page id sorts last; rows equal in
page id and payload are separate records, of which one is the response; urls have
control characters and spaces escaped in the header; a null url has no target line;
columns besides those named are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regionlens.llm.common import store
from regionlens.session import shared_path

CRLF = "\r\n"
HEX32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Smaller payloads are stored with their own record and not shared by revisits.
MIN_SHARED = 0
#: The tables hold no fetch time; a fixed one keeps archives reproducible.
DATE = "1970-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1, as WARC digests are written."""
    digits = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digits, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), HEX32, BASE32)


def record_id(page_id: Column, uid: Column) -> Column:
    h = F.md5(F.concat_ws("/", F.coalesce(page_id.cast("string"), F.lit("")), uid.cast("string")))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def escaped(url: Column) -> Column:
    for code in (*range(0x21), 0x7F):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return url


def header(kind: Column) -> Column:
    """Exact header bytes of a record, up to its payload."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF * 2))
    block = F.length(http) + F.when(kind == "response", F.col("n")).otherwise(0)
    lines = F.concat_ws(
        CRLF,
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"), F.col("uid"))),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Source-Page: "), F.col("page_id").cast("string")),
        F.concat(F.lit("WARC-Target-URI: "), escaped(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(kind == "revisit", F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(kind == "revisit", F.concat(F.lit("WARC-Refers-To: "), record_id(F.col("first_page"), F.col("first_uid")))),
        F.when(kind == "revisit", F.concat(F.lit("WARC-Refers-To-Page: "), F.col("first_page").cast("string"))),
        F.concat(F.lit("Content-Type: application/http;msgtype=response")),
        F.concat(F.lit("Content-Length: "), block.cast("string")),
    )
    return F.concat(lines, F.lit(CRLF * 2), http).cast("binary")


def write_archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", payload: str = "html", min_shared: int = MIN_SHARED, table: str | None = None) -> None:
    """Write ``path``/payloads and ``path``/headers, a record per row of ``pages``; with
    ``table`` also as bucketed tables of that name and part."""
    spark = pages.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def save(df: DataFrame, part: str) -> None:
        if table is None:
            df.write.parquet(f"{path}/{part}")
        else:
            df.write.bucketBy(buckets, "sha256", "n").format("parquet").option("path", f"{path}/{part}").saveAsTable(f"{table}_{part}")

    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    src = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), body.alias("body"))
    src = src.withColumns({"sha256": F.unhex(F.sha2("body", 256)), "n": F.length("body").cast("long")})
    facts = store(src.select("page_id", "url", "sha256", "n", base32_sha1(F.col("body")).alias("sha1"), F.monotonically_increasing_id().alias("uid")), "warc-index")
    order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "uid")
    groups = facts.where(F.col("n") >= min_shared).groupBy("sha256", "n").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("copies"))
    shared = store(groups.where("copies > 1").select(F.col("sha256").alias("s"), F.col("n").alias("m"), F.col("first.page_id").alias("first_page"), F.col("first.uid").alias("first_uid")), "warc-shared")
    records = facts.join(shared, (facts["sha256"] == shared["s"]) & (facts["n"] == shared["m"]), "left")
    kind = F.when(F.col("first_uid").isNull() | (F.col("first_uid") == F.col("uid")), "response").otherwise("revisit")
    save(records.select("sha256", "n", header(kind).alias("header")), "headers")
    save(src.select("sha256", "n", "body").dropDuplicates(["sha256", "n"]), "payloads")


def part_of(spark: SparkSession, path: str, part: str, table: str | None) -> DataFrame:
    schema = f"sha256 binary, n long, {'header' if part == 'headers' else 'body'} binary"  # an empty archive has no files
    return spark.read.schema(schema).parquet(f"{path}/{part}") if table is None else spark.table(f"{table}_{part}")


def read_headers(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """Records with the fields parsed back from their exact header bytes."""
    h = part_of(spark, path, "headers", table).withColumn("lines", F.element_at(F.split(F.col("header").cast("string"), CRLF * 2, 2), 1))

    def value(name: str) -> Column:
        return F.nullif(F.regexp_extract("lines", rf"(?m)^{name}: (.*?)\r?$", 1), F.lit(""))

    return h.select(
        "sha256",
        "n",
        "header",
        value("WARC-Source-Page").cast("long").alias("page_id"),
        value("WARC-Type").alias("record_type"),
        value("WARC-Target-URI").alias("target_uri"),
        F.regexp_replace(value("WARC-Payload-Digest"), "^sha1:", "").alias("written_digest"),
        value("WARC-Refers-To-Page").cast("long").alias("refers_to"),
        value("Content-Length").cast("long").alias("content_length"),
    )


def checked_payloads(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """The payload table; a payload that doesn't fit its address raises."""
    p = part_of(spark, path, "payloads", table)
    holds = (F.unhex(F.sha2("body", 256)) == F.col("sha256")) & (F.length("body") == F.col("n"))
    return p.select("sha256", "n", F.when(holds, F.col("body")).otherwise(F.raise_error(F.lit("payload doesn't fit its digest")).cast("binary")).alias("body"))


def read_records(spark: SparkSession, path: str, table: str | None = None) -> DataFrame:
    """Original records: the fields of ``read_headers`` and the exact ``record`` bytes
    (header, payload of responses, and the two line ends that close a record)."""
    h = read_headers(spark, path, table)
    own = h.where("record_type = 'response'").join(checked_payloads(spark, path, table), ["sha256", "n"])
    end = F.lit(CRLF * 2).cast("binary")
    full = own.withColumn("record", F.concat("header", "body", end)).drop("body")
    return full.unionByName(h.where("record_type = 'revisit'").withColumn("record", F.concat("header", end)))


def payload_facts(records: DataFrame) -> DataFrame:
    """Length and WARC digest of every payload, taken from the bytes of a rebuilt response."""
    body = F.expr(f"substring(record, length(header) + 1, length(record) - length(header) - {2 * len(CRLF)})")
    own = records.where("record_type = 'response'").withColumn("body", body)
    facts = own.select("sha256", "n", F.length("body").cast("long").alias("payload_bytes"), base32_sha1(F.col("body")).alias("payload_digest"))
    return facts.dropDuplicates(["sha256", "n"])  # unshared payloads have several responses


def archive_report(pages: DataFrame) -> DataFrame:
    """Write the archive of ``pages`` and report every record as rebuilt from it:
    page_id, payload_bytes, payload_digest, record_type, refers_to. A revisit has the
    length and digest of the response's payload."""
    spark = pages.sparkSession
    path, table = shared_path(spark, "llm-warc"), f"llm_warc_{uuid.uuid4().hex}"
    try:
        write_archive(pages, path, table=table)
        facts = store(payload_facts(read_records(spark, path, table)), "warc-facts").withColumnsRenamed({"sha256": "s", "n": "m"})
    finally:
        for part in ("headers", "payloads"):
            spark.sql(f"DROP TABLE IF EXISTS {table}_{part}")
    h = read_headers(spark, path)
    return h.join(facts, (h["sha256"] == facts["s"]) & (h["n"] == facts["m"])).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
