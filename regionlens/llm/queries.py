"""Registered queries of this subpackage: the numbered operators on whole tables, and
their DuckDB SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionlens.llm.bpe import encode_decode
from regionlens.llm.decontamination import contaminated
from regionlens.llm.filter_audit import audit_filters
from regionlens.llm.line_dedup import dedup_lines
from regionlens.llm.near_dedup import near_groups
from regionlens.llm.periodic_runs import periodic_runs, planted, run_digest
from regionlens.llm.quality_rules import quality_rules
from regionlens.llm.sharding import balanced_shards
from regionlens.llm.source_mix import mix_sources
from regionlens.llm.suffix_dedup import dedup_substrings
from regionlens.llm.token_counts import token_counts
from regionlens.llm.url_filter import MARGIN, url_verdicts
from regionlens.llm.warc import archive_report
from regionlens.sources.tables import load


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_report(load(spark, sf_dir, "pages"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(load(spark, sf_dir, "documents")).drop("th")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_verdicts(load(spark, sf_dir, "pages"), load(spark, sf_dir, "labels"))
    return found.select("page_id", "host", "path", "rule", "verdict")


def op4_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``op4_url_filter`` with what it judges by."""
    found = url_verdicts(load(spark, sf_dir, "pages"), load(spark, sf_dir, "labels"))
    return found.select("page_id", "host", "path", "rule", "verdict", "n_labelled", "bad_lower")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(load(spark, sf_dir, "documents"))
    return found.drop("th", "clean_text")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(load(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("clean_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced_shards(load(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).drop("th")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_decode(load(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(load(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digest(periodic_runs(load(spark, sf_dir, "documents"), rewrite=planted))


QUERIES = {
    f.__name__: f
    for f in (
        op1_warc, op2_suffix_dedup, op3_near_dedup, op4_url_filter, op4_url_reputation, op5_quality_rules, op6_token_counts, op7_line_dedup,
        op8_sharding, op9_decontamination, op10_bpe, op11_filter_audit, op12_source_mix, op13_periodic_runs,
    )
}

#: Words of a text: maximal runs of anything but space and \\x09-\\x0D.
_WORDS = "list_filter(regexp_split_to_array(coalesce({t}, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')"
_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL = {
    "op1_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, row_number() OVER () AS r FROM pages),
d AS (SELECT page_id, r, octet_length(body) AS payload_bytes, sha1(body) AS h, sha256(body) AS k FROM p),
b AS (SELECT *, first_value(page_id) OVER w AS first_page, first_value(r) OVER w AS first_r FROM d WINDOW w AS (PARTITION BY k, payload_bytes ORDER BY page_id NULLS LAST, r))
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT) >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN r = first_r THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN r = first_r THEN NULL ELSE first_page END AS refers_to FROM b""",
    "op5_quality_rules": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, md5(coalesce(text, '')) || (text IS NULL) AS th, {_WORDS.format(t="text")} AS w FROM documents),
win AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM d WHERE len(w) >= 3),
tri AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM win),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM tri) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY r),
lines AS (SELECT r, source, th, l FROM (SELECT r, source, th, unnest(string_split(t, chr(10))) AS l FROM d) WHERE trim(l, {_SPACES}) <> ''),
norm AS (SELECT r, source, th, l, lower(regexp_replace(trim(l, {_SPACES}), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS k FROM lines),
hosts AS (SELECT source, count(DISTINCT th) AS hd FROM d GROUP BY source),
often AS (SELECT n.source, k FROM norm n JOIN hosts h ON n.source IS NOT DISTINCT FROM h.source GROUP BY n.source, k, hd
  HAVING count(DISTINCT th) > 20 AND count(DISTINCT th) > 0.1 * hd),
lost AS (SELECT r, sum(len(string_split(n.k, ' '))) AS lost FROM norm n JOIN often o ON n.source IS NOT DISTINCT FROM o.source AND n.k = o.k GROUP BY r),
dl AS (SELECT r, count(*) - count(DISTINCT l) AS n FROM lines GROUP BY r),
m AS (SELECT d.r, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  coalesce(dl.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS n_boilerplate_words
  FROM d LEFT JOIN cov ON d.r = cov.r LEFT JOIN dl ON d.r = dl.r LEFT JOIN lost ON d.r = lost.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_boilerplate_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_boilerplate_words <= 0.5 * n_words AS kept FROM m""",
    "op7_line_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS line FROM d),
k AS (SELECT *, translate(trim(line, {_SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, max(coalesce(doc_id, -9223372036854775808)) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT coalesce(doc_id, -9223372036854775808)) >= 5),
m AS (SELECT r, doc_id, i, line, o.key IS NOT NULL AND coalesce(doc_id, -9223372036854775808) <> last AS gone FROM k LEFT JOIN o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM m GROUP BY r, doc_id""",
    "op9_decontamination": """
WITH w AS (SELECT 'd' AS kind, doc_id AS id, row_number() OVER () AS r, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM documents
 UNION ALL SELECT 'i', item_id, row_number() OVER (), list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') FROM benchmark),
s AS (SELECT DISTINCT kind, id, r, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT r, count(*) AS n FROM s WHERE kind = 'i' GROUP BY r)
SELECT d.id AS doc_id, i.id AS item_id, any_value(n.n)::BIGINT AS n_item, count(*)::BIGINT AS n_shared
FROM s i JOIN s d ON i.s = d.s AND i.kind = 'i' AND d.kind = 'd' JOIN n ON n.r = i.r
GROUP BY d.id, d.r, i.id, i.r HAVING 100 * count(*) >= 80 * any_value(n.n)""",
}

ORACLE_SQL["op11_filter_audit"] = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_WORDS.format(t="text")} AS w FROM documents),
first AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT d.part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
  || (CASE WHEN 100 * (length(d.t) - length(regexp_replace(d.t, '[A-Z]', '', 'g'))) > 2 * length(d.t) THEN 'C' ELSE '' END)
  || (CASE WHEN regexp_matches(d.t, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN coalesce(d.doc_id > least, false) THEN 'E' ELSE '' END) AS fails
  FROM d JOIN first ON d.t = first.t LEFT JOIN marks ON d.doc_id = marks.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
o AS (SELECT '' AS filter_order UNION ALL SELECT filter_order || x FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) AS v(x) WHERE strpos(filter_order, x) = 0 AND length(filter_order) < 5),
s AS (SELECT filter_order, k AS step, substr(filter_order, k, 1) AS x, left(filter_order, k - 1) AS before FROM o, (SELECT unnest(range(1, 6))::INT AS k) WHERE length(filter_order) = 5),
m AS (SELECT part, filter_order, step, x, n, good, toxic, fails, strpos(fails, x) > 0 AS bad, translate(fails, before, '') <> fails AS gone FROM c, s)
SELECT part, filter_order, step, coalesce(sum(n) FILTER (WHERE NOT bad AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE bad AND NOT gone), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (WHERE bad AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE fails = x), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (WHERE bad AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE bad AND NOT gone), 0)::BIGINT AS toxic_lost,
  coalesce(sum(sum(n) FILTER (WHERE bad AND NOT gone)) OVER (PARTITION BY part, x), 0)::BIGINT AS shapley
FROM m GROUP BY part, filter_order, step, x"""

_PART = "coalesce(length({0}) || ':' || {0}, '-')"
ORACLE_SQL["op12_source_mix"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, len({_WORDS.format(t="text")})::BIGINT AS size,
  ('0x' || substr(md5({_PART.format("doc_id::VARCHAR")} || {_PART.format("source")} || {_PART.format("md5(text)")}), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level, source_size / w AS ratio FROM s),
u AS (SELECT arg_min(level, ratio) AS level FROM l WHERE w * level <= 2 * source_size),
t AS (SELECT source, source_size, least((2 * source_size)::DOUBLE, w * coalesce((SELECT level FROM u), 0)) AS target FROM s),
k AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
c AS (SELECT d.*, source_size, target, whole, target - whole * source_size AS rest, sum(size) OVER (PARTITION BY d.source ORDER BY h, r) AS upto
  FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN rest > 0 AND upto - size < rest AND (rest - (upto - size)) * 2 >= size THEN 1 ELSE 0 END))::BIGINT AS taken FROM c"""

_URL = """
WITH raw AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM raw),
marks AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL OR toxic IS NOT NULL THEN 0 END) AS bad FROM labels GROUP BY doc_id),
h AS (SELECT host, string_split(host, '.')[-1] AS suffix, array_to_string(string_split(host, '.')[-2:], '.') AS domain, count(*) AS n, sum(bad)::DOUBLE AS bad
  FROM p JOIN marks ON page_id = doc_id WHERE host <> '' AND bad IS NOT NULL GROUP BY host),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY domain, suffix),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY suffix),
t AS (SELECT sum(bad) / sum(n) AS p0 FROM h),
{weights},
ps AS (SELECT suffix, (bad + ws * p0) / (n + ws) AS ps FROM s, ws, t),
pd AS (SELECT domain, (bad + wd * ps) / (n + wd) AS pd FROM d JOIN ps USING (suffix), wd),
seen AS (SELECT host, string_split(host, '.')[-1] AS suffix, array_to_string(string_split(host, '.')[-2:], '.') AS domain, coalesce(n, 0) AS n, coalesce(bad, 0) AS bad
  FROM (SELECT DISTINCT host FROM p WHERE host <> '') LEFT JOIN (SELECT host, n, bad FROM h) USING (host)),
pr AS (SELECT host, n, bad, coalesce(pd, ps, p0) AS prior FROM seen LEFT JOIN pd USING (domain) LEFT JOIN ps USING (suffix), t),
ab AS (SELECT host, bad + wh * prior AS a, n - bad + wh * (1 - prior) AS b FROM pr, wh),
rep AS (SELECT host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) - p0 AS above FROM ab, t),
rules(kind, rule, rh, rp) AS (VALUES {rules}),
fit AS (SELECT page_id, p.host, path, kind, rule, row_number() OVER (PARTITION BY p.rn ORDER BY length(rule) DESC NULLS LAST) AS k
  FROM (SELECT *, row_number() OVER () AS rn FROM p) p LEFT JOIN rules ON (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, fit.host, path, rule, coalesce(kind, CASE WHEN above > {margin} THEN 'block' ELSE 'allow' END) AS verdict FROM fit LEFT JOIN rep ON fit.host = rep.host WHERE k = 1"""


def _weights() -> str:
    made = []
    for name, table in (("ws", "s"), ("wd", "d"), ("wh", "h")):
        made.append(
            f"""{name} AS (SELECT CASE WHEN icc > 0 THEN greatest(1.0, least(1000.0, 1 / icc - 1)) ELSE 1000.0 END AS {name} FROM (
  SELECT (e - s * p * p - (k - 1) * p * (1 - p)) / nullif(p * (1 - p) * (s - q / s - (k - 1)), 0) AS icc FROM (
  SELECT sum(n)::DOUBLE AS s, sum(bad) / sum(n) AS p, sum(n * n)::DOUBLE AS q, count(*) AS k, sum(bad * bad / n) AS e FROM {table})))"""
        )
    return ",\n".join(made)


def _rules() -> str:
    from regionlens.llm.url_filter import RULES

    rows = []
    for kind, rule in RULES:
        host, _, rest = rule.partition("/")
        rows.append(f"('{kind}', '{rule}', '{host}', '/{rest}')")
    return ", ".join(rows)


ORACLE_SQL["op4_url_filter"] = _URL.format(weights=_weights(), rules=_rules(), margin=MARGIN)
ORACLE_SQL["op4_url_reputation"] = ORACLE_SQL["op4_url_filter"].replace(
    "SELECT page_id, fit.host, path, rule,", "SELECT page_id, fit.host, path, rule, coalesce(rep.n, 0)::BIGINT AS n_labelled, rep.lower AS bad_lower,"
).replace("- p0 AS above FROM ab, t", "- p0 AS above, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS lower, n FROM ab, t").replace("AS b FROM pr, wh", "AS b, n FROM pr, wh")
