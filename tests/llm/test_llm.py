"""The operators against plain versions and the public tokenizer libraries, on small inputs."""

from __future__ import annotations

import hashlib
import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from regionlens.llm import bpe, decontamination, line_dedup, near_dedup, quality_rules, sharding, suffix_dedup, token_counts, url_filter, warc
from regionlens.llm.queries import tokenizer_path

RNG = random.Random(7)
WORDS = [f"w{i}" for i in range(400)]
BASE = " ".join(RNG.choice(WORDS) for _ in range(120))
LINE = "A line that is certainly longer than forty characters"
TEXTS = [None, "", " \n\t", "one two", BASE, BASE, BASE.replace("w1", "W1"), BASE + " tail", "x" * 5000, "x" * 450, f"{LINE}\nown\n {LINE.upper()} ", "é\x1fb ŋ 日本\n" * 40, BASE[100:420]]
TEXTS += [f"{LINE}\ndocument {k}" for k in range(6)]
ROWS = list(enumerate(TEXTS)) + [(None, BASE[:300]), (5, BASE)]
SCHEMA = "doc_id long, text string, h long, c string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, 1, "clash", "s") for d, t in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("hot", [1, 2, 1000])
def test_substrings(docs, none, hot):
    got = suffix_dedup.dedup_substrings(docs, hot_contexts=hot).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
    want = [(d, *x) for (d, _), x in zip(ROWS, brute.substrings([t for _, t in ROWS], 200), strict=True)]
    assert rows(got) == sorted(want, key=repr)
    assert suffix_dedup.dedup_substrings(none).count() == 0


def test_suffix_order():
    for _ in range(100):
        t = bytes(RNG.choice(b"aab") for _ in range(RNG.randint(1, 200)))
        wanted = np.array([RNG.random() < 0.5 for _ in t])
        got = suffix_dedup.suffix_order(t, 1000, wanted).tolist()
        assert set(np.flatnonzero(wanted)) <= set(got) and got == sorted(got, key=lambda i: t[i:])


def test_near(docs, none):
    plain = [(d, t) for d, t in ROWS[: len(TEXTS)]]
    want = {d: x for d, *x in brute.near_groups(plain)}
    got = near_dedup.near_groups(docs).where("doc_id is not null").drop("th").collect()
    assert all(list(r)[1:] == want[r["doc_id"]] for r in got) and len(got) == len(ROWS) - 1
    assert near_dedup.near_groups(none).count() == 0


def test_lines(docs, none):
    got = line_dedup.dedup_lines(docs).withColumn("clean_text", F.coalesce("clean_text", F.lit("")))
    assert rows(got) == sorted(brute.line_dedup(ROWS), key=repr)
    assert line_dedup.dedup_lines(none).count() == 0


def test_decontamination(spark, docs, none):
    items = [(1, BASE[50:200]), (2, "one two"), (3, None), (4, "not there at all here"), (5, BASE[50:200])]
    table = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute.contaminated(ROWS, items), key=repr)
    assert rows(decontamination.contaminated(docs, table).drop("th")) == want
    assert rows(decontamination.contaminated(docs, table, block_bytes=8).drop("th")) == want
    assert decontamination.contaminated(none, table).count() == 0
    assert decontamination.contaminated(docs, table.limit(0)).count() == 0


def test_bpe(docs):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    want = []
    for d, t in ROWS:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), bytearray(np.asarray(ids, "<u4").tobytes()), lib.decode(ids, skip_special_tokens=False)))
    assert rows(bpe.encode_decode(docs, path)) == sorted(want, key=repr)
    coder = bpe.WordBpe.from_json(open(path, "rb").read())
    for text in ("a<|endoftext|>B<|END", "Σας ΟΔΟΣ İ ẞ ﬁ", "'S it'LL\x1c½Ⅻ"):
        ids = lib.encode(text, add_special_tokens=False).ids
        assert coder.document(text.encode())[1] == np.asarray(ids, "<u4").tobytes()


def test_token_counts(docs):
    import sentencepiece
    from tokenizers import Tokenizer, models

    path = tokenizer_path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    lib = Tokenizer(models.Unigram([(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())], unk_id=0, byte_fallback=True))
    got = {(r["doc_id"], r["n_tokens"]) for r in token_counts.token_counts(docs, path).collect()}
    assert got == {(d, len(lib.encode("▁" + t.replace(" ", "▁")).tokens) if t else 0) for d, t in ROWS}


def test_shards(docs, none):
    got = sharding.balanced_shards(docs, shards=4, cell_groups=5, cell_partitions=2).collect()
    assert len(got) == len(ROWS) and sharding.balanced_shards(none).count() == 0
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r["shard"] for r in got if r["doc_id"] in (4, 5)}) == 1


def test_archive(spark, tmp_path):
    pages = [(3, "http://a b\r\n", "same"), (1, None, "same"), (1, "u", "same"), (None, "v", "same"), (7, "w", None), (8, "x", "\r\n\r\ntail")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = warc.archive_report(df).collect()
    assert sorted((r["record_type"], r["page_id"] or 0, r["refers_to"]) for r in got if r["payload_bytes"] == 4) == [("response", 1, None), ("revisit", 0, 1), ("revisit", 1, 1), ("revisit", 3, 1)]
    path = str(tmp_path / "w")
    warc.write_archive(df, path)
    whole = [bytes(r["record"]) for r in warc.read_records(spark, path).collect()]
    assert len(whole) == 6 and sum(w.endswith(b"\r\n\r\n\r\n\r\ntail\r\n\r\n") for w in whole) == 1
    assert warc.archive_report(df.limit(0)).count() == 0


def test_urls(spark):
    pages = [(1, "http://A.Example.ORG/es/x?q"), (2, None), (3, "nohost"), (4, "ftp://x.com/de/1#t"), (5, "http://bad.net/a"), (6, "http://example.org/en/12")]
    p = spark.createDataFrame(pages, "page_id long, url string")
    marks = spark.createDataFrame([(5, 0, 1), (4, 1, 0), (None, 0, 0), (6, None, None)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_verdicts(p, marks).collect()}
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", "block") and got[2] == got[3] == ("", "", None, "allow")
    assert got[4][2:] == ("com/de/", "block") and got[6][2:] == ("example.org/en/1", "block")


@pytest.mark.parametrize("times", [1, 40])
def test_urls_are_judged_against_the_base_share(spark, times):
    # ten hosts at or below the base share, one bad throughout, at few and at many labels
    counts = {f"h{k}.d{k % 3}.net": (20 * times, (2 + k % 4) * times) for k in range(10)} | {"spam.d0.net": (20 * times, 20 * times)}
    pages = [(f"http://{h}/x", int(i < b)) for h, (n, b) in counts.items() for i in range(n)]
    p = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(pages)], "page_id long, url string")
    marks = spark.createDataFrame([(i, None, b) for i, (_, b) in enumerate(pages)], "doc_id long, quality int, toxic int")
    got = {(r["host"], r["verdict"]) for r in url_filter.url_verdicts(p, marks).collect()}
    assert got == {(h, "block" if h == "spam.d0.net" else "allow") for h in counts}


def test_unlabelled_hosts_are_judged_by_their_prior(spark):
    counts = {f"h{k}.bad.net": (40, 38) for k in range(4)} | {f"h{k}.good.org": (40, 2) for k in range(12)}
    pages = [(f"http://{h}/x", int(i < b)) for h, (n, b) in counts.items() for i in range(n)]
    marks = spark.createDataFrame([(i, None, b) for i, (_, b) in enumerate(pages)], "doc_id long, quality int, toxic int")
    pages += [(f"http://{h}/x", None) for h in ("new.bad.net", "new.good.org", "new.other.org", "new.other.info")]
    p = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(pages)], "page_id long, url string")
    found = url_filter.url_verdicts(p, marks).where("n_labelled = 0").collect()
    assert {r["host"]: r["verdict"] for r in found} == {"new.bad.net": "block", "new.good.org": "allow", "new.other.org": "allow", "new.other.info": "allow"}
    assert all(r["bad_lower"] is not None for r in found)
    assert {r["verdict"] for r in url_filter.url_verdicts(p, marks.limit(0)).collect()} == {"allow"}


def test_urls_without_spread_stay_allowed(spark):
    # hosts that don't differ: the prior's weight is at its most, and a base share above 0.2 blocks nobody
    pages = [(f"http://h{k}.d{k % 3}.net/x", int(i % 10 < 3)) for k in range(12) for i in range(200)]
    p = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(pages)], "page_id long, url string")
    marks = spark.createDataFrame([(i, None, b) for i, (_, b) in enumerate(pages)], "doc_id long, quality int, toxic int")
    assert {r["verdict"] for r in url_filter.url_verdicts(p, marks).collect()} == {"allow"}


def test_quality(docs, none):
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(docs, host="source").collect()}
    assert got[0]["n_words"] == 0 and got[0]["base_failed"] and got[10]["n_dup_lines"] == 0
    assert got[4]["n_words"] == 120 and quality_rules.quality_rules(none).count() == 0
    assert got[11]["n_repeat_words"] == got[11]["n_words"] > 0


def test_quality_removes_frequent_lines(spark):
    import corpus_pipeline as cp

    body = lambda k: " ".join(f"v{k}x{i}" for i in range(60))
    # host a: a footer in 25 documents, once with most of the words; host b: the same line twice only
    own = {k: f"{body(k)}\n\n{body(k)[::-1]}" for k in range(25)}
    foot = " ".join(f"f{i}" for i in range(70))
    texts = [(k, f"{t}\n {foot.upper()}\t\nend {k}\n", "a") for k, t in own.items()]
    texts += [(25, f"{body(25)}\n{foot}", "a"), (26, None, "a"), (27, f"{foot}\n{body(27)}", "b"), (28, f"{foot}\n{body(28)}", None)]
    df = spark.createDataFrame([(d, t, "x", h, len(t or "")) for d, t, h in texts], "doc_id long, text string, host string, source string, n_chars int")
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(df).collect()}
    left = {k: f"{t}\nend {k}\n" for k, t in own.items()} | {25: body(25), 26: None, 27: texts[27][1], 28: texts[28][1]}
    assert {d: r["clean_text"] for d, r in got.items()} == left
    assert {d: r["n_boilerplate_words"] for d, r in got.items()} == {d: 70 if d < 26 else 0 for d in left}
    assert [d for d, r in sorted(got.items()) if not r["kept"]] == [25, 26] and got[25]["base_failed"] is False
    staged = cp.quality_stage(spark, df, "")
    assert staged.columns == df.columns
    assert rows(staged) == sorted([(d, left[d], "x", h, len(left[d])) for d, _, h in texts if d not in (25, 26)], key=repr)


def test_pipeline_keeps_one_of_each_group(spark, docs):
    import corpus_pipeline as cp

    left = cp.near_stage(spark, docs, "")
    assert left.columns == docs.columns
    ids = {r["doc_id"] for r in left.collect()}
    assert 4 in ids and 5 not in ids
    assert hashlib.sha256(b"").hexdigest() == brute.sha(b"")
