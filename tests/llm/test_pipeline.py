"""The pipeline against plain versions, stage by stage and as a whole, and clashing columns."""

from __future__ import annotations

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from regionlens.llm import bpe, decontamination, line_dedup, sharding, token_counts, url_filter, warc
from regionlens.llm.queries import tokenizer_path

RNG = random.Random(23)
CLASHES = ["kept", "clean_text", "n_boilerplate_words", "th", "n_dropped", "host", "k0", "_id", "_th", "rest_of_document", "d_doc", "w x"]


def body(n=90):
    return " ".join(f"v{RNG.randrange(5000)}" for _ in range(n))


def corpus():
    foot, long_line = " ".join(f"f{i}" for i in range(20)), "a line of well over forty characters, in six documents"
    rows = [(k, f"{body()}\n{foot}\nend {k}", "a") for k in range(30)]
    rows += [(100 + k, f"{body()}\n  {long_line.upper() if k % 2 else long_line}\n{body(5)}", "b") for k in range(6)]
    base = body(200)
    rows += [(200, base, "b"), (201, base + " tail", "c"), (202, base, None), (203, body(), "c")]
    rows += [(300, None, "a"), (301, "", "a"), (302, "too short", "b"), (303, "same words here " * 40, "b")]
    item = body(40)
    rows += [(400, f"{body()} {item} {body()}", "c"), (401, f"{body()} {item[:100]} {body()}", "c"), (402, body(3000), "a")]
    return rows, [(1, item), (2, "not in there at all"), (3, None)]


def expected(rows, items):
    out = brute.quality(rows)
    assert {d for d, _ in rows_of(rows)} - {d for d, _ in out} == {300, 301, 302, 303}
    out = [(d, t) for d, _, _, t in brute.line_dedup(out)]
    out = [(d, t) for (d, t), g in zip(out, brute.near_groups(out), strict=True) if g[3]]
    leaks = {d for d, *_ in brute.contaminated(out, items)}
    assert leaks == {400}
    return {d: t for d, t in out if d not in leaks}


def rows_of(rows):
    return [(d, t) for d, t, _ in rows]


def test_run_against_plain_versions(spark, tmp_path):
    from tokenizers import Tokenizer

    rows, items = corpus()
    docs = spark.createDataFrame([(d, t, "x", s, len(t or "")) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["doc_id"]: r for r in cp.run(spark, str(tmp_path)).collect()}
    want = expected(rows, items)
    assert set(got) == set(want) and 202 not in want and 201 not in want and 200 in want
    lib = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    for d, text in want.items():
        ids = lib.encode(text, add_special_tokens=False).ids
        assert bytes(got[d]["ids"]) == np.asarray(ids, "<u4").tobytes() and got[d]["decoded"] == lib.decode(ids, skip_special_tokens=False)


def test_stages_keep_all_columns(spark, tmp_path):
    rows, items = corpus()
    extra = [F.lit(k).alias(c) for k, c in enumerate(CLASHES)]
    docs = spark.createDataFrame([(d, t, s, len(t or "")) for d, t, s in rows], "doc_id long, text string, source string, n_chars int").select("*", *extra)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = brute.quality(rows)
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        got = out.collect()
        assert all(r[c] == k for r in got for k, c in enumerate(CLASHES))
        if name == "quality rules":
            assert {(r["doc_id"], r["text"]) for r in got} == set(want)
            assert all(r["n_chars"] == len(r["text"]) for r in got)
        if name == "line dedup":
            assert {(r["doc_id"], r["text"] or "") for r in got} == {(d, t) for d, _, _, t in brute.line_dedup(rows_of(rows))}
    assert {r["doc_id"] for r in cp.decontamination_stage(spark, docs, str(tmp_path)).collect()} == {d for d, *_ in rows} - {400}
    assert cp.bpe_stage(spark, docs, str(tmp_path)).count() == len(rows) and cp.bpe_stage(spark, docs.limit(0), "").count() == 0


def test_line_runs_hold_every_line_once(spark):
    lines = spark.createDataFrame([(d, RNG.randrange(40), 7) for d in range(300) for _ in range(3)], "doc_id long, h1 long, h2 long").distinct()
    runs = line_dedup.LineRuns(spark)
    try:
        seen, fresh = set(), []
        for k in range(5):
            batch = lines.where(F.col("doc_id") % 5 == k)
            new = {r["h1"] for r in runs.add(batch).collect()}
            assert new == {r["h1"] for r in batch.collect()} - seen
            seen |= new
            fresh.append(new)
        held = [r["h1"] for t in runs.runs("lines") for r in spark.table(t).collect()]
        assert sorted(held) == sorted(seen) and len(fresh[0]) > len(fresh[-1])
        want = {r["h1"]: (r["n"], r["m"]) for r in lines.groupBy("h1").agg(F.count("doc_id").alias("n"), F.max("doc_id").alias("m")).collect()}
        assert {r["h1"]: (r["n_docs"], r["max_doc"]) for r in runs.totals().collect()} == want
        made = list(runs.made)
        assert all("regionlens" in spark.sql(f"DESCRIBE FORMATTED {t}").where("col_name = 'Location'").first()["data_type"] for t in made)
    finally:
        runs.close()
    assert not [t.name for t in spark.catalog.listTables() if t.name in made]


def test_runs_go_when_a_step_fails(spark):
    before = {t.name for t in spark.catalog.listTables()}
    bad = spark.createDataFrame([(1, 1, 1)], "doc_id long, h1 long, h2 long").withColumn("h1", F.when(F.col("h2") == 1, F.raise_error(F.lit("no"))).otherwise(F.col("h1")).cast("long"))
    with pytest.raises(Exception, match="no"):
        line_dedup.line_totals(bad)
    assert {t.name for t in spark.catalog.listTables()} == before


def test_large_items_and_many_blocks(spark):
    words = [f"w{RNG.randrange(3000)}" for _ in range(3000)]
    part = lambda a, b: " ".join(words[a:b])
    items = [(1, part(0, 900)), (2, part(1000, 1040)), (3, part(1100, 1130)), (4, part(1200, 1900)), (5, "one two"), (4, part(1200, 1900))]
    rows = [(10, part(0, 3000)), (11, part(100, 900)), (12, part(200, 900)), (13, part(990, 1200)), (14, "one two"), (None, part(1150, 1950)), (10, part(0, 3000)), (15, None)]
    docs, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute.contaminated(rows, items), key=repr)
    assert len(want) > 10
    for block_bytes in (1 << 20, 400, 64):  # one block; many, with two items too large; three too large
        got = decontamination.contaminated(docs, table, block_bytes=block_bytes).drop("th")
        assert sorted(map(tuple, got.collect()), key=repr) == want


def test_archive_rows_come_from_rebuilt_records(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc"), (3, None, None), (4, "u", "d" * 100000)], "page_id long, url string, html string")
    path = str(tmp_path / "w")
    warc.write_archive(pages, path, min_shared=10)
    facts = {r["payload_bytes"] for r in warc.payload_facts(warc.read_records(spark, path)).collect()}
    assert facts == {0, 3, 100000}
    spark.read.parquet(f"{path}/payloads").withColumn("body", F.when(F.col("n") == 3, F.lit(b"abd")).otherwise(F.col("body"))).write.parquet(f"{path}/spoilt")
    spark.read.parquet(f"{path}/spoilt").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="doesn't fit"):
        warc.payload_facts(warc.read_records(spark, path)).collect()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("llm_warc")]


def test_near_links_of_a_whole_table(spark):
    """Recall measured: every component of the small documents table against all links that
    an inverted index of its shingles holds (no document is left out)."""
    from regionlens.llm.near_dedup import near_groups

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = {d: tuple(x) for d, *x in brute.near_groups([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_groups(docs).collect()}
    assert sum(not kept for _, _, kept in want.values()) > 20
    assert got == want


def test_bpe_letters_are_those_of_the_library():
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    coder, lib = bpe.WordBpe.from_json(open(path, "rb").read()), Tokenizer.from_file(path)
    # every code point that is a letter or a number to the pattern library, and some of all others
    every = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]
    letters = [c for c in every if coder.words.findall(f"a{c}") != ["a", c]]
    for texts in ([f"a{c}b?{c}?" for c in letters[:: 1 + len(letters) // 40000]], [f"a{c}?" for c in RNG.sample(every, 20000)], [f"a{chr(c)}?b" for a, b in (*bpe.NO_LETTERS, *bpe.NO_NUMBERS) for c in range(a, b + 1)]):
        got = [coder.document(t.encode())[1] for t in texts]
        lib_ids = (np.asarray(e.ids, "<u4").tobytes() for e in lib.encode_batch(texts, add_special_tokens=False))
        assert [t for t, g, e in zip(texts, got, lib_ids, strict=True) if g != e] == []


def test_control_pieces_are_ordinary_text(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    vocabulary = token_counts.unigram_vocabulary(path)
    counter = token_counts.CountViterbi(vocabulary)
    scores, unknown = dict(vocabulary), min(s for _, s in vocabulary) - 10

    def plain(text):
        text = "▁" + text.replace(" ", "▁")
        best = [(0.0, 0)] + [(float("-inf"), 0)] * len(text)
        for i in range(1, len(text) + 1):
            for j in range(max(0, i - 20), i):
                if text[j:i] in scores and best[j][0] + scores[text[j:i]] > best[i][0]:
                    best[i] = (best[j][0] + scores[text[j:i]], best[j][1] + 1)
            if text[i - 1] not in scores and best[i - 1][0] + unknown > best[i][0]:
                best[i] = (best[i - 1][0] + unknown, best[i - 1][1] + len(text[i - 1].encode()))
        return best[-1][1]

    pieces = ["<s>", "</s>", "<unk>", "<0x0A>", "a", "b ", "<", "s", ">", "中", "\x00", "▁", "x" * 30]
    texts = ["<s>", "a<s>b</s> <unk>", "<0x41>"] + ["".join(RNG.choice(pieces) for _ in range(RNG.randint(1, 12))) for _ in range(300)]
    assert [counter.count(t)[0] for t in texts] == [plain(t) for t in texts]
    assert token_counts.token_counts(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0


def test_shard_bytes_are_near_equal(spark):
    hot = "h" * 3000
    rows = [(i, hot if i < 20 else "x" * RNG.randrange(1, 400)) for i in range(1500)] + [(5000, "y" * 9000), (5001, None)]
    got = sharding.balanced_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), shards=8).collect()
    total = {}
    for r in got:
        total[r["shard"]] = total.get(r["shard"], 0) + r["size"]
    assert {r["law"] for r in got} == {"bytes"} and len(total) == 8 and sum(total.values()) == sum(len(t or "") + 16 for _, t in rows)
    group = 20 * (3000 + 16)  # the copies stay together, above an eighth of all
    mean = (sum(total.values()) - group) / 7
    rest = [n for s, n in total.items() if n < group]
    assert len(rest) == 7 or max(total.values()) - min(total.values()) <= 400
    assert max(rest) - min(rest) <= 0.01 * mean + 9016 * (9016 > mean)


def test_empty_pages(spark):
    pages, marks = spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert url_filter.url_verdicts(pages, marks).count() == 0
