"""The missing key's part in joins, one run for a map layer, splits of exact size, boundary lines."""

import json
import math

import numpy as np
from pyspark.sql import functions as F

from regionlens.operators import aggregates, features, growth, joins
from regionlens.plans.registry import supplier_panel
from regionlens.session import shared_path
from regionlens.sources import files, standins
from regionlens.sources.tables import load


def _panel_inputs(spark):
    rng = np.random.default_rng(3)
    keys = ["00000" if i % 3 == 0 else f"{rng.integers(1, 400):05d}" for i in range(6000)]
    rates = spark.createDataFrame([(k, f"c{i}", float(i)) for i, k in enumerate(keys)], "FIPS string, County string, Cases double").repartition(5)
    one = spark.createDataFrame([(f"{k:05d}", float(k)) for k in range(400)] + [("00000", -1.0)], "FIPS string, A double")
    two = spark.createDataFrame([(f"{k:05d}", -float(k)) for k in range(0, 400, 2)], "FIPS string, B double")
    return rates, one, two


def test_missing_key_is_dealt_over_parts(spark):
    rates, one, two = _panel_inputs(spark)
    want = rates.join(one.join(two, "FIPS"), "FIPS").collect()
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "16")
        got = joins.panel(rates, [one, two])
        assert "SortMergeJoin" in got._jdf.queryExecution().executedPlan().toString()
        sizes = got.groupBy(F.spark_partition_id().alias("p")).count().collect()
        rows = got.collect()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, want)) and got.columns == ["FIPS", "County", "Cases", "A", "B"]
    total = sum(r["count"] for r in sizes)
    assert sum(r["FIPS"] == "00000" for r in rows) > total / 2  # the hot key
    assert max(r["count"] for r in sizes) < total / 4


def test_panel_scans_the_fact_table_once(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    plan = supplier_panel(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_returnflag" not in plan  # what is left of the fact table is its written aggregate
    # lines without a supplier and those of supplier 0 are one entity, as in the separate files
    li = load(spark, sf, "lineitem")
    key = F.when(F.col("l_suppkey") % 3 == 0, F.lit(None)).when(F.col("l_suppkey") % 3 == 1, F.lit(0)).otherwise(F.col("l_suppkey"))
    li.withColumn("l_suppkey", key.cast("long")).write.parquet(str(tmp_path / "lineitem.parquet"))
    base = str(tmp_path)
    cases, deaths = standins.counts_of(standins.supplier_facts(spark, base))
    for got, want in ((cases, standins.supplier_cases(spark, base)), (deaths, standins.supplier_deaths(spark, base))):
        assert got.schema.names == want.schema.names
        assert sorted(got.collect()) == sorted(want.collect())
        assert got.where("FIPS = 0").count() == 1


def test_map_layer_runs_its_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    df = spark.createDataFrame([(i, float(i)) for i in range(100)], "k long, v double").mapInPandas(count, "k long, v double")
    layer = aggregates.map_layer(df, "k", "v", scale="fraction")
    rows = {r["k"]: r for r in layer.collect()}
    assert seen.value == 100
    assert rows[99]["range_hi"] == 99 / 5 and rows[99]["color"] == 99 / 5 and rows[10]["color"] == 10.0
    plan = layer._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Exchange" not in plan
    assert aggregates.map_layer(df.limit(0), "k", "v").count() == 0


def test_exact_split(spark):
    df = spark.range(1234).withColumn("x", F.lit(1))
    for share in (0.0, 0.2, 0.33, 1.0):
        n = features.exact_split(df, "id", share, 7).where("split = 'test'").count()
        assert n == math.ceil(round(share * 1234, 9))
    ids = lambda d: {r["id"] for r in features.exact_split(d, "id", 0.2, 7).where("split = 'test'").collect()}
    assert ids(df) == ids(df.repartition(7))
    one = df.select(F.lit(5).alias("id")).limit(10).unionByName(spark.createDataFrame([(None,)], "id int"))
    assert features.exact_split(one, "id", 0.5, 7).groupBy("split").count().count() == 2
    assert features.exact_split(df.limit(0), "id", 0.5, 7).count() == 0


def test_smallest_hashes(spark):
    values = [0, 0, 0, 5, 7, 7, 4096, 4097, (1 << 60) - 1]
    h = spark.createDataFrame([(v,) for v in values], "h long")
    assert [features.smallest_hashes(h, "h", k + 1) for k in range(len(values))] == values


def test_boundary_lines(spark):
    path = shared_path(spark, "test-boundaries")
    shape = {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [0, 1], [0, 0]]]}
    table = spark.createDataFrame([("01\"001", json.dumps(shape)), ("01003", json.dumps(shape))], "id string, geometry string")
    files.write_boundary_lines(table.repartition(2), path)
    got = {r["id"]: r for r in files.read_boundary_lines(spark, path).collect()}
    assert set(got) == {"01\"001", "01003"} and got["01003"]["geometry_type"] == "Polygon" and json.loads(got["01003"]["geometry"]) == shape


def test_fits_of_uneven_series_equal_single_ones(spark):
    rng = np.random.default_rng(4)
    rows, alone = [], {}
    for key in range(30):
        t = np.arange(1, rng.integers(1, 120), dtype=float)
        y = 900 / (1 + 50 * np.exp(-t / (3 + key % 9))) + rng.normal(0, 1, len(t)) if key % 7 else np.full(len(t), float(key))
        rows += [(key, float(a), None if key == 9 and a == 5 else float(b)) for a, b in zip(t, y, strict=True)]
        y = np.where((key == 9) & (t == 5), 0.0, y)
        starts = [s for s in (growth.linear_start(t, y) if len(t) > 1 else None, growth.CASES_P0, growth._heuristic_start(t, y) if len(t) else None) if s]
        alone[key] = growth.fit_one(t, y, starts) if len(t) else None
    df = spark.createDataFrame(rows, "k long, t double, y double").repartition(4)
    got = {r["k"]: r for r in growth.logistic_fit(df, "k", "t", "y").collect()}
    for key, r in got.items():
        p, rss, _, status = alone[key]
        assert r["status"] == status
        if status == "ok":
            assert abs(r["rss"] - rss) <= 1e-6 * rss + 1e-9
    assert growth.logistic_fit(df.limit(0), "k", "t", "y").count() == 0
