"""Known-answer fixtures F1-F3, F5, F8 and plan checks for the relational operators."""

import json

import pytest
from pyspark.sql import functions as F

from regionlens.functions.scalar import clean_text, pad_key, to_number
from regionlens.operators import aggregates, features, missing, projection, rates, topk
from regionlens.operators.series import wide_to_long
from regionlens.sources import files


def _f1(spark):
    rows = [
        (1001.0, "Alpha, X", 55869, 0, 1, 4, 120),
        (1003.0, "Beta, X", 223234, 0, 0, 2, 120),
        (float("nan"), "Unassigned, X", 0, 0, 0, 0, 7),
        (56045.0, "Gamma, Y", 6927, 0, 0, 0, 0),
    ]
    cols = ["FIPS", "Combined_Key", "Population", "1/22/20", "1/23/20", "1/24/20", "12/31/20"]
    return spark.createDataFrame(rows, cols)


def test_keep_and_latest_columns(spark):
    df = _f1(spark)
    kept = projection.keep_columns(df, ["Combined_Key", "FIPS", "12/31/20"])
    assert kept.columns == ["FIPS", "Combined_Key", "12/31/20"]
    latest = projection.latest_measure(df, ["FIPS"], "Cases")
    assert latest.columns == ["FIPS", "Cases"]
    assert sorted(r.Cases for r in latest.collect()) == [0, 7, 120, 120]


def test_top_k_series_tie_break_and_positive_filter(spark):
    top = topk.top_k_series(_f1(spark).na.fill(0), 4, tiebreak=("FIPS",)).collect()
    # Alpha and Beta tie on the last date: the key decides; Gamma (0) is not positive
    assert [r.Combined_Key for r in top] == ["Alpha, X", "Beta, X", "Unassigned, X"]
    plan = topk.top_k(_f1(spark), "12/31/20", 2, ("FIPS",))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_wide_to_long_dates_and_day_index(spark):
    long = wide_to_long(_f1(spark), ["FIPS", "Combined_Key", "Population"])
    rows = {(r.Combined_Key, str(r.date)): (r.t, r.value) for r in long.collect()}
    assert rows[("Alpha, X", "2020-01-22")] == (1, 0.0)
    assert rows[("Alpha, X", "2020-01-24")] == (3, 4.0)
    assert rows[("Beta, X", "2020-12-31")] == (345, 120.0)
    assert long.count() == 16


def _f2(spark):
    rows = [
        (1001, 120, 3, 55869),
        (1003, 0, 0, 1000),
        (1005, 5, 9, 1000),
        (1007, 50, 1, 0),
        (1009, 1001, 1, 1000),
        (None, 10, 1, 1000),
    ]
    cases = spark.createDataFrame([(r[0], f"c{r[0]}", r[1]) for r in rows], "FIPS long, Combined_Key string, Cases long")
    deaths = spark.createDataFrame(
        [(r[0], f"c{r[0]}", r[3], r[2]) for r in rows], "FIPS long, Combined_Key string, Population long, Deaths long"
    )
    return cases, deaths


def test_entity_rates_fixture(spark):
    cases, deaths = _f2(spark)
    out = {r.FIPS: r for r in rates.entity_rates(cases, deaths).collect()}
    assert set(out) == {"01001", "01003", "00000"}
    assert out["01001"].InfectionRate == 0.00215 and out["01001"].Fatality == 0.025
    assert out["01003"].InfectionRate == 0.0 and out["01003"].Fatality == 0.0
    assert out["00000"].InfectionRate == 0.01 and out["00000"].Fatality == 0.1
    dropped = rates.entity_rates(cases, deaths, drop_missing_key=True).collect()
    assert {r.FIPS for r in dropped} == {"01001", "01003"}


def test_rates_plan_has_no_python_udf_and_pushes_filter(spark):
    cases, deaths = _f2(spark)
    plan = rates.entity_rates(cases, deaths)._jdf.queryExecution().executedPlan().toString()
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan


def test_format_number_parity_and_rint(spark):
    df = spark.createDataFrame([(1, 3), (2, 0), (1, 8)], "a long, b long")
    r = rates.add_rates(df.select(F.col("a").alias("Cases"), F.col("b").alias("Population"), F.lit(0).alias("Deaths")))
    assert [x.InfectionRate for x in r.collect()] == [0.33333, 0.0, 0.125]
    r2 = rates.add_rates(
        df.select(F.col("a").alias("Cases"), F.col("b").alias("Population"), F.lit(0).alias("Deaths")), method="format_number"
    )
    assert [x.InfectionRate for x in r2.collect()] == [0.33333, 0.0, 0.125]


def test_pad_key_null_and_wide(spark):
    df = spark.createDataFrame([(1001.0,), (None,), (1234567.0,)], "k double")
    assert [r.p for r in df.select(pad_key("k").alias("p")).collect()] == ["01001", None, "1234567"]


def _f3(spark):
    return spark.createDataFrame(
        [
            ("1001", "55,200", "55,869", "$58,786"),
            ("1003", "212,000", "None", "$-1,250.50"),
            ("1005", "24,000", "24,686", None),
            ("1007", "22,000", "nan", ""),
        ],
        "FIPStxt string, POP_2017 string, POP_2018 string, INCOME_2018 string",
    )


def test_dirty_attributes_fixture(spark):
    df = _f3(spark)
    picked = projection.columns_by_token(df.withColumn("FIPS", pad_key("FIPStxt")).drop("FIPStxt"), "FIPS", "2018")
    assert picked.columns == ["FIPS", "POP_2018", "INCOME_2018"]
    cleaned = projection.clean_all_columns(picked)
    kept = missing.drop_missing(cleaned, ["POP_2018", "INCOME_2018"])
    rows = kept.select("FIPS", *[to_number(c).alias(c) for c in ("POP_2018", "INCOME_2018")]).collect()
    assert [(r.FIPS, r.POP_2018, r.INCOME_2018) for r in rows] == [("01001", 55869.0, 58786.0)]
    neg = df.select(to_number("INCOME_2018").alias("v")).collect()
    assert neg[1].v == -1250.5
    assert df.select(clean_text("POP_2018").alias("c")).collect()[1].c is None


def test_missing_profile(spark):
    prof = {r.column: (r.n_missing, r.has_missing) for r in missing.missing_profile(_f3(spark)).collect()}
    assert prof["POP_2018"] == (2, True)
    assert prof["INCOME_2018"] == (2, True)
    assert prof["POP_2017"] == (0, False)


def test_fill_numeric_includes_nan_not_strings(spark):
    df = spark.createDataFrame([(float("nan"), None, None)], "x double, y long, s string")
    r = missing.fill_numeric(df).collect()[0]
    assert (r.x, r.y, r.s) == (0.0, 0, None)


def test_scaling_fixture_f5(spark):
    df = spark.createDataFrame([(float(v), 7.0) for v in range(1, 6)], "v double, c double")
    scaled, constant = features.minmax_scale(df, ["v", "c"])
    assert constant == ["c"]
    assert [r.v for r in scaled.collect()] == [0.0, 0.25, 0.5, 0.75, 1.0]
    m = {r.column: r for r in aggregates.column_moments(df, ["v"]).collect()}
    assert m["v"].std_samp == pytest.approx(1.5811388, abs=1e-7)
    assert m["v"].std_pop == pytest.approx(1.4142136, abs=1e-7)
    z = features.standardize(df, ["v", "c"]).collect()
    assert [r.c for r in z] == [0.0] * 5
    assert sum(r.v for r in z) == pytest.approx(0.0, abs=1e-12)


def test_hash_split_is_partition_independent(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    a = {r.k: r.split for r in features.hash_split(df.repartition(7), "k", 0.33, 7).collect()}
    b = {r.k: r.split for r in features.hash_split(df.coalesce(1), "k", 0.33, 7).collect()}
    assert a == b
    share = sum(v == "test" for v in a.values()) / len(a)
    assert 0.28 < share < 0.38


def test_geojson_boundaries_f8(spark, tmp_path):
    doc = {
        "type": "FeatureCollection",
        "features": [
            {"type": "Feature", "id": "01001", "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}},
            {
                "type": "Feature",
                "id": "01003",
                "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [2, 0], [2, 2], [0, 0]]]]},
            },
        ],
    }
    p = tmp_path / "counties.json"
    p.write_text(json.dumps(doc, indent=2))
    rows = {r.id: r.geometry_type for r in files.read_boundaries(spark, str(p)).collect()}
    assert rows == {"01001": "Polygon", "01003": "MultiPolygon"}


def test_wide_csv_round_trip(spark, tmp_path):
    from pyspark.sql import types as T

    path = str(tmp_path / "wide")
    files.write_csv(_f1(spark).na.fill(0), path)
    meta = T.StructType([T.StructField("FIPS", T.DoubleType()), T.StructField("Combined_Key", T.StringType()), T.StructField("Population", T.DoubleType())])
    wide = files.read_wide_csv(spark, path, meta)
    assert wide.columns[-1] == "12/31/20"
    assert sorted(r["12/31/20"] for r in wide.collect()) == [0.0, 7.0, 120.0, 120.0]
    with pytest.raises(ValueError):
        files.read_wide_csv(spark, path, T.StructType([T.StructField("Nope", T.StringType())]))


def test_attribute_csv_latin1(spark, tmp_path):
    path = str(tmp_path / "attr")
    df = spark.createDataFrame([("1001", "Doña Ana", "$1,234.50")], "FIPStxt string, Name string, INC_2018 string")
    files.write_csv(df, path, files.ATTRIBUTE_ENCODING)
    back = files.read_attribute_csv(spark, path).collect()[0]
    assert back.Name == "Doña Ana"
    assert spark.createDataFrame([back]).select(to_number("INC_2018").alias("v")).collect()[0].v == 1234.5


def test_map_layer_clamps(spark):
    df = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 0)], "k string, Cases long")
    out = {r.k: r for r in aggregates.map_layer(df, "k", "Cases").collect()}
    assert out["b"].color == pytest.approx(3.0)
    assert out["a"].color == pytest.approx(1.0)
    assert out["c"].value is None


def test_nan_key_is_missing(spark):
    from regionlens.operators.rates import entity_rates

    cases = spark.createDataFrame([(1.0, "a", 5.0), (float("nan"), "b", 3.0)], "FIPS double, Combined_Key string, Cases double")
    deaths = spark.createDataFrame([(1.0, "a", 1.0, 10.0), (float("nan"), "b", 1.0, 10.0)], "FIPS double, Combined_Key string, Deaths double, Population double")
    assert [r["FIPS"] for r in entity_rates(cases, deaths, drop_missing_key=True).collect()] == ["00001"]


def test_header_that_is_no_date_raises(spark, tmp_path):
    import pytest
    from pyspark.sql import types as T

    from regionlens.sources.files import read_wide_csv

    (tmp_path / "w.csv").write_text("FIPS,NotADate,1/22/20\n1,2,3\n")
    with pytest.raises(ValueError):
        read_wide_csv(spark, str(tmp_path / "w.csv"), T.StructType([T.StructField("FIPS", T.LongType())]))


def test_validation_rows_are_independent_of_the_split(spark):
    from regionlens.operators.boost import with_validation
    from regionlens.operators.features import hash_split

    df = hash_split(spark.range(2000), "id", 0.2, 7).where("split = 'train'")
    assert with_validation(df, "id", 0.2, 6).where("is_validation").count() > 200
