"""Registered queries: one per operator of the inventory.

Every query is ``(spark, base_dir) -> DataFrame``. ``ORACLE_SQL`` holds the
DuckDB equivalent for the SQL-checkable ones (views named after the tables).
Floating results that two engines may sum in different orders are rounded
(half to even) to a stated number of decimals in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionlens.functions.scalar import pad_key, round_to, threshold_label, to_number
from regionlens.operators import aggregates, missing, projection, rates, series, topk
from regionlens.operators.joins import panel
from regionlens.plans.rates_report import ranking, supplier_rates
from regionlens.session import shared_path
from regionlens.sources import files, standins
from regionlens.sources.tables import load

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        return fn

    return deco


# =========================================================================== SQL fragments
_SUPPLIER_RATES_SQL = """
WITH c AS (
  SELECT l_suppkey AS FIPS, printf('Supplier#%09d', l_suppkey) AS Combined_Key,
         count_if(l_returnflag = 'R')::BIGINT AS Cases
  FROM lineitem GROUP BY ALL),
d AS (
  SELECT l_suppkey AS FIPS, printf('Supplier#%09d', l_suppkey) AS Combined_Key,
         count(*)::BIGINT AS Population,
         count_if(l_returnflag = 'R' AND l_linestatus = 'F')::BIGINT AS Deaths
  FROM lineitem GROUP BY ALL),
rates AS (
  SELECT printf('%05d', c.FIPS) AS FIPS, c.Combined_Key AS County, Cases, Population, Deaths,
         coalesce(round_even(Cases::DOUBLE / nullif(Population, 0) * 100000.0, 0) / 100000.0, 0.0) AS InfectionRate,
         coalesce(round_even(Deaths::DOUBLE / nullif(Cases, 0) * 10000.0, 0) / 10000.0, 0.0) AS Fatality
  FROM c JOIN d ON c.FIPS = d.FIPS AND c.Combined_Key = d.Combined_Key
  WHERE Population <> 0 AND Cases >= Deaths AND Population >= Cases)
"""

_LINE_COUNTS_SQL = """
WITH lc AS (
  SELECT l_orderkey, l_linenumber, (l_linenumber * 4)::BIGINT AS Cases,
         round(l_tax * 100)::BIGINT AS Deaths, (l_quantity - 1)::BIGINT AS Population
  FROM lineitem)
"""

# customer attributes: money text of c_acctbal and of order totals per status
_CUSTOMER_SPEND_SQL = """
WITH s AS (
  SELECT o_custkey,
         sum(o_totalprice::DECIMAL(18,2)) FILTER (WHERE o_orderstatus = 'F') AS F,
         sum(o_totalprice::DECIMAL(18,2)) FILTER (WHERE o_orderstatus = 'O') AS O,
         sum(o_totalprice::DECIMAL(18,2)) FILTER (WHERE o_orderstatus = 'P') AS P
  FROM orders GROUP BY o_custkey),
a AS (
  SELECT c.*, s.F, s.O, s.P FROM customer c LEFT JOIN s ON c.c_custkey = s.o_custkey)
"""

_SERIES_SQL = """
WITH b AS (SELECT min(ts::DATE) AS d0, max(ts::DATE) AS d1 FROM events),
daily AS (
  SELECT user_id, ts::DATE AS day, count(*) AS n_all, count_if(event_type = 'error') AS n_death
  FROM events GROUP BY ALL),
users AS (SELECT DISTINCT user_id FROM events),
grid AS (
  SELECT u.user_id, g.day::DATE AS day, (g.day::DATE - b.d0 + 1)::INTEGER AS t
  FROM users u, b, generate_series(b.d0::TIMESTAMP, b.d1::TIMESTAMP, INTERVAL 1 DAY) AS g(day)),
ser AS (
  SELECT g.user_id, g.day, g.t,
         (sum(coalesce(n_all, 0)) OVER (PARTITION BY g.user_id ORDER BY g.day))::BIGINT AS cases,
         (sum(coalesce(n_death, 0)) OVER (PARTITION BY g.user_id ORDER BY g.day))::BIGINT AS deaths
  FROM grid g LEFT JOIN daily d ON d.user_id = g.user_id AND d.day = g.day)
"""


def _money_sql(x: str) -> str:
    return f"'$' || format('{{:,.2f}}', ({x})::DOUBLE)"


# =========================================================================== E1: rates and rankings
@register("entity_rates", _SUPPLIER_RATES_SQL + "SELECT * FROM rates")
def q_entity_rates(spark, base):
    return supplier_rates(spark, base)


@register(
    "join_composite",
    """
WITH c AS (
  SELECT l_suppkey AS FIPS, printf('Supplier#%09d', l_suppkey) AS Combined_Key,
         count_if(l_returnflag = 'R')::BIGINT AS Cases FROM lineitem GROUP BY ALL),
d AS (
  SELECT l_suppkey AS FIPS, printf('Supplier#%09d', l_suppkey) AS Combined_Key,
         count(*)::BIGINT AS Population,
         count_if(l_returnflag = 'R' AND l_linestatus = 'F')::BIGINT AS Deaths FROM lineitem GROUP BY ALL)
SELECT c.FIPS, c.Combined_Key, Cases, Population, Deaths
FROM c JOIN d ON c.FIPS = d.FIPS AND c.Combined_Key = d.Combined_Key
""",
)
def q_join_composite(spark, base):
    return rates.join_composite(standins.supplier_cases(spark, base), standins.supplier_deaths(spark, base))


for _name, _col in (("topk_cases", "Cases"), ("topk_rate", "InfectionRate"), ("topk_fatality", "Fatality")):

    def _make(col):
        def q(spark, base):
            return ranking(supplier_rates(spark, base), col, 10)

        return q

    register(_name, _SUPPLIER_RATES_SQL + f"SELECT * FROM rates ORDER BY {_col} DESC NULLS LAST, FIPS LIMIT 10")(_make(_col))


@register(
    "county_rates",
    _LINE_COUNTS_SQL
    + """
SELECT printf('%05d', l_orderkey) AS FIPS, l_linenumber, Cases, Population, Deaths,
       coalesce(round_even(Cases::DOUBLE / nullif(Population, 0) * 100000.0, 0) / 100000.0, 0.0) AS InfectionRate,
       coalesce(round_even(Deaths::DOUBLE / nullif(Cases, 0) * 10000.0, 0) / 10000.0, 0.0) AS Fatality
FROM lc WHERE Population <> 0 AND Cases >= Deaths AND Population >= Cases
""",
)
def q_county_rates(spark, base):
    lc = standins.line_counts(spark, base)
    out = rates.add_rates(lc).withColumn("FIPS", pad_key("l_orderkey"))
    return rates.valid_rows(missing.fill_numeric(out)).select(
        "FIPS", "l_linenumber", "Cases", "Population", "Deaths", "InfectionRate", "Fatality"
    )


@register(
    "valid_rows",
    _LINE_COUNTS_SQL
    + "SELECT * FROM lc WHERE Population <> 0 AND Cases >= Deaths AND Population >= Cases",
)
def q_valid_rows(spark, base):
    return rates.valid_rows(standins.line_counts(spark, base))


@register(
    "rate_format_number",
    _LINE_COUNTS_SQL
    + """
SELECT l_orderkey, l_linenumber,
       coalesce(TRY_CAST(printf('%.5f', Cases::DOUBLE / nullif(Population, 0)) AS DOUBLE), 0.0) AS InfectionRate,
       coalesce(TRY_CAST(printf('%.4f', Deaths::DOUBLE / nullif(Cases, 0)) AS DOUBLE), 0.0) AS Fatality
FROM lc
""",
)
def q_rate_format_number(spark, base):
    lc = standins.line_counts(spark, base)
    return rates.add_rates(lc, method="format_number").select("l_orderkey", "l_linenumber", "InfectionRate", "Fatality")


@register("pad_key", "SELECT c_custkey, printf('%05d', c_custkey) AS FIPS FROM customer")
def q_pad_key(spark, base):
    return load(spark, base, "customer").select("c_custkey", pad_key("c_custkey").alias("FIPS"))


@register(
    "threshold_label",
    _SUPPLIER_RATES_SQL
    + """
SELECT FIPS, Fatality, (Fatality >= 0.01)::INTEGER AS high_fatality,
       InfectionRate, (InfectionRate >= 0.01)::INTEGER AS high_infection
FROM rates
""",
)
def q_threshold_label(spark, base):
    r = supplier_rates(spark, base)
    return r.select(
        "FIPS",
        "Fatality",
        threshold_label("Fatality", 0.01).alias("high_fatality"),
        "InfectionRate",
        threshold_label("InfectionRate", 0.01).alias("high_infection"),
    )


@register(
    "map_layer",
    _SUPPLIER_RATES_SQL
    + """
, v AS (SELECT FIPS, CASE WHEN Cases > 0 THEN log10(Cases::DOUBLE) END AS value FROM rates),
m AS (SELECT max(value) AS hi FROM v)
SELECT FIPS, round_even(value * 1e9, 0) / 1e9 AS value, round_even(hi * 1e9, 0) / 1e9 AS range_hi,
       round_even(least(greatest(value, 0.0), hi) * 1e9, 0) / 1e9 AS color
FROM v, m
""",
)
def q_map_layer(spark, base):
    layer = aggregates.map_layer(supplier_rates(spark, base), "FIPS", "Cases", scale="log10")
    return layer.select("FIPS", *[round_to(c, 9).alias(c) for c in ("value", "range_hi", "color")])


@register(
    "map_layer_fraction",
    _SUPPLIER_RATES_SQL
    + """
, v AS (SELECT FIPS, InfectionRate::DOUBLE AS value FROM rates),
m AS (SELECT max(value) / 5 AS hi FROM v)
SELECT FIPS, round_even(value * 1e9, 0) / 1e9 AS value, round_even(hi * 1e9, 0) / 1e9 AS range_hi,
       round_even(least(greatest(value, 0.0), hi) * 1e9, 0) / 1e9 AS color
FROM v, m
""",
)
def q_map_layer_fraction(spark, base):
    layer = aggregates.map_layer(supplier_rates(spark, base), "FIPS", "InfectionRate", scale="fraction")
    return layer.select("FIPS", *[round_to(c, 9).alias(c) for c in ("value", "range_hi", "color")])


@register(
    "map_layer_fixed",
    _SUPPLIER_RATES_SQL
    + """
, v AS (SELECT FIPS, Fatality::DOUBLE AS value FROM rates),
m AS (SELECT any_value(0.1::DOUBLE) AS hi FROM v)
SELECT FIPS, round_even(value * 1e9, 0) / 1e9 AS value, round_even(hi * 1e9, 0) / 1e9 AS range_hi,
       round_even(least(greatest(value, 0.0), hi) * 1e9, 0) / 1e9 AS color
FROM v, m
""",
)
def q_map_layer_fixed(spark, base):
    layer = aggregates.map_layer(supplier_rates(spark, base), "FIPS", "Fatality", scale="fixed")
    return layer.select("FIPS", *[round_to(c, 9).alias(c) for c in ("value", "range_hi", "color")])


@register(
    "map_boundaries",
    _SUPPLIER_RATES_SQL
    + """
, v AS (SELECT FIPS, InfectionRate::DOUBLE AS value FROM rates),
m AS (SELECT max(value) / 5 AS hi FROM v)
SELECT FIPS, round_even(least(greatest(value, 0.0), hi) * 1e9, 0) / 1e9 AS color, 'Point' AS geometry_type,
       s_nationkey::DOUBLE * 10 - 120 AS lon, (s_suppkey % 90)::DOUBLE AS lat
FROM v, m, supplier WHERE FIPS = printf('%05d', s_suppkey)
""",
)
def q_map_boundaries(spark, base):
    """A map layer with the shapes it colours: boundaries from a GeoJSON file, one feature a line."""
    sup = load(spark, base, "supplier")
    point = F.to_json(F.struct(F.lit("Point").alias("type"), F.array(F.col("s_nationkey").cast("double") * 10 - 120, (F.col("s_suppkey") % 90).cast("double")).alias("coordinates")))
    path = files.write_boundary_lines(sup.select(pad_key("s_suppkey").alias("id"), point.alias("geometry")), shared_path(spark, "boundaries"))
    layer = aggregates.map_layer(supplier_rates(spark, base), "FIPS", "InfectionRate", scale="fraction")
    met = layer.join(files.read_boundary_lines(spark, path), F.col("FIPS") == F.col("id"))
    at = lambda k: F.get_json_object("geometry", f"$.coordinates[{k}]").try_cast("double")
    return met.select("FIPS", round_to("color", 9).alias("color"), "geometry_type", at(0).alias("lon"), at(1).alias("lat"))


@register(
    "count_positive",
    _SERIES_SQL
    + "SELECT count_if(deaths > 0)::BIGINT AS n_positive FROM (SELECT user_id, arg_max(deaths, day) AS deaths FROM ser GROUP BY user_id)",
)
def q_count_positive(spark, base):
    latest = projection.latest_from_long(standins.event_series(spark, base), ["user_id"], "day", "deaths", "deaths")
    return aggregates.count_positive(latest, "deaths")


# =========================================================================== E2: attributes and panel
@register(
    "clean_currency",
    _CUSTOMER_SPEND_SQL
    + """
SELECT printf('%05d', c_custkey) AS FIPS, c_acctbal AS ACCTBAL_2018,
       F::DOUBLE AS SPEND_F_2018, O::DOUBLE AS SPEND_O_2018, P::DOUBLE AS SPEND_P_2018
FROM a
""",
)
def q_clean_currency(spark, base):
    attrs = standins.customer_attributes(spark, base)
    feats = [c for c in attrs.columns if "2018" in c]
    return attrs.select(pad_key("FIPStxt").alias("FIPS"), *[to_number(c).alias(c) for c in feats])


@register(
    "clean_all_columns",
    _CUSTOMER_SPEND_SQL
    + """
SELECT c_custkey::VARCHAR AS FIPStxt, c_name AS Name, c_mktsegment AS SEGMENT_2017,
       printf('%.2f', c_acctbal) AS ACCTBAL_2018,
       printf('%.2f', F) AS SPEND_F_2018, printf('%.2f', O) AS SPEND_O_2018, printf('%.2f', P) AS SPEND_P_2018
FROM a
""",
)
def q_clean_all_columns(spark, base):
    return projection.clean_all_columns(standins.customer_attributes(spark, base))


@register(
    "columns_by_token",
    _CUSTOMER_SPEND_SQL
    + f"""
SELECT c_custkey::VARCHAR AS FIPStxt, {_money_sql('c_acctbal')} AS ACCTBAL_2018,
       {_money_sql('F')} AS SPEND_F_2018, {_money_sql('O')} AS SPEND_O_2018, {_money_sql('P')} AS SPEND_P_2018
FROM a
""",
)
def q_columns_by_token(spark, base):
    return projection.columns_by_token(standins.customer_attributes(spark, base), "FIPStxt", "2018")


@register(
    "feature_frame",
    """
SELECT l_orderkey, l_linenumber, TRY_CAST(l_quantity::VARCHAR AS DOUBLE) AS l_quantity,
       TRY_CAST(l_extendedprice::VARCHAR AS DOUBLE) AS l_extendedprice,
       TRY_CAST(l_discount::VARCHAR AS DOUBLE) AS l_discount,
       TRY_CAST(l_tax::VARCHAR AS DOUBLE) AS l_tax,
       TRY_CAST(l_returnflag::VARCHAR AS DOUBLE) AS l_returnflag,
       TRY_CAST(l_linestatus::VARCHAR AS DOUBLE) AS l_linestatus,
       TRY_CAST(l_shipdate::VARCHAR AS DOUBLE) AS l_shipdate
FROM lineitem
""",
)
def q_feature_frame(spark, base):
    li = load(spark, base, "lineitem")
    return projection.feature_frame(li, ["l_orderkey", "l_linenumber"], start=4)


@register(
    "fill_numeric",
    """
SELECT o_custkey,
       coalesce(round_even(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F') * 100, 0) / 100, 0.0) AS spend_F,
       coalesce(round_even(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O') * 100, 0) / 100, 0.0) AS spend_O,
       coalesce(round_even(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'P') * 100, 0) / 100, 0.0) AS spend_P
FROM orders GROUP BY o_custkey
""",
)
def q_fill_numeric(spark, base):
    o = load(spark, base, "orders")
    spend = o.groupBy("o_custkey").pivot("o_orderstatus", list(standins.ORDER_STATUSES)).agg(F.sum("o_totalprice"))
    spend = spend.select("o_custkey", *[round_to(s, 2).alias(f"spend_{s}") for s in standins.ORDER_STATUSES])
    return missing.fill_numeric(spend, 0.0)


@register(
    "drop_missing",
    _CUSTOMER_SPEND_SQL
    + """
SELECT printf('%05d', c_custkey) AS FIPS, c_acctbal AS ACCTBAL_2018,
       F::DOUBLE AS SPEND_F_2018, O::DOUBLE AS SPEND_O_2018, P::DOUBLE AS SPEND_P_2018
FROM a WHERE F IS NOT NULL AND O IS NOT NULL AND P IS NOT NULL
""",
)
def q_drop_missing(spark, base):
    attrs = standins.customer_attributes(spark, base)
    feats = [c for c in attrs.columns if "2018" in c]
    kept = missing.drop_missing(attrs.select("FIPStxt", *feats), feats)
    return kept.select(pad_key("FIPStxt").alias("FIPS"), *[to_number(c).alias(c) for c in feats])


_PROFILE_COLS = ("FIPStxt", "Name", "SEGMENT_2017", "ACCTBAL_2018", "SPEND_F_2018", "SPEND_O_2018", "SPEND_P_2018")


@register(
    "missing_profile",
    _CUSTOMER_SPEND_SQL
    + ", n AS (SELECT count(*)::BIGINT AS n_rows FROM a)\n"
    + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS \"column\", n_rows, (SELECT count_if({e} IS NULL)::BIGINT FROM a) AS n_missing, "
        f"(SELECT count_if({e} IS NULL) > 0 FROM a) AS has_missing FROM n"
        for c, e in zip(_PROFILE_COLS, ("c_custkey", "c_name", "c_mktsegment", "c_acctbal", "F", "O", "P"))
    ),
)
def q_missing_profile(spark, base):
    return missing.missing_profile(standins.customer_attributes(spark, base))


# panel: supplier rates joined to three supplier attribute tables
_PANEL_DROP = ("TAX_2018",)


def supplier_panel(spark: SparkSession, base: str) -> DataFrame:
    """Rates ⋈ (account ⋈ (volume ⋈ terms)) on the padded key, attributes cleaned
    to double, year-2018 columns only, then the listed columns dropped. The fact table
    is scanned once, for rates and attributes together."""
    facts = standins.supplier_facts(spark, base)
    tables = []
    for t in standins.supplier_attributes(spark, base, facts):
        t = t.withColumn("FIPS", pad_key("FIPStxt"))
        feats = [c for c in projection.columns_by_token(t, "FIPS", "2018").columns if c != "FIPS"]
        tables.append(t.select("FIPS", *[to_number(c).alias(c) for c in feats]))
    return panel(rates.entity_rates(*standins.counts_of(facts)), tables, key="FIPS", drop=_PANEL_DROP)


PANEL_SQL = (
    _SUPPLIER_RATES_SQL
    + """
, acct AS (SELECT printf('%05d', s_suppkey) AS FIPS, s_acctbal AS ACCTBAL_2018 FROM supplier),
per AS (SELECT l_suppkey, sum(l_quantity) AS qty, sum(l_extendedprice::DECIMAL(18,2)) AS price,
               sum(l_discount::DECIMAL(18,2)) AS disc FROM lineitem GROUP BY l_suppkey),
vol AS (SELECT printf('%05d', l_suppkey) AS FIPS, round_even(qty, 0) AS QTY_2018, price::DOUBLE AS PRICE_2018 FROM per),
terms AS (SELECT printf('%05d', l_suppkey) AS FIPS, disc::DOUBLE AS DISC_2018 FROM per),
panel AS (SELECT r.*, ACCTBAL_2018, QTY_2018, PRICE_2018, DISC_2018
  FROM rates r JOIN acct USING (FIPS) JOIN vol USING (FIPS) JOIN terms USING (FIPS))
"""
)


@register("county_panel", PANEL_SQL + "SELECT * FROM panel")
def q_county_panel(spark, base):
    return supplier_panel(spark, base)


@register(
    "scan_attr_csv",
    _CUSTOMER_SPEND_SQL
    + """
SELECT printf('%05d', c_custkey) AS FIPS, c_acctbal AS ACCTBAL_2018,
       F::DOUBLE AS SPEND_F_2018, O::DOUBLE AS SPEND_O_2018, P::DOUBLE AS SPEND_P_2018
FROM a
""",
)
def q_scan_attr_csv(spark, base):
    path = shared_path(spark, "attributes-csv")
    files.write_csv(standins.customer_attributes(spark, base), path, files.ATTRIBUTE_ENCODING)
    attrs = files.read_attribute_csv(spark, path)
    picked = projection.columns_by_token(attrs, "FIPStxt", "2018")
    feats = [c for c in picked.columns if c != "FIPStxt"]
    return picked.select(pad_key("FIPStxt").alias("FIPS"), *[to_number(c).alias(c) for c in feats])


# =========================================================================== E3: series
@register(
    "wide_to_long",
    _SERIES_SQL
    + "SELECT user_id::DOUBLE AS FIPS, printf('User %d', user_id) AS Combined_Key, day AS date, t, cases::DOUBLE AS value FROM ser",
)
def q_wide_to_long(spark, base):
    wide = standins.wide_series(spark, base, "cases")
    return series.wide_to_long(wide, ["FIPS", "Combined_Key"])


@register(
    "latest_measure",
    _SERIES_SQL + "SELECT user_id, arg_max(cases, day) AS Cases, max(day) AS as_of FROM ser GROUP BY user_id",
)
def q_latest_measure(spark, base):
    return projection.latest_from_long(standins.event_series(spark, base), ["user_id"], "day", "cases", "Cases")


@register(
    "keep_columns",
    """
SELECT user_id::DOUBLE AS FIPS, printf('User %d', user_id) AS Combined_Key,
       round(sum(value::DECIMAL(18,2)))::BIGINT AS Population, count_if(event_type = 'error')::BIGINT AS Deaths
FROM events GROUP BY user_id
""",
)
def q_keep_columns(spark, base):
    wide = standins.wide_series(spark, base, "deaths")
    last = projection.latest_column(wide)
    kept = projection.keep_columns(wide, ["FIPS", "Combined_Key", "Population", last])
    return projection.rename(kept, {last: "Deaths"})


@register(
    "topk_series",
    """
SELECT user_id::DOUBLE AS FIPS, printf('User %d', user_id) AS Combined_Key, count(*)::BIGINT AS latest
FROM events GROUP BY user_id ORDER BY latest DESC, FIPS LIMIT 8
""",
)
def q_topk_series(spark, base):
    wide = standins.wide_series(spark, base, "cases")
    last = projection.latest_column(wide)
    top = topk.top_k_series(wide, 8, tiebreak=("FIPS",))
    return top.select("FIPS", "Combined_Key", F.col(f"`{last}`").alias("latest"))


@register(
    "topk_series_deaths",
    """
SELECT user_id::DOUBLE AS FIPS, printf('User %d', user_id) AS Combined_Key, count_if(event_type = 'error')::BIGINT AS latest
FROM events GROUP BY user_id ORDER BY latest DESC, FIPS LIMIT 8
""",
)
def q_topk_series_deaths(spark, base):
    wide = standins.wide_series(spark, base, "deaths")
    last = projection.latest_column(wide)
    top = topk.top_k_series(wide, 8, tiebreak=("FIPS",))
    return top.select("FIPS", "Combined_Key", F.col(f"`{last}`").alias("latest"))


@register(
    "scan_wide_csv",
    """
SELECT user_id::DOUBLE AS FIPS, printf('User %d', user_id) AS Combined_Key,
       round(sum(value::DECIMAL(18,2)))::BIGINT::DOUBLE AS Population, count_if(event_type = 'error')::DOUBLE AS Deaths
FROM events GROUP BY user_id
""",
)
def q_scan_wide_csv(spark, base):
    path = shared_path(spark, "deaths-csv")
    files.write_csv(standins.wide_series(spark, base, "deaths"), path)
    meta = T.StructType(
        [
            T.StructField("FIPS", T.DoubleType()),
            T.StructField("Combined_Key", T.StringType()),
            T.StructField("Population", T.DoubleType()),
        ]
    )
    wide = files.read_wide_csv(spark, path, meta)
    return projection.latest_measure(wide, ["FIPS", "Combined_Key", "Population"], "Deaths")




# growth, feature preparation and model queries register themselves on import
from regionlens.plans import model_queries  # noqa: E402,F401
