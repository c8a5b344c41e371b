"""Reference-shaped inputs derived by Spark from the driver's tables.

The reference reads county files (case and death time series, attribute
tables). The test data has none, so each role is derived from a TPC-H-style
table with plain DataFrame operations; the work grows with the tables.

=========================  ==================================================
role                       derived from
=========================  ==================================================
cases / deaths per entity  ``lineitem`` per supplier: rows are the population,
                           returned lines the cases, returned and finished
                           lines the deaths
row-level counts           ``lineitem`` per line: population ``l_quantity-1``,
                           cases ``4*l_linenumber``, deaths ``round(100*l_tax)``
time series                ``events``: per user and day, cumulative number of
                           events (cases) and of ``error`` events (deaths)
attribute tables (text)    ``customer`` and ``orders`` rendered as text with
                           ``$`` and thousands commas; a customer without
                           orders in a status has a missing value there
=========================  ==================================================
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regionlens.session import cut_lineage
from regionlens.sources.tables import load

# Fixed values of the stand-in rules.
RETURNED_FLAG = "R"
FINISHED_STATUS = "F"
DEATH_EVENT_TYPE = "error"
ORDER_STATUSES = ("F", "O", "P")
SERIES_LABEL_FORMAT = "M/d/yy"


# --------------------------------------------------------------------------- entity counts
def _supplier_keys():
    """Entity key columns. A missing key is filled with 0 here, as the reference
    fills the file before using it; the keys are then non-nullable, so the later
    ``fillna`` leaves them untouched and a join on them can reuse the
    aggregation's hash partitioning instead of shuffling again."""
    k = F.coalesce(F.col("l_suppkey"), F.lit(0).cast("long"))
    return k.alias("FIPS"), F.format_string("Supplier#%09d", k).alias("Combined_Key")


def supplier_cases(spark: SparkSession, base: str) -> DataFrame:
    """Cases file role: ``(FIPS, Combined_Key, Cases)`` per supplier."""
    li = load(spark, base, "lineitem")
    return li.groupBy(*_supplier_keys()).agg(F.count_if(F.col("l_returnflag") == RETURNED_FLAG).cast("long").alias("Cases"))


def supplier_deaths(spark: SparkSession, base: str) -> DataFrame:
    """Deaths file role: ``(FIPS, Combined_Key, Population, Deaths)`` per supplier."""
    li = load(spark, base, "lineitem")
    returned_finished = (F.col("l_returnflag") == RETURNED_FLAG) & (F.col("l_linestatus") == FINISHED_STATUS)
    return li.groupBy(*_supplier_keys()).agg(
        F.count(F.lit(1)).cast("long").alias("Population"),
        F.count_if(returned_finished).cast("long").alias("Deaths"),
    )


def supplier_facts(spark: SparkSession, base: str) -> DataFrame:
    """Every count and sum of ``lineitem`` per supplier that the panel needs, one row a
    ``l_suppkey``, written once: cases, deaths and attributes then share one scan of the
    fact table."""
    returned = F.col("l_returnflag") == RETURNED_FLAG
    rate_sum = lambda c: F.sum(F.col(c).cast("decimal(18,2)"))
    return cut_lineage(
        load(spark, base, "lineitem").groupBy("l_suppkey").agg(
            F.count(F.lit(1)).alias("lines"),
            F.count_if(returned).alias("returned"),
            F.count_if(returned & (F.col("l_linestatus") == FINISHED_STATUS)).alias("finished"),
            F.sum("l_quantity").alias("qty"),
            rate_sum("l_extendedprice").alias("price"),
            rate_sum("l_discount").alias("disc"),
            rate_sum("l_tax").alias("tax"),
        )
    )


def counts_of(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``supplier_cases`` and ``supplier_deaths`` from ``supplier_facts`` (its rows without a
    key and with key 0 are one entity here)."""
    total = lambda c, name: F.sum(c).cast("long").alias(name)
    by_key = facts.groupBy(*_supplier_keys())
    return by_key.agg(total("returned", "Cases")), by_key.agg(total("lines", "Population"), total("finished", "Deaths"))


def line_counts(spark: SparkSession, base: str) -> DataFrame:
    """Row-level counts where every term of the validity filter fails somewhere."""
    li = load(spark, base, "lineitem")
    return li.select(
        "l_orderkey",
        "l_linenumber",
        (F.col("l_linenumber") * 4).cast("long").alias("Cases"),
        F.round(F.col("l_tax") * 100).cast("long").alias("Deaths"),
        (F.col("l_quantity") - 1).cast("long").alias("Population"),
    )


# --------------------------------------------------------------------------- time series
def day_bounds(events: DataFrame) -> tuple[dt.date, dt.date]:
    """First and last event day (two scalars reach the driver)."""
    row = events.agg(F.min(F.to_date("ts")).alias("d0"), F.max(F.to_date("ts")).alias("d1")).first()
    return row["d0"], row["d1"]


def event_daily(events: DataFrame) -> DataFrame:
    """Sparse daily counts per user; partial aggregation runs before the shuffle."""
    return events.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).cast("long").alias("n_all"),
        F.count_if(F.col("event_type") == DEATH_EVENT_TYPE).cast("long").alias("n_death"),
        F.sum(F.col("value").cast("decimal(18,2)")).alias("v_sum"),
    )


def event_series(spark: SparkSession, base: str, bounds: tuple[dt.date, dt.date] | None = None) -> DataFrame:
    """Dense cumulative series ``(user_id, day, t, cases, deaths, v_sum)``.

    ``v_sum`` is the day's (not cumulative) sum of event values, in decimal so
    that totals are exact whatever the summation order.

    Every user gets every day from the first to the last event day (like the
    wide files, which have all dates for all counties). The grid is generated
    per user with ``sequence`` (no cross join); the running sum partitions by
    user, and a partition holds one row per day, so a user with a third of all
    events still yields a bounded partition.
    """
    events = load(spark, base, "events").select("user_id", "ts", "event_type", "value")
    d0, d1 = bounds or day_bounds(events)
    daily = event_daily(events)
    users = daily.select("user_id").distinct()
    grid = users.select(
        "user_id",
        F.explode(F.sequence(F.lit(d0), F.lit(d1), F.expr("INTERVAL 1 DAY"))).alias("day"),
    )
    dense = grid.join(daily, ["user_id", "day"], "left")
    w = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dense.select(
        "user_id",
        "day",
        (F.datediff("day", F.lit(d0)) + 1).cast("int").alias("t"),
        F.sum(F.coalesce("n_all", F.lit(0))).over(w).cast("long").alias("cases"),
        F.sum(F.coalesce("n_death", F.lit(0))).over(w).cast("long").alias("deaths"),
        F.coalesce("v_sum", F.lit(0).cast("decimal(18,2)")).alias("v_sum"),
    )


def series_labels(d0: dt.date, d1: dt.date) -> list[str]:
    """Header texts ``M/d/yy`` for every day in [d0, d1]."""
    n = (d1 - d0).days + 1
    return [f"{d.month}/{d.day}/{d.strftime('%y')}" for d in (d0 + dt.timedelta(days=i) for i in range(n))]


def wide_series(spark: SparkSession, base: str, measure: str = "cases") -> DataFrame:
    """Wide file role: ``FIPS, Combined_Key[, Population], <M/d/yy>...``.

    One conditional aggregation per user builds the row: it groups on
    ``user_id``, which the running-sum window has already hash-partitioned, so
    no further shuffle is planned (a ``pivot`` would add two). The deaths file
    also carries ``Population``: the rounded sum of the user's event values,
    taken from the same daily pre-aggregate.
    """
    events = load(spark, base, "events")
    d0, d1 = day_bounds(events)
    series = event_series(spark, base, (d0, d1))
    labels = series_labels(d0, d1)
    days = [d0 + dt.timedelta(days=i) for i in range(len(labels))]
    cells = [F.max(F.when(F.col("day") == F.lit(d), F.col(measure))).alias(h) for d, h in zip(days, labels)]
    extra = [F.round(F.sum("v_sum")).cast("long").alias("Population")] if measure == "deaths" else []
    wide = series.groupBy("user_id").agg(*extra, *cells)
    head = [F.col("user_id").cast("double").alias("FIPS"), F.format_string("User %d", "user_id").alias("Combined_Key")]
    if measure == "deaths":
        head.append("Population")
    return wide.select(*head, *[F.col(f"`{h}`") for h in labels])


# --------------------------------------------------------------------------- attributes
def customer_attributes(spark: SparkSession, base: str) -> DataFrame:
    """Attribute file role, every column text.

    ``FIPStxt`` is the customer key; ``ACCTBAL_2018`` is a money text such as
    ``$-465.73``; ``SPEND_<status>_2018`` is the customer's order total in that
    status (``$12,345.67``), missing (null) when it has no such order;
    ``SEGMENT_2017`` is an older-year column that the year filter drops.
    Sums run in decimal so that the text is exact.
    """
    cust = load(spark, base, "customer")
    orders = load(spark, base, "orders")
    spend = (
        orders.groupBy("o_custkey")
        .pivot("o_orderstatus", list(ORDER_STATUSES))
        .agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")))
    )
    joined = cust.join(spend, cust.c_custkey == spend.o_custkey, "left")
    money = lambda c: F.concat(F.lit("$"), F.format_number(c, 2))
    return joined.select(
        F.col("c_custkey").cast("string").alias("FIPStxt"),
        F.col("c_name").alias("Name"),
        F.col("c_mktsegment").alias("SEGMENT_2017"),
        money(F.col("c_acctbal")).alias("ACCTBAL_2018"),
        *[money(F.col(s)).alias(f"SPEND_{s}_2018") for s in ORDER_STATUSES],
    )


def supplier_attributes(spark: SparkSession, base: str, facts: DataFrame) -> list[DataFrame]:
    """Three attribute tables keyed by supplier (text key ``FIPStxt``), all text.

    * account: ``ACCTBAL_2018`` money text, ``NATION_2017`` (an older column);
    * volume: ``QTY_2018`` total quantity, ``PRICE_2018`` total price (money text);
    * terms: ``DISC_2018`` and ``TAX_2018``, total discount and tax rates (exact
      decimal sums rendered with 2 decimals).

    Volume and terms come from ``facts`` (``supplier_facts``).
    """
    sup = load(spark, base, "supplier")
    money = lambda c: F.concat(F.lit("$"), F.format_number(c, 2))
    account = sup.select(
        F.col("s_suppkey").cast("string").alias("FIPStxt"),
        money(F.col("s_acctbal")).alias("ACCTBAL_2018"),
        F.col("s_nationkey").cast("string").alias("NATION_2017"),
    )
    volume = facts.select(
        F.col("l_suppkey").cast("string").alias("FIPStxt"),
        F.format_number("qty", 0).alias("QTY_2018"),
        money(F.col("price")).alias("PRICE_2018"),
    )
    terms = facts.select(
        F.col("l_suppkey").cast("string").alias("FIPStxt"),
        F.format_number("disc", 2).alias("DISC_2018"),
        F.format_number("tax", 2).alias("TAX_2018"),
    )
    return [account, volume, terms]
