"""Facts, dimensions and series derived from the star-schema tables, the same as DataFrames and as SQL.

Every fact has the columns of ``FACT``: keys (null: for all commodities, or no instrument or region), a metric, the
date it is about, the date it was first known, a revision, a value and an id. ``SQL`` has each one's defining query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FACT = ("commodity_key", "dim_key", "metric_code", "observation_date", "release_date", "revision", "metric_value", "source_fact_id")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SQL = {
    "dim_commodity": """
SELECT DISTINCT CAST(substr(p_brand, 7) AS INT) AS commodity_key, p_brand AS commodity_code FROM part""",
    "price": """
SELECT CAST(substr(p_brand, 7) AS INT) AS commodity_key,
       CASE WHEN l_suppkey % 5 = 4 THEN NULL ELSE CAST(l_suppkey % 5 AS INT) END AS dim_key, 'price_close' AS metric_code,
       CAST(o_orderdate AS DATE) AS observation_date, greatest(CAST(l_shipdate AS DATE), CAST(o_orderdate AS DATE)) AS release_date,
       l_linenumber - 1 AS revision, coalesce(CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_extendedprice - 1 END, l_extendedprice) AS metric_value,
       l_orderkey * 10 + l_linenumber AS source_fact_id
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "weather": """
SELECT CAST(1 + o_custkey % 25 AS INT) AS commodity_key, n_regionkey AS dim_key, lower(substr(o_orderpriority, 3)) AS metric_code,
       CAST(o_orderdate AS DATE) AS observation_date, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 7 AS INT) AS release_date,
       CAST(o_orderkey % 2 AS INT) AS revision, o_totalprice AS metric_value, o_orderkey AS source_fact_id
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "macro": """
SELECT CASE WHEN user_id % 5 = 0 THEN NULL ELSE CAST(1 + user_id % 25 AS INT) END AS commodity_key, CAST(NULL AS INT) AS dim_key, event_type AS metric_code,
       CAST(ts AS DATE) AS observation_date, CAST(ts AS DATE) + CAST(user_id % 4 AS INT) AS release_date,
       CAST(event_id % 3 AS INT) AS revision, value AS metric_value, event_id AS source_fact_id
FROM events""",
    "logistics": """
SELECT CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE CAST(1 + l_partkey % 25 AS INT) END AS commodity_key,
       CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE CAST(l_suppkey % 5 AS INT) END AS dim_key, l_linestatus AS metric_code,
       last_day(CAST(l_shipdate AS DATE)) AS observation_date, last_day(CAST(l_shipdate AS DATE)) + CAST(l_linenumber AS INT) AS release_date,
       CAST(l_orderkey % 2 AS INT) AS revision, l_quantity AS metric_value, l_orderkey * 10 + l_linenumber AS source_fact_id
FROM lineitem""",
    "supply": """
SELECT CAST(substr(p_brand, 7) AS INT) AS commodity_key, n_regionkey AS dim_key, l_returnflag AS metric_code,
       last_day(CAST(l_shipdate AS DATE)) AS observation_date, last_day(CAST(l_shipdate AS DATE)) + CAST(l_linenumber AS INT) AS release_date,
       CAST(l_orderkey % 2 AS INT) AS revision, l_extendedprice AS metric_value, l_orderkey * 10 + l_linenumber AS source_fact_id
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "event": """
SELECT CASE WHEN user_id % 3 = 0 THEN NULL ELSE CAST(1 + user_id % 25 AS INT) END AS commodity_key,
       CASE WHEN event_id % 2 = 0 THEN NULL ELSE CAST(user_id % 5 AS INT) END AS dim_key, event_type AS metric_code,
       CAST(ts AS DATE) AS observation_date, CAST(ts AS DATE) AS release_date, 0 AS revision, value AS metric_value, event_id AS source_fact_id
FROM events""",
    "series": """
SELECT CAST(substr(p_brand, 7) AS INT) AS commodity_key, CAST(o_orderdate AS DATE) AS price_date,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS DOUBLE) AS y
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "raw_price": """
SELECT l_orderkey, l_linenumber, l_suppkey, l_shipdate, CAST(substr(p_brand, 7) AS INT) AS commodity_key, l_returnflag AS source_code,
       CAST(o_orderdate AS DATE) AS observation_date, CAST(l_shipdate AS DATE) AS release_date, l_linenumber - 1 AS revision,
       CASE WHEN l_quantity > 48 THEN NULL ELSE l_extendedprice END AS value,
       CASE WHEN l_tax > 0.07 THEN NULL ELSE concat(CAST(l_orderkey AS VARCHAR), ':', CAST(l_linenumber AS VARCHAR), ':', CAST(l_suppkey AS VARCHAR)) END AS source_record_id
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
}


def _date(c: str):
    return F.col(c).cast("date")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", _date("o_orderdate").alias("o_date"))
    part = table(spark, sf_dir, "part").select("p_partkey", F.substring("p_brand", 7, 9).cast("int").alias("commodity_key"))
    lines = table(spark, sf_dir, "lineitem")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(part, lines["l_partkey"] == part["p_partkey"])


def dim_commodity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.substring("p_brand", 7, 9).cast("int").alias("commodity_key"), F.col("p_brand").alias("commodity_code")).distinct()


def price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily prices: close, else settle (which these tables lack), else value."""
    close = F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice") - 1)
    return _lines(spark, sf_dir).select(
        "commodity_key",
        F.when(F.col("l_suppkey") % 5 != 4, (F.col("l_suppkey") % 5).cast("int")).alias("dim_key"),
        F.lit("price_close").alias("metric_code"),
        F.col("o_date").alias("observation_date"),
        F.greatest(_date("l_shipdate"), "o_date").alias("release_date"),
        (F.col("l_linenumber") - 1).alias("revision"),
        F.coalesce(close, "l_extendedprice").alias("metric_value"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("source_fact_id"),
    )


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return (
        table(spark, sf_dir, "orders")
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            (1 + F.col("o_custkey") % 25).cast("int").alias("commodity_key"),
            F.col("n_regionkey").alias("dim_key"),
            F.lower(F.substring("o_orderpriority", 3, 99)).alias("metric_code"),
            _date("o_orderdate").alias("observation_date"),
            F.date_add(_date("o_orderdate"), (F.col("o_orderkey") % 7).cast("int")).alias("release_date"),
            (F.col("o_orderkey") % 2).cast("int").alias("revision"),
            F.col("o_totalprice").alias("metric_value"),
            F.col("o_orderkey").alias("source_fact_id"),
        )
    )


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.when(F.col("user_id") % 5 != 0, (1 + F.col("user_id") % 25).cast("int")).alias("commodity_key"),
        F.lit(None).cast("int").alias("dim_key"),
        F.col("event_type").alias("metric_code"),
        _date("ts").alias("observation_date"),
        F.date_add(_date("ts"), (F.col("user_id") % 4).cast("int")).alias("release_date"),
        (F.col("event_id") % 3).cast("int").alias("revision"),
        F.col("value").alias("metric_value"),
        F.col("event_id").alias("source_fact_id"),
    )


def logistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.last_day(_date("l_shipdate"))
    return table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_suppkey") % 5 != 0, (1 + F.col("l_partkey") % 25).cast("int")).alias("commodity_key"),
        F.when(F.col("l_suppkey") % 3 != 0, (F.col("l_suppkey") % 5).cast("int")).alias("dim_key"),
        F.col("l_linestatus").alias("metric_code"),
        end.alias("observation_date"),
        F.date_add(end, F.col("l_linenumber").cast("int")).alias("release_date"),
        (F.col("l_orderkey") % 2).cast("int").alias("revision"),
        F.col("l_quantity").alias("metric_value"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("source_fact_id"),
    )


def supply(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    part = table(spark, sf_dir, "part").select("p_partkey", F.substring("p_brand", 7, 9).cast("int").alias("commodity_key"))
    end = F.last_day(_date("l_shipdate"))
    return (
        table(spark, sf_dir, "lineitem")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .select(
            "commodity_key",
            F.col("n_regionkey").alias("dim_key"),
            F.col("l_returnflag").alias("metric_code"),
            end.alias("observation_date"),
            F.date_add(end, F.col("l_linenumber").cast("int")).alias("release_date"),
            (F.col("l_orderkey") % 2).cast("int").alias("revision"),
            F.col("l_extendedprice").alias("metric_value"),
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("source_fact_id"),
        )
    )


def event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.when(F.col("user_id") % 3 != 0, (1 + F.col("user_id") % 25).cast("int")).alias("commodity_key"),
        F.when(F.col("event_id") % 2 != 0, (F.col("user_id") % 5).cast("int")).alias("dim_key"),
        F.col("event_type").alias("metric_code"),
        _date("ts").alias("observation_date"),
        _date("ts").alias("release_date"),
        F.lit(0).alias("revision"),
        F.col("value").alias("metric_value"),
        F.col("event_id").alias("source_fact_id"),
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value a day for each commodity."""
    y = F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double")
    return _lines(spark, sf_dir).groupBy("commodity_key", F.col("o_date").alias("price_date")).agg(y.alias("y"))


def raw_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming price records as they come: release dates before the date, missing values and record ids among them."""
    record = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_suppkey")
    return _lines(spark, sf_dir).select(
        "l_orderkey",
        "l_linenumber",
        "l_suppkey",
        "l_shipdate",
        "commodity_key",
        F.col("l_returnflag").alias("source_code"),
        F.col("o_date").alias("observation_date"),
        _date("l_shipdate").alias("release_date"),
        (F.col("l_linenumber") - 1).alias("revision"),
        F.when(~(F.col("l_quantity") > 48), F.col("l_extendedprice")).alias("value"),
        F.when(~(F.col("l_tax") > 0.07), record).alias("source_record_id"),
    )


FAMILIES = {"price": price, "weather": weather, "macro": macro, "logistics": logistics, "supply": supply, "event": event}
