"""Queries over landed bodies: bodies are put together from the tables, parsed, and must give back what went in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import parse
from tidemark.plans.registry import query
from tidemark.sources import landed, star


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = star.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice", F.col("o_orderdate").cast("date").alias("day"))
    return own.withColumn("seconds", (F.unix_date("day") * 86400 + F.col("o_orderkey") % 80000).cast("string"))


_FIRST = "SELECT o_custkey, CAST(o_orderdate AS DATE) AS observation_date, arg_min(o_totalprice, o_orderkey) AS p FROM orders WHERE o_orderkey % 7 <> 0 GROUP BY 1, 2"


@query("parse_chart_arrays", f"SELECT o_custkey, observation_date, round(p * 10, 6) AS value, observation_date AS release_date FROM ({_FIRST})")
def parse_chart_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    bar = F.struct("o_orderkey", "seconds", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice").cast("string")).otherwise("NaN").alias("close"))
    bars = _orders(spark, sf_dir).groupBy("o_custkey").agg(F.array_sort(F.collect_list(bar)).alias("bars"))
    bodies = bars.select("o_custkey", F.to_json(F.struct(F.col("bars.seconds").alias("t"), F.col("bars.close").alias("c"))).alias("body"))
    return landed.daily_closes(bodies, ("o_custkey",), scale=10.0)


@query("parse_gold_results", f"""SELECT o_custkey, observation_date, p AS value, CASE WHEN o_custkey % 2 = 0 THEN p END AS buy, observation_date + 2 AS release_date FROM ({_FIRST})""")
def parse_gold_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    sell = F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).otherwise(-1.0).cast("string")
    row = F.struct("o_orderkey", F.col("seconds").alias("datetime"), sell.alias("sell_1l"), F.when(F.col("o_custkey") % 2 == 0, F.col("o_totalprice").cast("string")).otherwise("").alias("buy_1l"))
    rows = _orders(spark, sf_dir).groupBy("o_custkey").agg(F.array_sort(F.collect_list(row)).alias("results"))
    bodies = rows.select("o_custkey", F.to_json(F.struct("results")).alias("body"))
    return landed.gold_history(bodies, ("o_custkey",), "sell_1l", "buy_1l", lag=2)


@query("parse_weather_maps", """WITH d AS (SELECT o_custkey, o_orderpriority AS p, CAST(o_orderdate AS DATE) AS observation_date, max(o_totalprice) AS value FROM orders GROUP BY 1, 2, 3)
SELECT o_custkey, CASE p WHEN '1-URGENT' THEN 'urgent' ELSE lower(p) END AS metric_code, observation_date, value, observation_date + 1 AS release_date FROM d WHERE value < 250000""")
def parse_weather_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = _orders(spark, sf_dir).groupBy("o_custkey", "o_orderpriority", "day").agg(F.max("o_totalprice").alias("v"))
    entry = F.struct(F.date_format("day", "yyyyMMdd").alias("key"), F.when(F.col("v") < 250000, F.col("v")).otherwise(-999.0).alias("value"))
    maps = daily.groupBy("o_custkey", "o_orderpriority").agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    bodies = maps.groupBy("o_custkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "m")))).alias("body"))
    return landed.weather(bodies, ("o_custkey",), {"1-URGENT": "urgent"})


_SEASONS = list(parse.SEASON_END)


@query("parse_index_lines", f"""WITH s AS (SELECT event_id, 1950 + event_id % 70 AS y, list_value({", ".join(f"'{x}'" for x in _SEASONS)})[event_id % 12 + 1] AS s, list_value({", ".join(str(x) for x in parse.SEASON_END.values())})[event_id % 12 + 1] AS m,
  CAST(user_id AS DOUBLE) / 4 AS value FROM events WHERE event_id % 5 <> 0)
SELECT 'el_nino_la_nina' AS metric_code, make_date(CAST(y + (s = 'NDJ')::INT AS BIGINT), m, 1) AS observation_date, value, make_date(CAST(y + (s = 'NDJ')::INT AS BIGINT), m, 1) + 33 AS release_date FROM s""")
def parse_index_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    season = F.element_at(F.array(*map(F.lit, _SEASONS)), (F.col("event_id") % 12 + 1).cast("int"))
    value = (F.col("user_id") / 4).cast("string")
    line = F.when(F.col("event_id") % 5 == 0, F.lit("YR  SEAS TOTAL")).otherwise(F.concat_ws("  ", F.lit(""), 1950 + F.col("event_id") % 70, season, F.lit("24.72"), value))
    return landed.oceanic_index(star.table(spark, sf_dir, "events").select(line.alias("value")), lag=2)


@query("parse_spot_prices", """SELECT o_orderkey, DATE '2001-08-01' AS observation_date, CASE WHEN o_orderkey % 4 = 1 AND o_orderkey % 3 = 0 THEN 1000.0 ELSE CAST(1000000 + o_orderkey % 900000 AS DOUBLE) END AS value, DATE '2001-08-01' AS release_date FROM orders
WHERE NOT (o_orderkey % 4 = 0 AND o_orderkey % 3 = 0)""")
def parse_spot_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of all four formats; a third of those of two formats lack the product or its price. A row of the table whose
    price is missing has 1.000 as its last positive number."""
    n, key = (1000000 + F.col("o_orderkey") % 900000).cast("string"), F.concat(F.lit("Item & Son "), F.col("o_orderkey").cast("string"))
    grouped = F.concat_ws(".", F.substring(n, 1, 1), F.substring(n, 2, 3), F.substring(n, 5, 3))
    lacks = F.col("o_orderkey") % 3 == 0
    masp = F.concat(F.lit(" p"), F.col("o_orderkey").cast("string"))
    items = F.to_json(F.struct(F.array(F.struct(F.lit("other").alias("masp"), F.lit("5").alias("giaban")), F.struct(masp.alias("masp"), F.when(~lacks, n).otherwise("").alias("giaban"))).alias("data")))
    cells = lambda name, price: F.concat(F.lit("<TR class=x><td><b>"), name, F.lit("</b></td><td>kg</td><td>1.000</td><td> "), price, F.lit("</td></TR>\n"))
    table_ = F.concat(cells(F.lit("Other"), F.lit("7.000")), cells(F.replace(key, F.lit("&"), F.lit("&amp;")), F.when(lacks, F.lit("_")).otherwise(grouped)))
    page = F.concat(F.lit("<p>Trung bình <b>90.000</b> VNĐ/kg</p><td>"), F.lower(key), F.lit("</td>\n<td>"), grouped, F.lit("</td>"))
    board = F.to_json(F.struct(F.array(F.struct(F.lit("x").alias("Title"), F.lit("y").alias("EnglishTitle"), F.lit("3").alias("Zone1Price")), F.struct(F.lit("z").alias("Title"), F.concat(F.lit("  "), key).alias("EnglishTitle"), n.alias("Zone1Price"))).alias("Objects")))
    kind = F.col("o_orderkey") % 4
    bodies = star.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(kind == 0, "list").when(kind == 1, "table").when(kind == 2, "region").otherwise("board").alias("format"),
        F.when(kind == 0, F.upper(F.trim(masp))).otherwise(key).alias("product"),
        F.when(kind == 0, items).when(kind == 1, F.when(lacks, cells(key, F.lit("_"))).otherwise(table_)).when(kind == 2, page).otherwise(board).alias("body"),
    )
    return landed.spot_prices(bodies, ("o_orderkey",), "2001-08-01")


@query("parse_page_html", """SELECT page_id, coalesce(regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1), '') AS title, len(regexp_extract_all(html, '(?is)<li\\b.*?</li>')) AS n_items, len(regexp_extract_all(html, '(?is)<p\\b.*?</p>')) AS n_paragraphs FROM pages""")
def parse_page_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    title = F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1)
    count = lambda tag: F.size(parse.elements(html, tag)).cast("long")
    return star.table(spark, sf_dir, "pages").select("page_id", title.alias("title"), count("li").alias("n_items"), count("p").alias("n_paragraphs"))


@query("url_origin", """SELECT page_id, nullif(lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)), '') AS origin, CASE WHEN length(url) > 30 THEN 'sha256:' || substr(sha256(url), 1, 16) ELSE url END AS short_url,
  regexp_matches(url, '^https?://') AS is_url FROM pages""")
def url_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return star.table(spark, sf_dir, "pages").select("page_id", parse.url_origin(url).alias("origin"), parse.short_url(url, 30).alias("short_url"), parse.is_url(url).alias("is_url"))


_BULK = """bulk AS (SELECT p_brand AS commodity_id, l_suppkey % 4 AS attribute_id, n_name AS country, year(CAST(l_shipdate AS DATE)) AS year, max(month(CAST(l_shipdate AS DATE))) % 3 AS month, sum(CAST(l_quantity AS BIGINT))::DOUBLE AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2, 3, 4)"""


def _bulk(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    t = lambda name: star.table(spark, sf_dir, name)
    lines = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    ship = F.col("l_shipdate").cast("date")
    rows = lines.groupBy(F.col("p_brand").alias("commodity_id"), (F.col("l_suppkey") % 4).alias("attribute_id"), F.col("n_name").alias("country"), F.year(ship).alias("year")).agg(
        (F.max(F.month(ship)) % 3).alias("month"), F.sum(F.col("l_quantity").cast("long")).cast("double").alias("value")
    )
    rows = rows.withColumn("unit", F.lit(" t "))
    wanted = rows.select("commodity_id", "attribute_id", "country").distinct().filter("attribute_id < 2")
    wanted = wanted.withColumns({"commodity_code": F.upper("commodity_id"), "metric_code": F.concat(F.lit("attr_"), F.col("attribute_id").cast("string")), "region_code": F.col("country"), "unit": F.lit("t")})
    none = spark.createDataFrame([("Brand#11", 7, "NOWHERE", "BRAND#11", "attr_7", "NOWHERE", "t")], "commodity_id string, attribute_id long, country string, commodity_code string, metric_code string, region_code string, unit string")
    return rows, wanted.select(*none.columns).unionByName(none.withColumn("attribute_id", F.col("attribute_id").cast(wanted.schema["attribute_id"].dataType)))


@query("balance_sheet", f"""WITH {_BULK} SELECT upper(commodity_id) AS commodity_code, 'attr_' || attribute_id AS metric_code, country AS region_code, make_date(year, greatest(month, 1), 1) AS period_start,
  make_date(year, greatest(month, 1), 1) + 365 AS period_end, DATE '2002-02-02' AS release_date, value FROM bulk WHERE attribute_id < 2""")
def balance_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, wanted = _bulk(spark, sf_dir)
    found = landed.balance_sheet(rows, wanted.filter("country <> 'NOWHERE'"), "2002-02-02")
    return found.select("commodity_code", "metric_code", "region_code", "period_start", "period_end", "release_date", "value")


@query("balance_sheet_missing", "SELECT 'BRAND#11' AS commodity_code, 'attr_7' AS metric_code, 'NOWHERE' AS region_code")
def balance_sheet_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landed.unmatched(*_bulk(spark, sf_dir)).select("commodity_code", "metric_code", "region_code")
