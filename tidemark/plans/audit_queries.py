"""Queries of restatement, dimensions and profiles, and audits beyond the first ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import features
from tidemark.operators import asof, audit, registry, restate
from tidemark.plans.registry import query, rounded
from tidemark.plans.registry import with_facts as _with
from tidemark.sources import star

TODAY = "2001-08-01"
_SIDES = f""", stored AS (SELECT commodity_key AS key, price_date AS day, y AS value, CAST(commodity_key % 3 AS INT) AS revision FROM series WHERE price_date < DATE '2001-01-01' AND commodity_key <> 3),
fetched AS (SELECT commodity_key AS key, price_date AS day, CASE WHEN commodity_key % 4 = 0 THEN y * 1.5 ELSE y END AS value, price_date + 2 AS release_date FROM series WHERE price_date <= DATE '{TODAY}' AND commodity_key <> 5
  AND (commodity_key <> 7 OR price_date >= DATE '2001-02-01') AND (commodity_key <> 8 OR price_date >= DATE '2000-11-01') AND (commodity_key <> 9 OR price_date < DATE '2001-01-01')),
joined AS (SELECT key, day, s.value AS old, revision, f.value AS new FROM stored s FULL JOIN fetched f USING (key, day)),
ranked AS (SELECT *, old IS NOT NULL AND new IS NOT NULL AND day <> DATE '{TODAY}' AS anchor, row_number() OVER (PARTITION BY key ORDER BY CASE WHEN old IS NOT NULL AND new IS NOT NULL AND day <> DATE '{TODAY}' THEN day END DESC NULLS LAST) AS r FROM joined),
sums AS (SELECT key, count(old) AS n_stored, count(new) AS n_fetched, count(*) FILTER (WHERE anchor AND r <= 5) AS anchors, count(*) FILTER (WHERE anchor AND r <= 5 AND abs(new / old - 1) * 100 > 0.1) AS mismatched,
  count(*) FILTER (WHERE old IS NOT NULL AND new IS NOT NULL) AS n_shared, count(*) FILTER (WHERE old IS NULL) AS n_new, max(revision) AS revision FROM ranked GROUP BY 1),
judged AS (SELECT *, CASE WHEN n_stored = 0 THEN 'empty' WHEN n_fetched = 0 THEN 'error' WHEN anchors = 0 THEN 'no_anchor' WHEN mismatched > 0 AND n_shared < 0.9 * n_stored THEN 'error'
  WHEN mismatched > 0 THEN 'restated' WHEN n_new > 0 THEN 'appended' ELSE 'fresh' END AS status FROM sums)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = star.series(spark, sf_dir).select(F.col("commodity_key").alias("key"), F.col("price_date").alias("day"), F.col("y").alias("value"))
    stored = rows.filter("day < '2001-01-01' and key <> 3").withColumn("revision", (F.col("key") % 3).cast("int"))
    fetched = rows.filter(f"day <= '{TODAY}' and key <> 5 and (key <> 7 or day >= '2001-02-01') and (key <> 8 or day >= '2000-11-01') and (key <> 9 or day < '2001-01-01')")
    return stored, fetched.withColumn("release_date", F.date_add("day", 2)).withColumn("value", F.when(F.col("key") % 4 == 0, F.col("value") * 1.5).otherwise(F.col("value")))


@query("reconcile_status", _with("series", rest=_SIDES + " SELECT * FROM judged"))
def reconcile_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restate.statuses(*_sides(spark, sf_dir), TODAY)


@query("reconcile_append", _with("series", rest=_SIDES + f""" SELECT f.key, f.day, f.value, (j.revision + (status = 'restated')::INT)::INT AS revision, CASE WHEN status = 'restated' THEN greatest(DATE '{TODAY}', f.day) ELSE f.release_date END AS release_date,
  concat(f.key, ':', f.day, CASE WHEN j.revision + (status = 'restated')::INT > 0 THEN concat('@r', j.revision + (status = 'restated')::INT) ELSE '' END) AS record_id
FROM fetched f JOIN judged j USING (key) LEFT JOIN stored s USING (key, day) WHERE status = 'restated' OR (status = 'appended' AND s.value IS NULL)"""))
def reconcile_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, fetched = _sides(spark, sf_dir)
    return restate.new_rows(stored, fetched, restate.statuses(stored, fetched, TODAY), TODAY)


@query("restated_jump", _with("series", rest=_SIDES + """, c AS (SELECT key, abs(value / lag(value) OVER (PARTITION BY key ORDER BY day) - 1) * 100 AS c FROM fetched)
SELECT key, round(coalesce(max(c), 0.0), 6) AS worst_pct FROM c GROUP BY 1"""))
def restated_jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(restate.jumps(_sides(spark, sf_dir)[1]), "worst_pct")


@query("append_jumps", _with("series", rest=_SIDES + """, rows AS (SELECT f.key, f.day, f.value, status FROM fetched f JOIN judged j USING (key) LEFT JOIN stored s USING (key, day) WHERE status = 'restated' OR (status = 'appended' AND s.value IS NULL)),
edge AS (SELECT key, max(day) AS day, arg_max(value, day) AS value FROM stored WHERE key IN (SELECT key FROM rows WHERE status = 'appended') GROUP BY 1),
c AS (SELECT key, abs(value / lag(value) OVER (PARTITION BY key ORDER BY day) - 1) * 100 AS c FROM (SELECT key, day, value FROM rows UNION ALL SELECT key, day, value FROM edge))
SELECT key, round(coalesce(max(c), 0.0), 6) AS worst_pct, coalesce(max(c), 0.0) > 30 AS jump FROM c GROUP BY 1"""))
def append_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abnormal changes in what is to be written, the step from what is stored among them."""
    stored, fetched = _sides(spark, sf_dir)
    rows = restate.new_rows(stored, fetched, restate.statuses(stored, fetched, TODAY), TODAY)
    return rounded(restate.warnings(stored, rows), "worst_pct")


@query("reconcile_summary", _with("series", rest=_SIDES + " SELECT status, count(*) AS n, (SELECT count(*) = 0 FROM judged WHERE status IN ('error', 'no_anchor')) AS ok FROM judged GROUP BY 1"))
def reconcile_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restate.histogram(reconcile_status(spark, sf_dir))


_GRAIN = "concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '-')" for c in ("commodity_key", "dim_key", "metric_code", "observation_date", "release_date", "revision", "source_fact_id")) + ")"


@query("fact_fingerprint", " UNION ALL ".join(f"""SELECT '{f}' AS family, count(*) AS n_rows, max(observation_date) AS last_date, max(revision) AS last_revision,
  CAST(sum(CAST(('0x' || md5({_GRAIN})[1:12])::BIGINT AS HUGEINT)) AS VARCHAR) AS grain_sum FROM ({star.SQL[f]})""" for f in star.FAMILIES))
def fact_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [audit.fact_fingerprint(read(spark, sf_dir).withColumn("family", F.lit(f)), "family").withColumn("last_revision", F.col("last_revision").cast("long")) for f, read in star.FAMILIES.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_PARITY = """, a AS (SELECT commodity_key, dim_key, observation_date, max(metric_value) AS v FROM price GROUP BY ALL),
b AS (SELECT commodity_key, dim_key, observation_date, CASE WHEN day(observation_date) = 7 THEN v + 1 ELSE v END AS v FROM a WHERE commodity_key <> 11)"""


@query("parity_audit", _with("price", rest=_PARITY + """ SELECT count(*) FILTER (WHERE b.v IS NOT NULL) AS n_both, count(*) FILTER (WHERE b.v IS NULL) AS n_left, 0::BIGINT AS n_right, count(*) FILTER (WHERE a.v <> b.v) AS n_differ
FROM a LEFT JOIN b ON a.commodity_key = b.commodity_key AND a.dim_key IS NOT DISTINCT FROM b.dim_key AND a.observation_date = b.observation_date"""))
def parity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ("commodity_key", "dim_key", "observation_date")
    a = star.price(spark, sf_dir).groupBy(*key).agg(F.max("metric_value").alias("v"))
    b = a.filter("commodity_key <> 11").withColumn("v", F.when(F.dayofmonth("observation_date") == 7, F.col("v") + 1).otherwise(F.col("v")))
    return audit.parity(a, b, key, ("v",))


_EVERY = ", every AS (" + " UNION ALL ".join(f"SELECT '{f}/' || metric_code AS metric_code, observation_date, release_date FROM {f}" for f in star.FAMILIES) + ")"


def _every(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of all six families, a metric's code with its family before it."""
    parts = [read(spark, sf_dir).select(F.concat(F.lit(f"{f}/"), "metric_code").alias("metric_code"), "observation_date", "release_date") for f, read in star.FAMILIES.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("vintage_coverage", _with(*star.FAMILIES, rest=_EVERY + """, d AS (SELECT metric_code, release_date, CAST(floor(year(release_date) / 10) * 10 AS INT) AS decade FROM every),
h AS (SELECT metric_code, decade, count(*) AS n FROM d GROUP BY 1, 2), t AS (SELECT metric_code, string_agg(decade || '=' || n, ',' ORDER BY decade) AS decades FROM h GROUP BY 1)
SELECT metric_code, min(release_date) AS first_release, max(release_date) AS last_release, count(*) FILTER (WHERE release_date IS NULL) AS n_missing, any_value(decades) AS decades FROM d JOIN t USING (metric_code) GROUP BY 1"""))
def vintage_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.vintages(_every(spark, sf_dir), "metric_code")


_CUTS = ["1994-12-31", "1995-06-30", "1998-01-01", "2001-01-01"]


@query("fold_visibility", _with("supply", rest=f""", cuts AS (SELECT CAST(unnest([{", ".join(f"'{c}'" for c in _CUTS)}]) AS DATE) AS cut), roles AS (SELECT unnest(['R', 'A', 'N']) AS role),
n AS (SELECT g.commodity_key, cut, role, (SELECT count(*) FROM supply s WHERE s.commodity_key = g.commodity_key AND metric_code = role AND release_date <= cut) AS n FROM (SELECT DISTINCT commodity_key FROM supply) g, cuts, roles)
SELECT commodity_key, cut, min(n) AS least_rows, min(n) > 0 AS visible FROM n GROUP BY 1, 2"""))
def fold_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.visible_at(star.supply(spark, sf_dir), _CUTS, "commodity_key", "metric_code", ["R", "A", "N"])


@query("year_histogram", _with(*star.FAMILIES, rest=_EVERY + """, h AS (SELECT metric_code, year(observation_date) AS y, count(*) AS n FROM every GROUP BY 1, 2) SELECT metric_code, string_agg(y || '=' || n, ',' ORDER BY y) AS years FROM h GROUP BY 1"""))
def year_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.histogram(_every(spark, sf_dir), "metric_code", F.year("observation_date"), "years")


_LEVELS = ["metric_code", "commodity_key", "dim_key"]
_ROLLED = "CASE WHEN source_fact_id % 11 = 0 THEN 0.0 ELSE metric_value END AS v, year(observation_date) AS y, CASE WHEN revision = 0 THEN 't' ELSE 'kt' END AS unit"


@query("coverage_rollup", _with("supply", rest=f""", b AS (SELECT metric_code, commodity_key, dim_key, {_ROLLED} FROM supply),
s AS (SELECT metric_code, commodity_key, dim_key, (3 - GROUPING(metric_code) - GROUPING(commodity_key) - GROUPING(dim_key))::INT AS depth, count(*) AS n_rows, count(*) FILTER (WHERE v > 0) AS n_positive, count(*) FILTER (WHERE v = 0) AS n_zero,
  min(y)::INT AS first_year, max(y)::INT AS last_year, max(y) - min(y) + 1 - count(DISTINCT y) AS missing_years, list_sort(list(y)) AS ys, list_sort(list(unit)) AS us
  FROM b GROUP BY GROUPING SETS ((metric_code, commodity_key, dim_key), (metric_code, commodity_key), (metric_code), ()))
SELECT metric_code, commodity_key, dim_key, depth, n_rows, n_positive, n_zero, first_year, last_year, missing_years,
  array_to_string(list_transform(list_sort(list_distinct(ys)), lambda q: q || '=' || len(list_filter(ys, lambda z: z = q))), ',') AS years,
  array_to_string(list_transform(list_sort(list_distinct(us)), lambda q: q || '=' || len(list_filter(us, lambda z: z = q))), ',') AS units FROM s"""))
def coverage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage by metric, commodity and region, and rolled up to commodities, metrics and all, in one pass over the facts."""
    facts = star.supply(spark, sf_dir).withColumns({"v": F.when(F.col("source_fact_id") % 11 == 0, 0.0).otherwise(F.col("metric_value")), "unit": F.when(F.col("revision") == 0, "t").otherwise("kt")})
    out = audit.rolled_up(facts, _LEVELS, "v", F.year("observation_date"), "unit").withColumn("missing_years", F.col("missing_years").cast("long"))
    return out.withColumns({c: F.array_join(F.transform(F.map_entries(c), lambda x: F.concat_ws("=", x["key"].cast("string"), x["value"].cast("string"))), ",") for c in ("years", "units")})


@query("source_coverage", """SELECT l_shipmode_name AS source, count(l_orderkey) AS n_rows, count(DISTINCT l_partkey) AS n_parts FROM (SELECT unnest(['R', 'A', 'N', 'X']) AS l_shipmode_name) LEFT JOIN lineitem ON l_returnflag = l_shipmode_name GROUP BY 1""")
def source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = spark.createDataFrame([("R",), ("A",), ("N",), ("X",)], "source string")
    counts = star.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("source")).agg(F.count("l_orderkey").alias("n_rows"), F.count_distinct("l_partkey").alias("n_parts"))
    return sources.join(counts, "source", "left").fillna(0, ["n_rows", "n_parts"])


# --- dimensions and profiles

_DIM = """o AS (SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST(s_nationkey AS INT) END AS region FROM supplier WHERE s_suppkey % 5 <> 0),
n AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name || '!' WHEN s_suppkey % 7 = 0 THEN NULL ELSE s_name END AS s_name, CAST(s_nationkey + 1 AS INT) AS region FROM supplier WHERE s_suppkey % 6 <> 1)"""


@query("dim_upsert", f"""WITH {_DIM}, m AS (SELECT coalesce(o.s_suppkey, n.s_suppkey) AS s_suppkey, coalesce(n.s_name, o.s_name) AS s_name, coalesce(o.region, n.region) AS region, o.s_suppkey AS a, n.s_suppkey AS b, o.s_name AS on_, o.region AS orr FROM o FULL JOIN n ON o.s_suppkey = n.s_suppkey)
SELECT s_suppkey, s_name, region, CASE WHEN a IS NULL THEN 'created' WHEN b IS NULL THEN 'kept' WHEN s_name IS NOT DISTINCT FROM on_ AND region IS NOT DISTINCT FROM orr THEN 'unchanged' ELSE 'updated' END AS change FROM m""")
def dim_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = star.table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    old = rows.filter(key % 5 != 0).select("s_suppkey", "s_name", F.when(key % 4 != 0, F.col("s_nationkey").cast("int")).alias("region"))
    name = F.when(key % 3 == 0, F.concat("s_name", F.lit("!"))).when(key % 7 != 0, F.col("s_name"))
    new = rows.filter(key % 6 != 1).select("s_suppkey", name.alias("s_name"), (F.col("s_nationkey") + 1).cast("int").alias("region"))
    return registry.upsert(old, new, "s_suppkey", fill_only=("region",))


@query("seed_absent", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def seed_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = star.table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return registry.insert_absent(nation.filter("n_regionkey <> 2"), nation, "n_nationkey").drop("n_regionkey")


_SUM = "sha256(concat_ws(':', count(*), CAST(sum(CAST(('0x' || md5(concat_ws('|', p_name, p_partkey))[1:12])::BIGINT AS HUGEINT)) AS VARCHAR)))"


@query("registry_version", f"""WITH held AS (SELECT p_brand AS profile, {_SUM} AS checksum, 1 + length(p_brand) AS version FROM part WHERE p_partkey % 9 <> 0 AND p_brand <> 'Brand#13' GROUP BY 1),
loaded AS (SELECT p_brand AS profile, {_SUM} AS checksum FROM part WHERE p_partkey % 9 <> 0 OR p_brand LIKE '%5' GROUP BY 1)
SELECT l.profile, l.checksum, CAST(CASE WHEN h.checksum IS NULL THEN 1 ELSE version + (h.checksum <> l.checksum)::INT END AS INT) AS version,
  CASE WHEN h.checksum IS NULL THEN 'created' WHEN h.checksum = l.checksum THEN 'unchanged' ELSE 'updated' END AS change FROM loaded l LEFT JOIN held h USING (profile)""")
def registry_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = star.table(spark, sf_dir, "part").withColumnRenamed("p_brand", "profile")
    own = registry.checksum("p_name", "p_partkey").alias("checksum")
    held = part.filter("p_partkey % 9 <> 0 and profile <> 'Brand#13'").groupBy("profile").agg(own).withColumn("version", 1 + F.length("profile"))
    loaded = part.filter("p_partkey % 9 <> 0 or profile like '%5'").groupBy("profile").agg(own)
    return registry.versions(held, loaded, "profile")


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: star.table(spark, sf_dir, name)
    entries = F.array_sort(F.collect_list(F.struct(F.col("n_name").alias("code"), F.col("n_nationkey").alias("weight"))))
    own = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("profile_code"), "r_regionkey").agg(entries.alias("growing_regions"))
    start = F.struct(F.when(F.col("r_regionkey") % 2 == 0, "2001-02-03").otherwise("soon").alias("min_train_start_date"))
    return own.select("profile_code", F.to_json(F.struct("growing_regions", start.alias("features"))).alias("profile"))


@query("profile_bridge", "SELECT r_name AS profile_code, n_name AS code, CAST(n_nationkey AS INT) AS weight FROM nation JOIN region ON n_regionkey = r_regionkey")
def profile_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.bridge(_profiles(spark, sf_dir), "profile_code", "growing_regions", "code:string,weight:int")


@query("profile_composition", """SELECT r_name AS profile_code, count(*) AS growing_regions, 0::BIGINT AS instruments, CASE WHEN any_value(r_regionkey) % 2 = 0 THEN DATE '2001-02-03' END AS train_start FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def profile_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profiles(spark, sf_dir).select("profile_code", registry.composition("growing_regions").alias("growing_regions"), registry.composition("instruments").alias("instruments"), registry.train_start().alias("train_start"))


_LABEL = "element_at(array('daily', 'weekly', 'monthly', 'yearly'), n_nationkey % 4 + 1)"


@query("profile_models", """WITH m AS (SELECT r_name AS profile_code, n_name AS model_code, 'f' || n_nationkey % 3 AS family, ['daily', 'weekly', 'monthly', 'yearly'][n_nationkey % 4 + 1] AS horizon FROM nation JOIN region ON n_regionkey = r_regionkey),
w AS (SELECT * FROM m WHERE horizon = 'weekly')
SELECT r_name AS profile_code, model_code, family, horizon, CASE WHEN horizon = 'weekly' THEN 5 END AS days, CASE WHEN model_code IS NULL THEN 'no horizon weekly' END AS error FROM region LEFT JOIN w ON r_name = profile_code""")
def profile_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weekly models of each profile."""
    nations = star.table(spark, sf_dir, "nation").join(star.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    entry = F.struct(F.col("n_name").alias("model_code"), F.concat(F.lit("f"), (F.col("n_nationkey") % 3).cast("string")).alias("family"), F.expr(_LABEL).alias("horizon"))
    profiles = nations.groupBy(F.col("r_name").alias("profile_code")).agg(F.to_json(F.struct(F.collect_list(entry).alias("models"))).alias("profile"))
    return registry.models(profiles, "profile_code", horizon="weekly")


# --- small reads and features


@query("second_differences", _with("series", rest=""" SELECT commodity_key, price_date, round(y - lag(y) OVER w, 4) AS d1, round(y - 2 * lag(y) OVER w + lag(y, 2) OVER w, 4) + 0.0 AS d2 FROM series WINDOW w AS (PARTITION BY commodity_key ORDER BY price_date)"""))
def second_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = features.ordered()
    d1 = F.col("y") - F.lag("y").over(w)
    d2 = F.col("y") - 2 * F.lag("y").over(w) + F.lag("y", 2).over(w)
    return rounded(star.series(spark, sf_dir).select("commodity_key", "price_date", d1.alias("d1"), d2.alias("d2")), "d1", "d2", places=4)


@query("rows_per_year", _with("series", rest=" SELECT commodity_key, round(count(*) / ((max(price_date) - min(price_date)) / 365.25), 6) AS rows_per_year FROM series GROUP BY 1 HAVING max(price_date) > min(price_date)"))
def rows_per_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = star.series(spark, sf_dir).groupBy("commodity_key").agg(F.count("*").alias("n"), F.datediff(F.max("price_date"), F.min("price_date")).alias("d")).filter("d > 0")
    return rounded(own.select("commodity_key", (F.col("n") / (F.col("d") / 365.25)).alias("rows_per_year")), "rows_per_year")


@query("future_fill", """WITH g AS (SELECT o_custkey, o_orderdate, o_orderkey, CASE WHEN o_orderkey % 4 = 1 THEN o_totalprice END AS v FROM orders)
SELECT o_custkey, o_orderkey, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), first_value(v IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS v FROM g""")
def future_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drivers of days to come: the last known value, and before the first one that one."""
    rows = star.table(spark, sf_dir, "orders").select("o_custkey", F.struct("o_orderdate", "o_orderkey").alias("at"), "o_orderkey", F.when(F.col("o_orderkey") % 4 == 1, F.col("o_totalprice")).alias("v"))
    return features.fill_both_ways(rows, "o_custkey", "at", "v").drop("at")


@query("search_parts", "SELECT p_partkey, p_brand FROM part WHERE contains(lower(p_name), 'bl') OR contains(lower(p_brand), 'bl') ORDER BY p_brand, p_partkey")
def search_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search for a part of a name or a code, whatever the case, in the order of the codes."""
    hit = F.lower("p_name").contains("bl") | F.lower("p_brand").contains("bl")
    return star.table(spark, sf_dir, "part").filter(hit).select("p_partkey", "p_brand").orderBy("p_brand", "p_partkey")


@query("metric_catalogue", _with(*star.FAMILIES, rest=" SELECT DISTINCT regexp_replace(lower(metric_code), '[^a-z0-9_]', '_', 'g') AS name, metric_code FROM (" + " UNION ALL ".join(f"SELECT metric_code FROM {f}" for f in star.FAMILIES) + ")"))
def metric_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics that there are, with names that are fit for columns."""
    return asof.column_names(_every(spark, sf_dir).select(F.substring_index("metric_code", "/", -1).alias("metric_code")))
