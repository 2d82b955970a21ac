"""The library's queries over the star-schema tables, by name, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import dates, features, parse
from tidemark.operators import asof, audit, forecast, intake, kernels, revisions, shared, writer
from tidemark.plans.registry import ORACLE_SQL, QUERIES, query, rounded
from tidemark.plans.registry import with_facts as _with
from tidemark.sources import star
from tidemark.streaming import panel

#: Order families: the last day of the panel, whose days begin with each commodity's first price. Event families: all
#: days that they have. And the day that reads take for today.
ORDER_END, EVENT_DAYS, TODAY = "2001-12-31", ("2024-01-01", "2024-02-10"), "2001-08-01"
ORDER_FAMILIES, EVENT_FAMILIES = ("price", "weather", "logistics", "supply"), ("macro", "event")
ORDER_METRICS = ["price_close", "urgent", "high", "medium", "not specified", "low", "O", "F", "R", "A", "N"]
EVENT_METRICS = ["click", "error", "purchase", "signup", "view"]
HORIZON, FOLDS, MIN_TRAIN = 30, 6, 252
#: Means of whole cents are the same in every engine, whatever the order of the sums.
CENTS = "CAST(round(y * 100) AS BIGINT)"


# --- point-in-time panel


def _fanned(family: str) -> str:
    return f"""fanned AS (
  SELECT f.* FROM {family} f JOIN dim_commodity d ON f.commodity_key = d.commodity_key
  UNION ALL
  SELECT d.commodity_key, f.dim_key, f.metric_code, f.observation_date, f.release_date, f.revision, f.metric_value, f.source_fact_id
  FROM {family} f, dim_commodity d WHERE f.commodity_key IS NULL
)"""


_ORDER_GRID = f"""first AS (SELECT commodity_key, min(observation_date) AS d FROM price GROUP BY 1),
days AS (SELECT commodity_key, CAST(unnest(generate_series(coalesce(d, DATE '2000-01-01'), DATE '{ORDER_END}', INTERVAL 1 DAY)) AS DATE) AS as_of_date
  FROM dim_commodity LEFT JOIN first USING (commodity_key))"""
_EVENT_GRID = f"""days AS (SELECT commodity_key, as_of_date FROM dim_commodity,
  (SELECT CAST(unnest(generate_series(DATE '{EVENT_DAYS[0]}', DATE '{EVENT_DAYS[1]}', INTERVAL 1 DAY)) AS DATE) AS as_of_date))"""


def _as_of_ctes(family: str) -> str:
    """CTEs up to ``panel`` by DuckDB's own as-of join."""
    return f""", {_fanned(family)}, daily AS (
  SELECT commodity_key, dim_key, coalesce(dim_key, -1) AS dk, metric_code, greatest(observation_date, release_date) AS since,
         max(ROW(observation_date, release_date, revision, source_fact_id, metric_value)) AS w
  FROM fanned GROUP BY ALL
), running AS (
  SELECT commodity_key, dim_key, dk, metric_code, since, max(w) OVER (PARTITION BY commodity_key, dk, metric_code ORDER BY since) AS w FROM daily
), keys AS (SELECT DISTINCT commodity_key, dim_key, coalesce(dim_key, -1) AS dk, metric_code FROM fanned),
{_EVENT_GRID if family in EVENT_FAMILIES else _ORDER_GRID},
grid AS (SELECT * FROM days JOIN keys USING (commodity_key)),
panel AS (
  SELECT g.as_of_date, g.commodity_key, g.dim_key, g.metric_code, w[5] AS metric_value, w[4] AS source_fact_id, w[1] AS observation_date, w[2] AS release_date
  FROM grid g ASOF JOIN running r ON g.commodity_key = r.commodity_key AND g.dk = r.dk AND g.metric_code = r.metric_code AND g.as_of_date >= r.since
)"""


_SCALAR = """, scalar AS (
  SELECT * FROM panel QUALIFY row_number() OVER (PARTITION BY as_of_date, commodity_key, metric_code
    ORDER BY dim_key NULLS FIRST, observation_date DESC, release_date DESC, source_fact_id DESC, metric_value DESC) = 1
)"""


def _spans(spark: SparkSession, sf_dir: str, family: str) -> DataFrame:
    dims = star.dim_commodity(spark, sf_dir)
    facts = star.FAMILIES[family](spark, sf_dir)
    if family in EVENT_FAMILIES:
        starts = dims.select("commodity_key", F.to_date(F.lit(EVENT_DAYS[0])).alias("first")).distinct()
        return asof.spans(asof.winners(facts, dims), starts, EVENT_DAYS[1])
    return asof.spans(asof.winners(facts, dims), asof.starts(star.price(spark, sf_dir), dims), ORDER_END)


def _panel(family: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: asof.on_days(_spans(spark, sf_dir, family))


def _facts_of(*families: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys(("dim_commodity", *(() if families[0] in EVENT_FAMILIES else ("price",)), *families)))


def _panel_sql(family: str, rest: str) -> str:
    return _with(*_facts_of(family), rest=_as_of_ctes(family) + rest)


def _panels_sql(families: tuple[str, ...], rest: str) -> str:
    """CTEs up to ``panel``, the union of several families' panels."""
    parts = ", ".join(f"p_{f} AS ({_panel_sql(f, ' SELECT * FROM panel')})" for f in families)
    return f"WITH {parts}, panel AS ({' UNION ALL '.join(f'SELECT * FROM p_{f}' for f in families)}){rest}"


for _family in star.FAMILIES:
    query(f"pit_asof_{_family}", _panel_sql(_family, " SELECT * FROM panel"))(_panel(_family))


@query("pit_time_grid", _with("dim_commodity", "price", rest=f", {_ORDER_GRID} SELECT commodity_key, as_of_date FROM days"))
def pit_time_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.time_grid(star.price(spark, sf_dir), ORDER_END, star.dim_commodity(spark, sf_dir))


@query("pit_time_grid_profiles", _with("dim_commodity", "price", rest=f""", named AS (SELECT commodity_key, CASE WHEN commodity_key % 3 = 0 THEN make_date(1993 + commodity_key % 5, 7, 1) END AS d FROM dim_commodity),
first AS (SELECT commodity_key, min(observation_date) AS f FROM price GROUP BY 1)
SELECT commodity_key, CAST(unnest(generate_series(coalesce(d, f, DATE '2000-01-01'), DATE '{ORDER_END}', INTERVAL 1 DAY)) AS DATE) AS as_of_date FROM named LEFT JOIN first USING (commodity_key)"""))
def pit_time_grid_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid where a third of the commodities has a profile that names the first day."""
    dims = star.dim_commodity(spark, sf_dir)
    day = F.concat_ws("-", (1993 + F.col("commodity_key") % 5).cast("string"), F.lit("07-01"))
    profile = F.when(F.col("commodity_key") % 3 == 0, F.to_json(F.struct(F.struct(day.alias("min_train_start_date")).alias("features")))).otherwise("{}")
    return asof.time_grid(star.price(spark, sf_dir), ORDER_END, dims, profiles=dims.select("commodity_key", profile.alias("profile")))


def _long_sql(family: str) -> str:
    """One row for each run of days on which a key's winner stays the same, out of the daily panel."""
    return _panel_sql(family, f""", runs AS (SELECT *, as_of_date - CAST(row_number() OVER (PARTITION BY commodity_key, dim_key, metric_code, source_fact_id, observation_date, release_date, metric_value ORDER BY as_of_date) AS INT) AS run FROM panel)
SELECT '{family}' AS family, commodity_key, dim_key, metric_code, metric_value, source_fact_id, observation_date, release_date, min(as_of_date) AS first_day, max(as_of_date) AS last_day
FROM runs GROUP BY ALL""")


@query("pit_events_long", " UNION ALL ".join(f"SELECT * FROM ({_long_sql(f)})" for f in star.FAMILIES))
def pit_events_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of all families' panels, a row for each run of days; ``pit_asof_*`` have a row for each day."""
    parts = [asof.as_runs(_spans(spark, sf_dir, f)).withColumn("family", F.lit(f)) for f in star.FAMILIES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: All six families in one grid: each commodity's days from its first price to the last day that any family has.
ALL_FAMILIES, ALL_METRICS = tuple(star.FAMILIES), [*ORDER_METRICS, *EVENT_METRICS]


def _lane_sql(family: str) -> str:
    """Each key's winner from each day on at which it may change, not before the commodity's first price."""
    return f"""SELECT commodity_key, dim_key, metric_code, '{family}' AS family, greatest(since, first_day) AS since, max(w) AS w FROM (
  SELECT commodity_key, dim_key, metric_code, since, max(w) OVER (PARTITION BY commodity_key, dim_key, metric_code ORDER BY since) AS w FROM (
    SELECT d.commodity_key, f.dim_key, f.metric_code, greatest(f.observation_date, f.release_date) AS since, max(ROW(f.observation_date, f.release_date, f.revision, f.source_fact_id, f.metric_value)) AS w
    FROM {family} f JOIN dim_commodity d ON f.commodity_key = d.commodity_key OR f.commodity_key IS NULL GROUP BY ALL)) JOIN begun USING (commodity_key) WHERE since <= DATE '{EVENT_DAYS[1]}' GROUP BY ALL"""


_POINTS = _with("dim_commodity", *ALL_FAMILIES, rest=f""", begun AS (SELECT commodity_key, coalesce(min(observation_date), DATE '2000-01-01') AS first_day FROM dim_commodity LEFT JOIN price USING (commodity_key) GROUP BY 1),
lanes AS MATERIALIZED ({" UNION ALL ".join(_lane_sql(f) for f in ALL_FAMILIES)}),
days_of AS (SELECT DISTINCT commodity_key, metric_code, since AS day FROM lanes), each AS (SELECT DISTINCT commodity_key, dim_key, metric_code, family FROM lanes),
met AS (SELECT q.commodity_key, q.metric_code, q.dim_key, day, w FROM (SELECT * FROM days_of JOIN each USING (commodity_key, metric_code)) q
  ASOF JOIN lanes l ON q.commodity_key = l.commodity_key AND q.metric_code = l.metric_code AND q.family = l.family AND coalesce(q.dim_key, -1) = coalesce(l.dim_key, -1) AND q.day >= l.since),
points AS (SELECT commodity_key, metric_code, day, dim_key, w FROM met QUALIFY row_number() OVER (PARTITION BY commodity_key, metric_code, day ORDER BY dim_key NULLS FIRST, w[1] DESC, w[2] DESC, w[4] DESC, w[5] DESC) = 1),
scalar AS (SELECT as_of_date, g.commodity_key, g.metric_code, dim_key, w[5] AS metric_value, w[4] AS source_fact_id, w[1] AS observation_date, w[2] AS release_date
  FROM (SELECT commodity_key, metric_code, CAST(unnest(generate_series(first_day, DATE '{EVENT_DAYS[1]}', INTERVAL 1 DAY)) AS DATE) AS as_of_date FROM begun JOIN (SELECT DISTINCT commodity_key, metric_code FROM lanes) USING (commodity_key)) g
  ASOF JOIN points p ON g.commodity_key = p.commodity_key AND g.metric_code = p.metric_code AND g.as_of_date >= p.day)""")


def _scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six families' intervals, one winner for each commodity and metric at a time."""
    dims, end = star.dim_commodity(spark, sf_dir), EVENT_DAYS[1]
    begun = asof.starts(star.price(spark, sf_dir), dims)
    parts = [asof.spans(asof.winners(f(spark, sf_dir), dims), begun, end).withColumn("family", F.lit(name)) for name, f in star.FAMILIES.items()]
    cut = parts[0]
    for p in parts[1:]:
        cut = cut.unionByName(p)
    return asof.scalar_spans(asof.merged(cut, list(ALL_FAMILIES), end))


def _wide_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.wide_runs(_scalars(spark, sf_dir), ALL_METRICS, EVENT_DAYS[1])


@query("pit_scalar", _POINTS + " SELECT * FROM scalar")
def pit_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.on_days(_scalars(spark, sf_dir))


def _union_panel(spark: SparkSession, sf_dir: str, families: tuple[str, ...]) -> DataFrame:
    parts = [_panel(f)(spark, sf_dir) for f in families]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("pit_scalar_event", _panels_sql(EVENT_FAMILIES, _SCALAR + " SELECT * FROM scalar"))
def pit_scalar_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two event families over their own days alone, collapsed day by day."""
    return asof.collapse(_union_panel(spark, sf_dir, EVENT_FAMILIES))


@query("pit_features_doc", _POINTS + """ SELECT as_of_date, commodity_key, count(*) AS n_features,
  string_agg(metric_code || '@' || CAST(observation_date AS VARCHAR), ',' ORDER BY metric_code) AS features FROM scalar GROUP BY ALL""")
def pit_features_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = asof.documents(_wide_runs(spark, sf_dir), ALL_METRICS)
    shown = F.transform("features", lambda x: F.concat_ws("@", x["metric_code"], x["observation_date"].cast("string")))
    return docs.select("as_of_date", "commodity_key", F.size("features").cast("long").alias("n_features"), F.array_join(shown, ",").alias("features"))


_WIDE = ", ".join(f"max(metric_value) FILTER (WHERE metric_code = '{m}') AS {m}" for m in EVENT_METRICS)
_WIDE_ALL = ", ".join(f"""max(metric_value) FILTER (WHERE metric_code = '{m}') AS "{m.replace(' ', '_')}\"""" for m in ALL_METRICS)


@query("pit_wide", _POINTS + f" SELECT as_of_date, commodity_key, {_WIDE_ALL} FROM scalar GROUP BY ALL")
def pit_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = [F.col(f"`{m}`.metric_value").alias(m.replace(" ", "_")) for m in ALL_METRICS]
    return _wide_runs(spark, sf_dir).select(F.explode(F.sequence("first_day", "last_day")).alias("as_of_date"), "commodity_key", *values)


_FILLED = ", ".join(f"last_value({m} IGNORE NULLS) OVER w AS {m}" for m in EVENT_METRICS)
_ZEROED = ", ".join(f"coalesce(last_value({m} IGNORE NULLS) OVER w, 0.0) AS {m}" for m in EVENT_METRICS)
_SPARSE = f""", sparse AS (
  SELECT observation_date AS as_of_date, commodity_key, {_WIDE} FROM (
    SELECT commodity_key, metric_code, observation_date, metric_value FROM fanned QUALIFY row_number() OVER (PARTITION BY commodity_key, metric_code, observation_date
      ORDER BY dim_key NULLS FIRST, release_date DESC, source_fact_id DESC, metric_value DESC) = 1
  ) GROUP BY ALL
), span AS (SELECT * FROM days)
SELECT as_of_date, commodity_key, %s FROM span LEFT JOIN sparse USING (as_of_date, commodity_key)
WINDOW w AS (PARTITION BY commodity_key ORDER BY as_of_date ROWS UNBOUNDED PRECEDING)"""


def _sparse(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    dims = star.dim_commodity(spark, sf_dir)
    own = asof.for_every_commodity(star.event(spark, sf_dir), dims).withColumn("as_of_date", F.col("observation_date"))
    grid = asof.time_grid(own.limit(0), EVENT_DAYS[1], dims, EVENT_DAYS[0])
    return grid, asof.wide(asof.collapse(own), EVENT_METRICS)


@query("pit_wide_ffill_offline", _panel_sql("event", _SPARSE % _FILLED))
def pit_wide_ffill_offline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.forward_fill(*_sparse(spark, sf_dir), EVENT_METRICS)


@query("exog_impute", _panel_sql("event", _SPARSE % _ZEROED))
def exog_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.forward_fill(*_sparse(spark, sf_dir), EVENT_METRICS, zeros=True)


_LATE = ("supply", "weather")


@query("pit_late_rows", " UNION ALL ".join(f"SELECT * FROM ({_panel_sql(f, f""", moves AS (SELECT commodity_key, dim_key, metric_code, since, w, w IS DISTINCT FROM lag(w) OVER (PARTITION BY commodity_key, dk, metric_code ORDER BY since) AS moved FROM running)
SELECT '{f}' AS family, commodity_key, dim_key, metric_code, since, w[5] AS metric_value, w[4] AS source_fact_id, w[1] AS observation_date, w[2] AS release_date,
  lead(since) OVER (PARTITION BY commodity_key, coalesce(dim_key, -1), metric_code ORDER BY since) - 1 AS until FROM moves WHERE moved""")})" for f in _LATE))
def pit_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that arrive in three batches, late ones among them: what is kept after the last is what all facts give."""
    out = None
    for family in _LATE:
        folder, facts, dims = f"{shared.folder(spark)}/panel-{uuid.uuid4().hex}", star.FAMILIES[family](spark, sf_dir), star.dim_commodity(spark, sf_dir)
        for number in range(3):
            panel.apply(spark, folder, facts.filter(F.pmod(F.xxhash64("source_fact_id"), F.lit(3)) == number), number, dims)
        kept = panel.intervals(panel.points(spark, folder))
        part = kept.select(F.lit(family).alias("family"), *asof.KEYS, "since", *(f"winner.{c}" for c in ("metric_value", "source_fact_id", "observation_date", "release_date")), "until")
        out = part if out is None else out.unionByName(part)
    return out


# --- revisions and reads

_BENCHMARK = """, counted AS (SELECT commodity_key, dim_key, count(DISTINCT observation_date) AS n_days FROM price GROUP BY 1, 2),
benchmark AS (SELECT * FROM counted QUALIFY row_number() OVER (PARTITION BY commodity_key ORDER BY n_days DESC, dim_key NULLS FIRST) = 1)"""
_BASIS = """, basis AS (SELECT * FROM price QUALIFY revision = max(revision) OVER (PARTITION BY commodity_key, dim_key))"""


@query("benchmark_instrument", _with("price", rest=_BENCHMARK + " SELECT * FROM benchmark"))
def benchmark_instrument(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions.benchmark_instrument(star.price(spark, sf_dir))


@query("latest_revision_series", _with("price", rest=_BASIS + " SELECT * FROM basis"))
def latest_revision_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions.latest_revision(star.price(spark, sf_dir)).select(*star.FACT)


@query("latest_of_grain", _with("price", rest=""" SELECT commodity_key, dim_key, metric_code, observation_date, revision, source_fact_id, metric_value FROM price
QUALIFY row_number() OVER (PARTITION BY commodity_key, dim_key, metric_code, observation_date ORDER BY revision DESC, source_fact_id DESC, metric_value DESC) = 1"""))
def latest_of_grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions.latest_of_grain(star.price(spark, sf_dir))


@query("price_window", _with("price", rest=_BENCHMARK + _BASIS + f""" SELECT b.* FROM basis b JOIN benchmark m
  ON b.commodity_key = m.commodity_key AND b.dim_key IS NOT DISTINCT FROM m.dim_key
WHERE observation_date BETWEEN DATE '{TODAY}' - 365 AND DATE '{TODAY}'"""))
def price_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions.price_window(star.price(spark, sf_dir), TODAY, 365).select(*star.FACT)


@query("series_fingerprint", _with("price", rest=" SELECT commodity_key, count(*) AS n_rows, max(observation_date) AS last_date, max(revision) AS last_revision FROM price GROUP BY 1"))
def series_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions.fingerprint(star.price(spark, sf_dir))


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


@query("platform_stats", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in _TABLES))
def platform_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [star.table(spark, sf_dir, t).agg(F.count("*").alias("n_rows")).select(F.lit(t).alias("table_name"), "n_rows") for t in _TABLES]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query("commodity_instruments", _with("price", rest=""" SELECT commodity_key, string_agg(DISTINCT dim_key::VARCHAR, ',' ORDER BY dim_key::VARCHAR) AS instruments, count(*) AS n_rows FROM price GROUP BY 1"""))
def commodity_instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.array_join(F.array_sort(F.collect_set(F.col("dim_key").cast("string"))), ",")
    return star.price(spark, sf_dir).groupBy("commodity_key").agg(own.alias("instruments"), F.count("*").alias("n_rows"))


# --- intake

@query("resolve_keys", """SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_shipdate, p.p_partkey AS part_key, s.s_suppkey AS supplier_key,
  concat_ws(',', CASE WHEN p.p_partkey IS NULL THEN 'UNKNOWN_PART' END, CASE WHEN s.s_suppkey IS NULL THEN 'UNKNOWN_SUPPLIER' END) AS errors
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size <= 40) p ON l_partkey = p.p_partkey LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) s ON l_suppkey = s.s_suppkey""")
def resolve_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = star.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_shipdate", F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"))
    known = {
        "part": (star.table(spark, sf_dir, "part").filter("p_size <= 40"), "p_partkey", "p_partkey"),
        "supplier": (star.table(spark, sf_dir, "supplier").filter("s_acctbal > 0"), "s_suppkey", "s_suppkey"),
    }
    out = intake.resolve(records, known)
    return out.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_shipdate", "part_key", "supplier_key", F.array_join("errors", ",").alias("errors"))


_TARGET = "target AS (SELECT event_id, user_id, event_type, CAST(ts AS DATE) AS day, value FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-15')"
_BATCH = """batch AS (SELECT CASE WHEN event_id % 10 = 0 THEN event_id - 5 ELSE event_id END AS event_id, user_id, event_type, CAST(ts AS DATE) AS day,
  CASE WHEN event_id % 7 = 0 THEN value + 1 ELSE value END AS value, event_id AS seq FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-10')"""


def _events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = star.table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))
    target = events.filter("day < '2024-01-15'").select("event_id", "user_id", "event_type", "day", "value")
    again = F.when(F.col("event_id") % 10 == 0, F.col("event_id") - 5).otherwise(F.col("event_id"))
    value = F.when(F.col("event_id") % 7 == 0, F.col("value") + 1).otherwise(F.col("value"))
    batch = events.filter("day >= '2024-01-10'").select(again.alias("event_id"), "user_id", "event_type", "day", value.alias("value"), F.col("event_id").alias("seq"))
    return batch, target


def greedy(name: str, candidates: str) -> str:
    """CTE ``name`` (recursive) of rounds over candidates (seq, identity, grain): won is true for the records that count."""
    first = "seq = min(seq) OVER (PARTITION BY grain) AND (identity IS NULL OR seq = min(seq) OVER (PARTITION BY identity)) AS won"
    return f"""{name} AS (SELECT seq, identity, grain, {first} FROM {candidates} UNION ALL
  SELECT seq, identity, grain, {first} FROM (SELECT *, bool_or(won) OVER (PARTITION BY grain) AS g, identity IS NOT NULL AND bool_or(won) OVER (PARTITION BY identity) AS i FROM {name}) WHERE NOT won AND NOT g AND NOT i)"""


def outcome(batch: str, held: str, name: str) -> str:
    """CTEs that end in ``name``: ``batch`` (seq, identity, grain, v, h, rejected) with outcome and kind against ``held``."""
    return f"""{name}_ti AS (SELECT identity, min(ROW(v, h)) AS ti FROM {held} WHERE identity IS NOT NULL GROUP BY 1), {name}_tg AS (SELECT grain, min(ROW(v, h)) AS tg FROM {held} GROUP BY 1),
{name}_seen AS (SELECT b.*, ti, tg FROM {batch} b LEFT JOIN {name}_ti USING (identity) LEFT JOIN {name}_tg USING (grain)),
{name}_free AS (SELECT seq, identity, grain FROM {name}_seen WHERE NOT rejected AND ti IS NULL AND tg IS NULL), {greedy(name + "_r", name + "_free")},
{name}_new AS (SELECT s.seq AS nseq, s.identity AS nidentity, s.grain AS ngrain, ROW(s.v, s.h) AS nx FROM {name}_r r JOIN {name}_seen s USING (seq) WHERE won),
{name}_met AS (SELECT s.*, coalesce(ti, CASE WHEN i.nseq < s.seq THEN i.nx END) AS pi, coalesce(tg, CASE WHEN g.nseq < s.seq THEN g.nx END) AS pg
  FROM {name}_seen s LEFT JOIN {name}_new i ON s.identity = i.nidentity LEFT JOIN {name}_new g ON s.grain = g.ngrain),
{name} AS (SELECT *, CASE WHEN rejected THEN 'REJECTED' WHEN pi IS NOT NULL THEN CASE WHEN pi IS NOT DISTINCT FROM ROW(v, h) THEN 'IDEMPOTENT' ELSE 'CONFLICT' END
  WHEN pg IS NOT NULL THEN CASE WHEN pg[1] IS NOT DISTINCT FROM v THEN 'IDEMPOTENT' ELSE 'CONFLICT' END ELSE 'NEW' END AS outcome, CASE WHEN pi IS NOT NULL THEN 'provenance' ELSE 'grain' END AS kind FROM {name}_met)"""


def _keyed_sql(of: str, seq: str) -> str:
    return f"""SELECT {seq} AS seq, CASE WHEN event_id % 11 <> 0 THEN CAST(event_id AS VARCHAR) END AS identity, concat_ws('|', user_id, event_type, day) AS grain,
  CAST(CAST(value AS DECIMAL(38, 10)) AS VARCHAR) AS v, event_type AS h, value > 400 AS rejected, event_id, user_id, event_type, day, value FROM {of}"""


@query("classify_writes", f"""WITH RECURSIVE {_TARGET}, {_BATCH}, held AS ({_keyed_sql("target", "0")}), asked AS ({_keyed_sql("batch", "seq")}), {outcome("asked", "held", "judged")}
SELECT seq, event_id, user_id, event_type, day, value, outcome, CASE WHEN outcome = 'CONFLICT' THEN kind END AS conflict_kind FROM judged""")
def classify_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of days that are partly there already, with an event's id as identity and user, type and day as grain."""
    errors = F.when(F.col("value") > 400, F.array(F.lit("TOO_LARGE"))).otherwise(F.array().cast("array<string>"))
    keys = {"identity": F.when(F.col("event_id") % 11 != 0, F.col("event_id").cast("string")), "grain": F.concat_ws("|", "user_id", "event_type", "day")}
    made = {**keys, "values": writer.comparable("value"), "source_payload_hash": F.col("event_type"), "errors": errors}
    batch, target = (x.withColumns(made) for x in _events(spark, sf_dir))
    out = writer.classify(batch, target, "seq")
    return out.select("seq", "event_id", "user_id", "event_type", "day", "value", "outcome", "conflict_kind")


@query("backfill_new_rows", f"""WITH {_TARGET}, {_BATCH} SELECT b.user_id, b.event_type, b.day, b.seq, b.event_id, b.value FROM batch b
WHERE NOT EXISTS (SELECT 1 FROM target t WHERE t.user_id IS NOT DISTINCT FROM b.user_id AND t.event_type IS NOT DISTINCT FROM b.event_type AND t.day IS NOT DISTINCT FROM b.day)
QUALIFY row_number() OVER (PARTITION BY user_id, event_type, day ORDER BY seq) = 1""")
def backfill_new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch, target = _events(spark, sf_dir)
    return intake.backfill_new(batch.select("user_id", "event_type", "day", "seq", "event_id", "value"), target, ("user_id", "event_type", "day"), ("seq",))


# --- audits


@query("dup_grain_audit", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dup_grain_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.duplicate_grains(star.table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("coverage_audit", _with("weather", rest=""", sourced AS (SELECT *, CASE WHEN revision = 0 THEN 'api' ELSE 'bulk' END AS source, CASE WHEN metric_value > 200000 THEN NULL ELSE metric_value END AS v FROM weather)
SELECT metric_code, count(*) AS n_rows, count(v) AS n_values, round(1 - count(v) / count(*), 9) AS null_rate, min(observation_date) AS first_date, max(observation_date) AS last_date, min(release_date) AS first_release,
  max(release_date) AS last_release, count(DISTINCT release_date) AS n_releases, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM sourced GROUP BY 1"""))
def coverage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = star.weather(spark, sf_dir).withColumn("source", F.when(F.col("revision") == 0, "api").otherwise("bulk"))
    facts = facts.withColumn("metric_value", F.when(~(F.col("metric_value") > 200000), F.col("metric_value")))
    return audit.coverage(facts, "source").withColumn("null_rate", F.round("null_rate", 9))


@query("collision_audit", _with("supply", rest=""", g AS (SELECT commodity_key, metric_code, observation_date, count(*) AS n, count(DISTINCT dim_key) AS k FROM supply GROUP BY 1, 2, 3)
SELECT count(*) AS n_grains, sum(n)::BIGINT AS n_rows, sum(n - 1)::BIGINT AS n_colliding, sum(CASE WHEN k > 1 THEN n ELSE 0 END)::BIGINT AS n_mixed FROM g"""))
def collision_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.collisions(star.supply(spark, sf_dir), ("commodity_key", "metric_code", "observation_date"), "dim_key")


@query("freshness_verdict", _with("series", rest=f""", latest AS (SELECT commodity_key, max(price_date) AS last_date FROM series GROUP BY 1)
SELECT *, DATE '2001-08-08' - last_date AS gap_days, CASE WHEN DATE '2001-08-08' - last_date > 8 THEN 'fail' WHEN DATE '2001-08-08' - last_date > 7 THEN 'warn' ELSE 'ok' END AS verdict FROM latest"""))
def freshness_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = star.series(spark, sf_dir).groupBy("commodity_key").agg(F.max("price_date").alias("last_date"))
    return audit.freshness(latest, "2001-08-08", 7, 8).withColumn("gap_days", F.col("gap_days").cast("long"))


# --- parsers


@query("parse_event_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def parse_event_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("provenance_ids", """SELECT event_id, concat_ws(':', 'events', event_type, event_id) AS record_id, substr(sha256(concat_ws(':', 'events', event_type, event_id)), 1, 12) AS fingerprint FROM events""")
def provenance_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = parse.record_id(F.lit("events"), F.col("event_type"), F.col("event_id").cast("string"))
    return star.table(spark, sf_dir, "events").select("event_id", key.alias("record_id"), parse.short_hash(key).alias("fingerprint"))


@query("plain_numbers", """SELECT o_orderkey, CASE WHEN regexp_full_match(replace(replace(t, ',', ''), '.', ''), '[0-9]+') THEN CAST(replace(replace(t, ',', ''), '.', '') AS DOUBLE) END AS number
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE concat(CAST(o_orderkey // 1000 AS VARCHAR), '.', CAST(100 + o_orderkey % 900 AS VARCHAR)) END AS t FROM orders)""")
def plain_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise(F.concat_ws(".", F.floor(F.col("o_orderkey") / 1000), 100 + F.col("o_orderkey") % 900))
    return star.table(spark, sf_dir, "orders").select("o_orderkey", parse.plain_number(text).alias("number"))


# --- features


def _series_sql(columns: str, tail: str = "", more: str = "") -> str:
    return _with("series", rest=f""", s AS (SELECT *, ln(y) AS ly, row_number() OVER (PARTITION BY commodity_key ORDER BY price_date) - 1 AS i, count(*) OVER (PARTITION BY commodity_key) AS n FROM series){more}
SELECT {columns} FROM {tail or 's'}""")


_W = "OVER (PARTITION BY commodity_key ORDER BY price_date"
_ANGLE = "2 * pi() * dayofyear(price_date) / 365.25"


@query("feat_tabular", _series_sql(f"""commodity_key, price_date, round(r, 6) AS ret_1, round(ly - lag(ly, 5) {_W}), 6) AS ret_5, round(ly - lag(ly, 20) {_W}), 6) AS ret_20,
  round(ly - avg(ly) {_W} ROWS 19 PRECEDING), 6) AS dev_20, round(ly - avg(ly) {_W} ROWS 59 PRECEDING), 6) AS dev_60,
  round(stddev_pop(r) {_W} ROWS 19 PRECEDING), 6) AS vol_20, round(sin({_ANGLE}), 6) AS sin_doy, round(cos({_ANGLE}), 6) AS cos_doy""",
    "t", f", t AS (SELECT *, ly - lag(ly) {_W}) AS r FROM s)"))
def feat_tabular(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.tabular(star.series(spark, sf_dir)), "ret_1", "ret_5", "ret_20", "dev_20", "dev_60", "vol_20", "sin_doy", "cos_doy")


@query("feat_target", _series_sql("commodity_key, price_date, i, round(target, 6) AS target", "t WHERE i >= 60 AND target IS NOT NULL", f", t AS (SELECT *, ln(lead(y, {HORIZON}) {_W})) - ly AS target FROM s)"))
def feat_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.target(star.series(spark, sf_dir), HORIZON), "target").withColumn("i", F.col("i").cast("long"))


@query("feat_cycle_harmonics", _series_sql("commodity_key, price_date, round(sin(2 * pi() * i / 63), 6) + 0.0 AS sin_63, round(cos(2 * pi() * i / 63), 6) + 0.0 AS cos_63, round(sin(2 * pi() * i / 252), 6) + 0.0 AS sin_252, round(cos(2 * pi() * i / 252), 6) + 0.0 AS cos_252"))
def feat_cycle_harmonics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features.harmonics(star.series(spark, sf_dir), (63, 252)), "sin_63", "cos_63", "sin_252", "cos_252")


@query("trailing_mean", _series_sql(f"commodity_key, price_date, avg(CAST(round(y * 100) AS BIGINT)) {_W} ROWS 29 PRECEDING) / 100 AS mean_30"))
def trailing_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = features.causal_trailing_mean(F.expr(CENTS), features.ordered(), 30)
    return star.series(spark, sf_dir).select("commodity_key", "price_date", (mean / 100).alias("mean_30"))


@query("rolling_min_periods", _series_sql(f"""commodity_key, price_date, CASE WHEN count(v) {_W} ROWS 9 PRECEDING) >= 5 THEN avg(v) {_W} ROWS 9 PRECEDING)
  ELSE avg(v) {_W} ROWS UNBOUNDED PRECEDING) END / 100 AS mean_10""", "t", ", t AS (SELECT *, CASE WHEN day(price_date) % 2 = 0 THEN CAST(round(y * 100) AS BIGINT) END AS v FROM s)"))
def rolling_min_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = star.series(spark, sf_dir).withColumn("v", F.when(F.dayofmonth("price_date") % 2 == 0, F.expr(CENTS)))
    return rows.select("commodity_key", "price_date", (features.rolling_mean_min_periods(F.col("v"), features.ordered(), 10) / 100).alias("mean_10"))


@query("month_end_agg", _with("series", rest=" SELECT commodity_key, CAST(date_trunc('month', price_date) AS DATE) AS month, arg_max(y, price_date) AS last_y, max(price_date) AS last_date, avg(CAST(round(y * 100) AS BIGINT)) / 100 AS mean_y FROM series GROUP BY 1, 2"))
def month_end_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = features.month_end(star.series(spark, sf_dir).withColumn("y", F.expr(CENTS)))
    return cents.withColumns({"last_y": F.col("last_y") / 100, "mean_y": F.col("mean_y") / 100})


@query("month_lag", _with("series", rest=""", m AS (SELECT commodity_key, CAST(date_trunc('month', price_date) AS DATE) AS month, arg_max(y, price_date) AS last_y FROM series GROUP BY 1, 2)
SELECT *, lag(last_y, 3, 0.0) OVER (PARTITION BY commodity_key ORDER BY month) AS last_y_lag FROM m"""))
def month_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    monthly = features.month_end(star.series(spark, sf_dir)).select("commodity_key", "month", "last_y")
    return features.lag_months(monthly, "last_y", 2.6)


@query("step_function_densify", _with("series", rest=f""", c AS (SELECT commodity_key, CAST(date_trunc('month', price_date) AS DATE) AS d, arg_max(y, price_date) AS y FROM series GROUP BY 1, 2),
e AS (SELECT *, coalesce(lead(d) OVER (PARTITION BY commodity_key ORDER BY d) - 1, DATE '{ORDER_END}') AS until FROM c)
SELECT commodity_key, CAST(unnest(generate_series(d, until, INTERVAL 1 DAY)) AS DATE) AS day, y FROM e"""))
def step_function_densify(spark: SparkSession, sf_dir: str) -> DataFrame:
    monthly = features.month_end(star.series(spark, sf_dir)).select("commodity_key", "month", F.col("last_y").alias("y"))
    return features.step_function(monthly, "commodity_key", "month", "y", ORDER_END)


@query("daily_median_series", "SELECT CAST(o_orderdate AS DATE) AS day, median(o_totalprice) AS median_value, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 0 GROUP BY 1")
def daily_median_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = star.table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT' and o_totalprice > 0")
    return rows.groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.median("o_totalprice").alias("median_value"), F.count("*").alias("n"))


@query("business_days", """SELECT o_orderkey, (SELECT list(d ORDER BY d)[5] FROM (SELECT CAST(unnest(generate_series(CAST(o_orderdate AS DATE) + 1, CAST(o_orderdate AS DATE) + 15, INTERVAL 1 DAY)) AS DATE) AS d) WHERE isodow(d) < 6) AS fifth FROM orders""")
def business_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.table(spark, sf_dir, "orders").select("o_orderkey", dates.business_day_after(F.col("o_orderdate").cast("date"), 5).alias("fifth"))


@query("trading_days", """SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, (SELECT count(*) FROM (SELECT unnest(generate_series(CAST(o_orderdate AS DATE) + 1, CAST(l_shipdate AS DATE), INTERVAL 1 DAY)) AS d) WHERE isodow(d) < 6) AS n_days
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def trading_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = star.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("a"))
    rows = star.table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", dates.trading_days_between(F.col("a"), F.col("l_shipdate").cast("date")).cast("long").alias("n_days"))


# --- forecasts

_CUTS = f""", sizes AS (SELECT commodity_key, max(n) AS n FROM s GROUP BY 1),
cuts AS (SELECT DISTINCT commodity_key, CAST(floor({MIN_TRAIN} + k * (n - {HORIZON} - {MIN_TRAIN}) / {FOLDS - 1}) AS BIGINT) AS cut FROM sizes, range({FOLDS}) t(k) WHERE n - {HORIZON} >= {MIN_TRAIN})"""


@query("wf_cuts", _series_sql("*", "cuts", _CUTS))
def wf_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = star.series(spark, sf_dir).groupBy("commodity_key").agg(F.count("*").alias("n"))
    return forecast.cut_points(sizes, MIN_TRAIN, HORIZON, FOLDS)


@query("wf_naive_mape", _series_sql("commodity_key, count(*) AS n_folds, round(100 * avg(abs((a.y - p.y) / a.y)), 6) AS mape, round(sqrt(avg(pow(a.y - p.y, 2))), 4) AS rmse, round(avg(abs(a.y - p.y)), 4) AS mae",
    f"cuts JOIN s p USING (commodity_key) JOIN s a USING (commodity_key) WHERE p.i = cut - 1 AND a.i = cut + {HORIZON} - 1 GROUP BY 1", _CUTS))
def wf_naive_mape(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = forecast.naive_errors(star.series(spark, sf_dir), MIN_TRAIN, HORIZON, FOLDS)
    return rounded(rounded(forecast.accuracy(errors), "mape"), "rmse", "mae", places=4)


STEPS = 90
_OU = f""", m AS (SELECT *, avg(ly) {_W} ROWS {kernels.MEAN_ROWS - 1} PRECEDING) AS mean FROM s), d AS (SELECT *, ly - mean AS d FROM m), l AS (SELECT *, lag(d) {_W}) AS d0 FROM d),
raw AS (SELECT commodity_key, greatest(0.0, least({kernels.MOST_PHI}, sum(d0 * d) / sum(d0 * d0))) AS phi,
  (arg_max(mean, i) - max(mean) FILTER (WHERE i = n - 1 - {kernels.DRIFT_ROWS})) / {kernels.DRIFT_ROWS} AS drift,
  arg_max(ly, i) AS last_ly, arg_max(d, i) AS last_d, max(n) >= {kernels.MEAN_ROWS + STEPS + 5} AS fitted FROM l GROUP BY 1),
ou AS (SELECT commodity_key, CASE WHEN fitted THEN phi END AS phi, CASE WHEN fitted THEN drift END AS drift, last_ly, last_d, fitted FROM raw),
path AS (SELECT commodity_key, step::INT AS step, exp(last_ly + CASE WHEN fitted THEN drift * (1 - pow({kernels.DAMPING}, step)) / (1 - {kernels.DAMPING}) + last_d * (pow(phi, step) - 1) ELSE 0.0 END) AS predicted
  FROM ou, range(1, {STEPS} + 1) t(step))"""


@query("ou_params", _series_sql("commodity_key, round(phi, 6) AS phi, round(drift, 6) AS drift, round(last_ly, 6) AS last_ly, round(last_d, 6) AS last_d, fitted", "ou", _OU))
def ou_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(forecast.ou_parameters(star.series(spark, sf_dir), STEPS), "phi", "drift", "last_ly", "last_d")


def _ou_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.ou_forecast(forecast.ou_parameters(star.series(spark, sf_dir), STEPS), STEPS)


@query("ou_forecast", _series_sql("commodity_key, step, round(predicted, 3) AS predicted", "path", _OU))
def ou_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_ou_path(spark, sf_dir), "predicted", places=3)


_FIFTH = "(SELECT list(d ORDER BY d)[step] FROM (SELECT CAST(unnest(generate_series(as_of_date + 1, as_of_date + 150, INTERVAL 1 DAY)) AS DATE) AS d) WHERE isodow(d) < 6)"


@query("forecast_log_rows", _series_sql(f"commodity_key, as_of_date, {_FIFTH} AS target_date, step AS horizon, 'ou' AS model, round(predicted, 3) AS predicted, baseline, 'pending' AS status",
    "path JOIN ends USING (commodity_key) WHERE step IN (30, 90)", _OU + ", ends AS (SELECT commodity_key, max(price_date) AS as_of_date, arg_max(y, price_date) AS baseline FROM series GROUP BY 1)"))
def forecast_log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = star.series(spark, sf_dir).groupBy("commodity_key").agg(F.max("price_date").alias("as_of_date"), F.max_by("y", "price_date").alias("baseline"))
    return rounded(forecast.log_rows(_ou_path(spark, sf_dir), last, "ou", (30, 90)), "predicted", places=3)


_FEATURES = ["ret_1", "ret_5", "ret_20", "dev_20", "dev_60", "vol_20", "sin_doy", "cos_doy"]
_GRAM = [(a, b) for k, a in enumerate(["1", *_FEATURES]) for b in ["1", *_FEATURES, "target"][k:]]


@query("ridge_gram", _series_sql("commodity_key, unnest([" + ", ".join(f"'{a}'" for a, _ in _GRAM) + "]) AS a, unnest([" + ", ".join(f"'{b}'" for _, b in _GRAM) + "]) AS b, unnest(["
    + ", ".join(f"""round(sum({'1.0' if a == '1' else a} * {'1.0' if b == '1' else b}), 5) + 0.0""" for a, b in _GRAM) + "]) AS total", "f WHERE i >= 60 AND target IS NOT NULL GROUP BY commodity_key",
    f""", t AS (SELECT *, ly - lag(ly) {_W}) AS r FROM s), f AS (SELECT commodity_key, i, r AS ret_1, ly - lag(ly, 5) {_W}) AS ret_5, ly - lag(ly, 20) {_W}) AS ret_20, ly - avg(ly) {_W} ROWS 19 PRECEDING) AS dev_20,
  ly - avg(ly) {_W} ROWS 59 PRECEDING) AS dev_60, stddev_pop(r) {_W} ROWS 19 PRECEDING) AS vol_20, sin({_ANGLE}) AS sin_doy, cos({_ANGLE}) AS cos_doy, lead(ly, {HORIZON}) {_W}) - ly AS target FROM t)"""))
def ridge_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = star.series(spark, sf_dir)
    both = features.tabular(rows).join(features.target(rows, HORIZON), ["commodity_key", "price_date"])
    return rounded(forecast.gram(both, "target", _FEATURES), "total", places=5)


_SUPPLY = """m AS (SELECT CAST(substr(p_brand, 7) AS INT) AS commodity_key, CAST(date_trunc('month', CAST(l_shipdate AS DATE)) AS DATE) AS month, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS planted_area,
  CAST(count(*) AS DOUBLE) AS import_volume, CAST(sum(l_linenumber) AS DOUBLE) AS inventory FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
g AS (SELECT *, inventory + lag(planted_area, 5, 0.0) OVER w * 2.5 * (0.5 + month(month) / 8) * 0.75 * 1.25 + lag(import_volume, 1, 0.0) OVER w * 1.5 AS gross FROM m WINDOW w AS (PARTITION BY commodity_key ORDER BY month))"""


@query("supply_q", f"WITH {_SUPPLY} SELECT commodity_key, month, greatest(gross - 0.125 * greatest(gross, 0.0), 60.0) AS q FROM g")
def supply_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = star.table(spark, sf_dir, "part").select("p_partkey", F.substring("p_brand", 7, 9).cast("int").alias("commodity_key"))
    lines = star.table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).withColumn("month", F.trunc(F.col("l_shipdate").cast("date"), "MM"))
    monthly = lines.groupBy("commodity_key", "month").agg(
        F.sum(F.col("l_quantity").cast("long")).cast("double").alias("planted_area"), F.count("*").cast("double").alias("import_volume"), F.sum("l_linenumber").cast("double").alias("inventory")
    )
    indices = {"weather_index": 0.5 + F.month("month") / 8, "pest_index": F.lit(0.75), "quality_delta": F.lit(0.25), "import_shock": F.lit(0.5)}
    return forecast.supply(monthly.withColumns(indices), 5, 1, 2.5, 0.125, 60.0).select("commodity_key", "month", "q")


@query("naive_interval", _series_sql(f"""commodity_key, step::INT AS step, point, round(point * exp(-{kernels.BAND_Z} * sigma * sqrt(step)), 3) AS lower, round(point * exp({kernels.BAND_Z} * sigma * sqrt(step)), 3) AS upper""",
    f"own, range(1, {HORIZON} + 1) t(step)", f", r AS (SELECT *, ly - lag(ly) {_W}) AS r FROM s), own AS (SELECT commodity_key, arg_max(y, price_date) AS point, stddev_samp(r) AS sigma FROM r GROUP BY 1)"))
def naive_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(forecast.naive_interval(star.series(spark, sf_dir), HORIZON), "lower", "upper", places=3)


_BACKTESTED = f"""{_CUTS}, f AS (SELECT commodity_key, i + 1 AS cut, y AS naive, avg(CAST(round(y * 100) AS BIGINT)) {_W} ROWS 19 PRECEDING) / 100 AS mean_20, avg(CAST(round(y * 100) AS BIGINT)) {_W} ROWS 59 PRECEDING) / 100 AS mean_60 FROM s),
a AS (SELECT commodity_key, i + 1 - {HORIZON} AS cut, y AS actual FROM s),
e AS (UNPIVOT (SELECT commodity_key, actual, naive, mean_20, mean_60 FROM cuts JOIN f USING (commodity_key, cut) JOIN a USING (commodity_key, cut)) ON naive, mean_20, mean_60 INTO NAME model VALUE predicted),
scores AS (SELECT commodity_key, model, count(*) AS n_folds, round(100 * avg(abs((actual - predicted) / actual)), 6) AS mape, round(sqrt(avg(pow(actual - predicted, 2))), 6) AS rmse, round(avg(abs(actual - predicted)), 6) AS mae FROM e GROUP BY 1, 2)"""


@query("wf_scores", _series_sql("*", "scores", _BACKTESTED))
def wf_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backtests of the models that windows can express: the last value and trailing means."""
    rows = star.series(spark, sf_dir)
    cents = lambda n: features.causal_trailing_mean(F.expr(CENTS), features.ordered(), n) / 100
    scores = forecast.accuracy(forecast.fold_errors(rows, {"naive": F.col("y"), "mean_20": cents(20), "mean_60": cents(60)}, MIN_TRAIN, HORIZON, FOLDS), "model")
    return rounded(scores, "mape", "rmse", "mae")  # means of cents over 20 or 60 rows and a few folds lie halfway at four places, never at six


@query("select_model", _series_sql(f"commodity_key, best, best_mape, naive_mape, CASE WHEN best_mape < naive_mape * {1 - forecast.MARGIN} THEN best ELSE 'naive' END AS selected", "b",
    _BACKTESTED + ", b AS (SELECT commodity_key, arg_min(model, ROW(mape, model)) AS best, min(mape) AS best_mape, max(mape) FILTER (WHERE model = 'naive') AS naive_mape FROM scores GROUP BY 1)"))
def select_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.select_model(wf_scores(spark, sf_dir))


_LOG = """log AS (SELECT commodity_key, price_date AS as_of_date, price_date + 30 AS target_date, 30 AS horizon, 'naive' AS model, y AS predicted FROM series WHERE day(price_date) = 1)"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = star.series(spark, sf_dir).filter(F.dayofmonth("price_date") == 1)
    return rows.select("commodity_key", F.col("price_date").alias("as_of_date"), F.date_add("price_date", 30).alias("target_date"), F.lit(30).alias("horizon"), F.lit("naive").alias("model"), F.col("y").alias("predicted"))


@query("forecast_log_insert", _with("series", rest=f", {_LOG} SELECT * FROM log WHERE as_of_date >= DATE '2000-01-01'"))
def forecast_log_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _log(spark, sf_dir)
    return forecast.log_new(rows, rows.filter("as_of_date < '2000-01-01'"))


@query("evaluate_forecasts", _with("series", rest=f""", {_LOG}, found AS (SELECT l.*, min(price_date) AS actual_date, arg_min(y, price_date) AS actual FROM log l
  LEFT JOIN series s ON l.commodity_key = s.commodity_key AND price_date BETWEEN target_date AND target_date + 5 GROUP BY ALL)
SELECT *, CASE WHEN actual IS NOT NULL THEN 'evaluated' WHEN target_date + 20 < DATE '{TODAY}' THEN 'expired' ELSE 'pending' END AS status FROM found"""))
def evaluate_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.evaluate(_log(spark, sf_dir), star.series(spark, sf_dir), TODAY, 5, 20)


@query("movers_topk", _series_sql("commodity_key, section, direction, last_value, round(end_value, 4) AS end_value, round(pct, 6) AS pct, row_number() OVER (PARTITION BY section, direction ORDER BY abs(pct) DESC, commodity_key)::INT AS rank",
    "q QUALIFY rank <= 5", _OU + f""", f AS (SELECT commodity_key, CASE WHEN commodity_key % 2 = 0 THEN 'even' ELSE 'odd' END AS section, last_value, predicted AS end_value
  FROM path JOIN (SELECT commodity_key, arg_max(y, price_date) AS last_value FROM series GROUP BY 1) USING (commodity_key) WHERE step = {HORIZON}),
p AS (SELECT *, (end_value / last_value - 1) * 100 AS pct FROM f), q AS (SELECT *, CASE WHEN pct > 0 THEN 'up' ELSE 'down' END AS direction FROM p WHERE pct <> 0)"""))
def movers_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest changes that the mean-reverting model forecasts."""
    ends = _ou_path(spark, sf_dir).filter(F.col("step") == HORIZON).select("commodity_key", F.col("predicted").alias("end_value"))
    last = star.series(spark, sf_dir).groupBy("commodity_key").agg(F.max_by("y", "price_date").alias("last_value"))
    section = F.when(F.col("commodity_key") % 2 == 0, "even").otherwise("odd")
    return rounded(rounded(forecast.movers(last.join(ends, "commodity_key").withColumn("section", section), 5), "pct"), "end_value", places=4)


@query("model_forecasts")
def model_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.forecasts(star.series(spark, sf_dir), HORIZON)


@query("cycles")
def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.find_cycles(star.series(spark, sf_dir), HORIZON)


@query("wf_models")
def wf_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.backtest(star.series(spark, sf_dir), MIN_TRAIN, HORIZON, FOLDS)


@query("model_pool")
def model_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of all kernels and which one is chosen for each commodity, with its edge over the naive forecast."""
    chosen = forecast.select_model(forecast.accuracy(wf_models(spark, sf_dir), "model"))
    return chosen.withColumn("edge", F.col("naive_mape") - F.col("best_mape"))
