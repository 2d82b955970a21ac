"""Queries of the supply model, of forecasts as they are handed out, and of comparisons between models."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import cashflow, forecast, kernels, model_store, payload, shared
from tidemark.plans import catalogue
from tidemark.plans.registry import query, rounded
from tidemark.plans.registry import with_facts as _with
from tidemark.sources import star

CONFIG = cashflow.Config(harvest_months=5, import_months=1, yield_=2.5, loss=0.125, floor=60.0)
#: The supply's roles and the columns of the test tables' daily frame that play them.
ROLES = {"planted_area": "shipped", "import_volume": "n_lines", "inventory": "line_numbers", "weather_index": "season"}


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily series with what was shipped on each day, under names of its own."""
    part = star.table(spark, sf_dir, "part").select("p_partkey", F.substring("p_brand", 7, 9).cast("int").alias("commodity_key"))
    lines = star.table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).withColumn("price_date", F.col("l_shipdate").cast("date"))
    shipped = lines.groupBy("commodity_key", "price_date").agg(F.sum(F.col("l_quantity").cast("long")).alias("shipped"), F.count("*").alias("n_lines"), F.sum("l_linenumber").alias("line_numbers"))
    rows = star.series(spark, sf_dir).select("commodity_key", "price_date", F.col("y").alias("price"))
    season = 0.5 + F.month("price_date") / 8
    filled = {c: F.coalesce(c, F.lit(0)) for c in ("shipped", "n_lines", "line_numbers")}
    return cashflow.frame(rows.join(shipped, ["commodity_key", "price_date"], "left").withColumns(filled).withColumn("season", season), ROLES)


_MONTHLY = """, daily AS (SELECT s.commodity_key, s.price_date, y AS price, coalesce(area, 0.0) AS area, coalesce(imports, 0.0) AS imports, coalesce(stock, 0.0) AS stock FROM series s
  LEFT JOIN (SELECT CAST(substr(p_brand, 7) AS INT) AS commodity_key, CAST(l_shipdate AS DATE) AS price_date, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS area, CAST(count(*) AS DOUBLE) AS imports,
    CAST(sum(l_linenumber) AS DOUBLE) AS stock FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) USING (commodity_key, price_date)),
m AS (SELECT commodity_key, CAST(date_trunc('month', price_date) AS DATE) AS month, arg_max(price, price_date) AS price, avg(area) AS area, avg(imports) AS imports, avg(stock) AS stock FROM daily GROUP BY 1, 2),
g AS (SELECT *, stock + lag(area, 5, 0.0) OVER w * 2.5 * (0.5 + month(month) / 8) + lag(imports, 1, 0.0) OVER w AS gross FROM m WINDOW w AS (PARTITION BY commodity_key ORDER BY month)),
q AS (SELECT *, greatest(gross - 0.125 * greatest(gross, 0.0), 60.0) AS q FROM g),
f AS (SELECT *, avg(price * q) OVER (PARTITION BY commodity_key ORDER BY month ROWS 11 PRECEDING) AS m_flow FROM q)"""


@query("cashflow_parts", _with("series", rest=_MONTHLY + " SELECT commodity_key, month, round(q, 6) AS q, round(m_flow, 4) AS m_flow, round(m_flow / q, 6) AS p_mechanical FROM f"))
def cashflow_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cashflow.mechanical(cashflow.to_monthly(_daily(spark, sf_dir)), CONFIG).select("commodity_key", "month", "q", "m_flow", "p_mechanical")
    return rounded(rounded(rows, "q", "p_mechanical"), "m_flow", places=4)


@query("cashflow_fit")
def cashflow_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cashflow.components(cashflow.to_monthly(_daily(spark, sf_dir)), CONFIG)


@query("cashflow_forecast")
def cashflow_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six months after each series' last, with its last drivers."""
    monthly = cashflow.to_monthly(_daily(spark, sf_dir))
    last = monthly.groupBy("commodity_key").agg(F.max("month").alias("last"))
    months = last.select("commodity_key", F.explode(F.expr("sequence(add_months(last, 1), add_months(last, 6), interval 1 month)")).alias("month"))
    return cashflow.predicted(monthly, cashflow.carried(monthly, months), CONFIG)


@query("cashflow_holdout")
def cashflow_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cashflow.holdout(cashflow.to_monthly(_daily(spark, sf_dir)), CONFIG)


@query("supply_path")
def supply_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cashflow.daily_path(_daily(spark, sf_dir), CONFIG, catalogue.HORIZON)


#: What drives prices: all metrics of the wide panel but the price itself.
DRIVERS = [m.replace(" ", "_") for m in catalogue.ALL_METRICS if m != "price_close"]
_DRIVER_LIST = ", ".join(f'coalesce(last_value("{m}" IGNORE NULLS) OVER w, 0.0)' for m in DRIVERS)


def _driven(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel's changes alone: what lies between two of them is filled from the first."""
    values = [F.col(f"`{m}`.metric_value").alias(m.replace(" ", "_")) for m in catalogue.ALL_METRICS]
    changes = catalogue._wide_runs(spark, sf_dir).select("commodity_key", F.col("first_day").alias("as_of_date"), *values)
    return payload.with_drivers(star.series(spark, sf_dir), changes, DRIVERS)


@query("driver_matrix", f"""WITH wide AS ({catalogue.ORACLE_SQL["pit_wide"]}), series AS ({star.SQL["series"]}),
filled AS (SELECT commodity_key, as_of_date, [{_DRIVER_LIST}] AS d FROM (SELECT commodity_key, as_of_date FROM wide UNION SELECT commodity_key, price_date FROM series) LEFT JOIN wide USING (commodity_key, as_of_date)
  WINDOW w AS (PARTITION BY commodity_key ORDER BY as_of_date ROWS UNBOUNDED PRECEDING))
SELECT commodity_key, price_date, y, {", ".join(f'd[{k + 1}] AS "{m}"' for k, m in enumerate(DRIVERS))} FROM series JOIN filled ON series.commodity_key = filled.commodity_key AND price_date = as_of_date""".replace("SELECT commodity_key, price_date, y,", "SELECT series.commodity_key, price_date, y,"))
def driver_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drivers of each price, as known on its day."""
    return _driven(spark, sf_dir).select("commodity_key", "price_date", "y", *(F.col("drivers")[k].alias(m) for k, m in enumerate(DRIVERS)))


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload.payloads(star.series(spark, sf_dir), models=("ridge", "ou"))


@query("forecast_payload")
def forecast_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates: ridge and boosted trees with drivers, cycles, mean reversion, and the supply model."""
    made = payload.payloads(_driven(spark, sf_dir), daily=_daily(spark, sf_dir), config=CONFIG)
    return made.withColumn("horizons", F.to_json("horizons"))


@query("forecast_explain")
def forecast_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload.explained(_payloads(spark, sf_dir), catalogue.HORIZON).select("*", "backtest.*").withColumn("candidates", F.to_json("candidates")).drop("backtest")


@query("forecast_realized")
def forecast_realized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts made at the start of 2001 against what came."""
    rows = star.series(spark, sf_dir)
    return payload.realized(payload.payloads(rows.filter("price_date < '2001-01-01'"), models=("ridge", "ou")), rows, catalogue.HORIZON)


@query("forecast_recheck")
def forecast_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload.recheck(_payloads(spark, sf_dir), catalogue.HORIZON)


_FAMILIES: dict[str, str | None] = {"short": "mean_20", "long": "mean_60", "boosted": None}


@query("model_runs", catalogue._series_sql("commodity_key, family, model, error, n_folds, mape, rmse, mae, naive_mape, status, beats_naive", "done", catalogue._BACKTESTED + """,
asked AS (SELECT DISTINCT commodity_key, unnest(['short', 'long', 'boosted', 'other']) AS family FROM series),
done AS (SELECT a.*, CASE family WHEN 'short' THEN 'mean_20' WHEN 'long' THEN 'mean_60' END AS model, CASE family WHEN 'boosted' THEN 'boosted is not installed' WHEN 'other' THEN 'unsupported family other' END AS error,
  s.n_folds, s.mape, s.rmse, s.mae, n.mape AS naive_mape, CASE WHEN family IN ('boosted', 'other') THEN 'failed' WHEN s.mape IS NULL THEN 'skipped' ELSE 'ok' END AS status, coalesce(s.mape < n.mape, false) AS beats_naive
  FROM asked a LEFT JOIN scores s ON s.commodity_key = a.commodity_key AND s.model = CASE family WHEN 'short' THEN 'mean_20' WHEN 'long' THEN 'mean_60' END LEFT JOIN scores n ON n.commodity_key = a.commodity_key AND n.model = 'naive')"""))
def model_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested families, two that stand for a model and two that don't, with their backtests."""
    asked = star.series(spark, sf_dir).select("commodity_key").distinct().withColumn("family", F.explode(F.array(*(F.lit(f) for f in (*_FAMILIES, "other")))))
    return payload.run(asked, catalogue.wf_scores(spark, sf_dir), _FAMILIES)


@query("pool_edges", catalogue._series_sql("*", "done", catalogue._BACKTESTED + f""",
named AS (SELECT 'one' AS pool, ['mean_20'] AS models UNION ALL SELECT 'both', ['mean_20', 'mean_60']),
best AS (SELECT commodity_key, pool, min(mape) AS mape, arg_min(model, ROW(mape, model)) AS choice FROM scores, named WHERE list_contains(models, model) GROUP BY 1, 2),
done AS (SELECT b.commodity_key, pool, CASE WHEN b.mape < n.mape * {1 - forecast.MARGIN} THEN choice ELSE 'naive' END AS choice, CASE WHEN b.mape < n.mape * {1 - forecast.MARGIN} THEN b.mape ELSE n.mape END AS mape,
  round(n.mape - CASE WHEN b.mape < n.mape * {1 - forecast.MARGIN} THEN b.mape ELSE n.mape END, 6) + 0.0 AS edge FROM best b JOIN scores n ON n.commodity_key = b.commodity_key AND n.model = 'naive')"""))
def pool_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(payload.pools(catalogue.wf_scores(spark, sf_dir), {"one": ("mean_20",), "both": ("mean_20", "mean_60")}), "edge")


@query("research_pools")
def research_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What mean reversion and the oscillator add to the pool, and each alone."""
    errors = kernels.backtest(star.series(spark, sf_dir), catalogue.MIN_TRAIN, catalogue.HORIZON, catalogue.FOLDS, tuple(kernels.RESEARCH))
    named = {"ridge": ("ridge",), "with_ou": ("ridge", "ou"), "with_vdp": ("ridge", "ou", "vdp"), "ou_alone": ("ou",), "vdp_alone": ("vdp",)}
    return payload.pools(forecast.accuracy(errors, "model"), named)


@query("model_store_scores")
def model_store_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridge models fitted on the prices before 2001, registered, read back, and scored on all rows without another fit."""
    rows = star.series(spark, sf_dir)
    early = rows.filter("price_date < '2001-01-01'")
    errors = forecast.accuracy(kernels.backtest(early, catalogue.MIN_TRAIN, catalogue.HORIZON, catalogue.FOLDS, ("naive", "ridge")), "model")
    scores = errors.groupBy("commodity_key").agg(*(F.max(F.when(F.col("model") == m, F.col("mape"))).alias(c) for m, c in (("ridge", "mape"), ("naive", "naive_mape"))))
    new = model_store.entries(model_store.fitted(early, catalogue.HORIZON), scores, "ridge", catalogue.HORIZON, "2001-01-01T00:00:00Z")
    kept = model_store.register(spark, f"{shared.folder(spark)}/models-{uuid.uuid4().hex}", new, allow_write=True)
    return model_store.scored(rows, model_store.latest(kept))


@query("fresh_movers", catalogue._series_sql("commodity_key, is_equity, last_date, lag, skew, fresh, refused, direction, round(pct, 6) AS pct, rank", "done", catalogue._OU + f""",
days AS (SELECT commodity_key, CASE WHEN commodity_key % 6 = 0 THEN max(price_date) - 40 WHEN commodity_key % 6 = 1 THEN NULL ELSE max(price_date) END AS last_date, arg_max(y, price_date) AS last_value FROM series GROUP BY 1),
top AS (SELECT max(last_date) AS latest FROM days), week AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-08-08', INTERVAL 1 DAY)) AS DATE) AS d),
aged AS (SELECT d.*, (SELECT count(*) FROM week WHERE d > latest AND d <= DATE '2001-08-08' AND isodow(d) < 6) AS lag, CASE WHEN last_date IS NULL THEN 999 ELSE (SELECT count(*) FROM week w WHERE w.d > last_date AND w.d <= latest AND isodow(w.d) < 6) END AS skew FROM days d, top),
p AS (SELECT a.*, commodity_key % 2 = 0 AS is_equity, (predicted / last_value - 1) * 100 AS pct FROM aged a JOIN path USING (commodity_key) WHERE step = {catalogue.HORIZON}),
q AS (SELECT *, CASE WHEN pct > 0 THEN 'up' ELSE 'down' END AS direction FROM p WHERE pct <> 0 AND skew <= 3 AND lag <= 10),
done AS (SELECT commodity_key, is_equity, last_date, lag::INT AS lag, skew::INT AS skew, true AS fresh, false AS refused, direction, pct, row_number() OVER (PARTITION BY is_equity, direction ORDER BY abs(pct) DESC, commodity_key)::INT AS rank FROM q QUALIFY rank <= 5)"""))
def fresh_movers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest changes among equities and among the others, of series that don't lag behind the latest one."""
    rows = star.series(spark, sf_dir)
    ends = catalogue._ou_path(spark, sf_dir).filter(F.col("step") == catalogue.HORIZON).select("commodity_key", F.col("predicted").alias("end_value"))
    key, newest = F.col("commodity_key"), F.max("price_date")
    last = rows.groupBy("commodity_key").agg(newest.alias("d"), F.max_by("y", "price_date").alias("last_value"))
    last = last.withColumn("last_date", F.when(key % 6 == 0, F.date_sub("d", 40)).when(key % 6 != 1, F.col("d"))).drop("d")
    own = forecast.fresh(last.join(ends, "commodity_key").withColumn("is_equity", key % 2 == 0), "2001-08-08", 10, 3)
    found = forecast.movers(own.filter("fresh and not refused").withColumn("section", F.col("is_equity")), 5)
    return rounded(found.select("commodity_key", "is_equity", "last_date", "lag", "skew", "fresh", "refused", "direction", "pct", "rank"), "pct")
