"""A price as money flow over supply, with a trend and seasons for the rest: fit, forecast, hold-out, daily path."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import business_day_after
from tidemark.operators.forecast import cut_points, numbered, supply

#: What drives the supply, and the value of those that a frame lacks (None: it must have them).
DRIVERS = {"planted_area": None, "import_volume": None, "inventory": None, "weather_index": 1.0, "pest_index": 1.0, "quality_delta": 0.0, "import_shock": 0.0, "k": 1.0}


@dataclass(frozen=True)
class Config:
    """Lags in months, yield, loss and floor of the supply; months of the money flow; seasons (months), trend's degree."""

    harvest_months: float = 6.0
    import_months: float = 0.7
    yield_: float = 10.0
    loss: float = 0.10
    flow_months: int = 12
    seasons: tuple[float, ...] = (12.0, 6.0, 24.0)
    degree: int = 2
    floor: float = 1e-6

    @property
    def least(self) -> int:
        return max(12, self.flow_months + 3)


def frame(features: DataFrame, roles: dict[str, str]) -> DataFrame:
    """The columns of ``features`` that play the supply's roles (role: column), each under its role's name.

    A role that must be filled and isn't raises ValueError; the others take their neutral values, as nulls do.
    """
    missing = [r for r, v in DRIVERS.items() if v is None and roles.get(r) not in features.columns]
    if missing:
        raise ValueError(f"no column for {missing}")
    keys = [c for c in ("commodity_key", "price_date", "month", "price") if c in features.columns]
    value = {r: F.col(roles[r]).cast("double") if roles.get(r) in features.columns else F.lit(v) for r, v in DRIVERS.items()}
    return features.select(*keys, *((value[r] if v is None else F.coalesce(value[r], F.lit(v))).alias(r) for r, v in DRIVERS.items()))


def to_monthly(daily: DataFrame) -> DataFrame:
    """A row a month: its last price and the means of the drivers."""
    month = F.trunc("price_date", "MM").alias("month")
    return daily.groupBy("commodity_key", month).agg(F.max_by("price", "price_date").alias("price"), *(F.avg(c).alias(c) for c in DRIVERS))


def carried(monthly: DataFrame, months: DataFrame) -> DataFrame:
    """``months`` (commodity_key, month) with each series' last drivers and no price."""
    last = monthly.groupBy("commodity_key").agg(*(F.max_by(c, "month").alias(c) for c in DRIVERS))
    return months.select("commodity_key", "month").join(last, "commodity_key").withColumn("price", F.lit(None).cast("double"))


def mechanical(history: DataFrame, config: Config, future: DataFrame | None = None) -> DataFrame:
    """known, t, q, m_flow, p_mechanical of each row: supply by lagged drivers, the trailing mean of price times supply
    (in the future the last one), and their quotient times k. Future rows come after all of the history's."""
    columns = ["commodity_key", "month", "price", *DRIVERS]
    rows = history.select(*columns, F.lit(True).alias("known"))
    if future is not None:
        rows = rows.unionByName(future.select("commodity_key", "month", F.lit(None).cast("double").alias("price"), *DRIVERS, F.lit(False).alias("known")))
    w = Window.partitionBy("commodity_key").orderBy(F.desc("known"), "month")
    rows = rows.withColumn("i", F.row_number().over(w))
    whole = Window.partitionBy("commodity_key")
    rows = supply(rows, round(config.harvest_months), round(config.import_months), config.yield_, config.loss, config.floor, order="i")
    flow = F.avg(F.col("price") * F.col("q")).over(w.rowsBetween(1 - config.flow_months, 0))
    rows = rows.withColumn("m_flow", F.when(F.col("known"), flow))
    last = F.max_by("m_flow", F.when(F.col("known"), F.col("i"))).over(whole)
    rows = rows.withColumn("m_flow", F.coalesce("m_flow", last))
    start = F.min(F.when(F.col("known"), F.col("month"))).over(whole)
    t = 12 * (F.year("month") - F.year(start)) + F.month("month") - F.month(start)
    return rows.withColumn("p_mechanical", F.col("m_flow") / F.greatest("q", F.lit(config.floor)) * F.col("k")).withColumn("t", t)


PARTS = "month date, known boolean, price double, q double, m_flow double, p_mechanical double, p_rest double, p_total double"


def decomposed(rows: DataFrame, config: Config) -> DataFrame:
    """What mechanical() gives with p_rest, the trend and seasons fitted to what known prices leave, and the sum of both;
    nulls for a series of too few known rows. A series' months are one group: some hundred rows."""
    names = ["commodity_key", *(c.split()[0] for c in PARTS.split(", "))]

    def kernel(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i").reset_index(drop=True)
        known = pdf["known"].to_numpy(bool)
        pdf["p_rest"] = np.nan
        if known.sum() >= config.least:
            t = pdf["t"].to_numpy(float)
            waves = [f(2 * np.pi * t / p) for p in config.seasons for f in (np.cos, np.sin)]
            x = np.column_stack([t**d for d in range(config.degree + 1)] + waves)
            rest = (pdf["price"] - pdf["p_mechanical"]).to_numpy(float)
            pdf["p_rest"] = x @ np.linalg.lstsq(x[known], rest[known], rcond=None)[0]
        pdf["p_total"] = pdf["p_mechanical"] + pdf["p_rest"]
        return pdf[names]

    needed = rows.select("commodity_key", "month", "i", "t", "known", "price", "q", "m_flow", "p_mechanical")
    out = needed.groupBy("commodity_key").applyInPandas(kernel, f"commodity_key {rows.schema['commodity_key'].dataType.simpleString()}, {PARTS}")
    return out.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("price", "p_rest", "p_total")})


def components(history: DataFrame, config: Config) -> DataFrame:
    """The decomposition of the months that the fit has seen."""
    return decomposed(mechanical(history, config), config).drop("known")


def predicted(history: DataFrame, future: DataFrame, config: Config) -> DataFrame:
    """The future months' price and its parts; their drivers come with them (carried() gives the last ones)."""
    return decomposed(mechanical(history, config, future), config).filter("not known").drop("known", "price")


def holdout(history: DataFrame, config: Config, share: float = 0.2) -> DataFrame:
    """n_test, mae, rmse, mape of the last ``share`` of each series' rows, forecast from the others with the rows' own
    drivers; series whose first part is too short for a fit have no row."""
    w = Window.partitionBy("commodity_key")
    rows = history.withColumn("__i", F.row_number().over(w.orderBy("month"))).withColumn("__n", F.count("*").over(w))
    n_test = F.greatest(F.lit(1), F.bround(F.col("__n") * share).cast("int"))
    rows = rows.withColumn("__train", F.col("__n") - n_test).filter(F.col("__train") >= config.least)
    train, test = rows.filter("__i <= __train"), rows.filter("__i > __train")
    both = predicted(train, test, config).join(test.select("commodity_key", "month", "price"), ["commodity_key", "month"])
    error = F.abs(F.col("p_total") - F.col("price"))
    return both.groupBy("commodity_key").agg(
        F.count("*").alias("n_test"),
        F.avg(error).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        (100 * F.avg(F.when(F.abs("price") >= 1e-12, error / F.abs("price")))).alias("mape"),
    )


def daily_path(daily: DataFrame, config: Config, steps: int) -> DataFrame:
    """commodity_key, step, target_date, predicted: the monthly forecast carried over each month's business days and
    scaled to start at the last price; the last price where there is no fit or no month's forecast is above 0."""
    monthly = to_monthly(daily)
    last = daily.groupBy("commodity_key").agg(F.max("price_date").alias("as_of_date"), F.max_by("price", "price_date").alias("anchor"))
    ahead = last.select("*", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    days = ahead.withColumn("target_date", business_day_after(F.col("as_of_date"), F.col("step")))
    days = days.withColumn("month", F.trunc("target_date", "MM"))
    made = predicted(monthly, carried(monthly, days.select("commodity_key", "month").distinct()), config).select("commodity_key", "month", "p_total")
    w = Window.partitionBy("commodity_key")
    rows = days.join(made, ["commodity_key", "month"], "left").withColumn("first", F.min_by("p_total", "step").over(w))
    good = (F.count("p_total").over(w) == F.count("*").over(w)) & (F.max("p_total").over(w) > 0)
    scale = F.when(F.col("first") != 0, F.try_divide("anchor", "first")).otherwise(1.0)
    return rows.select("commodity_key", "step", "target_date", F.when(good, F.col("p_total") * scale).otherwise(F.col("anchor")).alias("predicted"))


def fold_errors(daily: DataFrame, config: Config, steps: int, min_train: int, folds: int) -> DataFrame:
    """commodity_key, cut, predicted, actual: the daily path's last step from every cut, all folds of all series at once.

    A fold is a series of its own, of the rows before its cut; a row travels once for each fold that sees it.
    """
    rows = numbered(daily.filter("price > 0"))
    cuts = cut_points(rows.groupBy("commodity_key").agg(F.max("n").alias("n")), min_train, steps, folds)
    own = rows.join(cuts, "commodity_key")
    seen = own.filter("i < cut").withColumn("commodity_key", F.concat_ws("#", F.col("commodity_key").cast("string"), F.col("cut").cast("string")))
    ends = daily_path(seen.drop("i", "n", "cut"), config, steps).filter(F.col("step") == steps).select(F.col("commodity_key").alias("__fold"), "predicted")
    true = own.filter(F.col("i") == F.col("cut") + steps - 1).select("commodity_key", "cut", F.col("price").alias("actual"))
    return true.join(ends, F.concat_ws("#", F.col("commodity_key").cast("string"), F.col("cut").cast("string")) == F.col("__fold")).drop("__fold")
