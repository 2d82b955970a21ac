"""Fitted models that are kept: coefficients as rows of a table, by version, scored by a join without another fit."""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import features
from tidemark.operators import kernels

#: What the rows of a store look like; rows of another format are refused.
FORMAT = 1
FEATURES = ("intercept", "ret_1", "ret_5", "ret_20", "dev_20", "dev_60", "vol_20", "sin_doy", "cos_doy")
ROW = "commodity_key int, model_code string, version int, horizon int, features array<string>, coefficients array<double>, mape double, naive_mape double, beats_naive boolean, trained_at string, format int"


def fitted(series: DataFrame, horizon: int) -> DataFrame:
    """commodity_key, coefficients: ridge on the features of all rows that have a future, by series."""

    def kernel(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        ly, days = kernels.positive(pdf)
        if len(ly) <= kernels.LOOK_BACK:
            return pd.DataFrame({"commodity_key": [], "coefficients": []})
        x, later = kernels.fitted_rows(ly, days, horizon)
        return pd.DataFrame({"commodity_key": [int(key[0])], "coefficients": [np.asarray(kernels.ridge(x[: len(later)], later)).tolist()]})

    return kernels.spread(series).groupBy("commodity_key").applyInPandas(kernel, "commodity_key int, coefficients array<double>")


def entries(coefficients: DataFrame, scores: DataFrame, model_code: str, horizon: int, trained_at: str) -> DataFrame:
    """Rows to be registered: coefficients with the backtest's errors (commodity_key, mape, naive_mape)."""
    rows = coefficients.join(scores.select("commodity_key", "mape", "naive_mape"), "commodity_key", "left")
    made = {"model_code": F.lit(model_code), "horizon": F.lit(horizon), "features": F.array(*map(F.lit, FEATURES)), "trained_at": F.lit(trained_at), "format": F.lit(FORMAT)}
    return rows.withColumns({**made, "beats_naive": F.coalesce(F.col("mape") < F.col("naive_mape"), F.lit(False))})


def registered(new: DataFrame, store: DataFrame) -> DataFrame:
    """``new`` entries as rows of the store, each with the version after the store's last of its commodity and model."""
    last = store.groupBy("commodity_key", "model_code").agg(F.max("version").alias("__last"))
    rows = new.join(last, ["commodity_key", "model_code"], "left").withColumn("version", F.coalesce("__last", F.lit(0)) + 1)
    return rows.select(*(c.split()[0] for c in ROW.split(", ")))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of a store; reading one of another format fails."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], ROW)
    rows = spark.read.schema(ROW).parquet(folder)
    other = F.raise_error(F.concat(F.lit("a model of format "), F.coalesce(F.col("format").cast("string"), F.lit("none")), F.lit(f" in a store of format {FORMAT}"))).cast("boolean")
    return rows.filter(F.when(F.col("format") == FORMAT, True).otherwise(other))


def register(spark: SparkSession, folder: str, new: DataFrame, allow_write: bool = False) -> DataFrame:
    """The rows under which ``new`` is registered; they are kept only with ``allow_write``."""
    rows = registered(new, read(spark, folder))
    if allow_write:
        rows.write.mode("append").parquet(folder)
        return read(spark, folder).join(new.select("commodity_key", "model_code").distinct(), ["commodity_key", "model_code"], "left_semi")
    return rows


def latest(store: DataFrame) -> DataFrame:
    """The last version of each commodity's models."""
    last = F.max_by(F.struct(*(c for c in store.columns if c not in ("commodity_key", "model_code"))), "version")
    return store.groupBy("commodity_key", "model_code").agg(last.alias("x")).select("commodity_key", "model_code", "x.*")


def best(store: DataFrame) -> DataFrame:
    """Of each commodity the last version of least error, of those that beat the naive forecast."""
    order = Window.partitionBy("commodity_key").orderBy("mape", "model_code")
    return latest(store).filter("beats_naive").withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def scored(series: DataFrame, models: DataFrame) -> DataFrame:
    """commodity_key, price_date, predicted: each row's price ``horizon`` rows on, by the model's coefficients."""
    rows = features.tabular(series).join(series.select("commodity_key", "price_date", "y"), ["commodity_key", "price_date"])
    value: dict[str, Column] = {"intercept": F.lit(1.0), **{f: F.col(f) for f in FEATURES[1:]}}
    both = rows.join(models.select("commodity_key", "model_code", "version", "horizon", "coefficients"), "commodity_key")
    total = sum((F.col("coefficients")[k] * value[f] for k, f in enumerate(FEATURES[1:], 1)), F.col("coefficients")[0] * value["intercept"])
    return both.select("commodity_key", "price_date", "model_code", "version", "horizon", (F.col("y") * F.exp(total)).alias("predicted"))
