"""Features of ordered series as window expressions; every one looks at the past of its own row alone."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(key: str = "commodity_key", day: str = "price_date") -> WindowSpec:
    return Window.partitionBy(key).orderBy(day)


def trailing(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(1 - n, 0)


def tabular(series: DataFrame) -> DataFrame:
    """Lagged log returns, deviations from trailing means, volatility and the season of each row."""
    w = ordered()
    logs = series.withColumn("ly", F.log("y")).withColumn("ret_1", F.col("ly") - F.lag("ly").over(w))
    angle = 2 * math.pi * F.dayofyear("price_date") / 365.25
    return logs.select(
        "commodity_key",
        "price_date",
        "ret_1",
        (F.col("ly") - F.lag("ly", 5).over(w)).alias("ret_5"),
        (F.col("ly") - F.lag("ly", 20).over(w)).alias("ret_20"),
        (F.col("ly") - F.avg("ly").over(trailing(w, 20))).alias("dev_20"),
        (F.col("ly") - F.avg("ly").over(trailing(w, 60))).alias("dev_60"),
        F.stddev_pop("ret_1").over(trailing(w, 20)).alias("vol_20"),
        F.sin(angle).alias("sin_doy"),
        F.cos(angle).alias("cos_doy"),
    )


def target(series: DataFrame, horizon: int, warm_up: int = 60) -> DataFrame:
    """log(y[i + horizon]) - log(y[i]) for the rows from number ``warm_up`` on that have a future."""
    w = ordered()
    rows = series.withColumn("i", F.row_number().over(w) - 1).withColumn("target", F.log(F.lead("y", horizon).over(w)) - F.log("y"))
    return rows.filter((F.col("i") >= warm_up) & F.col("target").isNotNull()).select("commodity_key", "price_date", "i", "target")


def harmonics(series: DataFrame, periods: tuple[float, ...]) -> DataFrame:
    i = F.row_number().over(ordered()) - 1
    waves = [f(2 * math.pi * i / p).alias(f"{name}_{p:g}".replace(".", "_")) for p in periods for name, f in (("sin", F.sin), ("cos", F.cos))]
    return series.select("commodity_key", "price_date", *waves)


def causal_trailing_mean(value: Column, w: WindowSpec, n: int) -> Column:
    """The mean of the last ``n`` rows; at the head, of those there are."""
    return F.avg(value).over(trailing(w, n))


def rolling_mean_min_periods(value: Column, w: WindowSpec, n: int) -> Column:
    """The mean of the last ``n`` rows if at least half of them have a value, else that of all rows so far."""
    enough = F.count(value).over(trailing(w, n)) >= max(1, n // 2)
    return F.when(enough, F.avg(value).over(trailing(w, n))).otherwise(F.avg(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def month_end(series: DataFrame) -> DataFrame:
    """The last price and its date, and the mean, of each month."""
    month = F.trunc("price_date", "MM")
    return series.groupBy("commodity_key", month.alias("month")).agg(F.max_by("y", "price_date").alias("last_y"), F.max("price_date").alias("last_date"), F.avg("y").alias("mean_y"))


def lag_months(monthly: DataFrame, column: str, months: float) -> DataFrame:
    """``column`` of ``months`` (rounded) rows before, 0 where there is none."""
    return monthly.withColumn(f"{column}_lag", F.lag(column, round(months), 0.0).over(ordered(day="month")))


def step_function(changes: DataFrame, key: str, day: str, value: str, end: str) -> DataFrame:
    """A value for every day from each change on, until the day before the next one."""
    w = Window.partitionBy(key).orderBy(day)
    until = F.coalesce(F.date_sub(F.lead(day).over(w), 1), F.to_date(F.lit(end)))
    spans = changes.withColumn("__until", until).filter(F.col(day) <= F.col("__until"))
    return spans.select(key, F.explode(F.sequence(day, "__until")).alias("day"), value)


def fill_both_ways(rows: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """Gaps take the last value before them; those at the head the first one after."""
    w = Window.partitionBy(key).orderBy(day)
    before = F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(value, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return rows.withColumn(value, F.coalesce(before, after))
