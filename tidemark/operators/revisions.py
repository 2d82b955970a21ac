"""Reads of revisioned facts: benchmark instrument, single-basis series, latest of a grain, windows, fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def benchmark_instrument(facts: DataFrame) -> DataFrame:
    """The instrument with most distinct dates for each commodity; ties to none, then to the smallest key."""
    days = facts.groupBy("commodity_key", "dim_key").agg(F.count_distinct("observation_date").alias("n_days"))
    rank = F.struct("n_days", F.col("dim_key").isNull(), -F.coalesce("dim_key", F.lit(0)))
    return days.groupBy("commodity_key").agg(F.max_by("dim_key", rank).alias("dim_key"), F.max("n_days").alias("n_days"))


def latest_revision(facts: DataFrame) -> DataFrame:
    """Rows at the largest revision of their whole instrument series (a single basis, never a mix of revisions)."""
    top = facts.groupBy("commodity_key", "dim_key").agg(F.max("revision").alias("__top")).withColumnsRenamed({"commodity_key": "__c", "dim_key": "__d"})
    same = facts["commodity_key"].eqNullSafe(top["__c"]) & facts["dim_key"].eqNullSafe(top["__d"])
    return facts.join(top, same & (F.col("revision") == F.col("__top"))).drop("__c", "__d", "__top")


def latest_of_grain(facts: DataFrame) -> DataFrame:
    """The greatest revision (then id, then value) of each grain: key, metric and date."""
    grain = ("commodity_key", "dim_key", "metric_code", "observation_date")
    best = facts.groupBy(*grain).agg(F.max(F.struct("revision", "source_fact_id", "metric_value")).alias("x"))
    return best.select(*grain, "x.*")


def price_window(facts: DataFrame, as_of: str, days: int) -> DataFrame:
    """The last ``days`` (1 to 20000) of the benchmark instrument's series, at its latest revision."""
    if not 1 <= days <= 20000:
        raise ValueError("days must be from 1 to 20000")
    series = facts.groupBy("commodity_key", "dim_key").agg(F.count_distinct("observation_date").alias("n_days"), F.max("revision").alias("top"))
    rank = F.struct("n_days", F.col("dim_key").isNull(), -F.coalesce("dim_key", F.lit(0)))
    chosen = series.groupBy("commodity_key").agg(F.max_by(F.struct("dim_key", "top"), rank).alias("x")).select(F.col("commodity_key").alias("__c"), "x.*").toDF("__c", "__d", "__top")
    last = F.to_date(F.lit(as_of))
    recent = facts.filter(F.col("observation_date").between(F.date_sub(last, days), last))
    same = (recent["commodity_key"] == F.col("__c")) & recent["dim_key"].eqNullSafe(F.col("__d")) & (F.col("revision") == F.col("__top"))
    return recent.join(chosen, same).drop("__c", "__d", "__top")


def fingerprint(facts: DataFrame) -> DataFrame:
    """Rows, last date and largest revision of each commodity: equal while nothing has been added."""
    return facts.groupBy("commodity_key").agg(F.count("*").alias("n_rows"), F.max("observation_date").alias("last_date"), F.max("revision").alias("last_revision"))
