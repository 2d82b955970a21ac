"""Reconciling a stored series with what its source serves now: append, restate as a whole, or refuse.

The last anchor dates that both sides have must agree. If they do, new dates are appended at the stored revision. If
not, the source has restated its history: the whole reload becomes the next revision, known from today on, provided it
reproduces enough of the stored dates. Today's row may still change and is no evidence.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    anchors: int = 5
    epsilon_pct: float = 0.1  # of an anchor's value
    coverage: float = 0.9  # of the stored dates that a reload has
    jump_pct: float = 30.0


def both_sides(stored: DataFrame, fetched: DataFrame) -> DataFrame:
    """key, day, old, revision, new; ``stored`` has key, day, value, revision, ``fetched`` key, day, value."""
    a = stored.select("key", "day", F.col("value").alias("old"), "revision")
    b = fetched.select("key", "day", F.col("value").alias("new")).filter("new > 0")
    return a.join(b, ["key", "day"], "full_outer")


def statuses(stored: DataFrame, fetched: DataFrame, today: str, limits: Limits = Limits()) -> DataFrame:
    """key, n_stored, n_fetched, anchors, mismatched, revision, status: empty, error, no_anchor, fresh, appended, restated."""
    now = F.to_date(F.lit(today))
    anchor = F.col("old").isNotNull() & F.col("new").isNotNull() & (F.col("day") != now)
    last = Window.partitionBy("key").orderBy(F.desc(F.when(anchor, F.col("day"))))
    ranked = both_sides(stored, fetched).withColumn("__anchor", anchor).withColumn("__checked", anchor & (F.row_number().over(last) <= limits.anchors))
    off = (F.col("old") <= 0) | (F.abs(F.try_divide("new", "old") - 1) * 100 > limits.epsilon_pct)
    sums = ranked.groupBy("key").agg(
        F.count("old").alias("n_stored"),
        F.count("new").alias("n_fetched"),
        F.count_if("__checked").alias("anchors"),
        F.count_if(F.col("__checked") & off).alias("mismatched"),
        F.count_if(F.col("old").isNotNull() & F.col("new").isNotNull()).alias("n_shared"),
        F.count_if(F.col("old").isNull()).alias("n_new"),
        F.max("revision").alias("revision"),
    )
    status = (
        F.when(F.col("n_stored") == 0, "empty")
        .when(F.col("n_fetched") == 0, "error")
        .when(F.col("anchors") == 0, "no_anchor")
        .when((F.col("mismatched") > 0) & (F.col("n_shared") < limits.coverage * F.col("n_stored")), "error")
        .when(F.col("mismatched") > 0, "restated")
        .when(F.col("n_new") > 0, "appended")
        .otherwise("fresh")
    )
    return sums.withColumn("status", status)


def new_rows(stored: DataFrame, fetched: DataFrame, judged: DataFrame, today: str) -> DataFrame:
    """key, day, value, revision, release_date, record_id of what is to be written, all of it or nothing for each key.

    Appended: the dates that the store lacks, at its revision, released when their record says (``fetched`` may have a
    release_date), else on their own day. Restated: every date of the reload at the next one, released today, so that what
    was known before today stays what it was. Revised rows have ids of their own.
    """
    if "release_date" not in fetched.columns:
        fetched = fetched.withColumn("release_date", F.col("day"))
    now = F.to_date(F.lit(today))
    own = fetched.filter("value > 0").join(judged.filter("status in ('appended', 'restated')").select("key", "status", F.col("revision").alias("held")), "key")
    known = stored.select("key", "day").withColumn("__known", F.lit(True))
    fresh = own.join(known, ["key", "day"], "left").filter((F.col("status") == "restated") | F.col("__known").isNull())
    restated = F.col("status") == "restated"
    revision = F.when(restated, F.col("held") + 1).otherwise(F.col("held"))
    mark = F.when(revision > 0, F.concat(F.lit("@r"), revision.cast("string"))).otherwise("")
    return fresh.select(
        "key", "day", "value", revision.cast("int").alias("revision"), F.when(restated, F.greatest(now, "day")).otherwise(F.greatest("release_date", "day")).alias("release_date"),
        F.concat(F.concat_ws(":", F.col("key").cast("string"), F.col("day").cast("string")), mark).alias("record_id"),
    )


def jumps(series: DataFrame) -> DataFrame:
    """key, worst_pct: the largest change from one row to the next, in percent; 0 if there are fewer than two."""
    before = F.lag("value").over(Window.partitionBy("key").orderBy("day"))
    change: Column = F.when(before > 0, F.abs(F.col("value") / before - 1) * 100)
    return series.withColumn("__c", change).groupBy("key").agg(F.coalesce(F.max("__c"), F.lit(0.0)).alias("worst_pct"))


def warnings(stored: DataFrame, rows: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """key, worst_pct, jump: the largest change within what is to be written (new_rows), for appended rows from the last
    stored value on, and whether it is abnormal."""
    last = stored.groupBy("key").agg(F.max("day").alias("day"), F.max_by("value", "day").alias("value"))
    appended = rows.join(stored.select("key", "day"), ["key", "day"], "left_semi").select("key").distinct()
    edge = last.join(rows.select("key").distinct(), "key", "left_semi").join(appended, "key", "left_anti")
    return jumps(rows.select("key", "day", "value").unionByName(edge.select("key", "day", "value"))).withColumn("jump", F.col("worst_pct") > limits.jump_pct)


def histogram(judged: DataFrame) -> DataFrame:
    """status, n, and ok: whether no key at all is in error or without an anchor."""
    counts = judged.groupBy("status").agg(F.count("*").alias("n"))
    bad = F.count_if(F.col("status").isin("error", "no_anchor")).over(Window.partitionBy())
    return counts.withColumn("ok", bad == 0)  # a row for each status, so the window has a few rows
