"""Audits of facts: duplicate grains, coverage, collisions, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duplicate_grains(facts: DataFrame, *grain: str) -> DataFrame:
    return facts.groupBy(*grain).agg(F.count("*").alias("n")).filter("n > 1")


def coverage(facts: DataFrame, source: str) -> DataFrame:
    """For each metric its rows, values, first and last dates, distinct releases and sources."""
    return facts.groupBy("metric_code").agg(
        F.count("*").alias("n_rows"),
        F.count("metric_value").alias("n_values"),
        (1 - F.count("metric_value") / F.count("*")).alias("null_rate"),
        F.min("observation_date").alias("first_date"),
        F.max("observation_date").alias("last_date"),
        F.min("release_date").alias("first_release"),
        F.max("release_date").alias("last_release"),
        F.count_distinct("release_date").alias("n_releases"),
        F.array_join(F.array_sort(F.collect_set(source)), ",").alias("sources"),
    )


def collisions(facts: DataFrame, kept: tuple[str, ...], dropped: str) -> DataFrame:
    """Rows that would collide if a key were left out of the grain."""
    each = facts.groupBy(*kept).agg(F.count("*").alias("n"), F.count_distinct(dropped).alias("n_dropped"))
    return each.agg(F.count("*").alias("n_grains"), F.sum("n").alias("n_rows"), F.sum(F.col("n") - 1).alias("n_colliding"), F.sum(F.when(F.col("n_dropped") > 1, F.col("n")).otherwise(0)).alias("n_mixed"))


def freshness(latest: DataFrame, today: str, warn: int, fail: int) -> DataFrame:
    """Days since each group's last date, and ok, warn or fail."""
    gap = F.datediff(F.to_date(F.lit(today)), F.col("last_date"))
    verdict = F.when(F.col("last_date").isNull() | (gap > fail), "fail").when(gap > warn, "warn").otherwise("ok")
    return latest.withColumn("gap_days", gap).withColumn("verdict", verdict)


def fact_fingerprint(facts: DataFrame, *by: str) -> DataFrame:
    """Rows, last date, largest revision and an order-free sum of the grains' digests: equal while the facts are the same."""
    grain = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("commodity_key", "dim_key", "metric_code", "observation_date", "release_date", "revision", "source_fact_id")))
    digest = F.conv(F.substring(F.md5(grain.cast("binary")), 1, 12), 16, 10).cast("decimal(20,0)")
    return facts.groupBy(*by).agg(F.count("*").alias("n_rows"), F.max("observation_date").alias("last_date"), F.max("revision").alias("last_revision"), F.sum(digest).cast("string").alias("grain_sum"))


def parity(a: DataFrame, b: DataFrame, key: tuple[str, ...], values: tuple[str, ...]) -> DataFrame:
    """One row: keys in both, in one alone, and keys whose values differ; keys are unique and compared null-safe."""
    side = lambda df, name: df.select(*key, F.struct(*values).alias(name))
    left, right = side(a, "__a"), side(b, "__b").withColumnsRenamed({k: f"__{k}" for k in key})
    same = F.lit(True)
    for k in key:
        same = same & left[k].eqNullSafe(right[f"__{k}"])
    both = left.join(right, same, "full_outer")
    return both.agg(
        F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("n_both"),
        F.count_if(F.col("__b").isNull()).alias("n_left"),
        F.count_if(F.col("__a").isNull()).alias("n_right"),
        F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull() & ~F.col("__a").eqNullSafe(F.col("__b"))).alias("n_differ"),
    )


def histogram(rows: DataFrame, by: str, bucket: Column, name: str) -> DataFrame:
    """For each group the counts of its buckets as one text, ``bucket=n`` in order."""
    counts = rows.groupBy(by, bucket.alias("__b")).agg(F.count("*").alias("n")).filter("__b is not null")
    each = F.array_sort(F.collect_list(F.struct("__b", "n")))
    return counts.groupBy(by).agg(F.array_join(F.transform(each, lambda x: F.concat_ws("=", x["__b"], x["n"])), ",").alias(name))


def vintages(facts: DataFrame, by: str) -> DataFrame:
    """First and last release of each group, rows without one, and rows by the decade of the release."""
    decade = (F.floor(F.year("release_date") / 10) * 10).cast("int")
    sums = facts.groupBy(by).agg(F.min("release_date").alias("first_release"), F.max("release_date").alias("last_release"), F.count_if(F.col("release_date").isNull()).alias("n_missing"))
    return sums.join(histogram(facts, by, decade, "decades"), by, "left")


def visible_at(facts: DataFrame, cuts: list[str], by: str, role: str, roles: list[str]) -> DataFrame:
    """For each group and cut whether every role has a row released by then, and the least number that one has.

    A row counts from the first cut on that it is released by, so no row meets more than one cut; sums run over cuts.
    """
    days = F.array(*(F.to_date(F.lit(c)) for c in sorted(cuts)))
    first = F.size(F.filter(days, lambda d: d < F.col("release_date")))
    counts = facts.filter(F.col(role).isin(roles) & F.col("release_date").isNotNull()).groupBy(by, F.col(role).alias("__role"), first.alias("__k")).agg(F.count("*").alias("n"))
    groups = facts.select(by).distinct().select(by, F.explode(F.array(*map(F.lit, roles))).alias("__role"), F.posexplode(days).alias("__k", "cut"))
    full = groups.join(counts, [by, "__role", "__k"], "left")
    so_far = F.coalesce(F.sum("n").over(Window.partitionBy(by, "__role").orderBy("__k")), F.lit(0))
    least = full.withColumn("__n", so_far).groupBy(by, "cut").agg(F.min("__n").alias("least_rows"))
    return least.withColumn("visible", F.col("least_rows") > 0)


def rolled_up(facts: DataFrame, levels: list[str], value: str, year: Column, unit: str) -> DataFrame:
    """Coverage by ``levels``, the outer ones first, and by each shorter list of them, down to all facts: rows, rows above 0
    and at 0, first and last year, years between that are missing, and counts by year and by unit as maps.

    The facts are aggregated once, to the levels with year and unit; all sums and maps are made of that.
    """
    base = facts.groupBy(*levels, year.alias("__year"), F.col(unit).alias("__unit")).agg(
        F.count("*").alias("__n"), F.count_if(F.col(value) > 0).alias("__pos"), F.count_if(F.col(value) == 0).alias("__zero")
    )
    sets = [levels[:k] for k in range(len(levels), -1, -1)]
    each = base.groupingSets([[*s, "__year", "__unit"] for s in sets], *levels, "__year", "__unit").agg(F.grouping_id().alias("__id"), *(F.sum(c).alias(c) for c in ("__n", "__pos", "__zero")))
    depth = F.lit(len(levels)) - sum((F.bit_get(F.col("__id"), F.lit(k + 2)).cast("int") for k in range(len(levels))), F.lit(0))
    group = [*levels, depth.alias("depth")]
    years = each.groupBy(*group, "__year").agg(*(F.sum(c).alias(c) for c in ("__n", "__pos", "__zero")))
    entries = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "__n"))))  # noqa: E731  a few years, a few units
    known = [*levels, "depth"]
    span = F.max("__year") - F.min("__year") + 1
    by_year = years.groupBy(*known).agg(
        F.sum("__n").alias("n_rows"), F.sum("__pos").alias("n_positive"), F.sum("__zero").alias("n_zero"), F.min("__year").alias("first_year"),
        F.max("__year").alias("last_year"), (span - F.count("__year")).alias("missing_years"), entries("__year").alias("years"),
    )
    by_unit = each.groupBy(*group, "__unit").agg(F.sum("__n").alias("__n")).groupBy(*known).agg(entries("__unit").alias("units")).withColumnsRenamed({c: f"__{c}" for c in known})
    same = F.lit(True)
    for c in known:
        same = same & by_year[c].eqNullSafe(F.col(f"__{c}"))
    return by_year.join(by_unit, same).select(*by_year.columns, "units")


def usable_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """The columns that have any number in them, by one pass; the others say nothing."""
    counts = df.agg(*(F.count(F.col(c).try_cast("double")).alias(c) for c in columns)).first()
    return [c for c in columns if counts[c]]


def resolve_column(columns: list[str], aliases: tuple[str, ...]) -> str | None:
    """The first alias that is there, whatever the case, as it is written there."""
    known = {c.lower(): c for c in reversed(columns)}
    return next((known[a.lower()] for a in aliases if a.lower() in known), None)
