"""The point-in-time panel: what was known on each day.

A row is visible on a day if what it is about and its release both lie on or before that day; of the visible rows of a
key the one with the greatest (observation, release, revision, id) wins. Since a running maximum only changes on days
on which rows become visible, each key's rows are first cut to one for each such day (a partial aggregation), then run
through a window of at most one row a day, and last spread over the days that each winner is valid for. The work is
that of the rows and of the output, never their product.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.registry import train_start

KEYS = ("commodity_key", "dim_key", "metric_code")


def starts(facts: DataFrame, dims: DataFrame, default: str = "2000-01-01", profiles: DataFrame | None = None) -> DataFrame:
    """commodity_key, first: the day that a commodity's profile names (``profiles``: commodity_key, profile, a JSON text),
    else its first observation, else ``default``."""
    first = facts.groupBy("commodity_key").agg(F.min("observation_date").alias("first"))
    begun = dims.select("commodity_key").distinct().join(first, "commodity_key", "left")
    named = F.lit(None).cast("date")
    if profiles is not None:
        own = profiles.groupBy(F.col("commodity_key").alias("__key")).agg(F.max(train_start()).alias("__named"))
        begun, named = begun.join(own, F.col("commodity_key") == F.col("__key"), "left"), F.col("__named")
    return begun.select("commodity_key", F.coalesce(named, "first", F.to_date(F.lit(default))).alias("first"))


def time_grid(facts: DataFrame, end: str, dims: DataFrame, start: str = "2000-01-01", profiles: DataFrame | None = None) -> DataFrame:
    """commodity_key, as_of_date: each commodity's days from the first one of starts() to ``end``."""
    last = F.to_date(F.lit(end))
    begun = starts(facts, dims, start, profiles).filter(F.col("first") <= last)
    return begun.select("commodity_key", F.explode(F.sequence("first", last)).alias("as_of_date"))


def for_every_commodity(facts: DataFrame, dims: DataFrame) -> DataFrame:
    """Rows of no commodity apply to each: an equi-join on the two kinds in place of a join on "equal or null".

    The rows are repeated where they are; commodities are few (a dimension), so their list travels as one array.
    """
    keys = dims.agg(F.array_sort(F.collect_set("commodity_key")).alias("__all"))
    joined = facts.withColumn("__one", F.lit(1)).join(F.broadcast(keys.withColumn("__one", F.lit(1))), "__one").drop("__one")
    each = F.when(F.col("commodity_key").isNull(), F.col("__all")).otherwise(F.filter(F.array("commodity_key"), lambda k: F.array_contains("__all", k)))
    return joined.withColumn("commodity_key", F.explode(each)).drop("__all")


def winners(facts: DataFrame, dims: DataFrame | None = None, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, winner (the struct that wins), since, until: validity intervals; until is null for the last.

    Rows are cut to one a day and key before those of no commodity are spread over the commodities of ``dims``, so what
    is spread are days, not facts; after that a key has at most two rows a day.
    """
    order = F.struct("observation_date", "release_date", "revision", "source_fact_id", "metric_value")
    daily = facts.groupBy(*keys, F.greatest("observation_date", "release_date").alias("since")).agg(F.max(order).alias("w"))
    if dims is not None:
        daily = for_every_commodity(daily, dims)
    by_key = Window.partitionBy(*keys).orderBy("since")  # rows of one day see each other
    return daily.withColumn("winner", F.max("w").over(by_key)).withColumn("until", F.date_sub(F.lead("since").over(by_key), 1)).drop("w")


def spans(won: DataFrame, begun: DataFrame, end: str) -> DataFrame:
    """The intervals of ``won``, cut to each commodity's days from ``first`` (in ``begun``) to ``end``."""
    last = F.to_date(F.lit(end))
    own = won.join(begun, "commodity_key").withColumn("a", F.greatest("since", "first")).withColumn("b", F.least(F.coalesce("until", last), last))
    return own.filter("a <= b").drop("since", "until", "first")


_FOUND = ("metric_value", "source_fact_id", "observation_date", "release_date")


def on_days(cut: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The winner of each key on each day of its intervals."""
    days = cut.select(*keys, "winner", F.explode(F.sequence("a", "b")).alias("as_of_date"))
    return days.select("as_of_date", *keys, *(f"winner.{c}" for c in _FOUND))


def as_runs(cut: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, the winner's columns, first_day, last_day: neighbouring intervals of one winner are one run."""
    own = cut.select(*keys, *(f"winner.{c}" for c in _FOUND), "a", "b")
    # a winner never comes back once another has taken its place
    return own.groupBy(*keys, *_FOUND).agg(F.min("a").alias("first_day"), F.max("b").alias("last_day"))


def as_of(facts: DataFrame, start: str, end: str, dims: DataFrame) -> DataFrame:
    """The winner of each key on each day from ``start`` to ``end``."""
    begun = dims.select("commodity_key", F.to_date(F.lit(start)).alias("first")).distinct()
    return on_days(spans(winners(facts, dims), begun, end))


def collapse(events: DataFrame) -> DataFrame:
    """One row for each day, commodity and metric: no region or instrument first, then the latest, then the largest id."""
    key = ("as_of_date", "commodity_key", "metric_code")
    rank = F.struct(F.col("dim_key").isNull(), (-F.coalesce("dim_key", F.lit(0))), "observation_date", "release_date", "source_fact_id", "metric_value")
    best = events.groupBy(*key).agg(F.max_by(F.struct("dim_key", "metric_value", "source_fact_id", "observation_date", "release_date"), rank).alias("x"))
    return best.select(*key, "x.*")


RANK = ("observation_date", "release_date", "source_fact_id", "metric_value")


def merged(cut: DataFrame, families: list[str], end: str) -> DataFrame:
    """The intervals of several families (column ``family``) as one set: where a key has winners of more than one on a day,
    the greatest (observation, release, id, value) stays. A winner stands until its family's next one, so each family's is
    the last so far at every day on which any changes."""
    w = Window.partitionBy(*KEYS).orderBy("a")  # rows of one day see each other
    rank = F.struct(*(F.col(f"winner.{c}").alias(c) for c in RANK))
    now = F.array_max(F.array_compact(F.array(*(F.last(F.when(F.col("family") == f, rank), ignorenulls=True).over(w) for f in families))))
    points = cut.select(*KEYS, "a", now.alias("winner"))
    once = points.groupBy(*KEYS, "a").agg(F.max("winner").alias("winner"))
    return once.withColumn("b", F.coalesce(F.date_sub(F.lead("a").over(w), 1), F.to_date(F.lit(end))))


def scalar_spans(cut: DataFrame) -> DataFrame:
    """commodity_key, metric_code, dim_key, winner, a, b: of the intervals of a commodity's metric those of the dimension
    that comes first (none at all, then the smallest number). A dimension that has been seen stays, so another one's
    intervals count until the first day of one that comes before it: days are never spread out for it."""
    first = cut.groupBy(*KEYS).agg(F.min("a").alias("__first"))
    before = Window.partitionBy("commodity_key", "metric_code").orderBy(F.col("dim_key").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    limits = first.withColumn("__until", F.min("__first").over(before)).select(*(F.col(k).alias(f"__{k}") for k in KEYS), "__until")
    same = F.lit(True)
    for k in KEYS:
        same = same & cut[k].eqNullSafe(F.col(f"__{k}"))
    own = cut.join(limits, same).filter("__until is null or a < __until")
    return own.select(*KEYS, "winner", "a", F.least("b", F.coalesce(F.date_sub("__until", 1), F.col("b"))).alias("b"))


def wide_runs(scalars: DataFrame, metrics: list[str], end: str) -> DataFrame:
    """commodity_key, first_day, last_day and a winner for each metric: one row for each run of days on which nothing
    changes. What is shuffled are changes."""
    changed = scalars.withColumnRenamed("a", "first_day").groupBy("commodity_key", "first_day").pivot("metric_code", metrics).agg(F.first("winner", ignorenulls=True))
    w = Window.partitionBy("commodity_key").orderBy("first_day")
    last = F.coalesce(F.date_sub(F.lead("first_day").over(w), 1), F.to_date(F.lit(end)))
    so_far = {m: F.last(F.col(f"`{m}`"), ignorenulls=True).over(w) for m in metrics}
    return changed.select("commodity_key", "first_day", last.alias("last_day"), *(c.alias(m) for m, c in so_far.items()))


def documents(runs: DataFrame, metrics: list[str]) -> DataFrame:
    """as_of_date, commodity_key, features: for each day an array of structs in the order of the metrics' names."""
    item = lambda m: F.struct(F.lit(m).alias("metric_code"), *(F.col(f"`{m}`.{c}").alias(c) for c in ("metric_value", "observation_date", "release_date")))
    held = F.array_compact(F.array(*(F.when(F.col(f"`{m}`").isNotNull(), item(m)) for m in sorted(metrics))))
    return runs.select("commodity_key", held.alias("features"), F.explode(F.sequence("first_day", "last_day")).alias("as_of_date"))


def as_document(scalars: DataFrame) -> DataFrame:
    """as_of_date, commodity_key, features: an array of structs in the order of the metrics."""
    item = F.struct("metric_code", "metric_value", "observation_date", "release_date")
    return scalars.groupBy("as_of_date", "commodity_key").agg(F.array_sort(F.collect_list(item)).alias("features"))


def wide(scalars: DataFrame, metrics: list[str]) -> DataFrame:
    """One column for each of the given metrics; naming them keeps the schema fixed and needs no job to find them."""
    return scalars.groupBy("as_of_date", "commodity_key").pivot("metric_code", metrics).agg(F.first("metric_value", ignorenulls=True))


def forward_fill(grid: DataFrame, panel: DataFrame, metrics: list[str], zeros: bool = False) -> DataFrame:
    """``grid`` with the panel's metrics, gaps filled from the past alone; leading gaps null, or 0.0."""
    by_key = Window.partitionBy("commodity_key").orderBy("as_of_date").rowsBetween(Window.unboundedPreceding, 0)
    full = grid.join(panel, ["commodity_key", "as_of_date"], "left")
    fill = {m: F.last(m, ignorenulls=True).over(by_key) for m in metrics}
    return full.withColumns({m: F.coalesce(c, F.lit(0.0)) if zeros else c for m, c in fill.items()})


def column_names(codes: DataFrame) -> DataFrame:
    """name, metric_code: each metric with a name of small letters, digits and underscores, for ``wide``."""
    return codes.select(F.regexp_replace(F.lower("metric_code"), "[^a-z0-9_]", "_").alias("name"), "metric_code").distinct()
