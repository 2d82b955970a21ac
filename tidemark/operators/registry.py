"""Dimensions and profiles: upserts that say what they did, versions by checksum, sections of profile documents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, fill_only: tuple[str, ...] = ()) -> DataFrame:
    """The dimension after ``new``: its values win, but for columns of ``fill_only``, which only fill gaps, and for nulls,
    which change nothing. change: created, updated, unchanged, or kept (not in ``new``)."""
    values = [c for c in old.columns if c != key]
    a = old.select(key, F.struct(*values).alias("__old"))
    b = new.select(key, F.struct(*values).alias("__new"))
    merged = {c: F.coalesce(*((f"__old.{c}", f"__new.{c}") if c in fill_only else (f"__new.{c}", f"__old.{c}"))) for c in values}
    out = a.join(b, key, "full_outer").withColumn("__is", F.struct(*(v.alias(c) for c, v in merged.items())))
    change = F.when(F.col("__old").isNull(), "created").when(F.col("__new").isNull(), "kept").when(F.col("__is").eqNullSafe(F.col("__old")), "unchanged").otherwise("updated")
    return out.select(key, "__is.*", change.alias("change"))


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return new.join(old.select(key), key, "left_anti")


def checksum(*parts: str) -> Column:
    """Of a group's rows, whatever their order: their number and the sum of their digests, by partial aggregation."""
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 12), 16, 10).cast("decimal(20,0)")
    return F.sha2(F.concat_ws(":", F.count("*"), F.sum(digest).cast("string")), 256)


def versions(held: DataFrame, loaded: DataFrame, key: str) -> DataFrame:
    """key, checksum, version, change after loading: the version goes up by one if and only if the checksum has changed."""
    a = held.select(key, F.col("checksum").alias("__sum"), F.col("version").alias("__version"))
    both = loaded.select(key, "checksum").join(a, key, "left")
    change = F.when(F.col("__sum").isNull(), "created").when(F.col("__sum") == F.col("checksum"), "unchanged").otherwise("updated")
    version = F.when(F.col("__sum").isNull(), 1).otherwise(F.col("__version") + (F.col("__sum") != F.col("checksum")).cast("int"))
    return both.select(key, "checksum", version.cast("int").alias("version"), change.alias("change"))


def bridge(profiles: DataFrame, key: str, section: str, columns: str) -> DataFrame:
    """key and the columns of each entry of an array of a profile document (column ``profile``, JSON)."""
    rows = F.from_json("profile", f"`{section}` array<struct<{columns}>>")[section]
    return profiles.select(key, F.inline(rows))


def composition(section: str) -> Column:
    """How many entries a section of the document has; 0 if it lacks the section."""
    return F.coalesce(F.json_array_length(F.get_json_object("profile", f"$.{section}")), F.lit(0)).cast("long")


def train_start() -> Column:
    return F.get_json_object("profile", "$.features.min_train_start_date").try_cast("date")


def feature_value(document: Column, metric: str) -> Column:
    """The value of a metric out of a document that is an array of (metric_code, metric_value)."""
    return F.get(F.filter(document, lambda x: x["metric_code"] == metric), F.lit(0))["metric_value"]


#: Business days of the horizons that a profile may name (fixed values).
HORIZON_DAYS = {"daily": 1, "weekly": 5, "monthly": 21}


def horizon_days(label: Column) -> Column:
    """Null for a label that stands for no horizon."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in HORIZON_DAYS.items() for x in pair)), label)


def models(profiles: DataFrame, key: str, model_code: str | None = None, horizon: str | None = None) -> DataFrame:
    """key, model_code, family, horizon, days, error: each profile's models, those of the code, or else of the horizon.

    A profile that has none such gives one row that says so.
    """
    if horizon is not None and horizon not in HORIZON_DAYS:
        raise ValueError(f"unsupported horizon {horizon!r}")
    entries = F.from_json("profile", "models array<struct<model_code:string,family:string,horizon:string>>")["models"]
    own = F.coalesce(entries, F.array().cast("array<struct<model_code:string,family:string,horizon:string>>"))
    picked = own
    if model_code is not None:
        picked = F.filter(own, lambda m: m["model_code"] == model_code)
    elif horizon is not None:
        picked = F.filter(own, lambda m: m["horizon"] == horizon)
    wanted = f"model {model_code}" if model_code is not None else f"horizon {horizon}"
    error = F.when(F.size(own) == 0, "no models").when(F.size(picked) == 0, f"no {wanted}")
    rows = profiles.select(key, error.alias("error"), F.inline_outer(picked))
    return rows.select(key, "model_code", "family", "horizon", horizon_days(F.col("horizon")).alias("days"), "error")


def catalog_issues(config: DataFrame, catalog: DataFrame) -> DataFrame:
    """place, commodity_code, metric_code, issues of the rows of a source's configuration that are not in order.

    ``config`` has a row for each metric of a series: place (the series' number), commodity_code, external_id, metric_code
    (null: the series has none), attribute_id, country, unit; ``catalog`` what the source offers: commodity_code,
    external_id (null: not available), attribute_id, unit. Commodities that the catalog lacks are judged by themselves.
    """
    first = lambda *by: F.min(F.struct("place", "metric_code")).over(Window.partitionBy(*by))
    own = F.struct("place", "metric_code")
    rows = config.withColumns({
        "__series": F.min("place").over(Window.partitionBy("commodity_code")),
        "__grain": first("external_id", "attribute_id", "country"),
        "__attribute": first("place", "attribute_id"),
    })
    offers = catalog.groupBy("commodity_code").agg(F.max("external_id").alias("__id"), F.lit(True).alias("__listed"))
    units = catalog.select("commodity_code", "attribute_id", F.col("unit").alias("__unit"), F.lit(True).alias("__offered")).dropDuplicates(["commodity_code", "attribute_id"])
    rows = rows.join(offers, "commodity_code", "left").join(units, ["commodity_code", "attribute_id"], "left")
    filled, served = F.col("metric_code").isNotNull(), F.col("__listed") & F.col("__id").isNotNull()
    checks = {
        "NO_METRICS": ~filled,
        "DUPLICATE_COMMODITY": F.col("__series") < F.col("place"),
        "NO_COUNTRY": filled & F.col("country").isNull(),
        "DUPLICATE_GRAIN": filled & F.col("country").isNotNull() & (F.col("__grain") < own),
        "ATTRIBUTE_REUSED": filled & (F.col("__attribute") < own),
        "UNAVAILABLE": F.col("__listed") & F.col("__id").isNull(),
        "OTHER_ID": served & ~F.col("__id").eqNullSafe(F.col("external_id")),
        "UNKNOWN_ATTRIBUTE": served & filled & F.col("__offered").isNull(),
        "OTHER_UNIT": served & filled & F.col("__offered") & ~F.col("__unit").eqNullSafe(F.col("unit")),
    }
    issues = F.array_compact(F.array(*(F.when(c, name) for name, c in checks.items())))
    return rows.select("place", "commodity_code", "metric_code", issues.alias("issues")).filter(F.size("issues") > 0)


def identifier(name: str) -> str:
    """A metric's name as a column name: lower case letters, digits and underscores, no digit first; else ValueError."""
    if not re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"not a column name: {name!r}")
    return name.lower()


def _text(name: str) -> Column:
    value = F.trim(F.get_json_object("profile", f"$.{name}"))
    return F.when(value != "", value)


def _one(rows: DataFrame, key: str, first: tuple[str, ...], last: tuple[str, ...] = ()) -> DataFrame:
    """A row for each key of several profiles' entries: the first value that there is in the order of the files, or the
    last one."""
    path = F.col("source_path")
    picked = [F.min_by(c, F.when(F.col(c).isNotNull(), path)).alias(c) for c in first] + [F.max_by(c, F.when(F.col(c).isNotNull(), path)).alias(c) for c in last]
    return rows.filter(F.coalesce(key, F.lit("")) != "").groupBy(key).agg(*picked)


COMMODITY = ("commodity_name", "commodity_group", "base_unit", "default_currency", "notes")
INSTRUMENT = ("exchange", "symbol", "description", "contract_unit", "currency")


def load_profiles(profiles: DataFrame, held: dict[str, DataFrame], regions: dict[str, str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables after loading ``profiles`` (source_path, profile, a JSON text with a commodity_code), to be written as one
    version, and a summary (entity, change, n).

    ``held`` has the tables as they are: dim_commodity, dim_market_instrument (its key is commodity and instrument code),
    dim_region, dim_data_source, commodity_region_map, registry. ``regions`` names the profile's sections of regions and
    the role that each stands for. Names and countries of regions and links of sources only fill gaps; a profile's version
    goes up if and only if its text has changed. Nothing is ever taken away.
    """
    own = profiles.withColumn("commodity_code", _text("commodity_code")).filter("commodity_code is not null")
    entries = lambda section, columns: bridge(own.select(F.struct("commodity_code", "source_path").alias("__of"), "profile"), "__of", section, columns).select("__of.*", *(c.split(" ")[0] for c in columns.split(", ")))
    text = lambda *names: ", ".join(f"{n} string" for n in names)
    commodities = own.select("commodity_code", *(_text(c).alias(c) for c in COMMODITY))
    instruments = entries("market_instruments", text("instrument_code", *INSTRUMENT)).filter("coalesce(instrument_code, '') <> ''")
    instruments = _one(instruments.withColumn("code", F.concat_ws("/", "commodity_code", "instrument_code")), "code", (), INSTRUMENT)
    placed = None
    for section, role in regions.items():
        part = entries(section, text("region_code", "name", "region_name", "country")).withColumn("role", F.lit(role))
        placed = part if placed is None else placed.unionByName(part)
    placed = placed.filter("coalesce(region_code, '') <> ''").withColumn("label", F.coalesce("name", "region_name", "region_code"))
    dim_region = _one(placed.withColumn("region_name", F.col("label")), "region_code", ("region_name", "country"))
    links = _one(placed.withColumn("link", F.concat_ws("/", "commodity_code", "region_code", "role")), "link", (), ("label",))
    sources = entries("data_sources", text("source_code", "name", "url", "access", "license")).withColumn("name", F.coalesce("name", "source_code"))
    changed = {
        "dim_commodity": upsert(held["dim_commodity"], commodities, "commodity_code"),
        "dim_market_instrument": upsert(held["dim_market_instrument"], instruments, "code"),
        "dim_region": upsert(held["dim_region"], dim_region, "region_code", ("region_name", "country")),
        "dim_data_source": upsert(held["dim_data_source"], _one(sources, "source_code", ("url", "access", "license"), ("name",)), "source_code", ("url", "access", "license")),
        "commodity_region_map": upsert(held["commodity_region_map"], links, "link"),
        "registry": versions(held["registry"], own.withColumn("checksum", F.sha2("profile", 256)), "commodity_code"),
    }
    summary = None
    for entity, rows in changed.items():
        part = rows.filter("change <> 'kept'").groupBy(F.lit(entity).alias("entity"), "change").agg(F.count("*").alias("n"))
        summary = part if summary is None else summary.unionByName(part)
    tables = {entity: rows.drop("change") for entity, rows in changed.items()}
    stays = held["registry"].join(own.select("commodity_code"), "commodity_code", "left_anti").select("commodity_code", "checksum", "version")
    tables["registry"] = tables["registry"].unionByName(stays)
    return tables, summary
