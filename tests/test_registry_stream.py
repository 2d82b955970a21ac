"""Models of profiles, configurations against a catalog, and a stream that is reconciled with what is stored."""

from __future__ import annotations

import datetime as dt
import json

import pytest

from tidemark.operators import registry
from tidemark.streaming import ingest


def test_models_of_profiles(spark):
    doc = '{"models": [{"model_code": "a", "family": "f", "horizon": "daily"}, {"model_code": "b", "family": "g", "horizon": "yearly"}]}'
    profiles = spark.createDataFrame([("X", doc), ("Y", "{}"), ("Z", None)], "code string, profile string")
    got = sorted(map(tuple, registry.models(profiles, "code").collect()), key=str)
    assert got == [("X", "a", "f", "daily", 1, None), ("X", "b", "g", "yearly", None, None), ("Y", None, None, None, None, "no models"), ("Z", None, None, None, None, "no models")]
    assert [r.model_code for r in registry.models(profiles, "code", model_code="b").filter("error is null").collect()] == ["b"]
    assert {(r.code, r.error) for r in registry.models(profiles, "code", horizon="monthly").collect()} == {("X", "no horizon monthly"), ("Y", "no models"), ("Z", "no models")}
    with pytest.raises(ValueError, match="yearly"):
        registry.models(profiles, "code", horizon="yearly")
    assert registry.identifier("Rain_mm") == "rain_mm"
    for bad in ("1a", "a b", "a;drop", ""):
        with pytest.raises(ValueError):
            registry.identifier(bad)


def test_configuration_against_a_catalog(spark):
    config = spark.createDataFrame(
        [
            (0, "CORN", "44", "output", 28, "US", "t"), (0, "CORN", "44", "stocks", 28, "BR", "t"), (0, "CORN", "44", "use", 88, None, "kg"),
            (1, "CORN", "44", "output", 28, "US", "t"), (2, "RICE", "9", None, None, None, None), (3, "GUAR", "7", "output", 1, "IN", "t"),
            (4, "WHEAT", "5", "output", 28, "US", "t"), (5, "LEGACY", "1", "output", 3, "US", "t"), (6, "OATS", "6", "output", 99, "US", "t"),
        ],
        "place int, commodity_code string, external_id string, metric_code string, attribute_id int, country string, unit string",
    )
    catalog = spark.createDataFrame(
        [("CORN", "44", 28, "t"), ("CORN", "44", 88, "t"), ("RICE", "9", 28, "t"), ("GUAR", None, None, None), ("WHEAT", "50", 28, "t"), ("OATS", "6", 28, "t")],
        "commodity_code string, external_id string, attribute_id int, unit string",
    )
    got = {(r.place, r.metric_code): r.issues for r in registry.catalog_issues(config, catalog).collect()}
    assert got == {
        (0, "stocks"): ["ATTRIBUTE_REUSED"], (0, "use"): ["NO_COUNTRY", "OTHER_UNIT"], (1, "output"): ["DUPLICATE_COMMODITY", "DUPLICATE_GRAIN"],
        (2, None): ["NO_METRICS"], (3, "output"): ["UNAVAILABLE"], (4, "output"): ["OTHER_ID"], (6, "output"): ["UNKNOWN_ATTRIBUTE"],
    }


def test_stream_is_reconciled(spark, tmp_path):
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(k)
    schema = "key string, day date, value double, landed long"
    where = [f"file://{tmp_path}/{x}" for x in ("in", "out", "status", "check")]

    def land(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(where[0])
        stream = ingest.read_landed(spark, where[0], spark.createDataFrame([], schema).schema)
        ingest.reconcile_to(stream, *where[1:], today="2024-02-01")
        return {(r.key, r.day): (r.value, r.revision) for r in ingest.stored(spark, where[1]).collect()}

    a = [("a", day(k), 10.0 + k, 1) for k in range(10)]
    b = [("b", day(k), 20.0, 1) for k in range(10)]
    got = land(a + b + [("a", day(0), 99.0, 0), (None, day(0), 1.0, 1), ("c", day(0), -1.0, 1)])
    assert got == {(k, d): (v, 0) for k, d, v, _ in a + b}  # the row that landed last, no keyless or negative ones
    # a goes on, with a day that comes late; b was restated as a whole
    more = [("a", day(k), 10.0 + k, 2) for k in range(5, 12)] + [("a", day(-3), 7.0, 2)]
    halved = [("b", day(k), 10.0, 2) for k in range(12)]
    got = land(more + halved)
    assert got[("a", day(11))] == (21.0, 0) and got[("a", day(-3))] == (7.0, 0) and got[("a", day(3))] == (13.0, 0)
    assert {v for (k, _), v in got.items() if k == "b"} == {(10.0, 1)} and len(got) == 13 + 12
    # a reload that lacks most of what is stored is refused
    assert land([("b", day(k), 5.0, 3) for k in range(9, 12)]) == got
    status = {(r.batch, r.key): r.status for r in spark.read.parquet(where[2]).collect()}
    assert status[0, "a"] == "empty" and status[1, "a"] == "appended" and status[1, "b"] == "restated" and status[2, "b"] == "error"
    assert land([("a", day(11), 21.0, 4)]) == got  # nothing new


def test_profiles_are_loaded_as_one_version(spark):
    schemas = {
        "dim_commodity": "commodity_code string, " + ", ".join(f"{c} string" for c in registry.COMMODITY), "dim_market_instrument": "code string, " + ", ".join(f"{c} string" for c in registry.INSTRUMENT),
        "dim_region": "region_code string, region_name string, country string", "dim_data_source": "source_code string, name string, url string, access string, license string",
        "commodity_region_map": "link string, label string", "registry": "commodity_code string, checksum string, version int",
    }
    empty = {k: spark.createDataFrame([], s) for k, s in schemas.items()}
    docs = [
        ("a.json", {"commodity_code": " CORN ", "commodity_name": "Corn", "commodity_group": "grain", "market_instruments": [{"instrument_code": "ZC", "currency": "USD"}, {"instrument_code": ""}],
                    "production_regions": [{"region_code": "US", "name": "Plains"}], "consumption_regions": [{"region_code": "CN"}], "data_sources": [{"source_code": "usda", "url": "u1"}]}),
        ("b.json", {"commodity_code": "RICE", "commodity_group": "grain", "production_regions": [{"region_code": "US", "name": "Delta", "country": "USA"}], "data_sources": [{"source_code": "usda", "name": "USDA", "url": "u2"}]}),
        ("c.json", {"name": "no code"}),
    ]
    roles = {"production_regions": "production", "consumption_regions": "consumption"}
    load = lambda rows, held: registry.load_profiles(spark.createDataFrame([(p, json.dumps(d)) for p, d in rows], "source_path string, profile string"), held, roles)
    told = lambda summary: {(r.entity, r.change): r.n for r in summary.collect()}
    tables, summary = load(docs, empty)
    assert told(summary) == {("dim_commodity", "created"): 2, ("dim_market_instrument", "created"): 1, ("dim_region", "created"): 2, ("dim_data_source", "created"): 1, ("commodity_region_map", "created"): 3, ("registry", "created"): 2}
    region = {r.region_code: (r.region_name, r.country) for r in tables["dim_region"].collect()}
    assert region == {"US": ("Plains", "USA"), "CN": ("CN", None)}  # the first name, gaps filled
    assert tables["dim_data_source"].first()[:3] == ("usda", "USDA", "u1") and {r.label for r in tables["commodity_region_map"].collect()} == {"Plains", "Delta", "CN"}
    held = {k: spark.createDataFrame(t.collect(), schemas[k]) for k, t in tables.items()}
    assert {c for _, c in told(load(docs, held)[1])} == {"unchanged"}
    docs[1][1]["commodity_name"] = "Rice"
    tables, summary = load(docs[1:2], held)
    assert told(summary)["dim_commodity", "updated"] == 1 and told(summary)["registry", "updated"] == 1 and ("dim_region", "updated") not in told(summary)
    assert {r.commodity_code: r.version for r in tables["registry"].collect()} == {"CORN": 1, "RICE": 2} and tables["dim_commodity"].count() == 2
