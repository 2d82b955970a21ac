"""Connectors as a data source: windows, types by family, the gate, lineage, and streams that go on where they were."""

from __future__ import annotations

import datetime as dt
import json

import pytest

from tidemark.operators import intake
from tidemark.sources import connector


def fetch(spec, first, last):
    """A value for each day, told apart by the specification; what is asked for is in the note of none."""
    for k in range((last - first).days + 1):
        day = first + dt.timedelta(k)
        yield {"observation_date": day.isoformat(), "release_date": (day + dt.timedelta(1)).isoformat(), "value": spec["base"] + day.day, **spec.get("more", {})}


def fetch_periods(spec, first, last):
    if first.day == 1:
        yield {"period_start": first, "period_end": last, "release_date": last, "value": "12.5", "source_record_id": "own-1"}


OPTIONS = {"fetcher": "tests.test_connector:fetch", "source": "SRC", "family": "macro_daily", "start": "2024-01-01", "end": "2024-01-25", "days": "10"}


def load(spark, specs, **more):
    spark.dataSource.register(connector.Connector)
    return spark.read.format("tidemark").options(**{**OPTIONS, "specs": json.dumps(specs), **more}).load()


def test_windows_and_lineage(spark):
    specs = [{"base": 1, "indicator_code": "dxy"}, {"base": 100, "indicator_code": "cpi", "commodity_code": "CORN"}]
    df = load(spark, specs)
    assert df.rdd.getNumPartitions() == 6 and "instrument_code" not in df.columns and dict(df.dtypes)["observation_date"] == "date"
    rows = df.collect()
    assert len(rows) == 50 and all(r.accepted and r.family == "macro_daily" and r.revision == 0 for r in rows)
    one = next(r for r in rows if r.indicator_code == "dxy" and r.observation_date == dt.date(2024, 1, 11))
    assert (one.value, one.release_date, one.commodity_code, one.source_record_id) == (12.0, dt.date(2024, 1, 12), None, "SRC:dxy:2024-01-11")
    assert {r.commodity_code for r in rows if r.indicator_code == "cpi"} == {"CORN"}
    raw = spark.createDataFrame([("2024-01-11", "2024-01-12", 12)], "observation_date string, release_date string, value int")
    assert one.source_payload_hash == raw.select(intake.payload_hash(raw, tuple(raw.columns)).alias("h")).first().h
    # what a connector gives goes through the gate and the rules of the intake
    assert intake.gate(df.drop("reasons", "accepted")).filter("not accepted").count() == 0
    periods = load(spark, [{"indicator_code": "baltic"}], family="logistics_periodic", fetcher="tests.test_connector:fetch_periods", days="40").collect()
    assert [(r.period_end, r.value, r.source_record_id) for r in periods] == [(dt.date(2024, 1, 25), 12.5, "own-1")]


def test_the_gate(spark):
    bad = [{"base": 1, "indicator_code": "dxy", "more": {"source_payload_hash": "ABC"}}]
    rows = load(spark, bad, gate="report", end="2024-01-02").collect()
    assert [(r.reasons, r.accepted) for r in rows] == [(["INVALID_SOURCE_PAYLOAD_HASH"], False)] * 2
    with pytest.raises(Exception, match="INVALID_SOURCE_PAYLOAD_HASH"):
        load(spark, bad).collect()
    assert connector.reasons({}) == ["MISSING_SOURCE", "MISSING_SOURCE_RECORD_ID", "MISSING_SOURCE_PAYLOAD_HASH"]
    with pytest.raises(Exception, match="no such family"):
        load(spark, bad, family="rumours").collect()
    assert load(spark, bad, start="2024-02-01").count() == 0


def test_a_stream_reads_each_day_once(spark, tmp_path):
    spark.dataSource.register(connector.Connector)

    def run(end):
        options = {**OPTIONS, "specs": json.dumps([{"base": 1, "indicator_code": "dxy"}]), "end": end}
        stream = spark.readStream.format("tidemark").options(**options).load()
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(r.observation_date.day for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run("2024-01-05") == list(range(1, 6))
    assert run("2024-01-05") == list(range(1, 6)) and run("2024-01-23") == list(range(1, 24))
