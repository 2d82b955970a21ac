"""Connectors as a data source of Spark's: a fetcher that knows one source's form, called by tasks for windows of days.

``spark.dataSource.register(Connector)``, then ``spark.read.format("tidemark")`` or ``spark.readStream`` with the options

- ``fetcher``: ``module:function``; it gets a specification (a dict), and the first and last day of a window, and gives the
  window's records as dicts with the names of the record contract. It alone knows how bodies are had and what they look
  like, and must give the same records when it is asked again, as a task may run twice;
- ``source``: the source's code; ``family``: the fact family, by which rows are typed and dates required;
- ``specs``: a JSON list of specifications; their ``commodity_code`` and the like are records' defaults, and a family whose
  facts apply to all commodities may leave it out, which leaves it null;
- ``start``, ``end``: ISO days, both included; ``days``: days of a window (a partition is one specification's window);
- ``gate``: ``fail`` (a rejected record fails the read, the default) or ``report`` (it comes with its reasons).

Records get an id and a hash of their payload where they have none, as ``intake.attach_provenance`` gives them. A stream's
offset is the first day that has not been read: a later ``end`` reads the days that are new, and no day twice.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import importlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidemark.operators import intake

_DIGEST = re.compile(r"\A[0-9a-f]{64}\Z")
_COMMON = "family string, data_source_code string, commodity_code string, region_code string, {code} string, release_date date, {dates}, value double, unit string, currency string, revision int"
_LINEAGE = "source_record_id string, source_payload_hash string, reasons array<string>, accepted boolean"


def schema_of(family: str) -> str:
    """The columns of a family's records: its own code and dates, and what describes the lineage."""
    own = intake.FAMILIES[family]
    dates = "period_start date, period_end date" if own.periodic else "observation_date date"
    return f"{_COMMON.format(code=own.code, dates=dates)}, {_LINEAGE}"


def payload_hash(payload: dict[str, Any]) -> str:
    """The hash of a payload without its lineage, as ``intake.payload_hash`` of its columns."""
    own = {k: v for k, v in payload.items() if k not in intake.LINEAGE}
    return hashlib.sha256(json.dumps(own, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str).encode()).hexdigest()


def reasons(record: dict[str, Any]) -> list[str]:
    """Why a record is rejected at the boundary."""
    missing = {"data_source_code": "MISSING_SOURCE", "source_record_id": "MISSING_SOURCE_RECORD_ID", "source_payload_hash": "MISSING_SOURCE_PAYLOAD_HASH"}
    found = [code for field, code in missing.items() if not record.get(field)]
    digest = record.get("source_payload_hash")
    return [*found, "INVALID_SOURCE_PAYLOAD_HASH"] if digest and not _DIGEST.match(digest) else found


@dataclass
class WindowPartition(InputPartition):
    spec: dict[str, Any]
    first: str
    last: str


class Windows:
    """What a batch and a stream have in common: windows of days, and the rows of one."""

    def __init__(self, options: dict[str, str]):
        self.options, self.family = options, options["family"]
        self.fields = [c.split()[0] for c in schema_of(self.family).split(", ")]

    def between(self, first: dt.date, last: dt.date) -> list[WindowPartition]:
        days, out = max(1, int(self.options.get("days", "31"))), []
        while first <= last:
            until = min(last, first + dt.timedelta(days - 1))
            out += [WindowPartition(spec, first.isoformat(), until.isoformat()) for spec in json.loads(self.options["specs"])]
            first = until + dt.timedelta(1)
        return out

    def rows(self, part: WindowPartition | None) -> Iterator[tuple]:
        if part is None:  # what Spark asks for where there is no window
            return
        module, name = self.options["fetcher"].split(":")
        fetch = getattr(importlib.import_module(module), name)
        dates = {f for f in self.fields if f in intake.DATES}
        for n, raw in enumerate(fetch(part.spec, dt.date.fromisoformat(part.first), dt.date.fromisoformat(part.last))):
            record = {**{k: v for k, v in part.spec.items() if k in self.fields}, **raw, "family": self.family}
            record.setdefault("data_source_code", self.options["source"])
            day = raw.get("period_start") or raw.get("observation_date") or n
            code = record.get(intake.FAMILIES[self.family].code)
            record["source_record_id"] = record.get("source_record_id") or ":".join(map(str, (record["data_source_code"], code, day)))
            record["source_payload_hash"] = record.get("source_payload_hash") or payload_hash(raw)
            why = reasons(record)
            if why and self.options.get("gate", "fail") == "fail":
                raise ValueError(f"record {record['source_record_id']} of {part.spec} is rejected: {', '.join(why)}")
            record |= {"reasons": why, "accepted": not why, "revision": record.get("revision") or 0}
            for f in dates:
                if isinstance(record.get(f), str):
                    record[f] = dt.date.fromisoformat(record[f])
            if record.get("value") is not None:
                record["value"] = float(record["value"])
            yield tuple(record.get(f) for f in self.fields)

    def day(self, name: str) -> dt.date:
        return dt.date.fromisoformat(self.options[name])


class BatchReader(DataSourceReader):
    def __init__(self, windows: Windows):
        self.windows = windows

    def partitions(self):
        return self.windows.between(self.windows.day("start"), self.windows.day("end"))

    def read(self, partition):
        return self.windows.rows(partition)


class StreamReader(DataSourceStreamReader):
    def __init__(self, windows: Windows):
        self.windows = windows

    def initialOffset(self):
        return {"day": self.windows.options["start"]}

    def latestOffset(self):
        return {"day": (self.windows.day("end") + dt.timedelta(1)).isoformat()}

    def partitions(self, start, end):
        return self.windows.between(dt.date.fromisoformat(start["day"]), dt.date.fromisoformat(end["day"]) - dt.timedelta(1))

    def read(self, partition):
        return self.windows.rows(partition)

    def commit(self, end):
        """Nothing is kept that could be given up."""


class Connector(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemark"

    def schema(self) -> str:
        if self.options.get("family") not in intake.FAMILIES:
            raise ValueError(f"no such family: {self.options.get('family')}")
        return schema_of(self.options["family"])

    def reader(self, schema) -> DataSourceReader:
        return BatchReader(Windows(dict(self.options)))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return StreamReader(Windows(dict(self.options)))
