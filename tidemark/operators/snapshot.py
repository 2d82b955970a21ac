"""Snapshots of derived tables with two-phase replacement: write beside, check, then switch a pointer.

A table's folder has data folders of fresh names and one pointer file for each version that became current, which holds
the name of its data; the largest pointer is current. A new version is written in full and checked before its pointer
is created, which fails if another writer has made that version, so readers see the old version or the new one. That
takes a store whose exclusive create is atomic (HDFS, a local disk); object stores need a conditional put for it.
Rolling back makes the version before current again. The fingerprint of the source may be taken before and after.

``Cutover`` parts the same switch into two commands with a decision between them: prepare() builds and checks a candidate
and stops; cutover() checks it again, rebuilds it from what the source has by then, and only then switches. What was
current stays as the backup until it is given up or restored.
"""

from __future__ import annotations

import contextlib
import json
import threading
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Snapshot:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/current")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(folder) if s.getPath().getName().isdigit())

    def read(self) -> DataFrame:
        name = self.current()
        if name is None:
            raise FileNotFoundError(f"{self.root} has no current version")
        return self.spark.read.parquet(f"{self.root}/{name}")

    def _pointer(self, version: int):
        return self._path(f"{self.root}/current/{version}")

    def replace(self, df: DataFrame, grain: list[str], check: Callable[[DataFrame], list[str]] = lambda _: [], source: Callable[[], object] = lambda: None) -> int:
        """Write and check ``df``, then make it current. Refused if empty, if the grain repeats, if ``check`` objects, or
        if ``source``, a fingerprint of what ``df`` was made of, has changed meanwhile."""
        version, before = max(self.versions(), default=0) + 1, source()
        name = f"data-{uuid.uuid4().hex}"
        place = f"{self.root}/{name}"
        df.write.parquet(place)
        written = self.spark.read.parquet(place)
        problems = list(check(written))
        if written.isEmpty():
            problems.append("no rows")
        if not written.groupBy(*grain).count().filter("count > 1").isEmpty():
            problems.append(f"repeated grain {grain}")
        if source() != before:
            problems.append("the source has changed")
        if problems:
            self._fs.delete(self._path(place), True)
            raise ValueError(f"{self.root} keeps its version: {'; '.join(problems)}")
        try:
            self._point(version, name)
        except RuntimeError:
            self._fs.delete(self._path(place), True)
            raise
        return version

    def _point(self, version: int, name: str) -> None:
        self._create(self._pointer(version), name, f"version {version} of {self.root} has been made by another writer")

    def _create(self, path, text: str, taken: str) -> None:
        """A file that must not be there yet."""
        try:
            out = self._fs.create(path, False)
        except Exception as e:
            raise RuntimeError(taken) from e
        out.write(bytearray(text.encode()))
        out.close()

    def _text(self, path) -> str | None:
        return self.spark.read.text(path.toString(), wholetext=True).first()[0] if self._fs.exists(path) else None

    def current(self) -> str | None:
        """The name of the current version's data."""
        versions = self.versions()
        return self._text(self._pointer(versions[-1])) if versions else None

    def roll_back(self) -> int:
        versions = self.versions()
        if len(versions) < 2:
            raise ValueError("there is no version to go back to")
        self._fs.delete(self._pointer(versions[-1]), False)
        return versions[-2]


#: Minutes that building a candidate may take: by default, at least, at most.
TIMEOUT, LEAST_TIMEOUT, MOST_TIMEOUT = 30, 5, 120


@dataclass
class Result:
    status: str  # prepared, cutover_applied, rolled_back, cleaned, cleanup_noop or failed
    phase: str = ""
    error: str = ""
    parity: dict[str, Any] | None = None


class Cutover(Snapshot):
    """Two commands, one decision: see the module. All commands of a table exclude each other by a lock file.

    ``build`` makes the table's rows anew, ``source`` a fingerprint of all that they come from; ``grain`` names the columns
    that are unique, ``day`` the one whose largest value shows what the rows cover.
    """

    def __init__(self, spark: SparkSession, root: str, build: Callable[[], DataFrame], source: Callable[[], object], grain: list[str], day: str, key: str, minutes: int = TIMEOUT):
        if not LEAST_TIMEOUT <= minutes <= MOST_TIMEOUT:
            raise ValueError(f"a build may take {LEAST_TIMEOUT} to {MOST_TIMEOUT} minutes")
        super().__init__(spark, root)
        self.build, self.source, self.grain, self.day, self.key, self.minutes = build, source, grain, day, key, minutes
        self._candidate, self._backup, self._lock = (self._path(f"{self.root}/{x}") for x in ("candidate", "backup", "lock"))

    def states(self) -> dict[str, str | list[str] | None]:
        """candidate, current, backup and orphans (data that none of these names, nor any earlier version)."""
        named = {self._text(self._pointer(v)) for v in self.versions()}
        candidate, backup = self._text(self._candidate), self._text(self._backup)
        folder = self._path(self.root)
        found = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        own = json.loads(candidate)["name"] if candidate else None
        orphans = sorted(x for x in found if x.startswith("data-") and x not in named | {own, backup})
        return {"candidate": own, "current": self.current(), "backup": backup, "orphans": orphans}

    @contextlib.contextmanager
    def _alone(self) -> Iterator[None]:
        self._create(self._lock, uuid.uuid4().hex, f"another command is at work on {self.root}")
        try:
            yield
        finally:
            self._fs.delete(self._lock, False)

    def _built(self) -> str:
        """The name of data made within the time that a build may take; jobs that run longer are cancelled."""
        name, context = f"data-{uuid.uuid4().hex}", self.spark.sparkContext
        tag = f"build-{uuid.uuid4().hex}"
        timer = threading.Timer(60 * self.minutes, lambda: context.cancelJobsWithTag(tag))
        context.addJobTag(tag)
        timer.start()
        try:
            self.build().write.parquet(f"{self.root}/{name}")
        except Exception:
            self._drop(name)
            raise
        finally:
            timer.cancel()
            context.removeJobTag(tag)
        return name

    def _drop(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def parity(self, name: str) -> dict[str, Any]:
        """rows, duplicate_grains, max_day, keys and whether they will do."""
        place = self._path(f"{self.root}/{name}")
        if not self._fs.exists(place):
            return {"ok": False, "rows": 0, "duplicate_grains": 0, "max_day": None, "keys": 0}
        rows = self.spark.read.parquet(place.toString())
        twice = rows.groupBy(*self.grain).count().filter("count > 1").agg(F.count("*").alias("duplicate_grains"))
        own = rows.agg(F.count("*").alias("rows"), F.max(self.day).cast("string").alias("max_day"), F.count_distinct(self.key).alias("keys"))
        found = {**own.first().asDict(), **twice.first().asDict()}
        return found | {"ok": found["rows"] > 0 and not found["duplicate_grains"] and found["max_day"] is not None}

    def prepare(self) -> Result:
        """Build a candidate, check it, and stop. Refused while there is a candidate or a backup."""
        with self._alone():
            for what, path in (("candidate", self._candidate), ("backup", self._backup)):
                if self._fs.exists(path):
                    return Result("failed", "occupied", f"there is a {what} already")
            before, name = self.source(), self._built()
            parity = self.parity(name)
            if not parity["ok"]:
                self._drop(name)
                return Result("failed", "prepare_parity", "the candidate's rows won't do", parity)
            self._create(self._candidate, json.dumps({"name": name, "source": str(before)}), "there is a candidate already")
            return Result("prepared", parity=parity)

    def cutover(self) -> Result:
        """Check the candidate, rebuild it, and make it current; refused if the source changes from the first look to the
        switch. The switch itself is the creation of one pointer. A refused candidate stays."""
        with self._alone():
            text = self._text(self._candidate)
            if text is None:
                return Result("failed", "revalidate", "there is no candidate")
            if self._fs.exists(self._backup):
                return Result("failed", "revalidate", "there is a backup already")
            name = json.loads(text)["name"]
            parity = self.parity(name)
            if not parity["ok"]:
                return Result("failed", "revalidate", "the candidate's rows won't do", parity)
            before = self.source()
            fresh = self._built()
            if self.source() != before:
                self._drop(fresh)
                return Result("failed", "final_refresh", "the source has changed while the candidate was made anew")
            parity = self.parity(fresh)
            if not parity["ok"] or self.source() != before:
                self._drop(fresh)
                return Result("failed", "cutover", "the rows won't do or the source has changed", parity)
            old, version = self.current(), max(self.versions(), default=0) + 1
            if old is not None:
                self._create(self._backup, old, "there is a backup already")
            try:
                self._point(version, fresh)
            except RuntimeError as e:
                if old is not None:
                    self._fs.delete(self._backup, False)
                self._drop(fresh)
                return Result("failed", "cutover", str(e), parity)
            self._fs.delete(self._candidate, False)
            self._drop(name)
            return Result("cutover_applied", parity=parity)

    def roll_back(self) -> Result:  # type: ignore[override]
        """Make the backup current again and drop what took its place; the backup's data stay, as the current ones."""
        with self._alone():
            backup = self._text(self._backup)
            if backup is None:
                return Result("failed", "rollback", "there is no backup")
            gone = self.current()
            self._fs.delete(self._pointer(self.versions()[-1]), False)
            if self.current() != backup:
                self._point(max(self.versions(), default=0) + 1, backup)
            self._fs.delete(self._backup, False)
            if gone not in (None, backup):
                self._drop(gone)
            return Result("rolled_back")

    def keep(self) -> Result:
        """Give the backup up: what is current is to stay, and a next candidate may be prepared."""
        with self._alone():
            backup = self._text(self._backup)
            if backup is None:
                return Result("failed", "keep", "there is no backup")
            self._fs.delete(self._backup, False)
            return Result("kept")

    def clean_up(self) -> Result:
        """Drop the candidate and data that nothing names; never what is current, a version before it, or the backup."""
        with self._alone():
            states = self.states()
            gone = [x for x in (states["candidate"], *states["orphans"]) if x]
            self._fs.delete(self._candidate, False)
            for name in gone:
                self._drop(name)
            return Result("cleaned" if gone else "cleanup_noop")
