"""Sharding with size-tiered compaction and a versioned manifest, with DataFrame functions alone.

Arrivals are appended as small immutable shards: each task writes what it reads, by arrival, without a shuffle. A run
is the shards of one arrival or of one merge. Runs whose sizes lie within the same power of ``fanout`` form a tier;
once a tier has ``fanout`` runs, they are merged into files of a target size, again without a shuffle: neighbouring
small partitions are read by one task. Every change is committed by a new manifest (JSON, one line for each run),
which is written beside its place and renamed to the next version's name; readers see one version or the next, shards
of a failed job are in no manifest, and old versions stay readable until ``vacuum``. The rename fails if the version is
there; that is atomic on HDFS and its like, but a check and a rename on a local disk, and object stores need a
conditional put for it, so on these one writer at a time has to be ensured from outside.

A run's size is the bytes of a text column, so what is merged depends on the rows alone. The manifest is metadata of a
few hundred bytes for each run, and compaction leaves fewer than ``fanout`` runs in each tier.

Defined results: a null arrival is an arrival of its own, as is an empty one; null and empty texts have no size; rows
of no size are kept; repeated rows are kept as often as they arrive; an empty table leaves a manifest without runs. Of
the run's columns that ``read`` adds, those whose names the table has get underscores in front until they are free.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Runs of a tier that are merged, bytes from which tier 1 starts, and bytes of text in a merged file.
FANOUT, BASE_BYTES, TARGET_BYTES = 4, 1 << 20, 256 << 20
#: No run reaches the tier after this one.
LAST_TIER = 20


@dataclass(frozen=True)
class Run:
    path: str  # below the table's folder
    name: str | None  # the least arrival in it
    arrivals: int
    rows: int
    bytes: int

    def tier(self, fanout: int, base: int) -> int:
        return sum(self.bytes >= base * fanout**k for k in range(LAST_TIER))


class ShardedTable:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, size_col: str = "text"):
        self.spark, self.root, self.schema, self.size_col = spark, root.rstrip("/"), schema, size_col
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _manifest(self, version: int):
        return self._path(f"{self.root}/manifests/{version:010d}.json")

    def versions(self) -> list[int]:
        folder = self._path(f"{self.root}/manifests")
        if not self._fs.exists(folder):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(folder))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def runs(self, version: int | None = None) -> list[Run]:
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return []
        lines = self.spark.read.text(self._manifest(version).toString()).collect()
        return sorted((Run(**json.loads(x.value)) for x in lines if x.value), key=lambda r: r.path)

    def commit(self, runs: list[Run], after: int) -> int:
        """Make ``runs`` the version after ``after``; fails if another writer has made it."""
        version, final = after + 1, self._manifest(after + 1)
        beside = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(beside, False)
        try:
            out.write(bytearray("".join(json.dumps(asdict(r)) + "\n" for r in runs).encode()))
        finally:
            out.close()
        jvm = self.spark._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(beside, final, plain)  # fails if the version is there
        except Exception as e:
            self._fs.delete(beside, False)
            raise RuntimeError(f"version {version} of {self.root} has been committed by another writer") from e
        return version

    def _sizes(self, df: DataFrame, *by: Column | str) -> DataFrame:
        size = F.sum(F.coalesce(F.octet_length(self.size_col), F.lit(0)).cast("long"))
        return df.groupBy(*by).agg(F.count("*").alias("rows"), size.alias("bytes"))

    def append(self, df: DataFrame, arrival: str) -> int:
        """Add the rows of ``df``, one run for each value of its column ``arrival``; the version that has them."""
        version = max(self.versions(), default=0)
        folder = f"runs/{uuid.uuid4().hex}"
        place = F.md5(F.coalesce(F.concat(F.lit("="), F.col(arrival).cast("string")), F.lit("")).cast("binary"))
        df.select(*self.schema.names).withColumn("__place", place).write.partitionBy("__place").parquet(f"{self.root}/{folder}")
        known = self.runs(version)
        if self._fs.listStatus(self._path(f"{self.root}/{folder}")) and any(s.isDirectory() for s in self._fs.listStatus(self._path(f"{self.root}/{folder}"))):
            schema = T.StructType([*self.schema, T.StructField("__place", T.StringType())])
            written = self.spark.read.schema(schema).parquet(f"{self.root}/{folder}")
            sizes = self._sizes(written, "__place", F.col(arrival).cast("string").alias("__name"))
            known += [Run(f"{folder}/__place={r['__place']}", r["__name"], 1, r["rows"], r["bytes"]) for r in sizes.collect()]  # one row for each new run
        return self.commit(known, version)

    def compact(self, fanout: int = FANOUT, base: int = BASE_BYTES, target: int = TARGET_BYTES) -> int:
        """Merge tiers until each has fewer than ``fanout`` runs; the last version. Each round commits once."""
        while True:
            version = max(self.versions(), default=0)
            runs, tiers = self.runs(version), {}
            for run in runs:
                tiers.setdefault(run.tier(fanout, base), []).append(run)
            full = [tiers[t] for t in sorted(tiers) if len(tiers[t]) >= fanout]
            if not full:
                return version
            merged = [self._merge(group, target) for group in full]
            gone = {r.path for group in full for r in group}
            self.commit([r for r in runs if r.path not in gone] + merged, version)

    def _merge(self, group: list[Run], target: int) -> Run:
        folder, size = f"runs/{uuid.uuid4().hex}", sum(r.bytes for r in group)
        rows = self.spark.read.schema(self.schema).parquet(*(f"{self.root}/{r.path}" for r in group))
        rows.coalesce(max(1, math.ceil(size / target))).write.parquet(f"{self.root}/{folder}")
        name = None if any(r.name is None for r in group) else min(r.name for r in group)
        return Run(folder, name, sum(r.arrivals for r in group), sum(r.rows for r in group), size)

    def read(self, version: int | None = None, fanout: int = FANOUT, base: int = BASE_BYTES) -> DataFrame:
        """The rows of a version, with run, run_arrivals, run_rows, run_bytes and tier of the run that each is in."""
        runs = self.runs(version)
        named = {c: self._free(c) for c in ("run", "run_arrivals", "run_rows", "run_bytes", "tier")}
        own = "{run} string, {run_arrivals} long, {run_rows} long, {run_bytes} long, {tier} int".format(**{k: f"`{v}`" for k, v in named.items()})
        known = self.spark.createDataFrame([(r.path, r.name, r.arrivals, r.rows, r.bytes, r.tier(fanout, base)) for r in runs], f"__path string, {own}")
        if not runs:
            return self.spark.createDataFrame([], self.schema).join(known.drop("__path"), F.lit(False), "left").select(*self.schema.names, *named.values())
        rows = self.spark.read.schema(self.schema).parquet(*(f"{self.root}/{r.path}" for r in runs))
        path = F.regexp_extract(F.replace(F.col("_metadata.file_path"), F.lit("%3D"), F.lit("=")), r"(runs/[0-9a-f]{32}(?:/__place=[0-9a-f]{32})?)/[^/]+$", 1)
        # the manifest is a few hundred bytes for each run
        joined = rows.select("*", path.alias("__path")).join(F.broadcast(known), "__path")
        return joined.select(*self.schema.names, *named.values())

    def _free(self, name: str) -> str:
        taken = {c.lower() for c in self.schema.names}
        while name.lower() in taken:
            name = f"_{name}"
        return name

    def vacuum(self, keep: int = 1) -> None:
        """Delete the shards that only versions before the last ``keep`` have, and those versions."""
        versions = self.versions()
        kept = {r.path for v in versions[-keep:] for r in self.runs(v)}
        for v in versions[:-keep]:
            for path in {r.path for r in self.runs(v)} - kept:
                self._fs.delete(self._path(f"{self.root}/{path}"), True)
            self._fs.delete(self._manifest(v), False)
