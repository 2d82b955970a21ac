"""URL filters over a sorted array of 64-bit digests.

Rules and lists are strings of a host and the start of a path (``example.org/es/``, ``ads.example.net/``); one fits its
host and all subdomains if the url's path starts with the rule's. Their xxhash64 digests, sorted, and the strings in
the same order are written to one file in the shared folder, which Spark ships to every executor and each Python
worker maps into memory. A url's candidates, its host's suffixes with the path starts of the lengths that rules have,
are looked up for a whole batch by binary search, and each hit is confirmed against the stored string, so two strings
with one digest don't matter. Of the rules that fit, the longest wins; a url that no rule fits goes by the list of
blocked hosts, and passes if that has no entry for it.

A file has at most ``MOST_ENTRIES`` entries, checked before it is made; a longer list is joined as a table instead.

Defined results: a url that is null or has no ``://`` has an empty host and path, no rule, and passes; an empty path
starts with no rule's path; repeated rows are each judged; an empty table gives an empty one. Columns of the input are
kept, but for those whose names the results take.
"""

from __future__ import annotations

import functools
import mmap
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import fresh_path

#: Entries of a mapped file at most: with strings of 60 bytes, 350 MB.
MOST_ENTRIES = 5_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url):
    """Columns host and path of the column ``url``."""
    url = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER), F.regexp_extract(url, pattern, 2)


def _digest(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data)


def pack(entries: Iterable[tuple[str, str]]) -> bytes:
    """The file of (verdict, rule) entries: counts, sorted digests, string ends, verdicts, path lengths, strings."""
    rows = sorted({(_digest(rule.encode()), rule.encode(), verdict == "block") for verdict, rule in entries})
    ends = np.cumsum([len(rule) for _, rule, _ in rows], dtype=np.int64)
    lengths = np.array(sorted({len(rule) - rule.index(b"/") for _, rule, _ in rows}), np.int64)
    head = np.array([len(rows), len(lengths)], np.int64)
    digests = np.array([d for d, _, _ in rows], np.uint64)
    return b"".join([head.tobytes(), lengths.tobytes(), digests.tobytes(), ends.tobytes(), bytes(b for _, _, b in rows), *(rule for _, rule, _ in rows)])


class Digests:
    """A packed file, mapped into memory."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n, k = (int(x) for x in np.frombuffer(self.map, np.int64, 2))
        self.lengths = np.frombuffer(self.map, np.int64, k, 16).tolist()
        at = 16 + 8 * k
        self.digests = np.frombuffer(self.map, np.uint64, n, at)
        self.ends = np.frombuffer(self.map, np.int64, n, at + 8 * n)
        self.blocks = np.frombuffer(self.map, np.uint8, n, at + 16 * n)
        self.strings = at + 17 * n

    def string(self, i: int) -> bytes:
        return self.map[self.strings + (int(self.ends[i - 1]) if i else 0) : self.strings + int(self.ends[i])]

    def longest(self, candidates: list[list[bytes]]) -> list[tuple[bytes, bool] | None]:
        """For each list of candidates its longest confirmed entry and whether that blocks."""
        owner = np.repeat(np.arange(len(candidates)), [len(c) for c in candidates])
        flat = [x for c in candidates for x in c]
        keys = np.fromiter(map(_digest, flat), np.uint64, len(flat))
        first = np.searchsorted(self.digests, keys, "left")
        hits = np.flatnonzero(self.digests[np.minimum(first, len(self.digests) - 1)] == keys) if len(self.digests) else []
        out: list[tuple[bytes, bool] | None] = [None] * len(candidates)
        for h in hits:
            i = int(first[h])
            while i < len(self.digests) and self.digests[i] == keys[h]:
                if self.string(i) == flat[h]:
                    best = out[owner[h]]
                    if best is None or len(flat[h]) > len(best[0]):
                        out[owner[h]] = flat[h], bool(self.blocks[i])
                i += 1
        return out


@functools.lru_cache(maxsize=4)
def mapped(path: str) -> Digests:
    return Digests(path)


def ship(spark: SparkSession, data: bytes) -> str:
    """Write ``data`` into the shared folder and let Spark bring it to every executor; the name it has there."""
    path = fresh_path(spark, "digests")
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, False)
    try:
        for at in range(0, len(data), 1 << 24):
            out.write(bytearray(data[at : at + (1 << 24)]))
    finally:
        out.close()
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[1]


def candidates(host: str, path: str, lengths: list[int]) -> list[bytes]:
    suffixes, at = [host], host.find(".")
    while at >= 0:
        suffixes.append(host[at + 1 :])
        at = host.find(".", at + 1)
    raw = path.encode("utf-8")
    starts = [raw[:n] for n in lengths if n <= len(raw)]
    return [s.encode("utf-8") + start for s in suffixes for start in starts]


def _judge(batches, rules: str, hosts: str, at: int, names: list[str]):
    rules_map, hosts_map = mapped(SparkFiles.get(rules)), mapped(SparkFiles.get(hosts))
    for batch in batches:
        pairs = list(zip(batch.column(at).to_pylist(), batch.column(at + 1).to_pylist(), strict=True))
        ruled = rules_map.longest([candidates(h, p, rules_map.lengths) for h, p in pairs])
        listed = hosts_map.longest([candidates(h, "/", hosts_map.lengths) if r is None and h else [] for (h, _), r in zip(pairs, ruled, strict=True)])
        verdicts = ["block" if (r or b or (b"", False))[1] else "allow" for r, b in zip(ruled, listed, strict=True)]
        rule = pa.array([r and r[0].decode() for r in ruled], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, rule, pa.array(verdicts, pa.string())], names)


def _judge_by_join(parsed: DataFrame, entries: DataFrame) -> DataFrame:
    """The same verdicts with entries (verdict, rule) of any number as a table: an equi-join on candidate strings."""
    keyed = parsed.withColumn("__row", F.struct("host", "path"))
    parts = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    cuts = F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    distinct = keyed.filter("host <> ''").select("__row", "host", "path").distinct()
    probes = distinct.select("__row", F.explode(F.flatten(F.transform(suffixes, lambda s: F.transform(F.filter(cuts, lambda p: p != ""), lambda p: F.concat(s, p))))).alias("rule"))
    best = probes.join(entries, "rule").groupBy("__row").agg(F.max_by(F.struct("rule", "verdict"), F.octet_length("rule")).alias("__best"))
    return keyed.join(best, "__row", "left").select(*parsed.columns, F.col("__best.rule").alias("rule"), F.coalesce("__best.verdict", F.lit(None).cast("string")).alias("verdict"))


def hosts_of(spark: SparkSession, path: str) -> DataFrame:
    """The table of blocked hosts that text files list, one in a line; empty lines and those that start with # are none."""
    line = F.translate(F.trim("value"), UPPER, LOWER)
    return spark.read.text(path).select(line.alias("h")).filter("h <> '' and not startswith(h, '#')").select(F.concat("h", F.lit("/")).alias("rule"))


def judge(pages: DataFrame, rules: Iterable[tuple[str, str]], blocked: Iterable[str] | DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (null if none fits) and verdict (allow or block) of each url.

    ``blocked`` holds hosts (ending in ``/``): an iterable, or a table with the column ``rule`` where they are many.
    """
    spark = pages.sparkSession
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = host_and_path(F.col(url_col))
    parsed = pages.select(*keep, host.alias("host"), path.alias("path"))
    if isinstance(blocked, DataFrame):
        if blocked.limit(MOST_ENTRIES + 1).count() > MOST_ENTRIES:
            table = spark.createDataFrame(list(rules), "verdict string, rule string")
            ruled = _judge_by_join(parsed, table).withColumnsRenamed({"rule": "__rule", "verdict": "__verdict", "path": "__path"})
            listed = _judge_by_join(ruled.withColumn("path", F.lit("/")), blocked.select("rule", F.lit("block").alias("verdict")).distinct())
            return listed.select(*keep, "host", F.col("__path").alias("path"), F.col("__rule").alias("rule"), F.coalesce("__verdict", "verdict", F.lit("allow")).alias("verdict"))
        blocked = [r.rule for r in blocked.select("rule").distinct().collect()]  # checked above
    rules_file = ship(spark, pack(rules))
    hosts_file = ship(spark, pack(("block", h) for h in blocked))
    schema = T.StructType([*parsed.schema, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    return parsed.mapInArrow(functools.partial(_judge, rules=rules_file, hosts=hosts_file, at=len(keep), names=[f.name for f in schema]), schema)
