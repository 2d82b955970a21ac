"""Helpers that several operators share: the shared folder, lineage cuts and vectorised hashing."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters other than space, tab, newline, vertical tab, form feed, carriage return.
WORD = re.compile("[^\x20\x09-\x0d]+")
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Entries of a per-process word table; when full it starts anew, so memory stays bounded.
WORD_TABLE = 300_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver see (spark.checkpoint.dir).

    Where it is unset, a local session gets a temporary one; elsewhere that is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="tidemark-"))
    return spark.conf.get("spark.checkpoint.dir")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tidemark-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: a lineage cut that outlives executors."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


#: Narrow rows, rows with texts or signatures, and texts that each make many rows, that one task writes at least.
NARROW, WIDE, MANY = 10_000, 1_000, 100


def in_few(df: DataFrame, rows: int, each: int = NARROW) -> DataFrame:
    """``df``, of about ``rows`` rows at most, in no more partitions than these need, but two for each core.

    Where there are many shuffle partitions and few rows, each would else write a file of a few rows, and each file on a
    local disk starts two processes from the executor's. Larger tables stay as they are.
    """
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def discard(df: DataFrame) -> None:
    """Delete what materialize() wrote for ``df``, once nothing that is still to run reads it."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._tidemark_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of an Arrow batch where whole texts go to Python workers: a batch of the longest texts stays small.
BATCH_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


#: Bits of the bitmap that marks_of() makes, whatever the input: 16 MB.
MARK_BITS = 27


class Marks:
    """A bitmap over 64-bit keys: has() is true for every marked key, and for others at the rate of its density."""

    def __init__(self, words: np.ndarray):
        self.words = words

    def has(self, key: int) -> bool:
        at = key & ((1 << MARK_BITS) - 1)
        return bool(int(self.words[at >> 6]) >> (at & 63) & 1)

    def has_each(self, keys: np.ndarray) -> np.ndarray:
        at = keys & np.uint64((1 << MARK_BITS) - 1)
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def marks_of(keys: DataFrame) -> Marks:
    """Marks of the long column ``key``. What the driver gets is bounded by the bitmap: 2**21 words at most."""
    at = F.col("key").bitwiseAND(F.lit((1 << MARK_BITS) - 1))
    words = keys.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(key & 63L as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (MARK_BITS - 6), np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return Marks(out)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


_words: dict[str, int] = {}


def word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words; each distinct word is hashed once for a process while its table lasts."""
    table = _words
    if len(table) > WORD_TABLE:
        table.clear()
    try:
        return np.fromiter(map(table.__getitem__, words), np.uint64, len(words))
    except KeyError:
        for w in set(words):
            if w not in table:
                table[w] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(table.__getitem__, words), np.uint64, len(words))


def words_of(text: str | None) -> list[str]:
    """Whitespace-separated words with A-Z lower-cased."""
    if not text:
        return []
    # bytes are lower-cased from A to Z alone
    return WORD.findall(text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """64-bit hash of each run of ``size`` words, in order; a shorter non-empty text is one shingle."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    size = min(size, n)
    out = np.full(n - size + 1, np.uint64(size), np.uint64)
    for k in range(size):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + words[k : n - size + 1 + k])
    return out


def bit_marks(keys: DataFrame, key: str) -> DataFrame:
    """A bitmap over the long column ``key`` as rows (bucket, marks): 4,096 rows and 16 MB at most, whatever the input."""
    bit = F.pmod(F.xxhash64(key), F.lit(1 << MARK_BITS))
    rows = keys.select(bit.alias("__bit")).groupBy(F.bitmap_bucket_number("__bit").alias("__bucket"))
    return rows.agg(F.bitmap_construct_agg(F.bitmap_bit_position("__bit")).alias("__marks"))


def with_mark(df: DataFrame, key: str, marks: DataFrame) -> DataFrame:
    """``df`` with __marked: true where ``key`` is in the bitmap, and in few other rows; a broadcast of fixed size."""
    bit = F.pmod(F.xxhash64(key), F.lit(1 << MARK_BITS))
    place = F.bitmap_bit_position(bit)
    byte = F.conv(F.hex(F.substring(F.col("__marks"), (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    joined = df.withColumn("__bucket", F.bitmap_bucket_number(bit)).join(F.broadcast(marks), "__bucket", "left")
    return joined.select(*df.columns, F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) != 0, F.lit(False)).alias("__marked"))


def marked(df: DataFrame, key: str, marks: DataFrame) -> DataFrame:
    """The rows whose ``key`` is marked, and a few others: a broadcast of fixed size in place of a shuffle of ``df``."""
    return with_mark(df, key, marks).filter("__marked").drop("__marked")
