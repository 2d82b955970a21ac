"""Exact top-k search by inner product, a block of documents at a time.

Components are turned into integers, so scores are exact. The rows are ordered by the pivot they are nearest to (pivots
are a few rows of least hash; they only decide how tight the bounds get) and cut into ranges, each of which is cut into
blocks. A block holds its rows' vectors (its forward index) and, for each dimension, the largest and least value. A
query's bound for a block is the sum over the dimensions of the larger of its products with those two.

1. Each query is scored within its own range, its blocks by falling bound, until the bounds are below the kth score.
2. With that kth score as a floor, a query goes to the ranges whose bound reaches it, and there through the blocks the
   same way. Queries travel in chunks and ranges once; a query's best k of all ranges are its result.

A block whose bound equals the kth score is skipped only if its least id is larger than the kth id, so ties are exact.
Ranges' summaries (512 bytes for thousands of rows) are sent to the tasks while they are below ``MOST_SUMMARY_BYTES``;
beyond it every query goes to every range, with the same result.

What the bounds save depends on the vectors: clustered ones leave a few blocks to score, directions that are spread
evenly over many dimensions nearly all (README has figures); the result is exact either way.

Defined results: vectors that are null, empty or hold nulls, non-finite components or such whose multiple does not fit
into a long take no part, nor do null ids; scores that don't fit into a long are cut to its range; every row is a
candidate, also one that shares its id or its vector with another, and every row with a fitting id a query, with all
rows but itself as candidates; missing components of shorter vectors count as zeros; a query with fewer than k
candidates gets them all; an empty table gives an empty one. Only the id and the vector column are used, so clashing
names of others don't matter.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

#: Rows of a range and of a block, queries that travel together, pivots.
RANGE_ROWS, BLOCK_ROWS, CHUNK, PIVOTS = 8192, 128, 512, 64
MOST_SUMMARY_BYTES = 32 << 20
LOWEST = -(1 << 62)


def quantised(vector: Column, scale: int = 256) -> tuple[Column, Column]:
    """Whether the vector takes part, and its components as floor(scale * component)."""
    scaled = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < 2.0**63))
    return F.coalesce((F.size(vector) > 0) & fine, F.lit(False)), scaled


def bounds(queries: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Queries x blocks: no row of the block has a larger product."""
    return np.maximum(queries, 0) @ most.T + np.minimum(queries, 0) @ least.T


def upper(queries: np.ndarray, most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """bounds() with room for rounding, so that none is too low; whole numbers that floating point holds stay exact."""
    queries = queries.astype(np.float64)
    found = bounds(queries, most, least)
    size = np.abs(queries) @ np.maximum(np.abs(most), np.abs(least)).T
    return np.ceil(np.where(size < 2.0**52, found, found + 1e-9 * size))


class Best:
    """The k best (score, id) of each of several queries, ties to smaller ids; ``own`` are the queries' own rows."""

    def __init__(self, own: np.ndarray, k: int, floor_score: np.ndarray, floor_id: np.ndarray):
        self.own, self.k = own, k
        self.score = np.full((len(own), k), LOWEST, np.int64)
        self.id = np.full((len(own), k), np.iinfo(np.int64).max, np.int64)
        self.floor_score, self.floor_id = floor_score, floor_id

    def kth(self, at) -> tuple[np.ndarray, np.ndarray]:
        """Score and id that a row must beat or equal to count."""
        s, i = self.score[at, -1], self.id[at, -1]
        lower = (s < self.floor_score[at]) | ((s == self.floor_score[at]) & (i > self.floor_id[at]))
        return np.where(lower, self.floor_score[at], s), np.where(lower, self.floor_id[at], i)

    def add(self, at: np.ndarray, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        scores = np.where(rows[None, :] == self.own[at][:, None], LOWEST, scores)
        s = np.concatenate([self.score[at], scores], axis=1)
        i = np.concatenate([self.id[at], np.broadcast_to(ids, scores.shape)], axis=1)
        i = np.where(s == LOWEST, np.iinfo(np.int64).max, i)
        order = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.score[at], self.id[at] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


class Range:
    """Rows of a range: row numbers, ids, vectors and its blocks' summaries."""

    def __init__(self, numbers: bytes, ids: bytes, vectors: bytes, dim: int, block: int = BLOCK_ROWS):
        self.numbers, self.ids = np.frombuffer(numbers, np.int64), np.frombuffer(ids, np.int64)
        self.whole = np.frombuffer(vectors, np.int64).reshape(-1, dim)
        self.rows = self.whole.astype(np.float64)
        self.starts = list(range(0, len(self.ids), block))
        self.most = np.stack([self.rows[s : s + block].max(0) for s in self.starts])
        self.least = np.stack([self.rows[s : s + block].min(0) for s in self.starts])
        self.least_id = np.array([self.ids[s : s + block].min() for s in self.starts])
        self.block = block
        self.largest = float(np.abs(self.rows).max(initial=0))

    def product(self, queries: np.ndarray, start: int) -> np.ndarray:
        """Exact scores: in floating point where all sums are whole numbers that it holds, else in longs, else unbounded."""
        rows = self.whole[start : start + self.block]
        size = self.largest * float(np.abs(queries.astype(np.float64)).max(initial=0)) * queries.shape[1]
        if size < 2.0**52:
            return (queries.astype(np.float64) @ self.rows[start : start + self.block].T).astype(np.int64)
        if size < 2.0**62:
            return queries @ rows.T
        return np.clip(queries.astype(object) @ rows.T.astype(object), LOWEST + 1, np.iinfo(np.int64).max).astype(np.int64)

    def search(self, queries: np.ndarray, best: Best) -> None:
        """Each query through its blocks by falling bound until the bounds are below its kth score."""
        bound = upper(queries, self.most, self.least)
        order = np.argsort(-bound, axis=1, kind="stable")
        live = np.arange(len(queries))
        for step in range(len(self.starts)):
            block = order[live, step]
            score, kth = best.kth(live)
            top = bound[live, block]
            go = top >= score  # bounds fall along a query's order: one that is below the kth score ends it
            live, block, equal = live[go], block[go], (top == score)[go] & (self.least_id[block] > kth)[go]
            if not len(live):
                return
            for b in np.unique(block[~equal]):
                at = live[(block == b) & ~equal]
                part = slice(self.starts[b], self.starts[b] + self.block)
                scores = self.product(queries[at], self.starts[b])
                some = scores.max(1) >= best.kth(at)[0]  # the others keep the best that they have
                best.add(at[some], self.numbers[part], self.ids[part], scores[some])


_PACKED = ("numbers", "ids", "vectors", "most", "least")
_SENT = ("q_numbers", "q_ids", "q_vectors", "q_score", "q_id")


def _schema(*binary: str, **other: pa.DataType) -> pa.Schema:
    return pa.schema([*((c, pa.binary()) for c in binary), *other.items()])


def _with_codes(batches, pivots: np.ndarray, dim: int):
    for batch in batches:
        lists = batch.column(2)
        rows = np.zeros((len(lists), dim), np.int64)
        lengths = np.diff(lists.offsets.to_numpy())
        rows[np.arange(dim)[None, :] < lengths[:, None]] = lists.flatten().to_numpy()
        code = np.argmax(rows.astype(np.float64) @ pivots.T, axis=1).astype(np.int32) if len(rows) else np.empty(0, np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(code), batch.column(0), batch.column(1), pa.array([r.tobytes() for r in rows], pa.binary())], ["code", "number", "id", "vector"])


def _ranges(batches, dim: int, rows: int):
    """Rows in order, cut into ranges."""
    held: list[tuple[int, int, bytes]] = []

    def made():
        numbers, ids, vectors = zip(*held, strict=True)
        data = Range(np.array(numbers, np.int64).tobytes(), np.array(ids, np.int64).tobytes(), b"".join(vectors), dim)
        row = {"numbers": data.numbers.tobytes(), "ids": data.ids.tobytes(), "vectors": b"".join(vectors), "most": data.most.max(0).tobytes(), "least": data.least.min(0).tobytes(), "least_id": int(data.ids.min())}
        held.clear()
        return pa.RecordBatch.from_pylist([row], _schema(*_PACKED, least_id=pa.int64()))

    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            held.append(row)
            if len(held) == rows:
                yield made()
    if held:
        yield made()


def _own_ranges(batches, dim: int, k: int, every: int):
    """Chunks of the queries of each range, with the kth score and id that they have there."""
    for batch in batches:
        for row in batch.to_pylist():
            data = Range(row["numbers"], row["ids"], row["vectors"], dim)
            at = np.flatnonzero(data.ids % every == 0)
            for start in range(0, len(at), CHUNK):
                own = at[start : start + CHUNK]
                best = Best(data.numbers[own], k, np.full(len(own), LOWEST), np.full(len(own), np.iinfo(np.int64).max))
                data.search(data.whole[own], best)
                values = (data.numbers[own], data.ids[own], data.whole[own], best.score[:, -1], best.id[:, -1])
                yield pa.RecordBatch.from_pylist([{c: v.tobytes() for c, v in zip(_SENT, values, strict=True)}], _schema(*_SENT))


def _unpacked(row: dict, dim: int) -> list[np.ndarray]:
    numbers, ids, vectors, score, kth = (np.frombuffer(row[c], np.int64) for c in _SENT)
    return [numbers, ids, vectors.reshape(-1, dim), score, kth]


def _to_ranges(batches, dim: int, n_ranges: int, summaries):
    """A row for each chunk and range that some of its queries must go to, with those queries."""
    known = summaries.value if summaries else None
    for batch in batches:
        for row in batch.to_pylist():
            own = _unpacked(row, dim)
            vectors, score, kth = own[2:]
            for first in range(0, n_ranges, 256):
                out = []
                numbers = range(first, min(first + 256, n_ranges))
                if known:
                    most, least, least_id = (x[first : first + 256] for x in known)
                    bound = upper(vectors, most, least)
                    go = (bound > score[:, None]) | ((bound == score[:, None]) & (least_id[None, :] <= kth[:, None]))
                for n in numbers:
                    at = np.flatnonzero(go[:, n - first]) if known else np.arange(len(score))
                    if len(at):
                        out.append({"range": n, **{c: v[at].tobytes() for c, v in zip(_SENT, own, strict=True)}})
                yield pa.RecordBatch.from_pylist(out, _schema(*_SENT, range=pa.int32()))


def _search_all(batches, dim: int, k: int):
    for batch in batches:
        for row in batch.to_pylist():
            numbers, ids, vectors, score, kth = _unpacked(row, dim)
            best = Best(numbers, k, score, kth)
            Range(row["numbers"], row["ids"], row["vectors"], dim).search(vectors, best)
            found = best.score > LOWEST
            each = found.sum(1)
            arrays = [np.repeat(numbers, each), np.repeat(ids, each), best.id[found], best.score[found]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["number", "query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, every: int = 50, range_rows: int = RANGE_ROWS, most_summary_bytes: int = MOST_SUMMARY_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the ``k`` best rows for each row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score long"
    fine, scaled = quantised(F.col(vector_col))
    rows = vectors.filter(F.col(id_col).isNotNull() & fine).select(F.monotonically_increasing_id().alias("number"), F.col(id_col).cast("long").alias("id"), scaled.alias("v"))
    rows = materialize(rows, "topk-rows")  # numbers are kept from here on
    shape = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).first()
    if not shape.n:
        return spark.createDataFrame([], result)
    before = spark.conf.get(_BATCH)
    try:
        found = _found(spark, rows, shape.n, shape.dim, k, every, range_rows, most_summary_bytes)
    finally:
        spark.conf.set(_BATCH, before)
    # partial limits: a task keeps k rows of a query before they are shuffled
    order = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _found(spark: SparkSession, rows: DataFrame, n: int, dim: int, k: int, every: int, range_rows: int, most_summary_bytes: int) -> DataFrame:
    """number, query_id, vec_id, score: at most k rows of each range that a query went to. All that is run is run here."""
    pivots = np.zeros((PIVOTS, dim))
    for i, r in enumerate(rows.orderBy(F.xxhash64("id"), "id", "v").limit(PIVOTS).collect()):
        pivots[i, : len(r.v)] = r.v
    coded = rows.mapInArrow(functools.partial(_with_codes, pivots=pivots, dim=dim), "code int, number long, id long, vector binary")
    parts = max(1, math.ceil(n / (2 * range_rows)))
    dealt = coded.repartitionByRange(parts, "code", "id").sortWithinPartitions("code", "id", "number")
    ranges = dealt.mapInArrow(functools.partial(_ranges, dim=dim, rows=range_rows), f"{', '.join(f'{c} binary' for c in _PACKED)}, least_id long")
    ranges = materialize(ranges.withColumn("key", F.xxhash64("numbers")), "topk-ranges")
    keys = ranges.select("key", "most", "least", "least_id")
    n_ranges = ranges.count()
    # numbers for the ranges: small keys, whose order is fixed by the keys
    summaries = None
    if n_ranges * dim * 16 <= most_summary_bytes:
        known = keys.orderBy("key", "least_id").collect()  # bounded by the check above
        unpack = lambda name: np.stack([np.frombuffer(getattr(r, name), np.float64) for r in known])
        summaries = spark.sparkContext.broadcast((unpack("most"), unpack("least"), np.array([r.least_id for r in known])))
        number = F.broadcast(spark.createDataFrame([(r.key, r.least_id, i) for i, r in enumerate(known)], "key long, least_id long, range int"))
    else:
        buckets = keys.groupBy(F.pmod("key", F.lit(1 << 16)).cast("int").alias("bucket")).count().orderBy("bucket").collect()  # 65,536 at most
        starts = spark.createDataFrame(list(zip((b.bucket for b in buckets), np.cumsum([0, *(b["count"] for b in buckets)])[:-1].tolist(), strict=True)), "bucket int, start long")
        within = F.row_number().over(Window.partitionBy("bucket").orderBy("key", "least_id")) - 1
        number = keys.withColumn("bucket", F.pmod("key", F.lit(1 << 16)).cast("int")).join(F.broadcast(starts), "bucket").select("key", "least_id", (F.col("start") + within).cast("int").alias("range"))
    numbered = ranges.join(number, ["key", "least_id"]).select("range", "numbers", "ids", "vectors")
    spark.conf.set(_BATCH, 8)  # rows are whole ranges or chunks from here on
    q = ", ".join(f"{c} binary" for c in _SENT)
    queries = materialize(ranges.select("numbers", "ids", "vectors").mapInArrow(functools.partial(_own_ranges, dim=dim, k=k, every=every), q), "topk-queries")
    sent = queries.mapInArrow(functools.partial(_to_ranges, dim=dim, n_ranges=n_ranges, summaries=summaries), f"{q}, range int")
    # queries times ranges are sent, which no estimate knows: a broadcast of them would grow with the square of the rows
    found = sent.hint("merge").join(numbered, "range").mapInArrow(functools.partial(_search_all, dim=dim, k=k), "number long, query_id long, vec_id long, score long")
    return materialize(found, "topk-found")
