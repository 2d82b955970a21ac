"""Exact integer k-means with block-norm screening.

Components become integers, so distances, sums and floors are exact, and the result doesn't depend on how rows are dealt.
A vector is stored once, packed, with its compressed form: the norm of each of its ``SEGMENTS`` segments. By
Cauchy-Schwarz a segment's squared distance is at least the squared difference of the two norms; their sum is a lower
bound of the whole distance. In each round a vector's exact distance to the centroid with the least bound comes first;
of the others only those whose bound does not exceed the least exact distance so far get one too.

A round is one narrow pass that ends in sums of k clusters, which are aggregated before the shuffle and have at most
k * dim * limbs rows for the driver; the centroids go to the tasks with the next pass. Sums are kept in limbs of 30 bits,
each summed as a long, so they are exact for components of any size and for 2**33 rows.

Defined results: vectors that are null, of another length, or hold nulls or non-finite components take no part, nor do
null ids; of rows with one id the hash is the same, and the smaller vector becomes the earlier centroid; with fewer than k
rows there are as many clusters as rows; distances and inertias beyond a long are cut to its largest value; repeated rows
are each assigned; an empty table gives an empty one. Only the id and the vector column are used, so clashing names of
others don't matter.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import discard, materialize

SEGMENTS = 8
#: Components below this (as absolute values) have distances that fit into a long, in up to 4,096 dimensions.
NARROW = 1 << 24
LIMB = 30
LONGEST = (1 << 63) - 1


def usable(vector: Column, dim: int) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(vector) == dim) & fine, F.lit(False))


def packed(values: list[int]) -> bytes:
    """Integers as longs where all are narrow, else as decimal text, whose length is no multiple of 8."""
    if all(abs(v) < NARROW for v in values):
        return np.array(values, np.int64).tobytes()
    text = ",".join(map(str, values)).encode()
    return text if len(text) % 8 else text + b" "


def unpacked(rows: list[bytes], dim: int) -> np.ndarray:
    """rows x dim integers: longs, or Python's where some row is not narrow."""
    if all(len(r) % 8 == 0 for r in rows):
        return np.frombuffer(b"".join(rows), np.int64).reshape(-1, dim)
    return np.array([list(map(int, r.split(b","))) if len(r) % 8 else np.frombuffer(r, np.int64).tolist() for r in rows], object).reshape(-1, dim)


def norms(rows: np.ndarray) -> np.ndarray:
    """Norms of a row's segments, as floating point."""
    if rows.dtype == object:  # what floating point can't square has no norm, so it is not screened
        rows = np.array([[float(x) if abs(x) < 1 << 500 else math.inf for x in r] for r in rows]).reshape(rows.shape)
    parts = np.array_split(np.arange(rows.shape[1]), SEGMENTS)
    return np.stack([np.sqrt((rows[:, p].astype(np.float64) ** 2).sum(axis=1)) for p in parts], axis=1)


def screen(rows: np.ndarray, compressed: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid (ties: smaller number), exact squared distance, and how many exact distances were worked out."""
    with np.errstate(over="ignore", invalid="ignore"):
        own = norms(centroids)
        gap = compressed[:, None, :] - own[None, :, :]
        # room for rounding: a bound that is too low only costs a distance, one that is too high could cost the result
        slack = 1e-9 * (compressed[:, None, :] + own[None, :, :])
        bound = (np.maximum(np.abs(gap) - slack, 0.0) ** 2).sum(axis=2)
    bound = np.where(np.isfinite(bound), bound, 0.0)
    exact = rows.dtype != object and centroids.dtype != object
    kind = np.int64 if exact else object

    def distance(at: np.ndarray, k: int) -> np.ndarray:
        gaps = rows[at].astype(kind) - centroids[k].astype(kind)[None, :]
        return (gaps * gaps).sum(axis=1)

    first = np.argmin(bound, axis=1)
    best, found, looked = np.empty(len(rows), kind), first.copy(), 0
    for k in range(len(centroids)):
        at = np.flatnonzero(first == k)
        if len(at):
            best[at] = distance(at, k)
            looked += len(at)
    for k in range(len(centroids)):
        least = np.array([float(x) if abs(x) < 1 << 1000 else math.inf for x in best]) if not exact else best.astype(np.float64)
        at = np.flatnonzero((first != k) & (bound[:, k] <= least * (1 + 1e-9) + 1))
        if len(at):
            d = distance(at, k)
            looked += len(at)
            better = (d < best[at]) | ((d == best[at]) & (k < found[at]))
            best[at[better]], found[at[better]] = d[better], k
    return found, best, looked


def limbs(value: int) -> list[int]:
    """A whole number in limbs of ``LIMB`` bits, each with the number's sign."""
    sign, value, out = (-1 if value < 0 else 1), abs(value), []
    while value:
        out.append(sign * (value & ((1 << LIMB) - 1)))
        value >>= LIMB
    return out


def _pack(batches, scale: int, dim: int):
    for batch in batches:
        vectors, wide = batch.column(1), []
        flat = np.asarray(vectors.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
        scaled = np.floor(flat * scale)
        narrow = (np.abs(scaled) < NARROW).all(axis=1) if len(flat) else np.empty(0, bool)
        whole = np.where(narrow[:, None], scaled, 0).astype(np.int64)
        data = [r.tobytes() for r in whole]
        for i in np.flatnonzero(~narrow).tolist():  # beyond what floating point multiplies exactly
            data[i] = packed([math.floor(_times(float(x), scale)) for x in flat[i]])
            wide.append(i)
        compressed = [r.tobytes() for r in (norms(whole) if len(whole) else whole)]
        for i in wide:
            compressed[i] = norms(unpacked([data[i]], dim)).tobytes()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary()), pa.array(compressed, pa.binary())], ["vec_id", "vector", "compressed"])


def _times(x: float, scale: int):
    """scale * x without overflow, for the floor."""
    return scale * x if abs(x) < 1e300 else scale * int(x)


def _columns(batch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    rows = unpacked(batch.column(1).to_pylist(), dim)
    return rows, np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float64).reshape(len(rows), -1)


def _assign(batches, centroids: np.ndarray):
    for batch in batches:
        if batch.num_rows:
            found, best, _ = screen(*_columns(batch, centroids.shape[1]), centroids)
            capped = [min(int(x), LONGEST) for x in best.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.astype(np.int32)), pa.array(capped, pa.int64())], ["vec_id", "cluster", "distance"])


def _sums(batches, centroids: np.ndarray):
    """cluster, dim (-1 for the rows), limb and value of each batch's sums."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows, compressed = _columns(batch, centroids.shape[1])
        found, _, _ = screen(rows, compressed, centroids)
        out = []
        for k in np.unique(found).tolist():
            own = rows[found == k]
            out.append((k, -1, 0, len(own)))
            out += [(k, d, i, x) for d, total in enumerate(own.sum(axis=0).tolist()) for i, x in enumerate(limbs(int(total)))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["cluster", "dim", "limb", "value"])


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Every non-empty centroid replaced by the floor of its rows' mean."""
    each = rows.mapInArrow(functools.partial(_sums, centroids=centroids), "cluster int, dim int, limb int, value long")
    sums = each.groupBy("cluster", "dim", "limb").agg(F.sum("value").alias("value")).collect()  # k * (dim * limbs + 1) rows at most
    count = {r.cluster: r.value for r in sums if r.dim < 0}
    total = {k: [0] * centroids.shape[1] for k in count}
    for r in sums:
        if r.dim >= 0:
            total[r.cluster][r.dim] += r.value << (LIMB * r.limb)
    return whole([[x // count[k] for x in total[k]] if k in count else c for k, c in enumerate(centroids.tolist())])


def whole(centroids: list[list[int]]) -> np.ndarray:
    narrow = all(abs(x) < NARROW for c in centroids for x in c)
    return np.array(centroids, np.int64 if narrow else object)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, dim: int = 64, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster, distance of every usable vector, and the centroids (k x dim whole numbers).

    The first centroids are the k vectors with the least lowercase-hex sha256 of ``<seed>:<id>``.
    """
    spark = vectors.sparkSession
    own = vectors.filter(F.col(id_col).isNotNull() & usable(F.col(vector_col), dim))
    own = own.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = materialize(own.mapInArrow(functools.partial(_pack, scale=scale, dim=dim), "vec_id long, vector binary, compressed binary"), "centroids")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = own.orderBy(digest, "v").limit(k).select("v").collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), np.empty((0, dim), np.int64)
    centroids = whole([[math.floor(_times(x, scale)) for x in r.v] for r in first])
    for _ in range(rounds):
        after = moved(rows, centroids)
        if (after == centroids).all():
            break  # every further round would give the same
        centroids = after
    found = materialize(rows.mapInArrow(functools.partial(_assign, centroids=centroids), "vec_id long, cluster int, distance long"), "clusters")
    discard(rows)
    return found, centroids


def with_inertia(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` with cluster_inertia, inertia and centroid_sha256 (of the centroid's components joined by commas)."""
    spark = assigned.sparkSession
    sums = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    cut = lambda x: min(x, LONGEST)
    rows = [(c, cut(sums.get(c, 0)), cut(sum(sums.values())), hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids.tolist())]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
