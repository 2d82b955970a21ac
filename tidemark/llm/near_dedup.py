"""Near-duplicate documents by MinHash bands and sequential Bayesian verification.

A document's set are the distinct shingles of its words. Equal sets form a class, whose smallest id stands for it.

1. Signatures are cut into bands; documents that share a band's values are candidates. Each is compared with the
   center of its bucket, the member that shares most of its bands with others, a batch of signature entries at a time:
   the pair is dropped once the posterior probability (uniform prior) that its similarity reaches the threshold falls
   below ``MISS``. The best candidate that is left for each document is verified on the full sets, and the links form
   components. So are all others that are left and whose ends these components keep apart.
2. What that leaves open is settled exactly. In a bucket with several components, two members may still be linked to
   each other, unless the triangle inequality of the Jaccard distance rules it out (one is certainly near the
   center, the other certainly far). All other members of such buckets are looked up by the rarest shingles of their
   sets (prefix, length and position filters, which lose no pair): first one candidate for each document, in rounds,
   while that joins components; then all pairs of different components that the filters let through. Pairs pass the
   Bayesian test and then the full comparison.

So a near-copy group of n documents costs n comparisons for each round, and after these the pairs of documents that
rare shingles and lengths leave possible although their components differ: a few for each document, unless thousands
of texts lie just below the threshold of each other. No bucket is gathered in one task or capped. With 51 bands of 5
rows a pair of similarity 0.8 shares no band with a probability of 2e-9.

Defined results: a text with fewer words than a shingle is one shingle; a null text or one without words has an empty
set and is linked with nothing; repeated rows and rows that share an id count as one document, linked by any of their
texts; a null id is linked with nothing and kept; an empty table gives an empty one. Ids are whole numbers (cast to
long); only the id and text columns are used, so clashing names of others don't matter.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import MANY, WIDE, in_few, materialize, mix64, shingle_hashes, small_batches, word_hashes, words_of
from tidemark.llm.graph import components

#: Bands and rows of a band; words of a shingle; percent of the union that two sets must share.
BANDS, ROWS, SHINGLE, PERCENT = 51, 5, 5, 80
#: Posterior probability at which a pair is given up, and entries of a signature that are compared at a time.
MISS, BATCH = 1e-6, 32
#: Similarities that a member of a bucket is certainly over (near) or under (far). Their distances 0.5 and 0.7 differ
#: by as much as the distance of a link, 0.2, so a near and a far member can't be linked.
NEAR, FAR = 0.5, 0.3
#: Ratio of neighbouring classes of set sizes, and rounds of single candidates before all that are left are compared.
LENGTHS, ROUNDS = 1.06, 4
HASHES = BANDS * ROWS
_RANDOM = np.random.RandomState(11)
_FACTORS = (_RANDOM.randint(0, 2**31, HASHES, dtype=np.int64) * 2 + 1).astype(np.uint32)
_TERMS = _RANDOM.randint(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    words = words_of(text)
    return np.unique(shingle_hashes(word_hashes(words), size)) if words else np.empty(0, np.uint64)


def signature(items: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    half = HASHES // 2
    low, high = items.astype(np.uint32), (items >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(items), 512):
        a = low[k : k + 512, None] * _FACTORS[None, :half] + _TERMS[None, :half]
        b = high[k : k + 512, None] * _FACTORS[None, half:] + _TERMS[None, half:]
        np.minimum(out[:half], a.min(axis=0), out=out[:half])
        np.minimum(out[half:], b.min(axis=0), out=out[half:])
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """Documents x bands."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key


@functools.lru_cache(maxsize=None)
def at_most(n: int, similarity: float, sure: float, upper: bool) -> int:
    """Of ``n`` entries (bytes, equal by chance once in 256) the number of equal ones that settles a pair.

    upper: the largest number at which the similarity reaches ``similarity`` with a probability under ``sure``.
    Else the smallest at which it stays below with a probability under ``sure``. With a uniform prior the posterior
    is a beta distribution, whose tail is that of a binomial one.
    """
    t = similarity + (1 - similarity) / 256
    log = [math.lgamma(n + 2) - math.lgamma(i + 1) - math.lgamma(n + 2 - i) + i * math.log(t) + (n + 1 - i) * math.log(1 - t) for i in range(n + 2)]
    tail = np.cumsum(np.exp(log))  # P(at least t | m equal) = P(Binomial(n + 1, t) <= m)
    if upper:
        return int(np.searchsorted(tail, sure, "left")) - 1
    return int(np.searchsorted(tail, 1 - sure, "right"))


def _features(batches, size: int, id_at: int, text_at: int):
    for batch in batches:
        ids = batch.column(id_at)
        sets = [shingle_set(t, size) for t in batch.column(text_at).to_pylist()]
        signatures = np.stack([signature(s) for s in sets]) if sets else np.empty((0, HASHES), np.uint32)
        keys = band_keys(signatures).view(np.int64)
        classes = [np.array([np.bitwise_xor.reduce(mix64(s)), np.add.reduce(mix64(s + np.uint64(7)))], np.uint64).tobytes() if len(s) else None for s in sets]
        sig = (signatures >> np.uint32(8)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array(classes, pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.ListArray.from_arrays(np.arange(len(sets) + 1, dtype=np.int32) * BANDS, pa.array(keys.ravel())),
                pa.array([x.tobytes() for x in sig], pa.binary()),
            ],
            ["id", "class", "n", "bands", "sig"],
        )


def _test(batches, percent: int, keep: int):
    """Pairs (their first ``keep`` columns, then two signatures) with equal entries, whether they may be linked, and place."""
    steps = [*range(BATCH, HASHES, BATCH), HASHES]
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
        n = len(a)
        equal, may, place, live, done = np.zeros(n, np.int64), np.ones(n, bool), np.zeros(n, np.int8), np.arange(n), 0
        for step in steps:
            if not len(live):
                break
            equal[live] += (a[live, done:step] == b[live, done:step]).sum(axis=1)
            done = step
            may[live] &= equal[live] > at_most(step, percent / 100, MISS, True)
            far = equal[live] <= at_most(step, FAR, MISS, True)
            near = equal[live] >= at_most(step, NEAR, MISS, False)
            place[live[far]], place[live[near]] = -1, 1
            live = live[may[live] | ~(far | near)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:keep], pa.array(equal), pa.array(may), pa.array(place)], [*batch.schema.names[:keep], "equal", "may", "place"])


def _verify(batches, size: int, percent: int):
    memo: dict[str, np.ndarray] = {}
    for batch in batches:
        keep = []
        memo.clear()
        for x, y in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
            s = shingle_set(x, size)
            t = memo.get(y)
            if t is None:
                t = memo[y] = shingle_set(y, size)
            both = len(np.intersect1d(s, t, assume_unique=True))
            keep.append(bool(both) and 100 * both >= percent * (len(s) + len(t) - both))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _shingles(batches, size: int):
    for batch in batches:
        sets = [shingle_set(t, size) for t in batch.column(1).to_pylist()]
        ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(s) for s in sets])
        flat = np.concatenate([s.view(np.int64) for s in sets]) if sets else np.empty(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(flat)], ["id", "shingle"])


class NearDedup:
    def __init__(self, docs: DataFrame, id_col: str, text_col: str, size: int, percent: int):
        small_batches(docs.sparkSession)
        self.size, self.percent = size, percent
        self.texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
        features = self.texts.mapInArrow(functools.partial(_features, size=size, id_at=0, text_at=1), "id long, class binary, n long, bands array<long>, sig binary")
        self.features = materialize(features, "near-features")
        self.rows = self.features.count()

    def classes(self) -> DataFrame:
        """class, rep (the smallest id of the class)."""
        return self.features.filter("id is not null and class is not null").groupBy("class").agg(F.min("id").alias("rep"))

    def tested(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (a, b) after the sequential test."""
        sig = self.heads.select("id", "sig")
        full = pairs.select("a", "b").join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a").join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b")
        return full.select("a", "b", "sig_a", "sig_b").mapInArrow(functools.partial(_test, percent=self.percent, keep=2), "a long, b long, equal long, may boolean, place byte")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The links among ``pairs``; b, which may be frequent, is joined last, so no exchange carries its text twice."""
        full = pairs.select("a", "b").join(self.texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
        full = full.join(self.texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        return full.select("a", "b", "text_a", "text_b").mapInArrow(functools.partial(_verify, size=self.size, percent=self.percent), "a long, b long")

    def links(self) -> DataFrame:
        """Links between representatives whose components are those of all links."""
        reps = materialize(in_few(self.classes(), self.rows), "near-classes")
        heads = self.features.filter("class is not null").join(reps, "class").filter("id = rep").select("id", "n", "bands", "sig")
        self.heads = materialize(in_few(heads, self.rows, WIDE), "near-heads")
        rows = self.heads.select("id", F.explode("bands").alias("band"))
        sizes = rows.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
        rows = materialize(in_few(rows.join(sizes, "band").select("band", "id", "size"), self.rows, WIDE), "near-buckets")
        # the center of a bucket is its member with the fullest buckets, which is the least edited one of a group
        weights = rows.groupBy("id").agg(F.sum("size").alias("weight"))
        centers = rows.join(weights, "id").groupBy("band").agg(F.max(F.struct("weight", (-F.col("id")).alias("id"))).alias("x")).select("band", (-F.col("x.id")).alias("center"))
        members = materialize(in_few(rows.join(centers, "band").select("band", "id", "center", "size"), self.rows, WIDE), "near-members")
        stars = members.filter("id <> center").select(F.col("id").alias("a"), F.col("center").alias("b")).distinct()
        stars = materialize(in_few(self.tested(stars), self.rows, WIDE), "near-stars")
        best = stars.filter("may").groupBy("a").agg(F.max(F.struct("equal", (-F.col("b")).alias("b"))).alias("best")).select("a", (-F.col("best.b")).alias("b"))
        first = materialize(in_few(self.verified(best), self.rows, WIDE), "near-links")
        parts = components(first)
        other = materialize(self.verified(self.apart(stars.filter("may").join(best, ["a", "b"], "left_anti"), parts)), "near-links")
        parts = components(first.union(other))
        return first.union(other).union(self.settle(members, stars, parts))

    @staticmethod
    def apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
        """``pairs`` (a, b) whose ends lie in different components of ``parts``."""
        for c in ("a", "b"):
            pairs = pairs.join(parts.select(F.col("node").alias(c), F.col("component").alias(f"part_{c}")), c, "left")
        return pairs.filter(F.coalesce("part_a", "a") != F.coalesce("part_b", "b")).select("a", "b")

    def open_members(self, members: DataFrame, stars: DataFrame, parts: DataFrame) -> DataFrame:
        """id, component of the documents that may have links to other components which no star has shown."""
        placed = members.filter("size > 2").join(stars.select(F.col("a").alias("id"), F.col("b").alias("center"), "place"), ["id", "center"], "left")
        placed = placed.withColumn("place", F.coalesce("place", F.lit(1).cast("byte")))  # the center itself
        placed = placed.join(parts.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        inner, outer = (F.when(F.col("place") >= 0, F.col("component")), F.when(F.col("place") <= 0, F.col("component")))
        open_ = placed.groupBy("band").agg(F.min(inner) < F.max(inner), F.min(outer) < F.max(outer)).toDF("band", "inner", "outer").filter("inner or outer")
        return placed.join(open_, "band").filter("(inner and place >= 0) or (outer and place <= 0)").select("id", "component").distinct()

    def tokens(self, ids: DataFrame) -> DataFrame:
        """token, length, id, n, at, short: the rarest shingles of the sets of ``ids``, by the length of the shorter set.

        Of two sets that may be linked, the shorter has a shared shingle among its first ones (in the order of rarity)
        that leave it enough of them, and the longer one too; how many those are depends on both lengths. A set is the
        shorter one of its own class of lengths, and the longer one of each class that a linked set can have.
        """
        texts = self.texts.join(ids.select("id"), "id", "left_semi").select("id", "text")
        rows = texts.mapInArrow(functools.partial(_shingles, size=self.size), "id long, shingle long").distinct()
        count = ids.count()
        rows = materialize(in_few(rows, count, MANY), "near-shingles")
        frequent = rows.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1")
        # shingles of one document alone come first in every order; only their number counts
        counted = rows.join(frequent, "shingle").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("common"))
        sets = counted.join(rows.groupBy("id").agg(F.count("*").alias("n")), "id").withColumn("alone", F.col("n") - F.size("common"))
        class_of = lambda n: F.floor(F.log(n) / math.log(LENGTHS)).cast("int")
        least = F.ceil(F.col("n") * self.percent / 100.0 - 1e-9)
        roles = sets.select("*", F.lit(True).alias("short"), class_of(F.col("n")).alias("length"), F.col("n").cast("double").alias("other"))
        longer = sets.select("*", F.lit(False).alias("short"), F.explode(F.sequence(class_of(least), class_of(F.col("n")))).alias("length"))
        longer = longer.withColumn("other", F.greatest(least, F.floor(F.pow(F.lit(LENGTHS), "length") - 1e-6)).cast("double"))
        both = roles.unionByName(longer)
        # places at which the rest of the set is as large as what sets of these lengths must share
        take = F.col("n") - F.ceil((F.col("n") + F.col("other")) * self.percent / (100.0 + self.percent) - 1e-6) + 1 - F.col("alone")
        both = both.withColumn("take", take.cast("int")).filter("take > 0")
        spread = both.select("id", "n", "alone", "length", "short", F.posexplode(F.slice("common", F.lit(1), F.col("take"))).alias("at", "x"))
        spread = spread.select(F.col("x.shingle").alias("token"), "length", "id", "n", (F.col("alone") + F.col("at")).alias("at"), "short")
        return materialize(in_few(spread, count, MANY), "near-tokens")

    def fits(self) -> Column:
        """Whether the sets x and y may be linked if a shingle at these places is the first that they share."""
        shared = F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y"))
        return (100 + self.percent) * shared >= self.percent * (F.col("n_x") + F.col("n_y"))

    def settle(self, members: DataFrame, stars: DataFrame, parts: DataFrame) -> DataFrame:
        """Links between the components of ``parts`` that the buckets leave open.

        In rounds, each open document meets the most promising document of the component that most documents with one
        of its rare shingles belong to, so a group that has no good center still grows together by as many comparisons
        as it has members. When a round finds nothing, the pairs of different components that are left are compared.
        """
        who = materialize(in_few(self.open_members(members, stars, parts), self.rows), "near-open")
        tokens = self.tokens(who)
        found, parts, tried = None, who, None
        for _ in range(ROUNDS):
            pairs = self.leads(tokens, parts)
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
            pairs = materialize(in_few(pairs, self.rows), "near-leads")
            tried = pairs if tried is None else tried.union(pairs)
            new = materialize(in_few(self.verified(self.tested(pairs).filter("may")), self.rows, WIDE), "near-links")
            if new.isEmpty():
                break
            found = new if found is None else found.union(new)
            parts = materialize(in_few(self.merged(parts, new), self.rows), "near-open")
        last = materialize(self.verified(self.tested(self.left(tokens, parts)).filter("may")), "near-links")
        return last if found is None else last.union(found)

    @staticmethod
    def merged(parts: DataFrame, links: DataFrame) -> DataFrame:
        """``parts`` (id, component) after ``links`` (a, b)."""
        rows = links.count()
        for c in ("a", "b"):
            links = links.join(parts.select(F.col("id").alias(c), F.col("component").alias(f"part_{c}")), c)
        whole = components(links.select(F.col("part_a").alias("a"), F.col("part_b").alias("b")), rows).toDF("component", "whole")
        return parts.join(whole, "component", "left").select("id", F.coalesce("whole", "component").alias("component"))

    @staticmethod
    def majors(tokens: DataFrame, parts: DataFrame) -> DataFrame:
        """``tokens`` of which several components have one, with component and major (that of most documents)."""
        own = tokens.join(parts, "id")
        most = own.groupBy("token", "length", "component").agg(F.count("*").alias("c")).groupBy("token", "length")
        most = most.agg(F.max_by("component", F.struct("c", "component")).alias("major"), F.count("*").alias("kinds")).filter("kinds > 1")
        return own.join(most.select("token", "length", "major"), ["token", "length"])

    def leads(self, tokens: DataFrame, parts: DataFrame) -> DataFrame:
        """a, b: for each document, the best candidate among the first ones of the components that lead its tokens."""
        own = self.majors(tokens, parts)
        lead = own.filter("component = major").groupBy("token", "length").agg(F.max_by(F.struct("id", "n", "at"), F.struct(-F.col("at"), -F.col("id"))).alias("y"))
        pairs = own.filter("component <> major").join(lead, ["token", "length"])
        pairs = pairs.select("id", F.col("n").alias("n_x"), F.col("at").alias("at_x"), F.col("y.id").alias("b"), F.col("y.n").alias("n_y"), F.col("y.at").alias("at_y")).filter(self.fits())
        room = F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y")) / (F.col("n_x") + F.col("n_y"))
        return pairs.groupBy("id").agg(F.max_by("b", F.struct(room, -F.col("b"))).alias("b")).select(F.col("id").alias("a"), "b")

    def left(self, tokens: DataFrame, parts: DataFrame) -> DataFrame:
        """a, b: all pairs of different components that the prefix, length and position filters let through."""
        own = materialize(self.majors(tokens, parts), "near-left")
        x = own.filter("short").select("token", "length", "major", *(F.col(c).alias(f"{c}_x") for c in ("id", "component", "n", "at")))
        y = own.filter("not short").select("token", "length", *(F.col(c).alias(f"{c}_y") for c in ("id", "component", "n", "at")))
        differ = (F.col("component_x") != F.col("component_y")) & (F.col("n_x") <= F.col("n_y"))
        key = ["token", "length"]
        minor = x.filter("component_x <> major").drop("major").join(y, key)
        major = x.filter("component_x = major").join(y.withColumnRenamed("component_y", "c"), key).filter("c <> major").withColumnRenamed("c", "component_y").drop("major")
        pairs = minor.unionByName(major).filter(differ & self.fits())
        return pairs.select(F.greatest("id_x", "id_y").alias("a"), F.least("id_x", "id_y").alias("b")).distinct()

    def members(self) -> DataFrame:
        """id, class, n, component of each row of the input."""
        parts = components(self.links())
        reps = self.classes().join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("class", F.coalesce("component", "rep").alias("component"))
        found = self.features.select("id", "class", "n").join(reps, "class", "left")
        return found.select("id", "n", "class", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """id_col, n_shingles, component_id, kept of each row of ``docs``."""
    found = NearDedup(docs, id_col, text_col, size, percent).members()
    # rows that share an id are one document: their components are joined below by the id itself
    least = found.groupBy("id").agg(F.min("component").alias("c"), F.max("component").alias("d"))
    split = least.filter("c < d").select(F.col("c").alias("a"), F.col("d").alias("b"))
    if split.isEmpty():
        out = found
    else:
        again = components(split)
        out = found.join(again.withColumnRenamed("component", "whole"), found["component"] == again["node"], "left").withColumn("component", F.coalesce("whole", "component"))
    kept = F.coalesce(F.col("id") == F.col("component"), F.lit(True))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept.alias("kept"))
