"""Toxicity scores by weak supervision.

Voters are words of a lexicon and patterns (a word start that a given number of the text's words has). The lexicon's candidates are found in labelled rows: a
Spark job counts, for each word and word start, the labelled rows of either label that have it. A voter votes "toxic"
where it occurs and abstains elsewhere. A generative label model (two classes, one rate per voter and class, fitted by
expectation maximisation on the votes alone) estimates the voters' accuracies, and the correlations left between voters
within a class; correlated voters are discounted, so that one word and its start count once. The rows' own labels are no
voters: they serve to find the lexicon and to set the share of toxic rows. The model's posterior labels train a linear
(logistic) classifier on the votes and the share of words that voted.

What is fitted comes from at most ``MOST_LABELLED`` labelled rows (those of least hash of their id and text; repeats of a
row count once) whose crc32(doc_id) mod 5 is not 0; every row of the input is scored, over its whole text. Only votes go
into a score. More than ``MOST_VOTERS`` voters are cut to those of most evidence, with a warning.

Defined results: null and empty texts get the score of a text without votes; a null id is held out like any id whose
remainder is 0 (crc32 of an empty string); labels that are null, or whose rows contradict each other, count by their
largest value; without labelled rows of both kinds all scores are the share of toxic labels, or 0; repeated rows are
each scored; an empty table gives an empty one. Columns of the input are kept, but for those whose names the results
take.
"""

from __future__ import annotations

import functools
import re
import warnings
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import WIDE, discard, in_few, materialize, small_batches

#: Labelled rows that are read for the fit at most, voters at most, and labelled toxic rows that a voter must occur in.
MOST_LABELLED, MOST_VOTERS, LEAST_ROWS = 12_000, 2_000, 4
#: A voter's share of toxic rows, with one row of either kind added, and the lengths of word starts.
LEAST_PRECISION, STARTS = 0.72, (4, 5, 6, 7)
#: Words with one start that a pattern may ask for.
TIMES = (1, 2, 3, 5)
ROUNDS, NEWTON_STEPS, PENALTY, BLOCK = 30, 25, 0.02, 1024
#: Words whose votes a process remembers at most.
WORD_TABLE = 150_000
_WORD = re.compile(r"[^\W\d_]+")


def remainder(id_col: str):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5


def traits(text: str | None) -> set[str]:
    """A text's words (``=word``) and, where ``k`` of its words start so, patterns (``k^start``)."""
    words = _WORD.findall((text or "").lower())
    starts = Counter(w[:n] for w in words for n in STARTS if len(w) > n)
    return {f"={w}" for w in words} | {f"{k}^{start}" for start, n in starts.items() for k in TIMES if n >= k}


def _explode_traits(batches):
    for batch in batches:
        label = batch.column(1).to_pylist()
        found = [sorted(traits(t)) for t in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x for f in found for x in f], pa.string()), pa.array([y for f, y in zip(found, label, strict=True) for _ in f], pa.int32())], ["trait", "toxic"]
        )


@dataclass
class Model:
    voters: list[str]
    weights: np.ndarray  # of the voters, then of the share of words that voted, then the intercept

    def __post_init__(self):
        self.words = {v[1:]: k for k, v in enumerate(self.voters) if v[0] == "="}
        self.starts: dict[str, list[tuple[int, int]]] = {}
        for k, v in enumerate(self.voters):
            if v[0] != "=":
                times, start = v.split("^", 1)
                self.starts.setdefault(start, []).append((int(times), k))
        self.memo: dict[str, tuple[int, tuple[str, ...]] | None] = {}

    def about(self, word: str) -> tuple[int, tuple[str, ...]] | None:
        """The voter of a word (-1: none) and the starts of it that patterns are about; None where neither is."""
        starts = tuple(word[:n] for n in STARTS if len(word) > n and word[:n] in self.starts)
        known = (self.words.get(word, -1), starts) if starts or word in self.words else None
        if len(self.memo) > WORD_TABLE:
            self.memo.clear()
        self.memo[word] = known
        return known

    def votes(self, text: str | None) -> tuple[set[int], float]:
        """The voters that vote, and the share of the text's words that they are about."""
        words = _WORD.findall((text or "").lower())
        found: set[int] = set()
        seen: Counter = Counter()
        hits: Counter = Counter()
        memo = self.memo
        for w in words:
            known = memo[w] if w in memo else self.about(w)
            if known:
                if known[0] >= 0:
                    found.add(known[0])
                seen.update(known[1])
                hits[known] += 1
        for start, n in seen.items():
            found.update(k for times, k in self.starts[start] if n >= times)
        voted = sum(n for (k, starts), n in hits.items() if k >= 0 or any(found.intersection(v for _, v in self.starts[x]) for x in starts))
        return found, voted / max(1, len(words))

    def score(self, text: str | None) -> float:
        found, share = self.votes(text)
        z = self.weights[-1] + self.weights[-2] * min(1.0, 10 * share) + sum(self.weights[k] for k in found)
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


#: Correlations within a class from which voters count as repeating each other, and rounds after which they are looked at.
CORRELATED, LOOKS = 0.6, (5, 15)


def label_model(votes: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of class 1 for each row, from votes (rows x voters, 0 or 1) alone, and the voters' rates in class 1 and 0.

    ``prior`` is the share of class 1. Rows with several votes start out likely, rows with none unlikely: a voter abstains
    far more often than it votes, so class 1 is where votes meet. An abstaining voter says nothing; what that leaves out is
    made up for by the share of class 1, which each round keeps.
    """
    x = votes.astype(np.float32, copy=False)  # rows x voters: what is made of it below is no larger than voters x voters
    n, v = x.shape
    weight, common = np.ones(v), (x.T @ x).astype(float)
    if v > 1:  # before the first round, voters that nearly always vote together count as one
        own = np.maximum(np.diag(common), 1)
        overlap = common / np.sqrt(np.outer(own, own))
        weight = 1 / np.where(overlap > 0.8, overlap, 0).sum(axis=1).clip(1)
    seen = x @ weight
    q = np.where(seen >= 1.5, 0.9, np.where(seen > 0, 0.3, 0.02))
    for step in range(ROUNDS):
        in1, in0 = (((p.astype(np.float32) @ x).astype(float)) for p in (q, 1 - q))
        rate1, rate0 = (in1 + 0.5) / (q.sum() + 1), (in0 + 0.5) / ((1 - q).sum() + 1)
        if step in LOOKS:  # correlations within the classes; abstaining voters have little variance to share
            # the products of what is left of the votes when each class's rates are taken off, by their sums
            r = np.stack([rate1, rate0])
            mixed = np.array([[q @ q, q @ (1 - q)], [q @ (1 - q), (1 - q) @ (1 - q)]])
            crossed = np.stack([in1, in0]).T @ r
            cov = (common - crossed - crossed.T + r.T @ mixed @ r) / n
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
            corr = np.abs(cov / np.outer(sd, sd))
            np.fill_diagonal(corr, 0)
            weight = 1 / (1 + np.where(corr > CORRELATED, corr, 0).sum(axis=1))
        q = balanced((x @ (weight * np.log(rate1 / rate0)).astype(np.float32)).astype(float), prior)
    return q, rate1, rate0


def balanced(z: np.ndarray, share: float) -> np.ndarray:
    """Probabilities in the order of the log odds ``z``, shifted so that their mean is ``share``."""
    low, high = -80.0, 80.0
    for _ in range(60):
        middle = (low + high) / 2
        q = 1 / (1 + np.exp(-np.clip(z + middle, -40, 40)))
        low, high = (middle, high) if q.mean() < share else (low, middle)
    return q




def logistic(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Weights of a penalised logistic regression on soft labels, the intercept last; votes never count against.

    Voters whose weight comes out negative, as collinear ones' may, are left out and the rest is fitted again.
    """
    used = np.ones(x.shape[1] + 1, bool)
    while True:
        own, w = np.flatnonzero(used[:-1]), np.zeros(int(used.sum()))
        ridge = np.full(len(w), PENALTY)
        ridge[-1] = 1e-6
        for _ in range(NEWTON_STEPS):
            curve, slope = np.diag(ridge + 1e-9), -ridge * w
            for at in range(0, len(x), BLOCK):  # a block of rows at a time, so no second matrix of all rows is made
                part = np.column_stack([x[at : at + BLOCK, own], np.ones(len(x[at : at + BLOCK]))]).astype(float)
                p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
                curve += (part * (p * (1 - p))[:, None]).T @ part
                slope += part.T @ (q[at : at + BLOCK] - p)
            step = np.linalg.solve(curve, slope)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        wrong = w < 0
        wrong[-1] = False
        if not wrong.any():
            break
        used[np.flatnonzero(used)[wrong]] = False
    out = np.zeros(x.shape[1] + 1)
    out[used] = w
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from the labelled rows that aren't held out; its size is bounded by ``MOST_VOTERS``."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__toxic")).filter("__id is not null and __toxic in (0, 1)")
    known = known.filter(remainder("__id") != 0).groupBy("__id").agg(F.max("__toxic").alias("__toxic"))
    digest = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), digest.alias("__digest"))
    # few enough rows, picked by narrow columns before their texts are looked at
    picked = texts.select("__id", "__digest").join(known, "__id").distinct().orderBy(F.xxhash64(F.col("__id").cast("string"), "__digest"), "__id", "__digest").limit(MOST_LABELLED)
    rows = texts.join(F.broadcast(picked), ["__id", "__digest"]).groupBy("__id", "__digest").agg(F.first("__text").alias("__text"), F.first("__toxic").alias("__toxic"))
    rows = materialize(in_few(rows.select("__text", "__toxic"), MOST_LABELLED, WIDE), "toxicity-rows")
    counts = rows.mapInArrow(_explode_traits, "trait string, toxic int").groupBy("trait").agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    found = counts.withColumn("precision", (F.col("bad") + 1) / (F.col("bad") + F.col("good") + 2)).filter((F.col("bad") >= LEAST_ROWS) & (F.col("precision") >= LEAST_PRECISION))
    best = found.orderBy(F.desc(F.col("bad") * F.col("precision") * F.col("precision")), "trait").limit(MOST_VOTERS + 1)
    voters = [r.trait for r in best.select("trait").collect()]  # bounded by MOST_VOTERS
    if len(voters) > MOST_VOTERS:
        warnings.warn(f"more than {MOST_VOTERS} voters were found; those of most evidence are kept", stacklevel=2)
        voters.pop()
    model = Model(voters, np.zeros(len(voters) + 2))

    def vote(batches):
        for batch in batches:
            each = [model.votes(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([sorted(f) for f, _ in each], pa.list_(pa.int32())), pa.array([s for _, s in each], pa.float64()), batch.column(1)], ["votes", "share", "toxic"])

    sample = rows.mapInArrow(vote, "votes array<int>, share double, toxic int").toArrow().to_pylist()  # bounded by MOST_LABELLED
    discard(rows)
    gold = np.array([r["toxic"] for r in sample], int)
    if len(set(gold.tolist())) < 2 or not voters:
        rate = float(gold.mean()) if len(gold) else 0.0
        model.weights[-1] = np.log(max(rate, 1e-9) / max(1 - rate, 1e-9))
        return model
    order = sorted(range(len(sample)), key=lambda k: (sample[k]["votes"], sample[k]["share"], sample[k]["toxic"]))
    votes = np.zeros((len(sample), len(voters)), np.float32)
    share = np.zeros(len(sample), np.float32)
    for row, k in enumerate(order):  # the same order whatever the tasks' order was
        votes[row, sample[k]["votes"]] = 1
        share[row] = min(1.0, 10 * sample[k]["share"])
    posterior, _, _ = label_model(votes, (gold.sum() + 1) / (len(gold) + 2))
    model.weights = logistic(np.column_stack([votes, share]), posterior)
    return model


def _score_all(batches, voters: list[str], weights: np.ndarray, text_at: int, keep: list[int], names: list[str]):
    model = Model(voters, weights)
    for batch in batches:
        scores = pa.array([model.score(t) for t in batch.column(text_at).to_pylist()], pa.float64())
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), scores], names)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with held_out, score and predicted (1 from a score of 0.5); one narrow pass."""
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("score", T.DoubleType())])
    run = functools.partial(_score_all, voters=model.voters, weights=model.weights, text_at=keep.index(text_col), keep=list(range(len(keep))), names=[f.name for f in schema])
    scored = docs.select(*keep).mapInArrow(run, schema)
    return scored.withColumns({"held_out": remainder(id_col) == 0, "predicted": (F.col("score") >= 0.5).cast("int")})
