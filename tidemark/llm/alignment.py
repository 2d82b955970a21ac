"""Alignment of two tokenizers' tokens over the same bytes, and how often ids are linked in the corpus.

A is a byte-level BPE (a ``tokenizers`` JSON file), B a sentencepiece model that puts a space before a text. Both encode
space + text. B's tokens are a static interval index (their sorted starts and ends); two bisections give for each A token
the list of B tokens that it overlaps. A gap between two tokens that no token of the other side spans is a group boundary;
all A-B pairs within a group are links.

A text is cut before each single space between two characters that are no white space: neither vocabulary has a token
that reaches over such a place, so each unit is encoded by itself, its alignment is remembered in a bounded table of the
process, and all units that a batch of texts lacks are encoded and aligned together.

Corpus counts (documents that hold a pair of ids linked) are an aggregation by pair. Each text then asks for the counts
of its pairs. Of D (document, pair) rows no more than ``HOT_PAIRS`` pairs can have D / HOT_PAIRS or more: these are
broadcast (a proven bound, and no key that is left is frequent), the others are joined by a shuffle.

Defined results: texts that are null, empty, or whose tokens' bytes are not those of space + text (as with U+2581 in it)
have zeros and an empty text for a hash; repeated rows are documents of their own; null ids are kept; an empty table
gives an empty one. Columns of the input are kept, but for the text and those whose names the results take.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import discard, materialize, small_batches
from tidemark.llm.token_counts import byte_letters

#: Units and characters of units that a process remembers at most, before its table starts anew.
UNIT_TABLE, TABLE_CHARS = 300_000, 8_000_000
#: Pairs of ids whose counts are broadcast at most (20 bytes each).
HOT_PAIRS = 1 << 18
#: A group with more pairs than these is counted by distinct ids.
LARGE_GROUP = 4096
#: How byte-level vocabularies cut a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = re.compile(r"(?<=\S) (?=\S)")
_OTHER_SPACE = re.compile("[" + "".join(c for c in map(chr, [*range(0x1C, 0x20), *range(0x80, 0x3001)]) if c.isspace()) + "]")
_NOT_ALONE = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ", " \v", "\v ", " \f", "\f ")
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
RESULTS = (*COUNTS, "n_best", "count_sum", "groups_sha256")


def units_of(text: str) -> list[str]:
    """The units of space + text, each without the space that it starts with."""
    if not any(x in text for x in _NOT_ALONE) and text[0] != " " and text[-1] != " " and not _OTHER_SPACE.search(text):
        return text.split(" ")
    return [u[1:] if k == 0 else u for k, u in enumerate(_CUT.split(" " + text))]


def overlaps(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each A token the first B token that it overlaps, and the one after the last, from both sides' ends."""
    a_start, b_start = np.concatenate([[0], a_end[:-1]]), np.concatenate([[0], b_end[:-1]])
    return np.searchsorted(b_end, a_start, side="right"), np.searchsorted(b_start, a_end, side="left")


def group_ends(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of A and of B tokens up to the end of each group."""
    if not len(a_end):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first, after = overlaps(a_end, b_end)
    unspanned = np.append(first[1:] >= after[:-1], True)  # no B token overlaps this A token and the next one
    return np.flatnonzero(unspanned) + 1, after[unspanned]


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters, added = spec["model"]["vocab"], byte_letters(), {t["content"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in added}  # ids follow the merges' order
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for data, i in ranks.items():
            self.a_bytes[i] = data
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[1:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        if any(" " in x.decode("utf-8", "ignore").lstrip(" ") for x in self.b_bytes):
            raise ValueError("a piece of B reaches over a space, so texts can't be cut into units")
        self.a_len, self.b_len = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.text = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        self.groups: list[str | None] = []  # None: the tokens' bytes differ from the unit's
        self.counts = np.empty((0, 4), np.int64)
        self.start = np.zeros(1, np.int64)  # of each unit's pairs
        self.pair_code, self.pair_times = np.empty(0, np.int64), np.empty(0, np.int64)

    def learn(self, units: list[str]) -> None:
        """Encode and align units that the table lacks, all as one run of bytes."""
        a_ids = [self.a.encode_ordinary(" " + u) for u in units]
        b_ids = self.b.encode(units, num_threads=1)
        fine = []
        for u, x, y in zip(units, a_ids, b_ids, strict=True):
            data = (" " + u).encode()
            fine.append(b"".join(map(self.a_bytes.__getitem__, x)) == data and b"".join(map(self.b_bytes.__getitem__, y)) == data)
        a_ids, b_ids = ([x if ok else [] for x, ok in zip(ids, fine, strict=True)] for ids in (a_ids, b_ids))
        a, b = (np.fromiter(itertools.chain.from_iterable(ids), np.int64) for ids in (a_ids, b_ids))
        a_to, b_to = group_ends(np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b]))
        a_from, b_from = (np.concatenate([[0], x[:-1]]) if len(x) else x for x in (a_to, b_to))
        pairs = (a_to - a_from) * (b_to - b_from)
        n_a, n_b = np.array(list(map(len, a_ids)), np.int64), np.array(list(map(len, b_ids)), np.int64)
        last = np.searchsorted(a_to, np.cumsum(n_a), side="right")  # groups up to the end of each unit
        n_groups = np.diff(last, prepend=0)
        before = np.concatenate([[0], np.cumsum(pairs)])
        self.counts = np.concatenate([self.counts, np.column_stack([n_a, n_b, n_groups, np.diff(before[last], prepend=0)])])
        code, times, of = self._pairs(a, b, a_from, a_to, b_from, b_to, pairs)
        each = np.zeros(len(pairs) + 1, np.int64)
        each[1:] = np.cumsum(np.bincount(of, minlength=len(pairs))) if len(pairs) else 0
        self.start = np.concatenate([self.start, self.start[-1] + each[last]])
        self.pair_code, self.pair_times = np.concatenate([self.pair_code, code]), np.concatenate([self.pair_times, times])
        text = self.text
        a_text, b_text = [text[i] for i in a.tolist()], [text[i] for i in b.tolist()]
        shown = [",".join(a_text[p:q]) + "|" + ",".join(b_text[r:s]) for p, q, r, s in zip(a_from.tolist(), a_to.tolist(), b_from.tolist(), b_to.tolist(), strict=True)]
        at = 0
        for u, ok, end in zip(units, fine, last.tolist(), strict=True):
            self.known[u] = len(self.groups)
            self.groups.append(";".join(shown[at:end]) if ok else None)
            self.chars += len(u)
            at = end

    def _pairs(self, a, b, a_from, a_to, b_from, b_to, pairs):
        """Codes of the linked ids, how often, and the group that each belongs to, in the groups' order."""
        large = np.flatnonzero(pairs > LARGE_GROUP)
        size = pairs.copy()
        size[large] = 0
        of = np.repeat(np.arange(len(size)), size)
        within = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        wide = (b_to - b_from)[of]
        code = (a[a_from[of] + within // wide] << 32) | b[b_from[of] + within % wide] if len(of) else np.empty(0, np.int64)
        times = np.ones(len(of), np.int64)
        for g in large.tolist():  # at most the product of two vocabularies' sizes, and far fewer in any text seen
            x, n = np.unique(a[a_from[g] : a_to[g]], return_counts=True)
            y, m = np.unique(b[b_from[g] : b_to[g]], return_counts=True)
            code, times = np.concatenate([code, ((x << 32)[:, None] | y[None, :]).ravel()]), np.concatenate([times, np.outer(n, m).ravel()])
            of = np.concatenate([of, np.full(len(x) * len(y), g)])
        if len(large):
            order = np.argsort(of, kind="stable")
            code, times, of = code[order], times[order], of[order]
        return code, times, of

    def prepare(self, texts: list[str | None]) -> list[list[str]]:
        """The units of texts, all of which the table then has."""
        if len(self.known) > UNIT_TABLE or self.chars > TABLE_CHARS:
            self.clear()
        each = [units_of(t) if t else [] for t in texts]
        lacking = list({u for units in each for u in units if u not in self.known})
        if lacking:
            self.learn(lacking)
        return each

    def align(self, units: list[str]) -> tuple[np.ndarray, str, np.ndarray, np.ndarray]:
        """Counts (n_a, n_b, n_groups, n_links), the groups as text, codes of linked pairs (ascending) and how often."""
        at = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
        groups = [self.groups[i] for i in at.tolist()]
        if not units or None in groups:
            return np.zeros(4, np.int64), "", np.empty(0, np.int64), np.empty(0, np.int64)
        unit, n = np.unique(at, return_counts=True)
        size = self.start[unit + 1] - self.start[unit]
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.start[unit], size)
        code, which = np.unique(self.pair_code[place], return_inverse=True)
        times = np.bincount(which, self.pair_times[place] * np.repeat(n, size), len(code)).astype(np.int64)
        return n @ self.counts[unit], ";".join(groups), code, times


@functools.lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, parts)]).astype(np.int32), pa.array(flat).cast(kind))


def _align_all(batches, a_path: str, b_path: str, text_at: int, keep: list[int], names: list[str], as_text: bool):
    own = aligner(a_path, b_path)
    for batch in batches:
        counts, digests, codes, times = [], [], [], []
        for units in own.prepare(batch.column(text_at).to_pylist()):
            n, groups, code, often = own.align(units)
            counts.append(n)
            digests.append(groups if as_text or not groups else hashlib.sha256(groups.encode()).hexdigest())
            codes.append(code)
            times.append(often)
        table = np.array(counts, np.int64).reshape(-1, 4)
        made = [*(pa.array(table[:, k]) for k in range(4)), pa.array(digests, pa.string())]
        if not as_text:
            made += [_lists([c >> 32 for c in codes], pa.int32()), _lists([c & 0xFFFFFFFF for c in codes], pa.int32()), _lists(times, pa.int64())]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *made], names)


def _aligned(docs: DataFrame, a_path: str, b_path: str, text_col: str, last: str) -> DataFrame:
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in (*RESULTS, "groups", text_col)]
    schema = "".join(f", {c} long" for c in COUNTS)[2:] + f", {last} string" + (", __a array<int>, __b array<int>, __times array<long>" if last != "groups" else "")
    out = T.StructType([*(docs.schema[c] for c in keep), *T.StructType.fromDDL(schema)])
    run = functools.partial(_align_all, a_path=a_path, b_path=b_path, text_at=len(keep), keep=list(range(len(keep))), names=[f.name for f in out], as_text=last == "groups")
    return docs.select(*keep, text_col).mapInArrow(run, out)


def token_groups(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with the counts and the groups themselves (``a1,a2|b1;a3|b2,b3``); a narrow pass."""
    return _aligned(docs, a_path, b_path, text_col, "groups")


def _look_up(batches, codes, counts, best, n_keep: int, names: list[str]):
    """Sums over a text's frequent pairs, and its other pairs as they are."""
    codes, counts, best = codes.value, counts.value, best.value
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, times = (batch.column(n_keep + k) for k in range(3))
        starts, code = a.offsets.to_numpy(), (a.flatten().to_numpy().astype(np.int64) << 32) | b.flatten().to_numpy()
        starts, often = starts - starts[0], times.flatten().to_numpy()
        row = np.repeat(np.arange(batch.num_rows), np.diff(starts))
        at = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
        hit = codes[at] == code if len(codes) else np.zeros(len(code), bool)
        sums = [np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)]
        np.add.at(sums[0], row[hit], (often * best[at] if len(codes) else often)[hit])
        np.add.at(sums[1], row[hit], (often * counts[at] if len(codes) else often)[hit])
        left = np.concatenate([[0], np.cumsum(np.bincount(row[~hit], minlength=batch.num_rows))]).astype(np.int32)
        rest = pa.StructArray.from_arrays([pa.array((code[~hit] >> 32).astype(np.int32)), pa.array((code[~hit] & 0xFFFFFFFF).astype(np.int32)), pa.array(often[~hit])], ["a", "b", "times"])
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(n_keep)), *map(pa.array, sums), pa.ListArray.from_arrays(left, rest)], names)


def pair_counts(stored: DataFrame) -> DataFrame:
    """a, b, n (documents that hold the pair linked) and best (no pair of ``a`` has more)."""
    pairs = stored.select(F.explode(F.arrays_zip("__a", "__b")).alias("p")).groupBy(F.col("p.__a").alias("a"), F.col("p.__b").alias("b")).agg(F.count("*").alias("n"))
    pairs = materialize(pairs, "alignment-pairs")
    most = pairs.groupBy(F.col("a").alias("__id")).agg(F.max("n").alias("__most"))
    found = materialize(pairs.join(most, F.col("a") == F.col("__id")).select("a", "b", "n", (F.col("n") == F.col("__most")).alias("best")), "alignment-counts")
    discard(pairs)
    return found


def align(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text", hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """``docs`` without the text, with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 (see the module).

    Texts are encoded once; what is stored of them are their pairs of ids.
    """
    spark = docs.sparkSession
    stored = _aligned(docs, a_path, b_path, text_col, "groups_sha256")
    keep = [c for c in stored.columns if not c.startswith("__")]
    stored = materialize(stored.withColumn("__row", F.monotonically_increasing_id()), "alignment")  # numbers are kept from here on
    pairs = pair_counts(stored)
    total = pairs.agg(F.sum("n")).first()[0] or 0
    hot = pairs.filter(F.col("n") * hot_pairs >= total).toArrow()  # hot_pairs rows at most: their n sum up to total
    code = (hot["a"].to_numpy().astype(np.int64) << 32) | hot["b"].to_numpy()
    order = np.argsort(code)
    sent = [spark.sparkContext.broadcast(np.ascontiguousarray(x[order])) for x in (code, hot["n"].to_numpy(), hot["best"].to_numpy().astype(np.int64))]
    schema = T.StructType([*(stored.schema[c] for c in (*keep, "__row")), *T.StructType.fromDDL("__best long, __sum long, __rest array<struct<a: int, b: int, times: bigint>>")])
    looked = stored.select(*keep, "__row", "__a", "__b", "__times").mapInArrow(functools.partial(_look_up, codes=sent[0], counts=sent[1], best=sent[2], n_keep=len(keep) + 1, names=[f.name for f in schema]), schema)
    rare = looked.select("__row", F.explode("__rest").alias("p")).select("__row", "p.*").join(pairs, ["a", "b"])
    rare = rare.groupBy(F.col("__row").alias("__of")).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("__more_best"), F.sum(F.col("times") * F.col("n")).alias("__more"))
    joined = looked.join(rare, F.col("__row") == F.col("__of"), "left")
    sums = {"n_best": F.col("__best") + F.coalesce("__more_best", F.lit(0)), "count_sum": F.col("__sum") + F.coalesce("__more", F.lit(0))}
    found = materialize(joined.select(*keep, *(c.alias(name) for name, c in sums.items())), "alignment-result")
    discard(stored)
    discard(pairs)
    return found
