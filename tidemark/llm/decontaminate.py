"""Benchmark decontamination: CGK embedding, bit-sampling LSH over item-sized windows, exact edit verification.

Texts and benchmark items are sequences of words (runs of letters and digits, lower-cased). The CGK walk reads a
sequence from a start and goes on to the next word or stays, as a random bit of the step and the word says; two
sequences of small edit distance meet again soon after an edit, so their embeddings (the words read at each step) have
a small Hamming distance. A repetition samples a few steps; an item and a window fall together if the words read there
are equal. Every word of a text starts a window and, in the walks from the end, ends one. A window of an item's size
is embedded only as far as its samples still agree with some item, which gives the same matches as embedding it whole.
Walks and repetitions are as many as a recall of 0.9 needs where all the edits allowed are made (``tests/llm`` asserts it).

Before that, one look goes over the pairs of neighbouring words: a passage keeps all of an item's pairs but two for each
edit. Windows around which too few pairs are some item's can't match, and texts without other windows go no further.

Matches are verified exactly: the least number of word edits that turn the item into a passage of the text at that
place; at most ``EDITS`` of the item's words may be edited.

The benchmark goes to the tasks in slices of at most ``MOST_WORDS`` words, each with a pass over the texts, so what is
broadcast has a bound. A text is read whole by one task, without a shuffle.

Defined results: null texts, texts and items without words have no match; repeated documents each give their rows;
repeated items count once (by id, the least text); null ids of documents are kept, null ids of items left out; empty
tables give an empty one. Only the named columns are used, so clashing names of others don't matter.
"""

from __future__ import annotations

import functools
import itertools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import mix64, small_batches

#: Share of an item's words that may be edited; walks in each direction; repetitions of each walk; samples of each.
EDITS, WALKS, REPEATS, SAMPLES = 0.2, 1, 12, 4
#: Steps among which a repetition's first sample lies, and words of a slice of the benchmark at most.
FIRST_STEPS, MOST_WORDS = 4, 2_000_000
#: Words of a text whose numbers a process remembers at most.
WORD_TABLE = 300_000
#: Slots of a repetition's table of pairs: 64 kB.
SLOT_BITS = 16
_WORD = re.compile(r"[^\W_]+")
#: ASCII letters and digits, lower-cased; other bytes are spaces.
_LOWER = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else 32 for b in range(256))
PAD = -1


def words_of(text: str | None) -> list[str]:
    if text and text.isascii():
        return text.encode().translate(_LOWER).decode().split()
    return _WORD.findall((text or "").lower())


def bits(hashes: np.ndarray, walk: int, block: int) -> np.ndarray:
    """The random bits of 64 steps for each word."""
    seed = (0x9E3779B97F4A7C15 * (2 * walk + 1) + 0xD1B54A32D192ED03 * (block + 1)) & 0xFFFFFFFFFFFFFFFF
    return mix64(hashes ^ np.uint64(seed))


def samples(walk: int, repeat: int, steps: int) -> list[int]:
    """A repetition's steps: the first two early, so that most windows are soon done with, the others anywhere."""
    rng = np.random.RandomState(1000 * walk + repeat)
    first = int(rng.randint(FIRST_STEPS))
    second = first + 1 + int(rng.randint(3))
    later = 3 + FIRST_STEPS + rng.permutation(200)
    return [first, second, *sorted(int(x) for x in [x for x in later if x < steps][: SAMPLES - 2])]


def fold(columns: list[np.ndarray]) -> np.ndarray:
    """One 64-bit key for each row of several columns."""
    key = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + c.astype(np.uint64))
    return key


def slots(pairs: np.ndarray) -> np.ndarray:
    return (pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - SLOT_BITS)).view(np.int64)


class Buckets:
    """The items by the words that they have at the sampled steps, and those words' keys."""

    def __init__(self, items: dict[tuple[int, ...], list[int]]):
        self.items = items
        self.folded = np.sort(fold([np.array(c, np.int64) for c in zip(*items, strict=True)]))


@dataclass
class Items:
    """A slice of the benchmark and the tables of all repetitions."""

    ids: list[int]
    words: list[list[str]]

    def __post_init__(self):
        self.number = {w: k + 1 for k, w in enumerate(dict.fromkeys(w for ws in self.words for w in ws))}
        self.rows = [np.array([self.number[w] for w in ws], np.int64) for ws in self.words]
        hashes = np.array([0, *(xxhash.xxh64_intdigest(w.encode()) for w in self.number)], np.uint64)
        size = len(self.number) + 1
        self.lengths = sorted({len(row) for row in self.rows})
        self.neighbours = np.unique(np.concatenate([np.empty(0, np.int64), *(row[:-1] * size + row[1:] for row in self.rows)]))
        self.plans = []  # backwards, walk, repetitions: (first, second, words at first, pairs, classes)
        for walk in range(2 * WALKS):
            back, plan = walk >= WALKS, []
            reads = {}
            for k, row in enumerate(self.rows):
                row = row[::-1] if back else row
                steps = self.steps(len(row))
                h, at, out = hashes[row], 0, []
                random = [bits(h, walk, b) for b in range(steps // 64 + 1)]
                for j in range(steps):
                    out.append(int(row[at]) if at < len(row) else PAD)
                    if at < len(row):
                        at += int(random[j // 64][at] >> np.uint64(j % 64)) & 1
                reads[k] = out
            for repeat in range(REPEATS):
                first, second = samples(walk, repeat, 0)[:2]
                early = np.zeros(size, bool)
                pairs, classes = set(), {}
                for k, out in reads.items():
                    steps = samples(walk, repeat, len(out))
                    if len(out) <= second:  # an item of a few words: its first word alone
                        classes.setdefault(("short",), {}).setdefault((out[0],), []).append(k)
                        continue
                    got = tuple(out[j] for j in steps)
                    if PAD in got:
                        continue
                    early[got[0]] = True
                    pairs.add(got[0] * size + got[1])
                    classes.setdefault(tuple(steps[2:]), {}).setdefault(got, []).append(k)
                classes = {k: v if k == ("short",) else Buckets(v) for k, v in classes.items()}
                plan.append((first, second, early, np.array(sorted(pairs), np.int64), classes))
            self.plans.append((back, walk, plan))

    @staticmethod
    def steps(n: int) -> int:
        """Steps of the walk over a window of the size class (a power of two) that has ``n`` words."""
        return max(1, 3 * (1 << (n.bit_length() - 1)) // 2)


def edit_match(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Least edits between ``item`` and a part of ``passage``, and where that part starts and ends (ties: the first)."""
    n = len(passage)
    across = np.arange(n + 1)
    cost, start = np.zeros(n + 1, np.int64), across.copy()
    for w in item:
        take = cost[:-1] + (passage != w)
        drop = cost + 1
        best, from_ = drop.copy(), start.copy()
        better = take <= drop[1:]
        best[1:][better], from_[1:][better] = take[better], start[:-1][better]
        # words of the passage that the item lacks: running minimum of cost less place
        level = best - across
        low = np.minimum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == low, across, 0))
        cost, start = low + across, from_[source]
    end = int(np.argmin(cost))
    return int(cost[end]), int(start[end]), end


class Matcher:
    def __init__(self, items: Items):
        self.items = items
        self.table: dict[str, int] = {}
        self.hashes = np.zeros(1024, np.uint64)
        self.filters: dict[int, np.ndarray] = {}
        self.seen = np.zeros(len(items.number) + 1, bool)

    def filter(self, pairs: np.ndarray) -> np.ndarray:
        """Whether some of the pairs has a slot."""
        if id(pairs) not in self.filters:  # the plans' own arrays, which live as long as this
            table = self.filters[id(pairs)] = np.zeros(1 << SLOT_BITS, bool)
            table[slots(pairs)] = True
        return self.filters[id(pairs)]

    def look_up(self, words: list[str]) -> np.ndarray:
        """Places of the words in ``hashes``."""
        table = self.table
        distinct = set(words)
        new = distinct.difference(table)
        if len(new) + len(table) > WORD_TABLE:
            table.clear()
            new = distinct
        for w in new:
            k = table[w] = len(table) + 1
            if k >= len(self.hashes):
                self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
            self.hashes[k] = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(table.__getitem__, words), np.int64, len(words))

    def known(self, pairs: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Which keys are among the pairs: few are, and most others are told by a table of fixed size."""
        maybe = np.flatnonzero(self.filter(pairs).take(slots(key)))
        some = key[maybe]
        return maybe[pairs[np.minimum(np.searchsorted(pairs, some), len(pairs) - 1)] == some]

    def possible(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a passage that matches() would accept may start, and where one may end, as matches() looks for it.

        Of an item's n - 1 pairs of neighbours an edit undoes two at most, so the part of the text that is verified holds
        n - 1 - 2 * edits places of such pairs.
        """
        total, size = len(ids), len(self.items.number) + 1
        allowed = [int(EDITS * n) for n in self.items.lengths]
        if any(n - 1 - 2 * a < 1 for n, a in zip(self.items.lengths, allowed, strict=True)):
            return np.ones(total, bool), np.ones(total, bool)
        at = np.flatnonzero((ids[:-1] != 0) & (ids[1:] != 0))
        places = at[self.known(self.items.neighbours, ids.take(at).astype(np.int64) * size + ids.take(at + 1))]
        changes = np.zeros((2, total + 1), np.int64)
        for n, a in zip(self.items.lengths, allowed, strict=True):
            least = n - 1 - 2 * a
            if len(places) < least:
                continue
            first, last = places[: len(places) - least + 1], places[least - 1 :]
            near = np.flatnonzero(last - first <= n + 4 * a)
            low, high = last[near] - n - 2 * a + 1, first[near] + 2 * a + 2
            for change, shift in zip(changes, (0, n - 1), strict=True):
                np.add.at(change, np.clip(low + shift, 0, total), 1)
                np.add.at(change, np.clip(high + shift, 0, total), -1)
        starts, ends = np.cumsum(changes, 1)[:, :-1] > 0
        return starts, ends

    def candidates(self, hashes: np.ndarray, ids: np.ndarray, ends: np.ndarray, may: np.ndarray, walk: int, plan) -> list[tuple[np.ndarray, list[int]]]:
        """Windows (their starts) and items that fall together in some repetition. ``ends``: a word past each text;
        ``may``: which windows are to be looked at."""
        out = []
        size = len(self.items.number) + 1
        random = {0: bits(hashes, walk, 0)}
        at = windows = np.flatnonzero(may)
        limits = ends.take(windows)
        states = [at]
        soon = random[0].astype(np.uint8)  # the bits of the first eight steps
        for j in range(FIRST_STEPS - 1):
            at = np.minimum(at + (soon.take(at) >> j & 1), limits)
            states.append(at)

        def go(at: np.ndarray, last: np.ndarray, j: int, to: int) -> np.ndarray:
            while j < to:
                if j < 8:
                    at = np.minimum(at + (soon.take(at) >> j & 1), last)
                    j += 1
                    continue
                if j // 64 not in random:
                    random[j // 64] = bits(hashes, walk, j // 64)
                at = np.minimum(at + (random[j // 64].take(at) >> np.uint64(j % 64) & np.uint64(1)).astype(np.int64), last)
                j += 1
            return at

        # one look for all repetitions of a walk whose first samples lie at the same step
        early_at = {}
        for j in {p[0] for p in plan}:
            marks = np.zeros(size, np.uint16)
            for k, p in enumerate(plan):
                if p[0] == j:
                    marks[p[2]] |= np.uint16(1 << k)
            early_at[j] = marks.take(ids.take(states[j]))
        shared = {}

        def at_first(first: int):
            """The windows that some repetition reads on at this first step: which, and places and words of four steps."""
            if first not in shared:
                live = np.flatnonzero(early_at[first])
                place, last = states[first].take(live), limits.take(live)
                steps = [(place, ids.take(place))]
                for j in range(first, max(p[1] for p in plan if p[0] == first)):
                    place = go(place, last, j, j + 1)
                    steps.append((place, ids.take(place)))
                shared[first] = windows.take(live), early_at[first].take(live), steps
            return shared[first]

        for k, (first, second, _, pairs, classes) in enumerate(plan):
            for got, keys_ in classes.get(("short",), {}).items():
                out.append((np.flatnonzero(may & (ids == got[0])), keys_))
            if not len(pairs):
                continue
            live, marks, steps = at_first(first)
            own = np.flatnonzero(marks & np.uint16(1 << k))
            places, words = steps[second - first]
            key = steps[0][1].take(own).astype(np.int64) * size + words.take(own)
            own = own[self.known(pairs, key)]
            live, place, read = live[own], places[own], [steps[0][1][own], words[own]]
            for later, buckets in classes.items():
                if later == ("short",) or not len(live):
                    continue
                p, j, got = place, second, list(read)
                for step in later:
                    p = go(p, ends[live], j, step)
                    j = step
                    got.append(ids[p])
                folded = fold(got)
                hit = np.flatnonzero(np.isin(folded, buckets.folded))
                hits: dict[tuple, list[int]] = {}
                for w, g in zip(live[hit].tolist(), zip(*(g[hit].tolist() for g in got), strict=True), strict=True):
                    if g in buckets.items:
                        hits.setdefault(g, []).append(w)
                out += [(np.array(ws), buckets.items[g]) for g, ws in hits.items()]
        return out

    def matches(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(text, item, first word, words, edits), the best match of each text and item."""
        each = [words_of(t) for t in texts]
        sizes = np.array([len(w) for w in each], np.int64)
        number = self.items.number.get
        # a word of no kind past each text
        ids = np.fromiter((k for ws in each for k in (*map(number, ws, itertools.repeat(0)), 0)), np.int32, int(sizes.sum()) + len(each))
        may_start, may_end = self.possible(ids)
        owner = np.repeat(np.arange(len(each)), sizes + 1)
        kept = np.unique(owner[may_start | may_end])
        if not len(kept) or not sizes[kept].sum():
            return []
        # the other texts go no further
        some = np.zeros(len(each), bool)
        some[kept] = True
        some = some.take(owner)
        ids, may_start, may_end = ids[some], may_start[some], may_end[some]
        each, sizes = [each[k] for k in kept.tolist()], sizes[kept]
        places = np.zeros(len(ids), np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])
        mask = np.ones(len(places), bool)
        mask[starts[1:] - 1] = False
        places[mask] = self.look_up([w for ws in each for w in ws])
        owner = np.repeat(np.arange(len(each)), sizes + 1)
        hashes = self.hashes.take(places)
        ends = (starts[1:] - 1).take(owner)
        total = len(ids)
        # for the walks from the end: the same texts the other way round
        turn = (starts[:-1] + starts[1:] - 2).take(owner) - np.arange(total)
        turn[starts[1:] - 1] = starts[1:] - 1
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        tried: set[tuple[int, int, int]] = set()
        for back, walk, plan in self.items.plans:
            found = self.candidates(*((hashes[turn], ids[turn], ends, may_end[turn]) if back else (hashes, ids, ends, may_start)), walk, plan)
            for windows, keys in found:
                for w in windows.tolist():
                    w = int(turn[w]) if back else w
                    text = int(owner[w])
                    for k in keys:
                        item = self.items.rows[k]
                        n = len(item)
                        allowed = int(EDITS * n)
                        begin = w - n + 1 if back else w
                        if (text, k, begin // (allowed + 1)) in tried:
                            continue
                        tried.add((text, k, begin // (allowed + 1)))
                        low = max(int(starts[text]), begin - 2 * allowed - 1)
                        high = min(int(ends[w]), begin + n + 2 * allowed + 1)
                        passage = ids[low:high]
                        self.seen[passage] = True
                        lacking = n - int(self.seen[item].sum())  # words that must be edited in any case
                        self.seen[passage] = False
                        if lacking > allowed:
                            continue
                        edits, a, b = edit_match(item, passage)
                        if edits <= allowed:
                            match = (edits, low + a - int(starts[text]), b - a)
                            if match < best.get((text, k), (1 << 30, 0, 0)):
                                best[text, k] = match
        return sorted((int(kept[t]), k, a, n, e) for (t, k), (e, a, n) in best.items())


_matchers: dict[str, Matcher] = {}


def matcher_of(ids: list[int], words: list[list[str]]) -> Matcher:
    """A process's matcher of a slice: its tables, and the words it has seen, serve all its tasks."""
    key = xxhash.xxh3_128_hexdigest(repr((ids, words)))
    if key not in _matchers:
        if len(_matchers) > 1:
            _matchers.clear()
        _matchers[key] = Matcher(Items(ids, words))
    return _matchers[key]


def _match(batches, ids: list[int], words: list[list[str]]):
    matcher = matcher_of(ids, words)
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("item_id", "start_word", "n_words", "edits"))])
    for batch in batches:
        docs = batch.column(0).to_pylist()
        rows = [(docs[t], ids[k], a, n, e) for t, k, a, n, e in matcher.matches(batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, start_word, n_words, edits: the best passage of each document and item within the edits allowed."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.filter(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).groupBy(F.col(item_col).cast("long").alias("id")).agg(F.min(item_text_col).alias("text"))
    out, ids, words, size = None, [], [], 0

    def add():
        nonlocal out
        found = texts.mapInArrow(functools.partial(_match, ids=list(ids), words=list(words)), "doc_id long, item_id long, start_word long, n_words long, edits long")
        out = found if out is None else out.unionByName(found)

    for r in items.orderBy("id").toLocalIterator():  # a slice at a time
        own = words_of(r.text)
        if own:
            ids.append(r.id)
            words.append(own)
            size += len(own)
        if size >= MOST_WORDS:
            add()
            ids, words, size = [], [], 0
    if ids or out is None:
        add()
    return out
