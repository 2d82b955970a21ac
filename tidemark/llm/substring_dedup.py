"""Near-duplicate passages by compact windows.

A document is the sequence of its shingles of five words. For a hash function, all stretches of at least the least
length whose smallest hash lies at the same place form one compact window: that place, and how far to the left and to
the right no smaller hash comes (the node of a Cartesian tree and its subtree's extent). A band's windows are the parts
that those of two functions share around a stretch of the least length, with both smallest shingles as the key: 4n / length for a document of n shingles.
Two passages of similarity J have the same two smallest shingles, and so lie in two windows with one key, with a
probability of J * J for each band.

Only regions take part: stretches in which enough shingles are such that several documents have. A passage lies in a
region on either side, so this loses none; regions are numbered in the order of their documents' ids and are what
``doc`` and ``first`` mean below. Which shingles several documents have is told from 42 bits of their hashes, packed
and sorted by their first ten.

The windows of a key are joined to that of its first region. Windows that no passage found so covers are then joined to
the last region before theirs that has the key too: keys of a passage may have first documents that lack the rest of
it. For each pair of documents the windows' intervals are put together and verified:
stretches of equal shingles on one diagonal are chained across gaps that what matches could make up for, and a chain is
a passage if it has at least ``LEAST_WORDS`` words and its two sides' sets of shingles a similarity of at least
``PERCENT``; else its longest part whose stretches make up for the gaps between them is tried, and what lies on either
side of that.

The rest loses no document either: what is still open then goes on to all earlier documents that have its key, each round
eight times as far back, until it is covered or none is left. Only windows whose place lies in a stretch whose shingles
other windows of the key have, too, take part; no other can hold a passage with one of these.

Equal texts are a class, which its smallest id stands for; each copy has one passage, the whole text, of that document.
Passages are those that two documents have; one that a document repeats within itself alone is not looked for. A
covered window goes no further, and a passage within a wider one of its region is no row of its own, so a passage that
n documents share gives a few rows for each but the first; what nothing covers is compared with all that have its key. No key's windows are gathered in one task.

Defined results: null texts and texts of fewer than ``LEAST_WORDS`` words have no passages; rows that share an id count
as one document, each text by itself; null ids take no part; an empty table gives an empty one. Only the id and text
columns are used, so clashing names of others don't matter.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import MARK_BITS, Marks, bit_marks, discard, materialize, mix64, shingle_hashes, small_batches, with_mark

#: Words of a shingle and of a passage at least, percent of the union that a passage's sides share.
SHINGLE, LEAST_WORDS, PERCENT = 5, 50, 80
#: Bands and the hash functions of each: equal passages agree in all bands, at J = 0.8 a passage with one window to match
#: in is missed with a probability of (1 - 0.8**2)**4 = 0.017.
BANDS, IN_BAND = 4, 2
FUNCTIONS = BANDS * IN_BAND
#: Each round of the rest reaches this many times as far back.
GROWTH = 8
_PART = 1 << 19
#: Bits of a shingle's hash by which shingles of several texts are told, of which 32 are written and the others make a
#: bucket; bits of a bucket's part of the bitmap; shingles that a task packs at a time.
_KEPT, _SLICE, _PACKED = 42, MARK_BITS - 10, 1 << 22
#: Bytes of text whose words are hashed at a time; what words are made of.
_BYTES = 1 << 18
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_LOWER = np.arange(256, dtype=np.uint8) + np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), 32, 0).astype(np.uint8)
_RANDOM = np.random.RandomState(23)
_FACTORS = (_RANDOM.randint(0, 2**31, FUNCTIONS, dtype=np.int64) * 2 + 1).astype(np.uint32)
_TERMS = _RANDOM.randint(0, 2**32, FUNCTIONS, dtype=np.uint64).astype(np.uint32)


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """For each of some distinct values in a row the number of the nearest smaller one to the left, or -1.

    This is the Cartesian tree, made by pointer jumping: what lies between a value and where its pointer stands is
    larger, so the pointer may go on to where the pointer there stands.
    """
    left = np.arange(-1, len(values) - 1)
    open_ = np.flatnonzero(left >= 0)
    open_ = open_[values[left[open_]] > values[open_]]
    while len(open_):
        left[open_] = left[left[open_]]
        open_ = open_[left[open_] >= 0]
        open_ = open_[values[left[open_]] > values[open_]]
    return left


def minima(shingles: np.ndarray, length: int, function: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the smallest hashes of all stretches of ``length``: each stretch's number among them, and the places
    with how far left and right no smaller hash comes."""
    n = len(shingles)
    hashed = (shingles >> np.uint64(32 * (function % 2))).astype(np.uint32) * _FACTORS[function] + _TERMS[function]
    low, span = hashed.astype(np.uint64) << np.uint64(32) | np.arange(n, dtype=np.uint64), 1  # ties go to the left
    while 2 * span <= length:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < length:
        low = np.minimum(low[: len(low) - (length - span)], low[length - span :])
    # the smallest place of a sliding stretch never comes back once it has gone
    new = np.concatenate([[True], low[1:] != low[:-1]])
    own = low[new]
    places = (own & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # the nearest smaller value on either side of such a place is such a place itself
    bound = np.concatenate([places, [-1]])
    left = bound[nearest_smaller(own)] + 1
    back = nearest_smaller(own[::-1])
    right = np.where(back >= 0, places[::-1][back], n)[::-1] - 1
    return np.cumsum(new) - 1, places, left, right


def compact_windows(shingles: np.ndarray, starts: np.ndarray, length: int, band: int) -> list[np.ndarray]:
    """Numbers of texts, keys, lefts, places and rights of a band's windows, one for each text and key.

    ``shingles`` holds those of several texts in a row, ``starts`` where each begins and the last ends. A band's
    windows are the parts that compact windows of all its functions share; lefts to rights are places in the text.
    """
    out = []
    for base in range(0, max(1, len(shingles) - length + 1), _PART):
        part = shingles[base : base + _PART + length - 1]
        if len(part) < length:
            break
        at = np.arange(base, base + len(part) - length + 1)
        text = np.searchsorted(starts, at, "right") - 1
        whole = at + length <= starts[text + 1]  # stretches that lie in one text
        changes, key, left, right = np.concatenate([[True], text[1:] != text[:-1]]), np.full(len(at), np.uint64(band + 1)), None, None
        for f in range(band * IN_BAND, (band + 1) * IN_BAND):
            number, places, l, r = minima(part, length, f)
            changes |= np.concatenate([[True], number[1:] != number[:-1]])
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + part[places][number])
            left, right = (l[number], r[number]) if left is None else (np.maximum(left, l[number]), np.minimum(right, r[number]))
            first = places[number] if f == band * IN_BAND else first
        pick = np.flatnonzero(changes & whole)
        own = text[pick]
        low, high = starts[own], starts[own + 1] - 1
        out.append((own, key[pick].view(np.int64), np.maximum(left[pick] + base, low) - low, first[pick] + base - low, np.minimum(right[pick] + base, high) - low))
    if not out:
        return [np.empty(0, np.int64)] * 5
    own, keys, lefts, places, rights = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.lexsort((places, keys, own))
    own, keys, lefts, places, rights = (x[order] for x in (own, keys, lefts, places, rights))
    head = np.flatnonzero(np.concatenate([np.ones(min(1, len(own)), bool), (own[1:] != own[:-1]) | (keys[1:] != keys[:-1])]))
    if not len(head):
        return [own, keys, lefts, places, rights]
    return [own[head], keys[head], np.minimum.reduceat(lefts, head), places[head], np.maximum.reduceat(rights, head)]


def hashed_words(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z lower-cased) of texts whose bytes stand in a row, and where each begins.

    ``starts`` tells where each text begins. A word's hash is made of the sum of a hash of each byte and its place in
    the word, so all words are hashed at once and none becomes a Python object.
    """
    inside = ~_SPACE[flat]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    begin[starts[starts < len(flat)]] = inside[starts[starts < len(flat)]]
    at = np.flatnonzero(begin)
    out, k = [], 0
    while k < len(at):
        # some words at a time, so that what is held for each byte stays small
        end = max(k + 1, int(np.searchsorted(at, at[k] + _BYTES)))
        low, high = at[k], at[end] if end < len(at) else len(flat)
        own = np.flatnonzero(inside[low:high]) + low
        heads = np.searchsorted(own, at[k:end])
        sizes = np.diff(heads, append=len(own))
        if end == k + 1 and sizes[0] > _BYTES:  # a word of this size by itself
            out.append(np.array([xxhash.xxh64_intdigest(_LOWER[flat[own]].tobytes())], np.uint64))
        else:
            places = np.arange(len(own), dtype=np.uint64) - np.repeat(heads.astype(np.uint64), sizes)
            sums = np.add.reduceat(mix64((places << np.uint64(8)) + _LOWER[flat[own]] + np.uint64(1)), heads)
            out.append(mix64(sums + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        k = end
    return np.concatenate(out) if out else np.empty(0, np.uint64), at


def shingles_of_all(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of several texts in a row, none of a text that is too short, and where each begins and the last ends."""
    texts = texts.fill_null("").cast(pa.binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    flat = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if bounds[-1] > bounds[0] else np.empty(0, np.uint8)
    bounds = bounds - bounds[0]
    words, at = hashed_words(flat, bounds[:-1])
    own = np.searchsorted(bounds, at, "right") - 1
    each = np.bincount(own, minlength=len(texts))
    words = words[each[own] >= LEAST_WORDS]
    each = np.where(each >= LEAST_WORDS, each, 0)
    ends = np.cumsum(each)
    whole = np.ones(len(words), bool)  # shingles that lie in one text
    for back in range(1, SHINGLE):
        whole[ends[ends >= back] - back] = False
    flat = shingle_hashes(words, SHINGLE)[whole[: max(0, len(whole) - SHINGLE + 1)]]
    return flat, np.concatenate([[0], np.cumsum(np.maximum(each - SHINGLE + 1, 0), dtype=np.int64)])


def _windows(batches):
    length = LEAST_WORDS - SHINGLE + 1
    for batch in batches:
        own = _sequences(batch.column(1))
        flat, starts = np.concatenate([*own, np.empty(0, np.uint64)]), np.cumsum([0, *map(len, own)])
        parts = [compact_windows(flat, starts, length, band) for band in range(BANDS)]
        own, keys, *places = (np.concatenate(x) for x in zip(*parts, strict=True))
        arrays = [pa.array(keys, pa.int64()), batch.column(0).take(pa.array(own, pa.int64())), *(pa.array(x.astype(np.int32)) for x in places)]
        yield pa.RecordBatch.from_arrays(arrays, ["key", "doc", "l", "c", "r"])


def regions(ends: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The stretches that the doc's windows, given by their lefts and rights, cover."""
    out: list[tuple[int, int]] = []
    for low, right in sorted(ends):
        high = right + 1
        if out and low <= out[-1][1]:
            out[-1] = out[-1][0], max(high, out[-1][1])
        else:
            out.append((low, high))
    return out


def stretches(a: np.ndarray, b: np.ndarray, order: np.ndarray, in_order: np.ndarray, diagonals: set[int], parts: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start in a, start in b, shingles) of equal stretches within ``parts`` of a: on given diagonals, and others.

    ``order`` sorts ``b``, stably, to ``in_order``.
    """
    found = []

    def runs(i: np.ndarray, j: np.ndarray) -> None:
        if len(i):
            heads = [0, *(np.flatnonzero((i[1:] - i[:-1] != 1) | (j[1:] - j[:-1] != 1)) + 1).tolist()]
            found.extend((int(i[x]), int(j[x]), y - x) for x, y in itertools.pairwise([*heads, len(i)]))

    for low, high in parts:
        i = np.arange(low, min(high, len(a)))
        at = np.minimum(np.searchsorted(in_order, a[i]), len(b) - 1)
        same = in_order[at] == a[i]
        runs(i[same], order[at[same]])
        if not _again(in_order, at[same]).any():  # each has one place in b, so these are all
            continue
        for d in diagonals:
            k = i[(i - d >= 0) & (i - d < len(b))]
            k = k[a[k] == b[k - d]]
            runs(k, k - d)
    return found


def _again(in_order: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether the values that stand at ``first`` for the first time come again in ``in_order``."""
    after = np.minimum(first + 1, len(in_order) - 1)
    return (after > first) & (in_order[after] == in_order[first])


def _distinct(values: np.ndarray) -> np.ndarray:
    """The different values, in order; not np.unique(), which is slower for as few as these."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])]


def _known(values: np.ndarray, in_order: np.ndarray) -> np.ndarray:
    """Which of ``values`` are in ``in_order``."""
    return in_order[np.minimum(np.searchsorted(in_order, values), len(in_order) - 1)] == values


def gaps(x: tuple[int, int, int], y: tuple[int, int, int]) -> tuple[int, int]:
    """Shingles between two stretches on either side."""
    return y[0] - x[0] - x[2], y[1] - x[1] - x[2]


def longest(chain: list[tuple[int, int, int]]) -> tuple[int, int]:
    """The longest part of a chain whose stretches have the share of all its shingles that a passage needs."""
    level, levels = 0, []  # before and after each stretch
    for k, c in enumerate(chain):
        start = level - PERCENT * sum(gaps(chain[k - 1], c)) if k else 0
        level = start + (100 - PERCENT) * c[2]
        levels.append((start, level))
    lows: list[int] = []  # starts that are lower than all before them
    for k, (start, _) in enumerate(levels):
        if not lows or start < levels[lows[-1]][0]:
            lows.append(k)
    best = (0, 0, 0)
    for k in range(len(chain) - 1, -1, -1):
        while lows and (lows[-1] > k or levels[lows[-1]][0] <= levels[k][1]):
            low = lows.pop()
            if low <= k:
                best = max(best, (chain[k][0] + chain[k][2] - chain[low][0], low, k + 1))
    return best[1:]


def passages(a: np.ndarray, b: np.ndarray, rows: list[dict]) -> list[tuple[int, int, int, int, float]]:
    """(start, words, start in b, words in b, similarity) of the passages that the sequences share."""
    order = np.argsort(b, kind="stable")
    in_order = b[order]
    return passages_within(a, b, order, in_order, {r["c"] - r["first_c"] for r in rows}, regions((r["l"], r["r"]) for r in rows), *shared_places([a], [in_order]))


def passages_within(a: np.ndarray, b: np.ndarray, order: np.ndarray, in_order: np.ndarray, diagonals: set[int], parts: list[tuple[int, int]], inside: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """passages() of windows on ``diagonals`` that cover ``parts`` of a; ``order`` sorts ``b``, stably, to ``in_order``.

    ``inside`` are the shared_places() of both.
    """
    found = sorted(set(stretches(a, b, order, in_order, diagonals, parts)))
    taken, picked = np.zeros(len(a), bool), []
    if all(x[0] + x[2] <= y[0] for x, y in itertools.pairwise(found)):
        found, picked = [], found  # none overlaps another
    for i, j, n in sorted(found, key=lambda x: (-x[2], x)):
        free = ~taken[i : i + n]
        if free.all():
            taken[i : i + n] = True
            picked.append((i, j, n))
        elif n > 1 and free.any():  # what a longer stretch has left of it
            k = np.flatnonzero(free)
            k = k[: int(np.argmax(np.diff(np.concatenate([k, [n + 2]])) != 1)) + 1]
            taken[i + k] = True
            picked.append((i + int(k[0]), j + int(k[0]), len(k)))
    # no more than the places of a that are known can be in both; where no shingle comes again, sides are as large as long
    upto = np.concatenate([[0], np.cumsum(_known(a, in_order))]).tolist()
    likely = np.concatenate([[0], np.cumsum(inside)]).tolist()
    a_once, b_once = len(_distinct(a)) == len(a), not (in_order[1:] == in_order[:-1]).any()
    out, chain = [], []

    def close() -> None:
        parts = [chain] if chain else []
        while parts:
            c = parts.pop()
            x, y = c[0][0], c[0][1]
            n, m = c[-1][0] + c[-1][2] - x, c[-1][1] + c[-1][2] - y
            if min(n, m, likely[x + n] - likely[x]) + SHINGLE - 1 < LEAST_WORDS:
                continue
            most = upto[x + n] - upto[x]
            if a_once and 100 * most < PERCENT * (n + m - most if b_once else n):
                both, all_ = 0, 1
            else:
                s, t = _distinct(a[x : x + n]), _distinct(b[y : y + m])
                both = int(_known(s, t).sum())
                all_ = len(s) + len(t) - both
            if 100 * both >= PERCENT * all_:
                out.append((x, n + SHINGLE - 1, y, m + SHINGLE - 1, both / all_))
            elif len(c) > 1:
                low, high = longest(c)
                if high - low == len(c):  # shingles that come again: at the widest gap
                    low, high = 0, max(range(1, len(c)), key=lambda k: max(gaps(c[k - 1], c[k])))
                parts += [p for p in (c[:low], c[low:high], c[high:]) if p]

    reach = sum(n for _, _, n in picked) * (100 - PERCENT) / PERCENT
    for i, j, n in sorted(picked):
        if chain and not all(0 <= g <= reach for g in gaps(chain[-1], (i, j, n))):
            close()
            chain = []
        chain.append((i, j, n))
    close()
    return sorted(out)


def _sequences(column: pa.Array) -> list[np.ndarray]:
    """The shingles of each row, read where Arrow holds them."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(column.buffers()[2], np.uint8) if ends[-1] > ends[0] else np.empty(0, np.uint8)
    return [flat[x:y].view(np.uint64) for x, y in itertools.pairwise(ends.tolist())]


def _verify(batches):
    names = ["doc_id", "first_doc_id", "start_word", "n_words", "first_start_word", "first_n_words", "similarity"]
    types = [*[pa.int64()] * 6, pa.float64()]
    length = LEAST_WORDS - SHINGLE + 1
    for batch in batches:
        rows, sorted_of, pairs = [], {}, []
        docs, firsts = (batch.column(c).to_pylist() for c in ("doc", "first"))
        lows = batch.column("low").to_pylist()  # where the part of the text begins that its windows lie in
        windows = batch.column("rows")
        ends = windows.offsets.to_pylist()
        lefts, places, rights, first_places = (windows.values.field(c).to_numpy().tolist() for c in ("l", "c", "r", "first_c"))
        for k, (a, b) in enumerate(zip(_sequences(batch.column("s")), _sequences(batch.column("first_s")), strict=True)):
            if min(len(a), len(b)) < length:
                continue
            # an id may have several texts: each is sorted once
            text = b.tobytes()
            if text not in sorted_of:
                order = np.argsort(b, kind="stable")
                sorted_of[text] = b, order, b[order]
            pairs.append((k, a, sorted_of[text]))
        # a passage lies in a stretch that is dense in the other's shingles; many pairs have none
        for (k, a, own), inside in zip(pairs, shared_places([p[1] for p in pairs], [p[2][2] for p in pairs]), strict=False):
            if inside.any():
                at, low = slice(ends[k], ends[k + 1]), lows[k]
                parts = [(x - low, y - low) for x, y in regions(zip(lefts[at], rights[at], strict=True))]
                diagonals = {x - low - y for x, y in zip(places[at], first_places[at], strict=True)}
                rows += [(docs[k], firsts[k], x + low, *p) for x, *p in passages_within(a, *own, diagonals, parts, inside)]
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _packed(sets: Iterable[np.ndarray]):
    """The different hashes of each of some arrays by their first bits, 32 bits each; those of several arrays twice."""
    held, n = [], 0

    def packed():
        all_ = np.sort(np.concatenate(held))
        keep = np.ones(len(all_), bool)
        keep[2:] = all_[2:] != all_[:-2]
        all_ = all_[keep]
        buckets = np.unique(all_ >> np.uint64(32))
        ends = np.searchsorted(all_, [*(buckets << np.uint64(32)), np.uint64(1 << _KEPT)])
        flat = all_.astype(np.uint32)
        return pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int32)), pa.array([flat[x:y].tobytes() for x, y in itertools.pairwise(ends.tolist())], pa.binary())], ["bucket", "packed"])

    for hashes in sets:
        held.append(np.unique(hashes >> np.uint64(64 - _KEPT)))
        n += len(held[-1])
        if n > _PACKED:
            yield packed()
            held, n = [], 0
    if n:
        yield packed()


def _packed_texts(batches):
    def sets():
        for batch in batches:
            flat, starts = shingles_of_all(batch.column(1))
            yield from (flat[x:y] for x, y in itertools.pairwise(starts.tolist()) if x < y)

    yield from _packed(sets())


def _with_key(shingles: np.ndarray, key: int) -> np.ndarray:
    return mix64(shingles ^ np.uint64(key & 0xFFFFFFFFFFFFFFFF))


def _packed_windows(batches):
    """Of regions and some of their windows, the pairs of a window's key and each of its shingles."""

    def sets():
        for batch in batches:
            for own, rows in zip(_sequences(batch.column("s")), batch.column("rows").to_pylist(), strict=True):
                yield from (_with_key(own[r["l"] : r["r"] + 1], r["key"]) for r in rows)

    yield from _packed(sets())


def _repeated(table: pa.Table) -> pa.Table:
    """The bits of those hashes of a bucket that come twice."""
    all_ = np.sort(np.frombuffer(b"".join(table.column("packed").to_pylist()), np.uint32))
    twice = all_[1:][all_[1:] == all_[:-1]].astype(np.uint64)
    bucket = table.column("bucket")[0].as_py()
    bits = np.zeros(1 << _SLICE, bool)
    bits[mix64(np.uint64(bucket << 32) | twice) & np.uint64((1 << _SLICE) - 1)] = True
    return pa.table({"bucket": pa.array([bucket], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


def marks_of_repeated(packed: DataFrame) -> Marks:
    """Marks of the hashes that several arrays of ``packed`` have, by _places(). What the driver gets is 16 MB at most."""
    slices = packed.groupBy("bucket").applyInArrow(_repeated, "bucket int, bits binary").toArrow()
    out = np.zeros((1 << (_KEPT - 32), 1 << (_SLICE - 6)), np.uint64)
    for bucket, bits in zip(slices.column("bucket").to_pylist(), slices.column("bits").to_pylist(), strict=True):
        out[bucket] = np.frombuffer(bits, np.uint64)
    return Marks(out.ravel())


def _places(flat: np.ndarray) -> np.ndarray:
    """Where the marks of hashes stand."""
    kept = flat >> np.uint64(64 - _KEPT)
    return (kept >> np.uint64(32)) << np.uint64(_SLICE) | mix64(kept) & np.uint64((1 << _SLICE) - 1)


def dense(known: np.ndarray, length: int, times: np.ndarray | None = None) -> np.ndarray:
    """The places that lie in some stretch of at least ``length`` of which ``PERCENT`` are known.

    ``times`` tells how often each shingle comes in its text: of those that are not known, which a stretch's set holds
    once, each place then counts as the part of one that is certain.
    """
    missing = PERCENT if times is None else PERCENT / times
    level = np.concatenate([[0], np.cumsum(np.where(known, 100 - PERCENT, -missing))])
    return _inside(np.round(level, 6), length)


def _inside(level: np.ndarray, length: int) -> np.ndarray:
    """The steps between two places, at least ``length`` apart, of which the second is no lower than the first."""
    most = np.maximum.accumulate(level[::-1])[::-1]
    ends = np.searchsorted(-most, -level, "right") - 1  # the last place that is no lower than the start
    starts = np.flatnonzero(ends - np.arange(len(level)) >= length)
    change = np.zeros(len(level), np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends[starts], -1)
    return np.cumsum(change)[:-1] > 0


def shared_places(sequences: list[np.ndarray], others: list[np.ndarray]) -> list[np.ndarray]:
    """For each of some sequences the places that a passage with a text of the ``others``' shingles, in order, can have.

    This is dense() for all at once: between two sequences the level falls by more than it can rise. Shares of what comes
    again are rounded down, so no place is left out.
    """
    sizes = np.array([len(x) for x in sequences], np.int64)
    own, flat = np.repeat(np.arange(len(sizes)), sizes), np.concatenate([*sequences, np.empty(0, np.uint64)])
    known = np.concatenate([*(_known(x, y) for x, y in zip(sequences, others, strict=True)), np.empty(0, bool)])
    _, at, n = np.unique(mix64(flat ^ mix64(own.astype(np.uint64) + np.uint64(1))), return_inverse=True, return_counts=True)
    steps = np.full(len(flat) + len(sizes), -(100 - PERCENT) * 1000 * (len(flat) + 1), np.int64)
    places = np.arange(len(flat)) + own
    steps[places] = np.where(known, (100 - PERCENT) * 1000, -(PERCENT * 1000 // n[at]))
    level = np.concatenate([[0], np.cumsum(steps)])
    return np.split(_inside(level, LEAST_WORDS - SHINGLE + 1)[places], np.cumsum(sizes)[:-1])


def _regions(batches, repeated):
    """id, start, s: the stretches of texts that a passage can lie in, with their shingles."""
    length = LEAST_WORDS - SHINGLE + 1
    for batch in batches:
        ids, own_of, begin, parts = batch.column(0), [], [], []
        flat, starts = shingles_of_all(batch.column(1))
        known = repeated.value.has_each(_places(flat))
        some = np.concatenate([[0], np.cumsum(known)])[starts]
        for k in np.flatnonzero(np.diff(some)):
            own, has = flat[starts[k] : starts[k + 1]], known[starts[k] : starts[k + 1]]
            if not dense(has, length, np.float64(len(own))).any():  # no shingle comes more often
                continue
            _, at, n = np.unique(own, return_inverse=True, return_counts=True)
            inside = np.diff(dense(has, length, n[at]).astype(np.int8), prepend=0, append=0)
            for x, y in zip(np.flatnonzero(inside > 0).tolist(), np.flatnonzero(inside < 0).tolist(), strict=True):
                own_of.append(k)
                begin.append(x)
                parts.append(own[x:y].tobytes())
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(own_of, pa.int64())), pa.array(begin, pa.int32()), pa.array(parts, pa.binary())], ["id", "start", "s"])


def _reaching(batches, repeated):
    names = ["key", "doc", "l", "c", "r", "rank"]
    types = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
    for batch in batches:
        out = []
        for doc, whole, rows in zip(batch.column("doc").to_pylist(), _sequences(batch.column("s")), batch.column("rows").to_pylist(), strict=True):
            for r in rows:
                own = whole[r["l"] : r["r"] + 1]
                known = repeated.value.has_each(_places(_with_key(own, r["key"])))
                _, at, n = np.unique(own, return_inverse=True, return_counts=True)
                if dense(known, LEAST_WORDS - SHINGLE + 1, n[at])[r["c"] - r["l"]]:
                    out.append((r["key"], doc, r["l"], r["c"], r["r"], r["rank"]))
        columns = list(zip(*out, strict=True)) or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def find_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, first_doc_id (smaller), start_word, n_words, first_start_word, first_n_words, similarity of passages."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).filter("doc is not null and text is not null")
    own, copies = _classes(texts)
    parts = _parts(own)
    windows = materialize(parts.select("doc", "s").mapInArrow(_windows, "key long, doc long, l int, c int, r int"), "passage-windows")
    repeated = windows.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").select("key", "first")
    windows = materialize(windows.hint("merge").join(repeated.hint("merge"), "key"), "passage-shared")
    firsts = windows.filter("doc = first").groupBy("key").agg(F.min("c").alias("first_c"))
    linked = windows.filter("doc > first").join(firsts.hint("merge"), "key")
    # pairs with two windows or more first; what they cover needs no other pair
    strong = linked.groupBy("doc", "first").agg(F.count("*").alias("n")).filter("n > 1").select("doc", "first")
    strong = materialize(strong, "passage-strong")
    found = materialize(_verified(linked.join(strong.hint("merge"), ["doc", "first"], "left_semi"), parts), "passage-found")
    open_ = materialize(_uncovered(linked, found), "passage-open")
    # the second way leads to the last region before; a pair's evidence are all its open windows, whichever way
    holders = _holders(windows.join(open_.select("key").distinct().hint("merge"), "key", "left_semi"))
    ranked = open_.join(holders.drop("c").hint("merge"), ["key", "doc"])
    again = _earlier(ranked, holders, 1, 1)
    # of strong pairs only the windows that lead to the first document have been looked at
    rest = open_.select(*linked.columns).join(strong.hint("merge"), ["doc", "first"], "left_anti")
    both = rest.unionByName(again.select(*rest.columns)).distinct()
    more = materialize(_verified(both, parts), "passage-more")
    out = found.unionByName(_new(more, found))
    # the rest: windows still open go on to the regions before, each time to more of them, until covered or none is left
    kept = materialize(_uncovered(ranked, more).filter("rank > 2"), "passage-left")
    if not kept.isEmpty():
        kept = materialize(_promising(kept, windows, parts), "passage-rest")
    nearest, most = 2, kept.agg(F.max("rank")).first()[0] or 0
    while nearest < most:
        tried = _earlier(kept, holders, nearest, nearest * GROWTH - 1).select(*linked.columns)
        more = materialize(_verified(tried, parts), "passage-more")
        out = out.unionByName(_new(more, out))
        nearest *= GROWTH
        kept = materialize(_uncovered(kept, more).filter(F.col("rank") > nearest), "passage-rest")
        most = kept.agg(F.max("rank")).first()[0] or 0
    for done in (windows, open_, strong):
        discard(done)
    return _placed(_widest(out), parts).unionByName(copies)


def _parts(texts: DataFrame) -> DataFrame:
    """doc, id, start, s: the regions of ``texts`` that can hold passages, numbered (doc) in the order of their ids.

    A passage's shingles are those of the other document but for a fifth of all, so it lies in a stretch in which
    enough shingles are such that several texts have. On both sides, so no other part of a text takes part.
    """
    packed = texts.select("doc", "text").mapInArrow(_packed_texts, "bucket int, packed binary")
    repeated = texts.sparkSession.sparkContext.broadcast(marks_of_repeated(packed))
    parts = materialize(texts.mapInArrow(functools.partial(_regions, repeated=repeated), "id long, start int, s binary"), "passage-regions")
    ordered = parts.repartitionByRange("id").sortWithinPartitions("id")
    numbered = materialize(ordered.select(F.monotonically_increasing_id().alias("doc"), "id", "start", "s"), "passage-parts")
    discard(parts)
    return numbered


def _widest(found: DataFrame) -> DataFrame:
    """The passages less those that lie within a wider one of their region, or in one as wide with an earlier region."""
    before = Window.partitionBy("doc_id").orderBy("start_word", F.desc("n_words"), "first_doc_id", "first_start_word").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start_word") + F.col("n_words")
    return found.withColumn("reached", F.max(end).over(before)).filter(F.coalesce("reached", F.lit(0)) < end).drop("reached")


def _placed(found: DataFrame, parts: DataFrame) -> DataFrame:
    """``found`` with the ids and places of the documents that its regions are of."""
    one, other = (parts.select(F.col("doc").alias(c), F.col("id").alias(f"{c}_of"), F.col("start").alias(f"{c}_at")) for c in ("doc_id", "first_doc_id"))
    full = found.hint("merge").join(one, "doc_id").hint("merge").join(other, "first_doc_id")
    moved = {"doc_id": F.col("doc_id_of"), "first_doc_id": F.col("first_doc_id_of"), "start_word": F.col("start_word") + F.col("doc_id_at"), "first_start_word": F.col("first_start_word") + F.col("first_doc_id_at")}
    return full.select(*(moved.get(c, F.col(c)).alias(c) for c in found.columns))


def _new(more: DataFrame, found: DataFrame) -> DataFrame:
    """The passages that have not been found before, written down: the next rounds compare with them, too."""
    return materialize(more.join(found.hint("merge"), found.columns, "left_anti"), "passage-new")


def _uncovered(windows: DataFrame, found: DataFrame) -> DataFrame:
    """The windows whose place lies in no passage that was found."""
    covers = found.select("doc_id", "start_word", (F.col("start_word") + F.col("n_words") - SHINGLE).alias("last_place"))
    return windows.join(covers.hint("merge"), (windows["doc"] == covers["doc_id"]) & windows["c"].between(F.col("start_word"), F.col("last_place")), "left_anti")


def _promising(left: DataFrame, windows: DataFrame, parts: DataFrame) -> DataFrame:
    """The windows whose place lies in a stretch in which enough shingles are such that others of their key have, too.

    A passage that gives two windows one key lies in both, with the places that made the key. No other window can hold
    one, so a short line that many documents have makes no pairs of all of them, and each window is looked at once for
    all that have its key. A bitmap of fixed size tells which shingles several windows of a key have.
    """
    keys = left.select("key").distinct().hint("merge")
    rows = windows.join(keys, "key", "left_semi").groupBy("doc").agg(F.collect_list(F.struct("key", "l", "r")).alias("rows"))
    packed = rows.hint("merge").join(parts.select("doc", "s"), "doc").mapInArrow(_packed_windows, "bucket int, packed binary")
    repeated = left.sparkSession.sparkContext.broadcast(marks_of_repeated(packed))
    own = left.groupBy("doc").agg(F.collect_list(F.struct("key", "l", "c", "r", "rank")).alias("rows"))
    own = own.hint("merge").join(parts.select("doc", "s"), "doc")
    return own.mapInArrow(functools.partial(_reaching, repeated=repeated), left.select("key", "doc", "l", "c", "r", "rank").schema)


def _earlier(ranked: DataFrame, holders: DataFrame, nearest: int, farthest: int) -> DataFrame:
    """``ranked`` windows with the regions before theirs that have the key, from the ``nearest`` to the ``farthest``;
    the first of all has been tried."""
    ranks = F.sequence(F.greatest(F.lit(1), F.col("rank") - farthest), F.col("rank") - nearest)
    each = ranked.filter(F.col("rank") > nearest).select("key", "doc", "l", "c", "r", F.explode(ranks).alias("rank"))
    return each.join(holders.select("key", "rank", F.col("doc").alias("first"), F.col("c").alias("first_c")).hint("merge"), ["key", "rank"])


def _classes(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The texts less the copies of a text that a smaller id has, and the copies as passages of that document.

    Which texts have a copy is told by a bitmap of fixed size; only these are moved.
    """
    digest = F.sha2(F.col("text"), 256)
    keyed = texts.select("doc", digest.alias("digest"))
    firsts = keyed.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).filter("first < last").select("digest", "first")
    firsts = materialize(firsts, "passage-copies")
    flagged = with_mark(texts.withColumn("digest", digest), "digest", bit_marks(firsts, "digest"))
    joined = flagged.filter("__marked").join(firsts.hint("merge"), "digest", "left")
    copied = F.col("first") < F.col("doc")
    rest = joined.filter(~F.coalesce(copied, F.lit(False))).select("doc", "text")
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0d]+")).cast("long")
    same = joined.filter(copied).select("doc", "first", words.alias("n")).filter(F.col("n") >= LEAST_WORDS).distinct()
    zero, whole = F.lit(0).cast("long"), F.col("n")
    passages_ = same.select(F.col("doc").alias("doc_id"), F.col("first").alias("first_doc_id"), zero.alias("start_word"), whole.alias("n_words"), zero.alias("first_start_word"), whole.alias("first_n_words"), F.lit(1.0).alias("similarity"))
    return flagged.filter("not __marked").select("doc", "text").unionByName(rest), materialize(passages_, "passage-same")


def _holders(windows: DataFrame) -> DataFrame:
    """key, doc, c, rank: the documents that have each key, numbered from 0 by their ids.

    Rows are in order across tasks, cut by key and document, so that a frequent key's are not in one task; a task goes
    on from how many rows of the key it begins with the tasks before have, of which there is a count each.
    """
    holders = windows.groupBy("key", "doc").agg(F.min("c").alias("c")).repartitionByRange("key", "doc").withColumn("task", F.spark_partition_id())
    holders = materialize(holders, "passage-holders")
    tasks = holders.groupBy("task").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    lasts = holders.join(F.broadcast(tasks.select("task", F.col("high").alias("key"))), ["task", "key"], "left_semi").groupBy("task", "key").agg(F.count("*").alias("n"))
    before = tasks.select("task", F.col("low").alias("key")).join(lasts.withColumnRenamed("task", "other"), "key").filter("other < task").groupBy("task", "key").agg(F.sum("n").alias("before"))
    own = F.row_number().over(Window.partitionBy("task", "key").orderBy("doc")) - 1
    ranked = holders.withColumn("own", own).join(F.broadcast(before), ["task", "key"], "left")
    return materialize(ranked.select("key", "doc", "c", (F.col("own") + F.coalesce("before", F.lit(0))).cast("int").alias("rank")), "passage-ranked")


def _verified(linked: DataFrame, parts: DataFrame) -> DataFrame:
    """The passages of the pairs of regions (doc, first) whose windows are ``linked``."""
    pairs = linked.groupBy("doc", "first").agg(F.collect_list(F.struct("l", "c", "r", "first_c")).alias("rows"), F.min("l").alias("low"), F.max("r").alias("high"))
    pairs = materialize(pairs, "passage-pairs")
    one, other = parts.alias("one"), parts.alias("other")
    # passages lie between the first and the last place of a pair's windows: no more of the text goes on with the pair
    part = F.expr("substring(s, 8 * low + 1, 8 * (high - low + 1))").alias("s")
    full = pairs.hint("merge").join(one, F.col("one.doc") == pairs["doc"]).select(pairs["doc"], F.col("one.id").alias("id"), "first", "rows", "low", part)
    full = full.hint("merge").join(other, (F.col("other.doc") == F.col("first")) & (F.col("other.id") < full["id"])).select(full["doc"], "first", "rows", "low", full["s"], F.col("other.s").alias("first_s"))
    return full.mapInArrow(_verify, "doc_id long, first_doc_id long, start_word long, n_words long, first_start_word long, first_n_words long, similarity double")
