"""op4 and op9 against brute force."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import near_dedup, substring_dedup
from tidemark.llm.common import words_of
from tidemark.llm.graph import components


def brute(texts: dict[int, str | None], size: int) -> dict[int, int]:
    sets = {}
    for i, t in texts.items():
        w = words_of(t)
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("size", [2, 5])
def test_near_dedup(docs, texts, size):
    got = near_dedup.dedup(docs, size=size).collect()
    want = brute(dict(enumerate(texts)), size)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (want[r.doc_id] == r.doc_id) for r in got)


def test_near_dedup_group_whose_first_is_an_outlier(spark):
    """Most members aren't linked to the smallest id; links among them count all the same."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    base = [word() for _ in range(120)]
    texts = {}
    for i in range(60):
        own = list(base)
        for _ in range(28 if i == 0 else rng.choice([0, 2, 5, 9, 14, 20])):
            own[rng.randrange(len(own))] = word()
        texts[i] = " ".join(own)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.dedup(df, size=2).collect()} == brute(texts, 2)


def test_near_dedup_odd_and_empty(odd, empty):
    out = near_dedup.dedup(odd).collect()
    assert len(out) == odd.count()
    assert [(r.component_id, r.kept) for r in out if r.doc_id is None] == [(None, True)]
    assert near_dedup.dedup(empty).count() == 0


def test_bayes_tables():
    for n in (32, 64, 255):
        low, high = near_dedup.at_most(n, 0.8, 1e-6, True), near_dedup.at_most(n, 0.5, 1e-6, False)
        assert 0 < low < 0.8 * n and 0.5 * n < high <= n
    rng = np.random.default_rng(0)
    equal = rng.random((20000, 64)) < 0.8 + 0.2 / 256
    assert (equal.sum(1) <= near_dedup.at_most(64, 0.8, 1e-6, True)).mean() < 1e-3


def test_components(spark):
    edges = [(k + 1, k) for k in range(0, 30)] + [(100, 90), (90, 95), (None, 3), (5, 5), (200, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(31)} | {90: 90, 95: 90, 100: 90}


def test_nearest_smaller():
    rng = np.random.default_rng(5)
    for values in (rng.permutation(500), np.arange(50), np.arange(50)[::-1], np.empty(0, int)):
        want = [max((j for j in range(k) if values[j] < values[k]), default=-1) for k in range(len(values))]
        assert substring_dedup.nearest_smaller(values).tolist() == want


def test_compact_windows_are_all_stretches():
    """Each stretch of the least length of each text lies in the window whose key is made of its smallest shingles."""
    rng = np.random.default_rng(1)
    flat = near_dedup.mix64(rng.integers(0, 60, 200).astype(np.uint64))
    starts = np.array([0, 90, 95, 95, 200])
    for band in range(2):
        own, keys, *places = (c.tolist() for c in substring_dedup.compact_windows(flat, starts, 10, band))
        found = {(t, k): (x, y) for t, k, x, _, y in zip(own, keys, *places, strict=True)}
        assert len(found) == len(own)
        for t, (low, high) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
            for i in range(low, high - 9):
                key = np.array([band + 1], np.uint64)
                for f in (2 * band, 2 * band + 1):
                    hashed = (flat >> np.uint64(32 * (f % 2))).astype(np.uint32) * substring_dedup._FACTORS[f] + substring_dedup._TERMS[f]
                    key = near_dedup.mix64(key * np.uint64(0x9E3779B97F4A7C15) + flat[i + int(hashed[i : i + 10].argmin())])
                x, y = found[t, int(key.view(np.int64)[0])]
                assert x <= i - low and i + 9 - low <= y


def test_passages(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    shared = [[word() for _ in range(70)] for _ in range(3)]
    texts = []
    for i in range(30):
        own = [word() for _ in range(40)] + (shared[i % 3] if i < 24 else []) + [word() for _ in range(30)]
        if i in (3, 7):
            own[60] = word()
        texts.append((i, " ".join(own)))
    texts += [(30, None), (31, ""), (32, "short text"), (None, texts[0][1]), (33, " ".join(["the"] * 300)), (34, " ".join(["the"] * 200))]
    got = substring_dedup.find_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    found = {(r.doc_id, r.first_doc_id) for r in got}
    assert {a for a, _ in found} == {*range(3, 24), 34} and found >= {(i, i % 3) for i in range(3, 24)} | {(34, 33)}
    assert all(a % 3 == b % 3 for a, b in found if a < 24) and len(found) < 44
    for r in got:
        if r.doc_id < 24:
            assert r.start_word <= 40 and r.start_word + r.n_words >= 110 and r.n_words <= 80
    assert substring_dedup.find_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_passage_whose_keys_are_first_in_other_documents(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    fill = lambda n: [word() for _ in range(n)]
    texts = {}
    for k in range(0, 400, 20):
        parts = [fill(20) for _ in range(4)]
        for n, part in enumerate(parts):
            texts[k + n] = fill(40) + part + fill(40)
        for n in (10, 11, 12):
            texts[k + n] = fill(30) + sum(parts, []) + fill(30)
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "doc_id long, text string")
    got = {(r.doc_id, r.first_doc_id) for r in substring_dedup.find_passages(df).collect()}
    assert all(a // 20 == b // 20 and b % 20 >= 10 for a, b in got)
    assert {a for a, _ in got} == {k + n for k in range(0, 400, 20) for n in (11, 12)}


def test_copies_between_many_documents_that_hold_their_keys(spark):
    """A passage's keys come first, and again last before its copy, in documents that share 45 words of it, no passage."""
    rng = random.Random(44)
    fill = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    texts = {}
    for k in range(0, 1200, 40):
        passage = fill(52)
        for n in range(32):
            part = passage if n in (14, 30) else passage[n % 8 : n % 8 + 45]
            texts[k + n] = fill(30) + part + fill(30)
    df = spark.createDataFrame([(k, " ".join(v)) for k, v in texts.items()], "doc_id long, text string")
    got = {(r.doc_id, r.first_doc_id) for r in substring_dedup.find_passages(df).collect()}
    assert got == {(k + 30, k + 14) for k in range(0, 1200, 40)}


def test_holders_are_numbered_across_tasks(spark):
    rows = [(k, d, d % 9) for k in (1, 2, 3) for d in range(0, 900 if k == 2 else 30, k)]
    got = substring_dedup._holders(spark.createDataFrame(rows + rows, "key long, doc long, c int").repartition(6)).collect()
    assert sorted((r.key, r.doc, r.c, r["rank"]) for r in got) == [(k, d, c, d // k) for k, d, c in rows]


def test_dense_stretches():
    rng = np.random.default_rng(1)
    for n in (1, 9, 10, 60):
        for _ in range(40):
            known = rng.random(n) < rng.choice([0.6, 0.8, 0.9])
            want = np.zeros(n, bool)
            for x in range(n):
                for y in range(x + 10, n + 1):
                    if 100 * known[x:y].sum() >= substring_dedup.PERCENT * (y - x):
                        want[x:y] = True
            assert (substring_dedup.dense(known, 10) == want).all()


def windows_of(s: np.ndarray) -> dict[int, tuple[int, int, int]]:
    starts = np.array([0, len(s)])
    parts = [substring_dedup.compact_windows(s, starts, substring_dedup.LEAST_WORDS - substring_dedup.SHINGLE + 1, k) for k in range(substring_dedup.BANDS)]
    return {k: (x, c, y) for part in parts for _, k, x, c, y in zip(*(p.tolist() for p in part), strict=True)}


def test_share_of_passages_near_the_threshold_that_become_pairs():
    """Passages of 50 words that differ in one: a similarity of 0.804, and one window to match in."""
    rng = np.random.default_rng(3)
    length, caught = substring_dedup.LEAST_WORDS - substring_dedup.SHINGLE + 1, 0
    for _ in range(3000):
        a = rng.integers(0, 2**63, length, dtype=np.uint64)
        b = a.copy()
        b[20:25] = rng.integers(0, 2**63, 5, dtype=np.uint64)  # 41 of 51 shingles are shared
        x, y = windows_of(a), windows_of(b)
        rows = [{"l": x[k][0], "c": x[k][1], "r": x[k][2], "first_c": y[k][1]} for k in x.keys() & y.keys()]
        caught += bool(rows and substring_dedup.passages(a, b, rows))
    assert caught >= 0.975 * 3000


def test_copies_of_a_passage_after_a_text_that_half_shares_it(spark):
    """First a passage of 60 words with four words changed, then the passage itself, then a copy of that."""
    rng = random.Random(31)
    fill = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for k in range(300):
        passage = fill(60)
        half = list(passage)
        for at in (7, 22, 37, 52):
            half[at] = fill(1)[0]
        rows += [(3 * k + j, " ".join(fill(40) + p + fill(40))) for j, p in enumerate((half, passage, passage))]
    got = {(r.doc_id, r.first_doc_id) for r in substring_dedup.find_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(3 * k + 2, 3 * k + 1) for k in range(300)}


def test_passages_of_all_pairs(spark):
    """Random families of passages with edits, against all pairs of documents: each document that repeats is found."""
    rng = random.Random(17)
    fill = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    texts, owner = {}, {}
    for family in range(80):
        base = fill(rng.randint(50, 130))
        for _ in range(rng.randint(2, 5)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                own[rng.randrange(len(own))] = fill(1)[0]
            i = len(texts)
            texts[i], owner[i] = fill(rng.randint(0, 60)) + own + fill(rng.randint(0, 60)), (family, own)
    order = list(texts)
    rng.shuffle(order)
    ids = dict(zip(texts, order, strict=True))
    shingles = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    want = set()
    for i in texts:
        for j in texts:
            if ids[j] < ids[i] and owner[i][0] == owner[j][0]:
                a, b = shingles(owner[i][1]), shingles(owner[j][1])
                if 100 * len(a & b) >= 80 * len(a | b):
                    want.add(ids[i])
    rows = [(ids[i], " ".join(t)) for i, t in texts.items()]
    got = {r.doc_id for r in substring_dedup.find_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(want) > 80 and len(want & got) >= 0.97 * len(want)


def test_passage_with_a_long_insertion():
    rng = np.random.default_rng(8)
    words = rng.integers(0, 2**63, 90, dtype=np.uint64)
    longer = np.concatenate([words[:45], rng.integers(0, 2**63, 9, dtype=np.uint64), words[45:]])
    a, b = (near_dedup.shingle_hashes(w, substring_dedup.SHINGLE) for w in (words, longer))
    far = rng.integers(0, 2**63, 200, dtype=np.uint64)
    for x, y in ((a, b), (b, a), (np.concatenate([far, a, far]), np.concatenate([far[:9], b]))):
        rows = [{"l": 0, "c": 0, "r": len(x) - 1, "first_c": 0}]
        assert any(n >= 90 and m >= 90 and s >= 0.8 for _, n, _, m, s in substring_dedup.passages(x, y, rows))


def test_longest_part_of_a_chain():
    rng = random.Random(2)
    for _ in range(500):
        chain, i, j = [], 0, 0
        for _ in range(rng.randint(1, 8)):
            n = rng.randint(1, 60)
            chain.append((i, j, n))
            i, j = i + n + rng.randint(0, 12), j + n + rng.randint(0, 12)

        def fits(low: int, high: int) -> bool:
            c = chain[low:high]
            same, both = sum(x[2] for x in c), c[-1][0] + c[-1][1] + 2 * c[-1][2] - c[0][0] - c[0][1]
            return 100 * same >= substring_dedup.PERCENT * (both - same)

        want = max(chain[h - 1][0] + chain[h - 1][2] - chain[low][0] for low in range(len(chain)) for h in range(low + 1, len(chain) + 1) if fits(low, h))
        low, high = substring_dedup.longest(chain)
        assert fits(low, high) and chain[high - 1][0] + chain[high - 1][2] - chain[low][0] == want


def test_near_dedup_link_other_than_the_best_candidate(spark):
    """The last text looks nearer to the first (0.786) than to the second (0.802), and no band holds all three."""
    rng = random.Random(189)
    fill = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    a = fill(100)
    texts = {0: " ".join(a[12:] + fill(12)), 1: " ".join(a[:-11] + fill(11)), 2: " ".join(a)}
    signatures = np.stack([near_dedup.signature(near_dedup.shingle_set(t, 1)) for t in texts.values()])
    bands = near_dedup.band_keys(signatures)
    assert not (bands[0] == bands[1]).any() and (bands[0] == bands[2]).any() and (bands[1] == bands[2]).any()
    assert (signatures[0] == signatures[2]).sum() > (signatures[1] == signatures[2]).sum()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.dedup(df, size=1).collect()} == brute(texts, 1) == {0: 0, 1: 1, 2: 1}


def test_near_dedup_links_at_the_threshold(spark):
    """Of 101 words the last and the first 81: both are linked to the whole at 0.8 exactly, not to each other."""
    rng = random.Random(77)
    ids = list(range(1800))
    rng.shuffle(ids)
    rows = []
    for k in range(600):
        a = [f"w{rng.randrange(10**9)}" for _ in range(101)]
        rows += zip(ids[3 * k : 3 * k + 3], (" ".join(x) for x in (a, a[-81:], a[:81])), strict=True)
    got = {r.doc_id: r.component_id for r in near_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), size=2).collect()}
    assert [k for k in range(600) if {got[i] for i in ids[3 * k : 3 * k + 3]} != {min(ids[3 * k : 3 * k + 3])}] == []


def test_near_dedup_large_group_around_a_missing_text(spark):
    """Copies with one to six edits of a text that is not there; no document is linked to most of the others."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(6))
    base = [word() for _ in range(110)]
    texts = {}
    for i in range(260):
        own = list(base)
        for _ in range(rng.randint(1, 6)):
            own[rng.randrange(len(own))] = rng.choice(["x", "y", word()])
        texts[i] = " ".join(own)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_dedup.dedup(df).collect()} == brute(texts, 5)


def test_what_is_broadcast_for_passages_has_a_bound(spark, monkeypatch):
    """Only bitmaps and lists of tasks are broadcast, however small the other sides of joins are."""
    rng = random.Random(41)
    fill = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for k in range(40):
        passage = fill(60)
        half = list(passage)
        for at in (7, 22, 37, 52):
            half[at] = fill(1)[0]
        rows += [(6 * k + j, " ".join(fill(40) + p + fill(40))) for j, p in enumerate((half, passage, passage, half, passage))] + [(6 * k + 5, rows[-1][1] if rows else "")]
    plans, write = {}, substring_dedup.materialize

    def written(df, label):
        plans.setdefault(label, []).append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(substring_dedup, "materialize", written)
    out = substring_dedup.find_passages(spark.createDataFrame(rows, "doc_id long, text string"))
    plans["result"] = [out._jdf.queryExecution().executedPlan().toString()]
    assert out.count() and {"passage-found", "passage-more", "passage-new", "passage-open"} <= set(plans)
    for label, own in plans.items():
        for line in "\n".join(own).splitlines():
            if "BroadcastHashJoin" in line or "BroadcastNestedLoopJoin" in line:
                assert "__bucket" in line or "task#" in line, (label, line)


def test_texts_of_one_id_are_verified_each_by_itself(spark):
    rng = random.Random(43)
    fill = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    one, other = fill(70), fill(70)
    rows = [(1, fill(20) + one), (1, fill(30) + other), (2, one + fill(20)), (3, other + fill(20)), (4, fill(9) + one + fill(9) + other)]
    got = substring_dedup.find_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string")).collect()
    firsts = {(r.doc_id, r.start_word, r.n_words, r.first_start_word) for r in got if r.first_doc_id == 1}
    assert firsts == {(2, 0, 70, 20), (3, 0, 70, 30), (4, 9, 70, 20), (4, 88, 70, 30)}


def test_shingles_are_those_of_the_words(texts, monkeypatch):
    """Taken from the bytes of an Arrow column, in pieces, without a Python object for each word."""
    every = [*texts, None, *(" ".join(t.split(" ")[:60]).upper() for t in texts if t), "w " * 48 + "w", "\x00 \x00\x00 " * 40, "\x1c\x85\xa0 B\x0bc " * 30, "y" * 5000 + " z" * 60]
    for size in (1 << 18, 64):
        monkeypatch.setattr(substring_dedup, "_BYTES", size)
        flat, starts = substring_dedup.shingles_of_all(pa.array(["cut off " * 70, *every]).slice(1))
        names, seen = {}, set()
        assert len(starts) == len(every) + 1 and starts[-1] == len(flat)
        for k, t in enumerate(every):
            w = words_of(t)
            want = [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 50 else []
            got = flat[starts[k] : starts[k + 1]].tolist()
            assert len(got) == len(want) and all(names.setdefault(x, y) == y for x, y in zip(got, want, strict=True))
            seen |= set(want)
        assert len(names) == len(seen)
    assert substring_dedup.shingles_of_all(pa.array([], pa.string()))[1].tolist() == [0]


def test_lines_that_many_documents_have_make_no_pairs(spark, monkeypatch):
    """Only stretches whose shingles other documents have take part: not a common line, nor a text that repeats itself."""
    rng = random.Random(5)
    fill = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    line, shared = fill(20), fill(60)
    texts = [fill(40) + line + fill(40) for _ in range(80)] + [fill(60) * 4 + line for _ in range(4)]
    texts += [fill(30) + shared + fill(30) for _ in range(2)]
    pairs, write = [], substring_dedup.materialize

    def written(df, label):
        out = write(df, label)
        pairs.extend((r.doc, r.first) for r in (out.collect() if label == "passage-pairs" else ()))
        return out

    monkeypatch.setattr(substring_dedup, "materialize", written)
    got = substring_dedup.find_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.first_doc_id, r.start_word, r.n_words, r.first_start_word) for r in got] == [(85, 84, 30, 60, 30)]
    assert len(set(pairs)) == 1


def test_dense_stretches_of_shingles_that_come_again():
    """Of shingles that are not known, each place counts as its part of the one that any stretch of the set holds."""
    rng = np.random.default_rng(2)
    for _ in range(60):
        own = rng.integers(0, rng.choice([4, 12, 30]), 40)
        known = np.isin(own, rng.integers(0, 30, 20))
        _, at, n = np.unique(own, return_inverse=True, return_counts=True)
        inside = substring_dedup.dense(known, 10, n[at])
        for x in range(40):
            for y in range(x + 10, 41):
                if 100 * len(set(own[x:y][known[x:y]])) >= substring_dedup.PERCENT * len(set(own[x:y])):
                    assert inside[x:y].all()
    assert not substring_dedup.dense(np.zeros(240, bool), 46, np.full(240, 4)).any()


def test_passages_within_wider_ones_are_left_out(spark):
    rows = [(9, 3, 10, 90, 0, 90, 0.9), (9, 1, 20, 60, 5, 60, 0.8), (9, 2, 10, 90, 0, 90, 0.9), (9, 4, 70, 60, 0, 60, 0.9), (8, 1, 20, 60, 5, 60, 1.0)]
    names = ["doc_id", "first_doc_id", "start_word", "n_words", "first_start_word", "first_n_words", "similarity"]
    got = {tuple(r)[:4] for r in substring_dedup._widest(spark.createDataFrame(rows, names)).collect()}
    assert got == {(9, 2, 10, 90), (9, 4, 70, 60), (8, 1, 20, 60)}


def test_places_of_many_pairs_at_once():
    rng = np.random.RandomState(11)
    texts = [rng.randint(0, k, n).astype(np.uint64) for k, n in ((10**6, 200), (30, 150), (60, 46), (10**6, 45), (5, 300), (10**6, 90))]
    others = [np.sort(np.concatenate([x[: len(x) * 7 // 8], rng.randint(0, 10**6, 50).astype(np.uint64)])) for x in texts]
    others[0] = np.sort(texts[1])  # nothing in common
    got = substring_dedup.shared_places(texts, others)
    assert [len(x) for x in got] == [len(x) for x in texts] and not got[0].any() and not got[3].any() and got[5].any()
    for x, y, inside in zip(texts, others, got, strict=True):
        _, at, n = np.unique(x, return_inverse=True, return_counts=True)
        want = substring_dedup.dense(np.isin(x, y), 46, n[at])
        assert inside[want].all() and (n.max() > 1 or (inside == want).all())


def test_pairs_without_a_dense_stretch_are_not_aligned(monkeypatch):
    rng = np.random.RandomState(12)
    a, line = rng.randint(0, 2**62, 300).astype(np.uint64), rng.randint(0, 2**62, 60).astype(np.uint64)
    b, c = a.copy(), rng.randint(0, 2**62, 300).astype(np.uint64)
    a[50:80], a[200:230], c[50:80], c[200:230] = line[:30], line[30:], line[:30], line[30:]  # two lines are all that a and c share
    asked = []
    monkeypatch.setattr(substring_dedup, "stretches", lambda *x, f=substring_dedup.stretches: asked.append(1) or f(*x))
    rows = [{"l": 0, "c": 60, "r": 299, "first_c": 60}]
    columns = {"doc": [2, 2], "first": [1, 0], "rows": [rows, rows], "low": [0, 0], "s": [a.tobytes()] * 2, "first_s": [c.tobytes(), b.tobytes()]}
    row = pa.struct([(x, pa.int32()) for x in ("l", "c", "r", "first_c")])
    types = [pa.int64(), pa.int64(), pa.list_(row), pa.int32(), pa.binary(), pa.binary()]
    batch = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns.values(), types, strict=True)], list(columns))
    (out,) = substring_dedup._verify([batch])
    assert out.column("first_doc_id").to_pylist() == [0] * out.num_rows and out.num_rows and len(asked) == 1
