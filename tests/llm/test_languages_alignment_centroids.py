"""op11, op12 and op13 against brute force."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import alignment, centroids, languages
from tidemark.llm.token_counts import byte_letters

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


# language identification


def enumerate_chain(e, t, start):
    """Posteriors of one sequence by going through all its paths."""
    out = np.zeros(e.shape)
    for path in itertools.product(range(e.shape[1]), repeat=len(e)):
        z = start[path[0]] + sum(e[k, s] for k, s in enumerate(path)) + sum(t[a, b] for a, b in itertools.pairwise(path))
        for k, s in enumerate(path):
            out[k, s] += math.exp(z)
    return out / out.sum(axis=1, keepdims=True)


def test_forward_backward_is_that_of_all_paths(monkeypatch):
    monkeypatch.setattr(languages, "LANE", 3)
    monkeypatch.setattr(languages, "LANES", 2)
    rng = np.random.default_rng(4)
    t, start = rng.normal(size=(3, 3)) * 2, rng.normal(size=3)
    lengths = np.array([1, 0, 8, 3, 4, 7, 6, 0])
    e = rng.normal(size=(lengths.sum(), 3)) * 3
    factors = np.exp(e - e.max(axis=1, keepdims=True))
    sums, state = languages.Chain(t, start).run(factors, lengths)
    ends = np.cumsum(lengths)
    for k, n in enumerate(lengths):
        own = e[ends[k] - n : ends[k]]
        if n:
            want = enumerate_chain(own, t, start)
            assert np.allclose(sums[k], want.sum(axis=0)) and (state[ends[k] - n : ends[k]] == want.argmax(axis=1)).all()
            assert np.allclose(languages.chain(own[None], t, start)[0][0], want)
        else:
            assert not sums[k].any()


def test_a_long_chain_neither_vanishes_nor_overflows():
    rng = np.random.default_rng(1)
    e = np.exp(rng.normal(size=(200_000, 4)) * 9)
    e /= e.max(axis=1, keepdims=True)
    sums, _ = languages.Chain(np.eye(4) * 7, np.zeros(4)).run(e, np.array([150_000, 50_000]))
    assert np.isfinite(sums).all() and np.allclose(sums.sum(axis=1), [150_000, 50_000])


def test_expected_transitions_are_the_slope_of_log_z():
    rng = np.random.default_rng(2)
    e, t, start = rng.normal(size=(2, 5, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    _, crossed, z = languages.chain(e, t, start)
    for i, j in itertools.product(range(3), repeat=2):
        moved = t.copy()
        moved[i, j] += 1e-6
        assert abs((languages.chain(e, moved, start)[2] - z) / 1e-6 - crossed[i, j]) < 1e-4


VOICES = {"xx": ["ba", "bo", "ka", "lan", "tir"], "yy": ["sch", "ung", "heit", "ver"], "zz": ["ção", "ñe", "los", "ría"]}


def speak(rng, lang, n):
    return " ".join("".join(rng.choice(VOICES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(7)
    rows = [(k, speak(rng, (lang := rng.choice(list(VOICES))), rng.randint(3, 60)), lang) for k in range(300)]
    rows += [(900, None, "xx"), (901, "12 34 ²½!", "xx"), (902, "", "yy"), (903, speak(rng, "zz", 9000), "zz"), (None, speak(rng, "yy", 5), None), (5, rows[5][1], rows[5][2]), (904, "ß" * 50_000, "")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("x") for c in ("score", "held_out", "n", "kind", "n_words")})


def test_texts_and_words_get_their_language(spark, spoken):
    model = languages.fit(spoken)
    assert model.langs == ["xx", "yy", "zz"] and (np.diag(model.transitions) > model.transitions.mean()).all()
    rows = languages.label(spoken, model).collect()
    assert len(rows) == 307
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 3 == 1)
        if r.doc_id in (900, 901, 902):
            assert (r.lang_pred, r.score, r.n_words) == ("und", 0.0, 0)
        else:
            assert r.lang_pred in model.langs and 1 / 3 <= r.score <= 1
    known = [r for r in rows if r.lang and r.doc_id not in (900, 901, 902, 904)]
    assert sum(r.lang_pred == r.lang for r in known) >= 0.99 * len(known)
    # code-switched text, word by word
    rng, parts = random.Random(3), []
    for k in range(12):
        parts.append((("xx", "yy", "zz")[k % 3], speak(rng, ("xx", "yy", "zz")[k % 3], 12)))
    mixed = spark.createDataFrame([(1, ", ".join(p for _, p in parts))], "doc_id long, text string")
    row = languages.label(mixed, model, spans=True).first()
    at, right, total = 0, 0, 0
    for lang, p in parts:
        for i in range(at, at + len(p)):
            total += 1
            right += any(s.start <= i < s.end and s.lang == lang for s in row.spans)
        at += len(p) + 2
    assert right / total > 0.93 and row.n_switches == len(row.spans) - 1 >= 9


def test_nothing_to_learn_from(spark, spoken):
    assert {r.lang_pred for r in languages.label(spoken, languages.fit(spoken.filter("false"))).collect()} == {"und"}
    one = languages.fit(spoken.filter("lang = 'yy'"))
    assert {(r.lang_pred, r.score) for r in languages.label(spoken, one).collect()} == {("und", 0.0), ("yy", 1.0)}
    assert languages.label(spoken.filter("false"), one).count() == 0


# alignment


def brute(text, a, b, a_bytes, b_bytes):
    """Groups as lists of ids, by the sets of both sides' ends."""
    if not text:
        return []
    x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    data = (" " + text).encode()
    if b"".join(a_bytes[i] for i in x) != data or b"".join(b_bytes[i] for i in y) != data:
        return []
    ends = lambda ids, known: list(itertools.accumulate(len(known[i]) for i in ids))
    ex, ey = ends(x, a_bytes), ends(y, b_bytes)
    groups, p, q = [], 0, 0
    for cut in sorted(set(ex) & set(ey)):
        r, s = ex.index(cut, p) + 1, ey.index(cut, q) + 1
        groups.append((x[p:r], y[q:s]))
        p, q = r, s
    return groups


MORE = ["a▁b c", " lead", "trail ", "a  b   c", "a\n b \n\nc\td", "x\x1cy \x1c z \x1d", "non breaking space here", "<s> </s> <|endoftext|> a<|endoftext|>b", "naïve café ﬁ ½ İstanbul ΑΣ", "👩‍👩‍👧 🙂 x", "don't can't WE'LL 12345 3.14", "ab" * 3000, "́ combining", " ", "\n", "　全角　スペース"]


@pytest.mark.parametrize("hot", [1 << 18, 20, 0])
def test_alignment(spark, odd, hot):
    more = spark.createDataFrame([(1000 + k, t) for k, t in enumerate(MORE)], "doc_id long, text string")
    both = odd.unionByName(more, allowMissingColumns=True)
    a, b = Tokenizer.from_file(public_tokenizers.path(A)), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(B))
    a.encode_special_tokens = True
    letters = byte_letters()
    a_bytes = {i: bytes(letters[c] for c in t) for t, i in a.get_vocab().items() if t != "<|endoftext|>"}
    b_bytes = [bytes([int(p[1:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in range(b.get_piece_size()))]
    rows = [(r.doc_id, brute(r.text, a, b, a_bytes, b_bytes)) for r in both.select("doc_id", "text").collect()]
    links = [collections.Counter(p for x, y in groups for p in itertools.product(x, y)) for _, groups in rows]
    n = collections.Counter(p for own in links for p in own)
    most = collections.defaultdict(int)
    for (x, _), c in n.items():
        most[x] = max(most[x], c)
    want = []
    for (doc, groups), own in zip(rows, links, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        want.append((doc, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(own.values()), sum(k for p, k in own.items() if n[p] == most[p[0]]),
                     sum(k * n[p] for p, k in own.items()), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    got = alignment.align(both, public_tokenizers.path(A), public_tokenizers.path(B), hot_pairs=hot)
    assert got.columns[:2] == ["doc_id", "lang"] and "score" in got.columns
    order = lambda r: (str(r[0]), r)
    names = ("doc_id", *alignment.RESULTS)
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=order) == sorted(want, key=order)


def test_alignment_shows_groups(spark, empty):
    shown = alignment.token_groups(spark.createDataFrame([(1, "ab cd"), (2, None)], "doc_id long, text string"), public_tokenizers.path(A), public_tokenizers.path(B)).collect()
    assert shown[0].groups.count(";") == shown[0].n_groups - 1 and shown[1].groups == ""
    assert alignment.align(empty, public_tokenizers.path(A), public_tokenizers.path(B)).count() == 0


def test_a_large_group_is_counted_by_distinct_ids(monkeypatch):
    own = alignment.aligner(public_tokenizers.path(A), public_tokenizers.path(B))
    args = [np.array(x, np.int64) for x in ([1, 1, 2, 9], [5, 5, 6, 7, 7, 7], [0, 3], [3, 4], [0, 4], [4, 6], [12, 2])]
    plain = own._pairs(*args)
    monkeypatch.setattr(alignment, "LARGE_GROUP", 3)
    code, times, of = own._pairs(*args)
    sums = [collections.Counter(), collections.Counter()]
    for total, found in zip(sums, (plain, (code, times, of)), strict=True):
        for c, n, g in zip(*(x.tolist() for x in found), strict=True):
            total[c, g] += n
    assert sums[0] == sums[1] and len(code) < len(plain[0]) and (np.diff(of) >= 0).all()


# centroids


def kmeans(rows, k, rounds, dim):
    rows = sorted(((i, v) for i, v in rows), key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    data = [(i, [math.floor(1024 * x) if abs(x) < 1e300 else 1024 * int(x) for x in v]) for i, v in rows]
    c = [v for _, v in data[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), n) for n, m in enumerate(c))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in data]
        c = [[sum(x) // len(part) for x in zip(*part, strict=True)] if (part := [v for (_, v), o in zip(data, own, strict=True) if o == n]) else m for n, m in enumerate(c)]
    return [(i, *reversed(near(v))) for i, v in data], c


@pytest.mark.parametrize("seed,wide", [(1, False), (2, False), (3, True)])
def test_centroids(spark, seed, wide):
    rng = np.random.default_rng(seed)
    dim = 64
    rows = [(i, [float(x) for x in rng.normal(size=dim) * (i % 3 + 0.1)]) for i in range(300)] + [(i, [0.25] * dim) for i in range(300, 400)]
    if wide:
        rows += [(500, [9e7] * dim), (501, [-3e15, *[1.0] * 63]), (502, [1e307] * dim), (503, [1.7e308, *[-1.7e308] * 63])]
    rows += rows[:7]
    odd = [(600, None), (601, [1.0] * 63), (602, [1.0] * 65), (603, [None, *[1.0] * 63]), (604, [float("nan")] * dim), (605, [float("inf")] * dim), (606, []), (None, [1.0] * dim)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(5).withColumns({c: F.lit("x") for c in ("cluster", "v", "distance", "vector")})
    assigned, found = centroids.cluster(df)
    want, c = kmeans(rows, 8, 10, dim)
    assert found.tolist() == c
    cut = lambda x: min(x, centroids.LONGEST)
    assert sorted(map(tuple, assigned.collect())) == sorted((i, n, cut(d)) for i, n, d in want)
    for r in centroids.with_inertia(assigned, found).collect():
        assert r.cluster_inertia == cut(sum(cut(d) for _, n, d in want if n == r.cluster)) and r.inertia == cut(sum(cut(d) for _, _, d in want))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, c[r.cluster])).encode()).hexdigest()


def test_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assigned, found = centroids.cluster(spark.createDataFrame([], schema))
    assert assigned.count() == 0 and centroids.with_inertia(assigned, found).count() == 0
    assigned, found = centroids.cluster(spark.createDataFrame([(0, [1.0] * 64), (1, [2.0] * 64)], schema))
    assert sorted(r.distance for r in assigned.collect()) == [0, 0] and len(found) == 2


def test_bounds_spare_distances():
    rng = np.random.default_rng(5)
    c = np.concatenate([rng.integers(0, 50, (1, 64)) + 900 * np.repeat(np.eye(8)[k], 8)[None] for k in range(8)]).astype(np.int64)
    rows = (c[rng.integers(0, 8, 500)] + rng.integers(-9, 9, (500, 64))).astype(np.int64)
    found, best, looked = centroids.screen(rows, centroids.norms(rows), c)
    every = ((rows[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (found == every.argmin(axis=1)).all() and (best == every.min(axis=1)).all() and looked < 0.3 * every.size
