"""op1 and op6 against the tokenizers library, whole texts and every prefix."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, token_counts

BYTE, RANKS, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"))


@pytest.mark.parametrize("chunk", [128, 1024])
def test_bpe_equals_library(docs, texts, chunk):
    library = Tokenizer.from_file(BYTE)
    got = bpe.decode(bpe.encode(docs, RANKS, chunk_bytes=chunk), RANKS).collect()
    assert len(got) == len(texts)
    for r in got:
        want = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(r.token_ids, "<u4").tolist() == want
        assert r.n_tokens == len(want)
        assert r.decoded == library.decode(want, skip_special_tokens=False)


def test_bpe_odd_and_empty(odd, empty):
    out = bpe.encode(odd, RANKS)
    assert out.count() == odd.count()
    assert out.columns.count("n_tokens") == 1
    assert bpe.encode(empty, RANKS).count() == 0


def test_joins_are_repaired():
    codec = bpe.codec(RANKS)
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice(["ab", " ", "\n", "é", "日", "'s", "12", "!!", "  "]) for _ in range(rng.randint(1, 400)))
        data = text.encode()
        ends = bpe.cuts(data, 64)
        known = {k: codec.encode(data[(ends[k - 1] if k else 0) : ends[k]]) for k in range(len(ends)) if rng.random() < 0.6}
        assert bpe.assemble(data, known, codec, 64).tolist() == codec.encode(data).tolist()


def test_counts_equal_library(docs, texts):
    library = Tokenizer.from_file(WORD)
    for r in token_counts.count_tokens(docs, WORD, limit=50).collect():
        text = texts[r.doc_id] or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(text.encode()), n > 50)
        assert len(library.encode(text[: r.n_chars_within], add_special_tokens=False).ids) <= 50


#: Decomposed and mixed scripts, special strings within words, contractions, marks that change places, Hangul jamo.
MIXED = [
    "か\u3099き\u3099くか\u3099x\u0301" * 6, "abc<|endoftext|>de\u0301f<|startoftext|><|endof" * 3, "e\u0301" * 40 + "'ll'll'r'", "x\u0323\u0301\u0328y" * 8,
    "\u1112\u1161\u11ab\u1100\u1173\u11af" * 7, "don't'll we're'v'" * 5, "\u0301\u0301a\u0308", "word" * 20 + "e\u0301word" * 9, "12e\u03013½\u0301" * 6, "日本e\u0301語<|endoftext|>" * 5,
]


def test_longest_prefix_within_a_limit(texts):
    library, counter = Tokenizer.from_file(WORD), token_counts.counter(WORD)
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    some = [t for t in texts if t and len(t) < 700] + MIXED + ["Cafe\u0301 noe\u0308l " * 9, "İstanbul'DA ǅ", "a<|endoftext|>bc<|endoftext|> d", "漢字かな" * 30 + " tail", "x\u2003y\u3000z"]
    for text in some:
        counts = [count(text[:j]) for j in range(len(text) + 1)]
        for limit in (0, 1, 2, 7, 20, 50):
            assert counter.within(text, limit) == max(j for j, n in enumerate(counts) if n <= limit), (text, limit)


def test_stored_tables_answer_any_limit(docs, texts):
    counter = token_counts.counter(WORD)
    rows = token_counts.prefix_tables(docs, WORD).select("doc_id", "prefix_tokens", token_counts.words_within(9).alias("n")).collect()
    for r in rows:
        assert (r.prefix_tokens or [0])[-1:] in ([], [counter.count(texts[r.doc_id] or "")]) and r.n == sum(x <= 9 for x in r.prefix_tokens)


def test_prefix_tables(texts):
    library, counter = Tokenizer.from_file(WORD), token_counts.counter(WORD)
    words = {w for t in texts[:20] for w in counter.words(t or "")} | {"internationalization", "aaaaaaa", "x1", "!!!???"}
    for w in words:
        assert list(counter.table(w)) == [len(library.encode(w[: k + 1], add_special_tokens=False).ids) for k in range(len(w))]


def test_counts_odd_and_empty(odd, empty):
    out = token_counts.count_tokens(odd, WORD)
    assert out.count() == odd.count()
    assert out.filter("doc_id is null").first().n_tokens == 2
    assert out.schema["n_tokens"].dataType.simpleString() == "bigint"
    assert token_counts.count_tokens(empty, WORD).select(F.sum("n_tokens")).first()[0] is None
