"""Texts of 20,000 words, of a megabyte, of one line, and a word of 100 kB, through every operator on documents."""

from __future__ import annotations

import random
import time

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.conftest import SF
from tests.llm.conftest import SCHEMA
from tidemark.llm import bpe, decontaminate, line_dedup, near_dedup, substring_dedup, token_counts, toxicity
from tidemark.llm.queries import table


@pytest.fixture(scope="module")
def long_texts():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    lines = "\n".join(" ".join(rng.choice(words) for _ in range(10)) for _ in range(2000))
    changed = lines.split(" ")
    for k in range(0, len(changed), 100):
        changed[k] = "other"
    return [lines, " ".join(changed), "w" * 100_000, " ".join(rng.choice(words) for _ in range(180_000)), "\n" * 50_000, "short one"]


@pytest.fixture(scope="module")
def long_docs(spark, long_texts):
    return spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(long_texts)], SCHEMA).repartition(3)


def test_tokens(long_docs, long_texts):
    byte, ranks, word = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "word_bpe_49k.json"))
    libraries = Tokenizer.from_file(byte), Tokenizer.from_file(word)
    for r in bpe.decode(bpe.encode(long_docs, ranks), ranks).collect():
        assert np.frombuffer(r.token_ids, "<u4").tolist() == libraries[0].encode(long_texts[r.doc_id], add_special_tokens=False).ids
        assert r.decoded == long_texts[r.doc_id]
    for r in token_counts.count_tokens(long_docs.select("doc_id", "text"), word).collect():
        assert r.n_tokens == len(libraries[1].encode(long_texts[r.doc_id], add_special_tokens=False).ids)


def test_near_copies(long_docs, long_texts):
    got = {r.doc_id: r for r in near_dedup.dedup(long_docs.select("doc_id", "text"), size=2).collect()}
    assert [got[k].component_id for k in range(6)] == [0, 0, 2, 3, 4, 5]
    assert got[4].n_shingles == 0 and got[2].n_shingles == 1
    sets = [{p for p in zip(t.split()[:-1], t.split()[1:], strict=True)} for t in (long_texts[0], long_texts[3])]
    assert [got[0].n_shingles, got[3].n_shingles] == [len(s) for s in sets]


def test_passages(long_docs, long_texts):
    got = substring_dedup.find_passages(long_docs).collect()
    assert {(r.doc_id, r.first_doc_id) for r in got} == {(1, 0)}
    assert sum(r.n_words for r in got) > 0.95 * len(long_texts[0].split())


def test_lines_leaks_and_scores(spark, long_docs, long_texts):
    lines = {r.doc_id: r for r in line_dedup.dedup_lines(long_docs.select("doc_id", "text")).collect()}
    assert len(lines) == 6 and lines[3].text == long_texts[3] and lines[0].text == long_texts[0]
    item = " ".join(long_texts[3].split(" ")[150_000:150_040])
    marks = spark.createDataFrame([(0, item), (1, "nothing of this is in any of the texts at all so far as anyone can tell from here today")], "item_id long, text string")
    leaks = decontaminate.find_leaks(long_docs, marks).collect()
    assert [tuple(r) for r in leaks] == [(3, 0, 150_000, 40, 0)]
    model = toxicity.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    scores = toxicity.score(long_docs.select("doc_id", "text"), model)
    assert scores.count() == 6 and scores.filter("score is null or score not between 0 and 1").count() == 0


@pytest.mark.parametrize("unit", ["か\u3099き\u3099", "e\u0301", "漢字かな", "ab<|endoftext|>", "w", "ж\u0301日x", "x\u0323\u0301"])
def test_long_stretches_are_cut_in_one_pass(unit):
    """100 kB without white space, whatever its script and form: the cut takes seconds at most and is the library's."""
    counter, library = token_counts.counter(public_tokenizers.path("word_bpe_49k.json")), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = unit * (100_000 // len(unit.encode()))
    began = time.process_time()
    cut = counter.within(text, token_counts.LIMIT)
    assert time.process_time() - began < 6
    count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    assert count(text[:cut]) <= token_counts.LIMIT and all(count(text[: cut + k]) > token_counts.LIMIT for k in range(1, 40))
