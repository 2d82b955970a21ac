"""op5 against brute force and planted edits; op10 on its held-out rows."""

from __future__ import annotations

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.llm import decontaminate, toxicity
from tidemark.llm.common import materialize


def edits(a: list, b: list) -> int:
    row = [0] * (len(b) + 1)
    for k, x in enumerate(a, 1):
        new = [k]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_edit_match():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(0, 14))
        cost, start, end = decontaminate.edit_match(a, b)
        assert cost == edits(a.tolist(), b.tolist())
        assert 0 <= start <= end <= len(b)


def plant(rng: random.Random, item: list[str], n: int) -> list[str]:
    own = list(item)
    for _ in range(n):
        p, kind = rng.randrange(len(own)), rng.random()
        if kind < 0.4:
            own[p] = f"zz{rng.randrange(999)}"
        elif kind < 0.7 and len(own) > 1:
            del own[p]
        else:
            own.insert(p, f"qq{rng.randrange(999)}")
    return own


def test_recall_and_clean_texts():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    items = [[rng.choice(words) for _ in range(rng.randint(12, 60))] for _ in range(300)]
    matcher = decontaminate.Matcher(decontaminate.Items(list(range(300)), items))
    for rate, least in ((0, 1.0), (0.05, 0.97), (0.1, 0.94)):
        texts = [" ".join([rng.choice(words) for _ in range(30)] + plant(rng, w, int(rate * len(w))) + [rng.choice(words) for _ in range(30)]) for w in items]
        found = matcher.matches(texts)
        assert sum((k, k) in {(t, i) for t, i, *_ in found} for k in range(300)) >= least * 300
        assert all(t == i for t, i, *_ in found)
        assert all(e <= decontaminate.EDITS * len(items[i]) for _, i, _, _, e in found)
    assert matcher.matches([" ".join(rng.choice(words) for _ in range(500)) for _ in range(50)]) == []


def test_recall_at_the_edits_allowed():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4))) for _ in range(3000)]
    items = [[rng.choice(words) for _ in range(rng.randint(12, 60))] for _ in range(300)]
    matcher = decontaminate.Matcher(decontaminate.Items(list(range(300)), items))
    caught = {}
    for rate in (0.05, 0.1, 0.2):
        caught[rate] = 0
        for _ in range(4):
            texts = [" ".join([rng.choice(words) for _ in range(30)] + plant(rng, w, int(rate * len(w))) + [rng.choice(words) for _ in range(30)]) for w in items]
            found = {(t, i) for t, i, *_ in matcher.matches(texts)}
            caught[rate] += sum((k, k) in found for k in range(300))
    print({rate: n / 1200 for rate, n in caught.items()})
    assert caught[0.05] >= 0.98 * 1200 and caught[0.1] >= 0.97 * 1200 and caught[0.2] >= 0.9 * 1200


def test_leaks(spark, monkeypatch):
    docs = [(1, "x y z " + "Alpha beta, gamma delta; epsilon zeta eta theta iota kappa. lambda mu" + " tail"), (2, "nothing here"), (3, None), (4, ""), (None, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu")]
    bench = [(10, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (11, "nothing"), (12, None), (13, "..."), (10, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (None, "nothing here")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    b = spark.createDataFrame(bench, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    want = {(1, 10, 3, 12, 0), (None, 10, 0, 12, 0), (2, 11, 0, 1, 0)}
    assert {tuple(r) for r in decontaminate.find_leaks(d, b).collect()} == want
    monkeypatch.setattr(decontaminate, "MOST_WORDS", 3)  # a slice for each item
    assert {tuple(r) for r in decontaminate.find_leaks(d, b).collect()} == want
    assert decontaminate.find_leaks(d.limit(0), b).count() == 0
    assert decontaminate.find_leaks(d, b.limit(0)).count() == 0


def test_toxicity_on_held_out_rows(spark):
    folder = SF.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, model).join(labels.withColumnRenamed("doc_id", "d"), F.col("doc_id") == F.col("d")).collect()
    held = [r for r in scored if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.93
    clean = [r for r in held if not r.toxic]
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)
    again = toxicity.fit(docs.repartition(5), labels)
    assert again.voters == model.voters and np.allclose(again.weights, model.weights)


def test_labels_of_held_out_rows_do_not_matter(spark):
    folder = SF.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(toxicity.remainder("doc_id") == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert np.allclose(toxicity.fit(docs, labels).weights, toxicity.fit(docs, turned).weights)


def test_toxicity_odd_and_empty(spark, odd, empty):
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    out = toxicity.score(odd, model)
    assert out.count() == odd.count() and out.filter("score is null or held_out is null").count() == 0
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0
    assert toxicity.score(odd, toxicity.fit(odd, labels.limit(0))).filter("score > 0.01").count() == 0


def test_label_model_finds_the_rates_of_simulated_voters():
    """Voters of known accuracy, one of them three times over: rates come out, repeats are not believed three times, and
    no label is looked at."""
    rng = np.random.default_rng(11)
    n, prior = 6000, 0.15
    y = rng.random(n) < prior
    rates = [(0.7, 0.01), (0.5, 0.02), (0.4, 0.005), (0.6, 0.03), (0.3, 0.01), (0.5, 0.05)]
    votes = np.column_stack([np.where(y, rng.random(n) < a, rng.random(n) < b) for a, b in rates])
    q, rate1, rate0 = toxicity.label_model(votes, prior)
    assert np.abs(rate1 - [a for a, _ in rates]).max() < 0.06 and np.abs(rate0 - [b for _, b in rates]).max() < 0.015
    assert np.mean((q > 0.5) == y) > 0.97
    # a poor voter that is repeated (with little noise) and clean rows that it alone speaks for
    poor = np.where(y, rng.random(n) < 0.5, rng.random(n) < 0.12)
    copies = np.column_stack([poor ^ (rng.random(n) < 0.01) for _ in range(3)])
    q, _, _ = toxicity.label_model(np.column_stack([votes, copies]), prior)
    alone = copies.all(axis=1) & ~votes.any(axis=1) & ~y
    assert alone.sum() > 100 and np.mean(q[alone] > 0.5) < 0.05 and np.mean((q > 0.5) == y) > 0.96


def test_repeated_rows_count_once(spark, monkeypatch):
    """The sample is bounded by rows; a row that is there many times has no more weight than one."""
    folder = SF.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    once = toxicity.fit(docs, labels)
    assert len(once.voters) > 20
    many = toxicity.fit(docs.unionByName(docs.join(labels.filter("toxic = 1").limit(20), "doc_id", "left_semi")).unionByName(docs), labels)
    assert many.voters == once.voters and np.allclose(many.weights, once.weights)
    monkeypatch.setattr(toxicity, "MOST_LABELLED", 20)
    both = docs.limit(3).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(30)))).withColumn("text", F.concat("text", F.lit(" "), F.col("n").cast("string")))
    seen = []
    monkeypatch.setattr(toxicity, "materialize", lambda df, label: seen.append(df.count()) or materialize(df, label))
    toxicity.fit(both, both.select("doc_id").distinct().withColumn("toxic", (F.col("doc_id") % 2).cast("int")))
    assert seen and seen[0] <= 20


def test_passages_that_lack_too_many_words_are_not_aligned(monkeypatch):
    """An item whose first words come again in a text that lacks the others is told by its words alone."""
    rng = random.Random(3)
    item = [f"w{rng.randrange(10**9)}" for _ in range(40)]
    texts = [" ".join(item[: 6 + k] + [f"x{rng.randrange(10**9)}" for _ in range(60)]) for k in range(25)] + [" ".join(["a", *item[:-1], "b"])]
    aligned, align = [], decontaminate.edit_match
    monkeypatch.setattr(decontaminate, "edit_match", lambda item, passage: aligned.append(1) or align(item, passage))
    found = decontaminate.Matcher(decontaminate.Items([7], [item])).matches(texts)
    assert [(t, k, e) for t, k, _, _, e in found] == [(25, 0, 1)]
    assert 1 <= len(aligned) <= 6


def test_texts_without_an_items_neighbours_go_no_further(monkeypatch):
    """Texts of the items' own words, in another order, are told by their pairs of words, which loses no match."""
    rng = random.Random(19)
    words = [f"w{k}" for k in range(600)]
    items = [[rng.choice(words) for _ in range(rng.randint(12, 60))] for _ in range(60)]
    fill = lambda n: [rng.choice(words) for _ in range(n)]
    texts = [" ".join(fill(400)) for _ in range(100)]
    texts += [" ".join(fill(30 * (k % 2)) + plant(rng, w, int(rate * len(w))) + fill(30 * (k // 2 % 2))) for rate in (0, 0.1, 0.2) for k, w in enumerate(items)]
    matcher = decontaminate.Matcher(decontaminate.Items(list(range(60)), items))
    looked, look_up = [], matcher.look_up
    monkeypatch.setattr(matcher, "look_up", lambda own: looked.append(len(own)) or look_up(own))
    found = matcher.matches(texts)
    assert len(found) > 160 and sum(looked) < sum(len(t.split()) for t in texts[100:]) + 4000
    monkeypatch.setattr(matcher, "possible", lambda ids: (np.ones(len(ids), bool), np.ones(len(ids), bool)))
    assert {m[:2] for m in matcher.matches(texts)} <= {m[:2] for m in found}


def test_words_of_ascii_texts_are_those_of_the_pattern():
    every = "".join(map(chr, range(128)))
    for text in (every, every[::-1] + "aZ_9 b", "A_b\x1cc\x0bd", ""):
        assert decontaminate.words_of(text) == decontaminate._WORD.findall(text.lower())
