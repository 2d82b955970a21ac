from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make_texts(seed: int = 5) -> list[str | None]:
    """Copies, near copies, repeated line blocks, long and empty texts, nulls, special strings and several scripts."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = "\n".join(sentence(12) for _ in range(12))
    block = "\n".join(sentence(9) for _ in range(8))
    texts: list[str | None] = [base, base, base.replace(" ", "  ", 3), base + "\n" + sentence(5), base.upper(), None, "", " \n\t ", "one", "one", "one two"]
    for k in range(6):
        own = base.split(" ")
        for _ in range(k):
            own[rng.randrange(len(own))] = rng.choice(words)
        texts.append(" ".join(own))
    texts += ["\n".join([sentence(10), sentence(8), block, sentence(7)]) for _ in range(5)]
    texts += [sentence(60) for _ in range(6)]
    texts += ["<|endoftext|>a<|startoftext|> b<|endoftext|", "日本語のテキスト、漢字。" * 40, "x" * 3000, "ΑΣ İ ǅ é é ½ 12,5 don't WE'LL", "a\r\nb\x0bc\x85d\xa0e", "🙂👩‍👩‍👧 " * 30, sentence(4000)]
    return texts


@pytest.fixture(scope="session")
def texts() -> list[str | None]:
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def odd(spark, docs):
    """The same, with repeated rows, a null id, and columns whose names results and helpers take."""
    more = spark.createDataFrame([(None, "no id", None, None, None), (3, docs.filter("doc_id = 3").first().text, "en", "s0", 1)], SCHEMA)
    from pyspark.sql import functions as F

    both = docs.unionByName(more)
    names = ("n_tokens", "score", "component_id", "kept", "key", "id", "n", "class", "text_a", "rows", "bands", "host", "item_id", "n_lines", "component")
    return both.withColumns({c: F.lit("clash") for c in names})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
