"""op2 and op7: no Python in their plans, whole results, edge cases."""

from __future__ import annotations

import hashlib
import re

import pytest

from tidemark.llm import line_dedup, sharding


def tier(size: int, fanout: int, base: int) -> int:
    return sum(size >= base * fanout**k for k in range(20))


def test_compaction(spark, odd, tmp_path):
    table = sharding.ShardedTable(spark, f"file://{tmp_path}/t", odd.schema)
    assert table.read().count() == 0
    table.append(odd, "source")
    table.append(odd.limit(0), "source")
    first = table.versions()[-1]
    for _ in range(3):
        table.append(odd.filter("doc_id < 9"), "source")
    before = sorted(map(repr, table.read().select(odd.columns).collect()))
    table.compact(fanout=2, base=1000, target=4000)
    runs = table.runs()
    tiers = [r.tier(2, 1000) for r in runs]
    assert len(tiers) == len(set(tiers))
    assert sum(r.rows for r in runs) == odd.count() + 3 * odd.filter("doc_id < 9").count()
    assert sorted(map(repr, table.read().select(odd.columns).collect())) == before
    assert table.read(first).count() == odd.count()
    with pytest.raises(RuntimeError):
        table.commit([], table.versions()[-1] - 1)
    table.vacuum()
    assert len(table.versions()) == 1
    assert sorted(map(repr, table.read().select(odd.columns).collect())) == before
    for r in runs:
        assert r.tier(2, 1000) == tier(r.bytes, 2, 1000)


def test_columns_that_clash_with_the_runs(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "x", 7)], "doc_id long, text string, run string, Tier int")
    table = sharding.ShardedTable(spark, f"file://{tmp_path}/t", df.schema)
    assert table.read().columns == ["doc_id", "text", "run", "Tier", "_run", "run_arrivals", "run_rows", "run_bytes", "_tier"]
    table.append(df, "run")
    assert tuple(table.read().first()) == (1, "a", "x", 7, "x", 1, 1, 1, 0)


def plain_chunks(text: str) -> list[list[str]]:
    lines, out, own = text.split("\n"), [], []
    h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
    for i, line in enumerate(lines):
        own.append(line)
        rolled = sum((h[i - b] if i >= b else 0) * line_dedup.FACTOR**b for b in range(line_dedup.WINDOW))
        if rolled % line_dedup.MEAN_LINES == 0:
            out.append(own)
            own = []
    return [*out, own] if own else out


def test_line_dedup(docs, texts):
    seen: set[str] = set()
    want = {}
    for k, t in enumerate(texts):
        if t is None:
            want[k] = (None, 0, 0)
            continue
        kept, gone = [], 0
        for c in plain_chunks(t):
            body = "\n".join(c)
            if sum(bool(x.strip(" ")) for x in c) >= line_dedup.LEAST_LINES:
                if body in seen:
                    gone += len(c)
                    continue
                seen.add(body)
            kept.append(body)
        want[k] = ("\n".join(kept), t.count("\n") + 1 if t else 0, gone)
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(docs).collect()}
    assert got == want
    assert sum(g[2] for g in got.values()) > 20


def test_line_dedup_odd_and_empty(odd, empty):
    out = line_dedup.dedup_lines(odd)
    assert out.count() == odd.count()
    twice = [r.text for r in out.filter("doc_id = 3").collect()]
    assert len(twice) == 2 and twice[0] == twice[1]  # equal rows are one document
    assert line_dedup.dedup_lines(empty).count() == 0


def test_no_python_in_plans(docs):
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
