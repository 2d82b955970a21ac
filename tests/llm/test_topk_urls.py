"""op3 and op8 against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import topk, urls
from tidemark.llm.queries import BLOCKED_HOSTS, RULES


@pytest.mark.parametrize("rows,seed,summary", [(16, 1, 1 << 25), (64, 2, 1 << 25), (16, 3, 0)])
def test_topk(spark, rows, seed, summary):
    """Against all rows, with ranges known by summaries and without; repeated rows, ties, and components that are large."""
    rng = np.random.default_rng(seed)
    vectors = [(i, [float(x) for x in rng.normal(size=6).round(1)]) for i in range(400)]
    vectors += [(i, [0.5] * 6) for i in range(400, 600)] + [(1000, None), (1050, [1.0, None]), (1100, [float("nan")] * 6), (1150, [float("inf")] * 6), (1200, []), (None, [1.0] * 6), (700, [0.25, 0.5])]
    vectors += [(800, [9e6, -1e6, 1.0]), (801, [1.2e6, 5.5]), *vectors[:20]]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(5).withColumns({c: F.lit("x") for c in ("id", "number", "v", "rank", "score")})
    fine = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for n, (q, v) in enumerate(fine):
        if q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for m, (i, w) in enumerate(fine) if m != n)[:5]  # noqa: B905
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    before = spark.conf.get(topk._BATCH)
    got = [tuple(r) for r in topk.top_k(df, range_rows=rows, most_summary_bytes=summary).collect()]
    assert sorted(got) == sorted(want) and spark.conf.get(topk._BATCH) == before


def test_topk_sends_no_queries_through_the_driver(spark, monkeypatch):
    """Queries times ranges grow with the square of the rows; the join that they meet in broadcasts neither side."""
    plans, write = {}, topk.materialize

    def noted(df, label):
        plans[label] = df._jdf.queryExecution().sparkPlan().toString()
        return write(df, label)

    monkeypatch.setattr(topk, "materialize", noted)
    df = spark.createDataFrame([(i, [i % 7 - 3.0, i % 5 - 2.0]) for i in range(300)], "vec_id long, embedding array<double>")
    for summary in (1 << 25, 0):
        assert topk.top_k(df, range_rows=32, most_summary_bytes=summary).count() == 30
        assert "SortMergeJoin [range" in plans["topk-found"]


def test_topk_small(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], schema)).count() == 0
    one = topk.top_k(spark.createDataFrame([(0, [1.0, 2.0]), (7, [1.0, -1.0])], schema)).collect()
    assert [tuple(r) for r in one] == [(0, 1, 7, 256 * 256 - 512 * 256)]


def test_blocks_are_pruned():
    rng = np.random.default_rng(3)
    rows = np.repeat(np.eye(8) * 200, 64, axis=0) + rng.integers(0, 5, (512, 8))
    data = topk.Range(np.arange(512).tobytes(), np.arange(512).tobytes(), rows.astype(np.int64).tobytes(), 8, block=64)
    looked = []
    product = data.product
    data.product = lambda q, start: looked.append(start) or product(q, start)
    best = topk.Best(np.array([-1]), 5, np.array([topk.LOWEST]), np.array([np.iinfo(np.int64).max]))
    data.search(rows[:1].astype(np.int64), best)
    assert looked == [0]


URLS = ["http://a.org/x", "https://B.Example.ORG/es/1", "http://example.org/en/12?q", "http://example.org/en/2", "http://shop.com/fr/1#x", "http://shop.com/de/", "http://com/fr/",
        "http://x.spam-farm.example.net/en", "http://spam-farm.example.net", "http://notspam-farm.example.net/", "ftp://u://v/w", "no url", "", None, "http://org", "http://a.b.org?x/", "x://\n.org/a\nb", "http://ÄB.org/ä"]


def judge(url: str | None):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([rest.index(c) for c in "?#" if c in rest], default=len(rest))]
    fits = lambda h: host == h or host.endswith("." + h)
    own = [(len(r), r, v) for v, r in RULES if fits(r.split("/", 1)[0]) and path.startswith(r[r.index("/") :])]
    if own:
        return host, path, max(own)[1], max(own)[2]
    return host, path, None, "block" if any(fits(h[:-1]) for h in BLOCKED_HOSTS) else "allow"


@pytest.mark.parametrize("most", [5_000_000, 3])
def test_urls(spark, monkeypatch, most):
    monkeypatch.setattr(urls, "MOST_ENTRIES", most)
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(URLS)], "page_id long, url string, verdict string, extra string")
    blocked = spark.createDataFrame([(h,) for h in BLOCKED_HOSTS], "rule string") if most == 3 else BLOCKED_HOSTS
    got = urls.judge(pages, RULES, blocked).collect()
    assert len(got) == len(URLS)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == judge(URLS[r.page_id])
    assert urls.judge(pages.limit(0), RULES, BLOCKED_HOSTS).count() == 0


def test_colliding_digests_are_told_apart(monkeypatch, tmp_path):
    monkeypatch.setattr(urls, "_digest", lambda data: 7)
    (tmp_path / "f").write_bytes(urls.pack([("block", "a.org/"), ("allow", "b.org/")]))
    found = urls.Digests(str(tmp_path / "f")).longest([[b"a.org/"], [b"b.org/"], [b"c.org/"]])
    assert found == [(b"a.org/", True), (b"b.org/", False), None]


def test_a_million_hosts_from_files(spark, tmp_path):
    (tmp_path / "hosts.txt").write_text("# junk\n\n" + "\n".join(f"Host{k}.example" for k in range(1_000_000)))
    blocked = urls.hosts_of(spark, f"file://{tmp_path}/hosts.txt")
    asked = ["http://a.host77.example/x", "http://host999999.example", "http://host1000000.example/", "http://xhost5.example/", "http://host5.example.org/"]
    pages = spark.createDataFrame(list(enumerate(asked)), "page_id long, url string")
    assert {r.page_id for r in urls.judge(pages, (), blocked).filter("verdict = 'block'").collect()} == {0, 1}
