"""The pipeline's stages, and the queries that have SQL."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.compare import same_rows
from tests.conftest import SF
from tests.llm.test_duplicates import brute
from tidemark.llm import graph, near_dedup
from tidemark.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    same_rows(QUERIES[name](spark, SF), duck, ORACLE_SQL[name])


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit(1))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "near dedup", "decontamination", "bpe"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, columns = docs, docs.columns
        docs = stage(spark, docs, SF).cache()
        assert docs.filter("doc_id is null").count() == 0 and docs.count() <= before.count()
        if k < 4:
            assert docs.columns == columns
        if name == "near dedup":
            want = brute({r.doc_id: r.text for r in before.collect()}, 5)
            assert {r.doc_id for r in docs.collect()} == {i for i, c in want.items() if i == c}
        if name == "decontamination":
            items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            left = {r.doc_id for r in docs.collect()}
            assert not [r.doc_id for r in before.collect() if r.doc_id in left and any(i in r.text for i in items)]
    assert docs.filter("not round_trip").count() == 0 and docs.count() > 100


def test_empty_and_odd(spark, empty, odd, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    for docs in (empty, odd):
        start = docs.count()
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            columns, types = docs.columns, docs.dtypes
            docs = stage(spark, docs, str(tmp_path)).cache()
            if k < 4:  # columns whose names operators use are the user's own
                assert docs.columns == columns and docs.dtypes == types
                assert docs.select(*set(columns) - set(empty.columns)).distinct().count() <= 1
        assert (docs.count() > 10) == (start > 0)


def test_few_rows_are_written_in_few_files(spark, monkeypatch):
    """With many shuffle partitions each round of the components wrote a file for each of them, of a row or two."""
    files, write = {}, graph.materialize

    def written(df, label):
        out = write(df, label)
        files.setdefault(label, []).append(len(out.inputFiles()))
        return out

    for module in (graph, near_dedup):
        monkeypatch.setattr(module, "materialize", written)
    known = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    most = 2 * spark.sparkContext.defaultParallelism
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 3 * most)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
        rows = [(i, " ".join(f"w{i // 2}x{k}" for k in range(60)) + f" {i}") for i in range(400)]
        got = near_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        for k, v in known.items():
            spark.conf.set(k, v)
    assert {r.doc_id: r.component_id for r in got} == {i: i // 2 * 2 for i in range(400)}
    assert {"edges", "near-classes", "near-heads", "near-buckets", "near-members", "near-stars"} <= set(files)
    assert max(max(files[k]) for k in files if k not in ("near-features", "near-left")) <= most
