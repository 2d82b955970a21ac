"""A corpus pipeline of five stages over documents; each stage's rows are written and read again by the next.

toxicity: documents that the classifier predicts to be toxic go; it is fitted on the labels of this input.
line dedup: repeated chunks of lines go but for their first occurrence; n_chars follows the text, and a document that
    loses all it had goes. near dedup: one document of each near-duplicate group stays, that of the smallest id; rows
    that share an id are one document, each of whose texts stays once, and rows without an id all stay.
decontamination: documents with a passage of the benchmark go. bpe: the token ids of what is left, and whether they
    decode to the text.

An empty table gives an empty one; null texts count as empty. All stages but the last return the columns of their
input. SQL can't express the stages, so ``ORACLE_SQL`` is None; ``tests/llm`` holds them against plain Python.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, line_dedup, near_dedup, toxicity
from tidemark.llm.common import WIDE, in_few, materialize


OWN = "__own_"


def aside(docs: DataFrame) -> DataFrame:
    """``docs`` with other names for all columns but the id and the text, so that no operator's result takes their place."""
    return docs.select(*(F.col(c).alias(c if c in ("doc_id", "text") else OWN + c) for c in docs.columns))


def back(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like`` out of what an operator has made of ``aside(like)``."""
    return docs.select(*(F.col(c if c in ("doc_id", "text") else OWN + c).alias(c) for c in like.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return back(toxicity.score(aside(docs), model).filter("predicted = 0"), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup_lines(aside(docs))
    left = left.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col(OWN + "n_chars"))
        left = left.withColumn(OWN + "n_chars", n_chars.cast(docs.schema["n_chars"].dataType))
    return in_few(back(left, docs), docs.count(), WIDE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = docs.count()
    found = materialize(in_few(near_dedup.dedup(docs.select("doc_id", "text")), rows), "pipeline-near")
    gone = found.filter(~F.col("kept")).select("doc_id").distinct()
    left = aside(docs).join(gone.hint("shuffle_hash"), "doc_id", "left_anti")
    repeated = found.groupBy("doc_id").count().filter("doc_id is not null and count > 1").select("doc_id")
    if not repeated.isEmpty():  # most tables have no such rows
        order = Window.partitionBy("doc_id", "text").orderBy("doc_id", *(F.to_json(F.struct(c)) for c in left.columns if c.startswith(OWN)))
        once = left.join(repeated, "doc_id", "left_semi").withColumn("__row", F.row_number().over(order)).filter("__row = 1").drop("__row")
        left = left.join(repeated, "doc_id", "left_anti").unionByName(once)
    return in_few(back(left, docs), rows, WIDE)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    leaks = decontaminate.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = materialize(leaks, "pipeline-leaks").select("doc_id").distinct()
    return docs.join(leaks.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    decoded = bpe.decode(bpe.encode(docs, path), path)
    same = F.col("decoded") == F.coalesce("text", F.lit(""))
    return decoded.withColumn("round_trip", same).drop("decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("bpe", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name.replace(' ', '-')}")
    return docs
