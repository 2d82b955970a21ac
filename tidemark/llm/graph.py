"""Connected components of an edge table, in rounds of large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import in_few, materialize


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """node, component (its smallest reachable node) for the nodes of ``edges`` (a, b), which may repeat.

    Each round links every node's larger neighbours, then its smaller ones, to the smallest of them, until nothing
    changes: a number of rounds logarithmic in the components' diameter. Neighbours are never gathered; a minimum is
    aggregated per node and joined back, and every round is written, so its lineage ends there. Null nodes are ignored.
    ``rows`` is a bound of the number of edges, for callers that know one; else they are counted.
    """
    both = lambda e: e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rows = edges.count() if rows is None else rows
    now = edges.filter("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialize(in_few(now, rows), "edges")
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == mark or not seen[0]:
            break
        mark = seen
        around = both(now)
        least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = around.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # the smaller neighbours of a node, the node itself among those linked to the smallest
        floor = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(floor, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(floor.select("a", F.col("m").alias("b")))
        now = materialize(in_few(small.filter("a <> b").distinct(), 2 * seen[0]), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
