"""The point-in-time panel kept up to date as facts arrive, late ones among them.

What is kept are change points: for each key the days from which on another row wins. A stored winner is the largest of all
rows that are visible on its day, so the points after a batch are the running maximum over the stored points and the
batch's own rows; nothing older than the batch's first day of a key is looked at, but for the point before it. A batch
writes the points that it makes, changes or takes away (``gone``) as a partition of its own (batch=n), so a batch that runs
twice gives the same rows and readers of earlier batches are not disturbed. Points lie in ``BUCKETS`` partitions by key, of
which a batch reads those of its own keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import asof

BUCKETS = 32
_ROW = "observation_date date, release_date date, revision int, source_fact_id long, metric_value double"
POINTS = f"commodity_key int, dim_key int, metric_code string, since date, winner struct<{_ROW.replace(' ', ': ').replace(',: ', ', ')}>, gone boolean, batch long, bucket int"


def _bucket():
    return F.pmod(F.xxhash64(*(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in asof.KEYS)), F.lit(BUCKETS)).cast("int")


def _there(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def points(spark: SparkSession, folder: str, before: int | None = None, buckets: list[int] | None = None) -> DataFrame:
    """The change points (keys, since, winner) after all batches, or those before a batch's number."""
    if not _there(spark, folder):
        return spark.createDataFrame([], T.StructType.fromDDL(POINTS)).drop("gone", "batch", "bucket")
    rows = spark.read.schema(POINTS).parquet(folder)
    if before is not None:
        rows = rows.filter(F.col("batch") < before)
    if buckets is not None:
        rows = rows.filter(F.col("bucket").isin(buckets))
    last = rows.groupBy(*asof.KEYS, "since").agg(F.max_by(F.struct("winner", "gone"), "batch").alias("x"))
    return last.filter("not x.gone").select(*asof.KEYS, "since", "x.winner")


def _same_key(a: str, b: str):
    same = F.lit(True)
    for k in asof.KEYS:
        same = same & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return same


def changes(held: DataFrame, facts: DataFrame, dims: DataFrame | None) -> DataFrame:
    """keys, since, winner, gone: what ``facts`` change of the stored points ``held``, and nothing else."""
    daily = facts.groupBy(*asof.KEYS, F.greatest("observation_date", "release_date").alias("since")).agg(F.max(F.struct(*(x.split()[0] for x in _ROW.split(", ")))).alias("w"))
    if dims is not None:
        daily = asof.for_every_commodity(daily, dims)
        daily = daily.groupBy(*asof.KEYS, "since").agg(F.max("w").alias("w"))
    daily = daily.select(*asof.KEYS, "since", F.col("w").cast(f"struct<{_ROW.replace(' ', ': ').replace(',: ', ', ')}>").alias("w"))
    first = daily.groupBy(*asof.KEYS).agg(F.min("since").alias("__first"))
    own = held.alias("h").join(first.alias("f"), _same_key("h", "f")).select("h.*", "f.__first")
    # of the points before the batch's first day only the last matters
    by_key = Window.partitionBy(*asof.KEYS)
    start = F.max(F.when(F.col("since") <= F.col("__first"), F.col("since"))).over(by_key)
    near = own.withColumn("__start", start).filter(F.col("__start").isNull() | (F.col("since") >= F.col("__start")))
    both = near.select(*asof.KEYS, "since", F.col("winner").alias("was"), F.col("winner").alias("w")).unionByName(daily.withColumn("was", F.lit(None).cast(near.schema["winner"].dataType)))
    days = both.groupBy(*asof.KEYS, "since").agg(F.max("was").alias("was"), F.max("w").alias("w"))
    order = by_key.orderBy("since")
    now = days.withColumn("now", F.max("w").over(order))
    now = now.withColumn("__before", F.lag("now").over(order))
    point = F.col("__before").isNull() | (F.col("now") != F.col("__before"))
    new = now.withColumn("__point", point)
    made = new.filter(F.col("__point") & (F.col("was").isNull() | (F.col("was") != F.col("now")))).select(*asof.KEYS, "since", F.col("now").alias("winner"), F.lit(False).alias("gone"))
    gone = new.filter(~F.col("__point") & F.col("was").isNotNull()).select(*asof.KEYS, "since", F.col("was").alias("winner"), F.lit(True).alias("gone"))
    return made.unionByName(gone)


def apply(spark: SparkSession, folder: str, facts: DataFrame, number: int, dims: DataFrame | None = None) -> None:
    """Write what batch ``number`` changes."""
    keyed = facts if dims is None else asof.for_every_commodity(facts.select(*asof.KEYS).distinct(), dims)
    asked = [r.bucket for r in keyed.select(_bucket().alias("bucket")).distinct().collect()]  # BUCKETS at most
    found = changes(points(spark, folder, number, asked), facts, dims).withColumn("bucket", _bucket())
    found.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/batch={number}")


def follow(stream: DataFrame, folder: str, checkpoint: str, dims: DataFrame | None = None):
    """Keep the panel up to date with a stream of facts until all that has landed is in."""
    one = lambda batch, number: apply(batch.sparkSession, folder, batch, number, dims)
    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def intervals(held: DataFrame) -> DataFrame:
    """keys, winner, since, until of change points, in the form of asof.winners(); until is null for the last."""
    order = Window.partitionBy(*asof.KEYS).orderBy("since")
    return held.withColumn("until", F.date_sub(F.lead("since").over(order), 1))


def compact(spark: SparkSession, folder: str, into: str) -> None:
    """The points of all batches as batch 0 of a new folder."""
    points(spark, folder).withColumns({"gone": F.lit(False), "bucket": _bucket()}).write.partitionBy("bucket").parquet(f"{into}/batch=0")
