"""Incremental ingest of landed events: each record once, late records as they come, sums by window with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import restate

STORED = "key string, day date, value double, revision int, release_date date, record_id string, batch long"


def read_landed(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def once(records: DataFrame, id_col: str, time_col: str, late: str = "2 days") -> DataFrame:
    """Each record id once, as long as its repeats come within ``late``."""
    records = records.withColumn(time_col, F.col(time_col).cast("timestamp"))
    return records.withWatermark(time_col, late).dropDuplicatesWithinWatermark([id_col])


def by_window(records: DataFrame, time_col: str, key: str, value: str, length: str = "1 day", late: str = "2 days") -> DataFrame:
    records = records.withColumn(time_col, F.col(time_col).cast("timestamp"))
    sums = records.withWatermark(time_col, late).groupBy(F.window(time_col, length), key)
    return sums.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def append_to(stream: DataFrame, folder: str, checkpoint: str):
    """Run until all that has landed is in ``folder`` (Parquet, exactly once by the checkpoint)."""
    query = stream.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
    return query


def stored(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The latest revision of each key and day that reconcile_to() has written, optionally by earlier batches alone."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], STORED)
    rows = spark.read.schema(STORED).parquet(folder)
    if before is not None:
        rows = rows.filter(F.col("batch") < before)
    return rows.groupBy("key", "day").agg(F.max_by(F.struct("value", "revision", "release_date", "record_id", "batch"), F.struct("revision", "batch")).alias("x")).select("key", "day", "x.*")


def reconcile_to(stream: DataFrame, folder: str, status_folder: str, checkpoint: str, today: str, limits: restate.Limits = restate.Limits()):
    """Reconcile each batch of fetched rows (key, day, value, landed) with what is stored, until all that landed is in.

    The state of a series is what earlier batches have stored, so it needs no memory of its own and late rows find it at
    any age. A key that is new is stored at revision 0; else only what ``restate`` allows is added. A batch writes its own
    partition (batch=n), read by later ones alone, so a batch that runs twice gives the same rows. The statuses of a
    batch's keys go to ``status_folder``. Of rows of one key and day in a batch the last landed counts.
    """

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fetched = batch.groupBy(F.col("key").cast("string").alias("key"), "day").agg(F.max_by("value", "landed").alias("value")).filter("key is not null and day is not null").persist()
        held = stored(spark, folder, number).join(fetched.select("key").distinct(), "key", "left_semi")
        judged = restate.statuses(held, fetched, today, limits)
        first = fetched.filter("value > 0").join(judged.filter("status = 'empty'").select("key"), "key", "left_semi")
        begun = first.select("key", "day", "value", F.lit(0).alias("revision"), F.col("day").alias("release_date"), F.concat_ws(":", "key", "day").alias("record_id"))
        rows = restate.new_rows(held, fetched, judged, today).unionByName(begun)
        judged.write.mode("overwrite").parquet(f"{status_folder}/batch={number}")
        rows.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        fetched.unpersist()

    query = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
