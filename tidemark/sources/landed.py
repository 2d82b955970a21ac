"""Facts out of landed bodies: files that a fetcher has put into a folder, or bodies in a column.

Fetching is not done here. Each reader takes a table of bodies (or a path) with the codes that its configuration gives
them, and gives one row for each observation; the release lags the observation by a number of days.
"""

from __future__ import annotations

import io
import itertools
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import parse


def released(rows: DataFrame, lag: int) -> DataFrame:
    return rows.withColumn("release_date", F.date_add("observation_date", lag))


def first_of_day(rows: DataFrame, *keys: str, order: str = "place") -> DataFrame:
    """The first row of each key and day, in the order in which the body has them."""
    w = Window.partitionBy(*keys, "observation_date").orderBy(order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", order)


def _each(bodies: DataFrame, keys: tuple[str, ...], rows: Column) -> DataFrame:
    return bodies.select(*keys, F.posexplode(rows).alias("place", "x"))


def daily_closes(bodies: DataFrame, keys: tuple[str, ...], body: str = "body", scale: float = 1.0, lag: int = 0) -> DataFrame:
    """keys, observation_date, value, release_date of chart bodies; closes that are no numbers are left out."""
    rows = _each(bodies, keys, parse.chart_closes(F.col(body), scale))
    rows = rows.select(*keys, "place", F.col("x.date").alias("observation_date"), F.round("x.close", 6).alias("value"))
    return released(first_of_day(rows, *keys), lag)


def gold_history(bodies: DataFrame, keys: tuple[str, ...], sell: str, buy: str, body: str = "body", lag: int = 0) -> DataFrame:
    rows = _each(bodies, keys, parse.dated_prices(F.col(body), sell, buy))
    rows = rows.select(*keys, "place", F.col("x.date").alias("observation_date"), F.col("x.sell").alias("value"), F.col("x.buy").alias("buy"))
    return released(first_of_day(rows, *keys), lag)


def spot_prices(bodies: DataFrame, keys: tuple[str, ...], today: str, body: str = "body", key: str = "product", form: str = "format") -> DataFrame:
    """One price of today for each body, by the parser that its ``format`` names; bodies without a positive one give no row."""
    parsers = {"list": parse.list_price, "table": parse.table_price, "region": parse.region_price, "board": parse.board_price}
    value = F.coalesce(*(F.when(F.col(form) == name, f(F.col(body), F.col(key))) for name, f in parsers.items()))
    found = bodies.select(*keys, F.to_date(F.lit(today)).alias("observation_date"), value.alias("value")).filter("value > 0")
    return released(found, 0)


def weather(bodies: DataFrame, keys: tuple[str, ...], names: dict[str, str], body: str = "body", lag: int = 1) -> DataFrame:
    """keys, metric_code, observation_date, value, release_date; parameters without a name keep theirs in lower case."""
    named = F.create_map(*(F.lit(x) for pair in names.items() for x in pair)) if names else F.create_map().cast("map<string,string>")
    rows = _each(bodies, keys, parse.power_values(F.col(body)))
    metric = F.coalesce(named[F.col("x.parameter")], F.lower("x.parameter"))
    return released(rows.select(*keys, metric.alias("metric_code"), F.col("x.date").alias("observation_date"), F.col("x.value").alias("value")), lag)


def oceanic_index(lines: DataFrame, line: str = "value", lag: int = 0) -> DataFrame:
    """metric_code, observation_date, value, release_date of the lines of the index; a month's value is known a month on."""
    rows = lines.select(parse.season_value(F.col(line)).alias("x")).filter("x is not null")
    return released(rows.select(F.lit("el_nino_la_nina").alias("metric_code"), F.col("x.date").alias("observation_date"), F.col("x.value").alias("value")), 31 + lag)


def balance_sheet(rows: DataFrame, wanted: DataFrame, release_date: str, days: int = 365) -> DataFrame:
    """Rows of a bulk table (commodity_id, attribute_id, country, year, month, unit, value) that ``wanted`` asks for.

    ``wanted`` has commodity_id, attribute_id, country and the codes and unit of each series. Fails if a series has
    another unit than it should, if two rows have one grain, or if a series has no row at all. Month 0 is January; rows
    without a year, a month that is one or a number are left out. All of a bulk file is known from the day it was taken.
    """
    key = ["commodity_id", "attribute_id", "country"]
    fine = (F.col("year") > 0) & F.col("month").between(0, 12) & F.col("value").isNotNull()
    start = F.make_date("year", F.greatest(F.col("month"), F.lit(1)), F.lit(1))
    own = rows.filter(fine).join(wanted.withColumnRenamed("unit", "__unit"), key).withColumns({"period_start": start, "period_end": F.date_add(start, days), "release_date": F.to_date(F.lit(release_date))})
    right = F.when(F.col("__unit").isNull() | (F.trim("unit") == F.col("__unit")), F.col("value"))
    own = own.withColumn("value", F.coalesce(right, F.raise_error(F.concat(F.lit("unit drift in "), F.concat_ws("/", *key), F.lit(": "), F.coalesce("unit", F.lit("none")))).cast("double")))
    grain = ["commodity_code", "metric_code", "region_code", "period_start"]
    once = Window.partitionBy(*grain)
    own = own.withColumn("value", F.when(F.count("*").over(once) == 1, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("two rows of "), F.concat_ws("/", *grain))).cast("double")))
    own = own.drop("__unit")
    # a series without rows raises as soon as its row meets the filter, which no projection of the result takes away and
    # which needs what the join has found
    met = rows.filter(fine).select(*key, F.lit(True).alias("__met")).distinct()
    silent = F.raise_error(F.concat(F.lit("no rows of "), F.concat_ws("/", *(F.col(c).cast("string") for c in key)))).cast("boolean")
    none = wanted.join(met, key, "left").filter(F.when(F.col("__met").isNull(), silent).otherwise(False))
    return own.unionByName(none.select(*(F.lit(None).cast(own.schema[c].dataType).alias(c) for c in own.columns)))


def unmatched(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The series of ``wanted`` that ``rows`` have nothing of."""
    return wanted.join(rows, ["commodity_id", "attribute_id", "country"], "left_anti")


def csv_prices(spark: SparkSession, path: str, day: str, value: str, where: dict[str, str], like: dict[str, str], form: str = "yyyy-MM-dd", method: str = "median") -> DataFrame:
    """observation_date, value, release_date (the day after) of local tables: rows whose columns equal ``where`` and
    contain ``like`` whatever the case, a positive number and a date in the format; one aggregate by ``method`` a day."""
    methods = {"median": F.median, "mean": F.avg, "min": F.min, "max": F.max}
    columns = list(dict.fromkeys((day, value, *where, *like)))
    rows = spark.read.option("header", True).csv(path).select(*columns)
    for c, v in where.items():
        rows = rows.filter(F.col(c) == v)
    for c, v in like.items():
        rows = rows.filter(F.lower(c).contains(v.lower()))
    typed = rows.select(F.try_to_timestamp(F.col(day), F.lit(form)).cast("date").alias("observation_date"), F.col(value).try_cast("double").alias("v")).filter("observation_date is not null and v > 0")
    return released(typed.groupBy("observation_date").agg(F.round(methods[method]("v"), 4).alias("value")), 1)


def zipped_lines(spark: SparkSession, path: str, member: str = ".csv", rows: int = 10_000) -> DataFrame:
    """file, number, line of the first member of each archive whose name ends so, in UTF-8 (other bytes replaced).

    An archive is one row of Spark's; its member is unpacked as a stream, ``rows`` lines of an Arrow batch at a time, so
    what a task holds are the packed bytes and one batch. An archive without such a member fails.
    """
    schema = "file string, number long, line string"

    def unpack(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    found = [n for n in archive.namelist() if n.lower().endswith(member)]
                    if not found:
                        raise ValueError(f"{name} has no member that ends in {member}")
                    with io.TextIOWrapper(archive.open(found[0]), "utf-8", "replace", newline="") as lines:
                        number = 0
                        while part := [x.rstrip("\r\n") for x in itertools.islice(lines, rows)]:
                            yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(range(number, number + len(part)), pa.int64()), pa.array(part)], ["file", "number", "line"])
                            number += len(part)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path)
    return files.select("path", "content").mapInArrow(unpack, schema)


def zipped_csv(spark: SparkSession, path: str, schema: str, member: str = ".csv") -> DataFrame:
    """The rows of zipped CSV files, whose first line names the columns: those of ``schema``, by name. A column that a file
    lacks fails; quoted fields may hold commas, but no line ends."""
    lines = zipped_lines(spark, path, member)
    header = lines.filter("number = 0").select("file", F.col("line").alias("__header"))
    cells = lambda c: F.transform(F.split(c, r',(?=(?:[^"]*"[^"]*")*[^"]*$)'), lambda x: F.replace(F.regexp_replace(x, r'^\s*"|"\s*$', ""), F.lit('""'), F.lit('"')))
    both = lines.filter("number > 0 and line <> ''").join(header, "file").withColumns({"__names": cells(F.col("__header")), "__cells": cells(F.col("line"))})
    fields = T.StructType.fromDDL(schema).fields
    at = lambda n: F.array_position("__names", n).cast("int")
    one = lambda n: F.when(at(n) > 0, F.try_element_at("__cells", at(n))).otherwise(F.raise_error(F.concat(F.col("file"), F.lit(f" has no column {n}"))))
    return both.select(*(F.nullif(F.trim(one(f.name)), F.lit("")).try_cast(f.dataType).alias(f.name) for f in fields))


def export_wide(rows: DataFrame, key: str, name: str, value: str, names: list[str], path: str) -> None:
    """``rows`` pivoted to a column for each of ``names`` (their mean, where several have one key), as CSV with a header,
    in the key's order."""
    wide = rows.groupBy(key).pivot(name, names).agg(F.avg(value)).orderBy(key)
    wide.write.mode("overwrite").option("header", True).csv(path)


FIXTURE = T.MapType(T.StringType(), T.StringType())


def fixtures(spark: SparkSession, path: str, family: str) -> DataFrame:
    """Records (family, fields, origin) of a JSON file that holds a list; the origin is the file's name and the row's number."""
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.posexplode(F.from_json("value", T.ArrayType(FIXTURE))).alias("place", "fields"))
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return rows.select(F.lit(family).alias("family"), "fields", F.concat_ws(":", F.lit(name), F.col("place").cast("string")).alias("origin"))


def all_fixtures(spark: SparkSession, files: dict[str, str]) -> DataFrame:
    """The fixtures of all families (family: path); without any, an empty table."""
    out = spark.createDataFrame([], T.StructType([T.StructField("family", T.StringType()), T.StructField("fields", FIXTURE), T.StructField("origin", T.StringType())]))
    for family, path in files.items():
        out = out.unionByName(fixtures(spark, path, family))
    return out


def registry(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Entries of a folder of JSON files, the newest (by ``created_at``) first; files that are no JSON are skipped."""
    rows = spark.read.schema(f"{schema}, __bad string").option("mode", "PERMISSIVE").option("multiLine", True).option("columnNameOfCorruptRecord", "__bad").json(path)
    return rows.filter("__bad is null").drop("__bad").orderBy(F.desc("created_at"))
