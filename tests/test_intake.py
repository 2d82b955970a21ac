"""Parsing of landed bodies and records, and batches that are written whole or not at all."""

from __future__ import annotations

import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tidemark.functions import parse
from tidemark.operators import restate
from tidemark.sources import landed


def value(spark, column, **cells):
    row = spark.createDataFrame([tuple(cells.values())], ", ".join(f"{c} string" for c in cells))
    return row.select(column.alias("x")).first().x


def test_prices_of_pages_and_bodies(spark):
    table = "<table><tr><td>Bạc <b>miếng</b></td><td>lượng</td><td>2,300,000</td><td>2,314,000</td></tr><tr><td>BẠC THỎI</td><td>kg</td><td>_</td></tr></table>"
    page = "<h1>Giá trung bình 148.500 VNĐ/kg</h1><td>Đắk&nbsp;Lắk</td><td>149,000</td>"
    get = lambda f, body, key: value(spark, f(F.col("body"), F.col("key")), body=body, key=key)
    assert get(parse.table_price, table, "bạc miếng") == 2314000.0
    assert get(parse.table_price, table, "bạc thỏi") is None and get(parse.table_price, table, "vàng") is None
    assert get(parse.region_price, page, "AVG") == 148500.0 and get(parse.region_price, page, "đắk lắk") == 149000.0
    assert get(parse.region_price, page, "gia lai") is None
    assert get(parse.list_price, '{"data":[{"masp":"sjc","giaban":"12.5"}]}', " SJC ") == 12.5
    assert get(parse.list_price, "no json", "SJC") is None
    assert get(parse.board_price, '{"Objects":[{"Title":"Xăng  A","EnglishTitle":"Petrol","Zone1Price":20510}]}', "petrol") == 20510.0


def test_arrays_and_lines(spark):
    body = json.dumps({"t": [0, 86400, "x", 172800], "c": [1.5, -1, 2, "3"]})
    assert [(r.date, r.close) for r in value(spark, parse.chart_closes(F.col("b"), 2.0), b=body)] == [(dt.date(1970, 1, 1), 3.0), (dt.date(1970, 1, 3), 6.0)]
    assert value(spark, parse.chart_closes(F.col("b")), b="{}") == []
    lines = {"1950 DJF 24.7 -1.5": (dt.date(1950, 2, 1), -1.5), " 1950  NDJ 1 0.5 ": (dt.date(1951, 1, 1), 0.5), "YR SEAS TOTAL ANOM": None, "1950 DJF 3": None, "1950 XXX 1 2": None}
    for line, want in lines.items():
        got = value(spark, parse.season_value(F.col("s")), s=line)
        assert (tuple(got) if got else None) == want
    assert tuple(spark.createDataFrame([("need >= 252 positive prices, have 10",)], "s string").select(*parse.needed_and_had(F.col("s"))).first()) == (252, 10)


def test_local_tables_and_fixtures(spark, tmp_path):
    (tmp_path / "a.csv").write_text("day,market,crop,price\n2024-01-01,North Hall,ONION,10\n2024-01-01,north,ONION,30\nbad,north,ONION,9\n2024-01-02,north,ONION,-1\n2024-01-02,south,ONION,7\n")
    got = landed.csv_prices(spark, f"file://{tmp_path}/*.csv", "day", "price", {"crop": "ONION"}, {"market": "NORTH"}).collect()
    assert [tuple(r) for r in got] == [(dt.date(2024, 1, 1), 20.0, dt.date(2024, 1, 2))]
    (tmp_path / "f.json").write_text(json.dumps([{"metric_code": "m", "value": "1"}, {"colour": "red"}]))
    rows = landed.all_fixtures(spark, {"macro_daily": f"file://{tmp_path}/f.json"}).orderBy("origin").collect()
    assert [(r.family, r.origin) for r in rows] == [("macro_daily", "f.json:0"), ("macro_daily", "f.json:1")]
    assert landed.all_fixtures(spark, {}).count() == 0
    for name, text in (("x", '{"code": "a", "created_at": "2024-01-01"}'), ("y", '{"code": "b", "created_at": "2024-02-01"}'), ("z", "{nothing")):
        (tmp_path / f"{name}.reg").write_text(text)
    assert [r.code for r in landed.registry(spark, f"file://{tmp_path}/*.reg", "code string, created_at string").collect()] == ["b", "a"]


def test_balance_sheet_fails_closed(spark):
    schema = "commodity_id string, attribute_id int, country string, year int, month int, unit string, value double"
    wanted = spark.createDataFrame([("c", 1, "US", "C", "stocks", "us", "t")], "commodity_id string, attribute_id int, country string, commodity_code string, metric_code string, region_code string, unit string")
    row = ("c", 1, "US", 2020, 0, " t", 5.0)
    fine = landed.balance_sheet(spark.createDataFrame([row, row[:3] + (0, 1, " t", 1.0), row[:3] + (2020, 13, " t", 1.0)], schema), wanted, "2024-05-06").first()
    assert (fine.period_start, fine.value, fine.release_date) == (dt.date(2020, 1, 1), 5.0, dt.date(2024, 5, 6))
    more = wanted.unionByName(wanted.withColumn("country", F.lit("BR")))
    for rows, asked, message in (([row[:5] + ("kg", 5.0)], wanted, "unit drift"), ([row, row], wanted, "two rows"), ([row], more, "no rows of c/1/BR"), ([], wanted, "no rows of c/1/US")):
        found = landed.balance_sheet(spark.createDataFrame(rows, schema), asked, "2024-05-06")
        with pytest.raises(Exception, match=message):
            found.collect()
        if "no rows" in message:  # whatever the result is reduced to
            with pytest.raises(Exception, match=message):
                found.select("region_code").count()


def test_zipped_files_and_wide_exports(spark, tmp_path):
    for name, text in (("a", 'Code,"Value",Note,Unit\r\nx,1.5,"one, two",t\r\ny,bad,"say ""hi""",\r\n\r\n'), ("b", "Unit,Code,Value\nkg,z,7\n")):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("read.me", "no table")
            z.writestr(f"{name}.CSV", text)
    got = sorted(landed.zipped_csv(spark, f"file://{tmp_path}", "Code string, Value double, Unit string").collect())
    assert [tuple(r) for r in got] == [("x", 1.5, "t"), ("y", None, None), ("z", 7.0, "kg")]
    assert [r.Note for r in landed.zipped_csv(spark, f"file://{tmp_path}/a.zip", "Note string").collect()] == ["one, two", 'say "hi"']
    lines = landed.zipped_lines(spark, f"file://{tmp_path}/a.zip", rows=1)
    assert lines.count() == 4 and lines.orderBy("number").first().line.startswith("Code")
    with pytest.raises(Exception, match="has no column Note"):
        landed.zipped_csv(spark, f"file://{tmp_path}/b.zip", "Note string").collect()
    with pytest.raises(Exception, match="no member"):
        landed.zipped_lines(spark, f"file://{tmp_path}/b.zip", ".txt").collect()
    rows = spark.createDataFrame([("d2", "p", 1.0), ("d1", "p", 2.0), ("d1", "q", 3.0), ("d1", "q", 5.0)], "day string, name string, v double")
    landed.export_wide(rows, "day", "name", "v", ["p", "q"], f"file://{tmp_path}/out")
    assert [tuple(r) for r in spark.read.option("header", True).csv(f"file://{tmp_path}/out").orderBy("day").collect()] == [("d1", "2.0", "4.0"), ("d2", "1.0", None)]


def test_appended_rows_keep_their_release(spark):
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(k)
    stored = spark.createDataFrame([("a", day(k), 10.0, 0) for k in range(8)] + [("b", day(k), 10.0, 1) for k in range(8)], "key string, day date, value double, revision int")
    fetched = spark.createDataFrame([("a", day(k), 10.0 if k < 8 else 20.0, day(k + 3)) for k in range(10)] + [("b", day(k), 5.0, day(k + 3)) for k in range(10)], "key string, day date, value double, release_date date")
    judged = restate.statuses(stored, fetched, "2024-01-20")
    rows = restate.new_rows(stored, fetched, judged, "2024-01-20")
    got = {(r.key, r.day): (r.release_date, r.revision) for r in rows.collect()}
    assert got["a", day(8)] == (day(11), 0) and got["a", day(9)] == (day(12), 0) and len(got) == 12
    assert {v for (k, _), v in got.items() if k == "b"} == {(day(19), 2)}
    jump = {r.key: (r.worst_pct, r.jump) for r in restate.warnings(stored, rows).collect()}
    assert jump == {"a": (100.0, True), "b": (0.0, False)}  # the step from the last stored value counts, a restatement's doesn't
    plain = restate.new_rows(stored, fetched.drop("release_date"), judged, "2024-01-20")
    assert plain.filter("key = 'a' and release_date <> day").count() == 0
