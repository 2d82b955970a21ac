"""Parsers of landed bodies and identifiers as column expressions.

A body that is not of its format gives null, or no rows; no parser makes up a value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The last month of each season of three months.
SEASON_END = {"DJF": 2, "JFM": 3, "FMA": 4, "MAM": 5, "AMJ": 6, "MJJ": 7, "JJA": 8, "JAS": 9, "ASO": 10, "SON": 11, "OND": 12, "NDJ": 1}
#: Keys that ask for the headline average of a page, and how it is written there.
HEADLINE_KEYS = ("TRUNG BINH", "TRUNG_BINH", "AVG", "AVERAGE")
HEADLINE = r"TRUNG BÌNH\s*([\d.,]{5,})\s*VNĐ/KG"
_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def plain_number(text: Column) -> Column:
    """A number whose commas and dots group thousands; null for anything else."""
    digits = F.regexp_replace(F.trim(text), "[,.]", "")
    return F.when(digits.rlike("^[0-9]+$"), digits).cast("double")


def normalised(text: Column) -> Column:
    """Common entities resolved, white space collapsed, upper case."""
    for entity, letter in _ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(letter))
    return F.upper(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def without_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", " ")


def elements(html: Column, tag: str) -> Column:
    """The outer texts of ``tag`` elements that hold no other of their kind."""
    return F.regexp_extract_all(html, F.lit(f"(?is)<{tag}\\b.*?</{tag}>"), F.lit(0))


def html_cells(html: Column, tag: str) -> Column:
    """The texts of ``tag`` elements, tags within them dropped and white space collapsed."""
    return F.transform(elements(html, tag), lambda x: F.trim(F.regexp_replace(without_tags(x), r"\s+", " ")))


def table_price(html: Column, product: Column) -> Column:
    """Of the first table row whose first cell contains ``product``, the last cell that is a positive number."""
    rows = F.transform(elements(html, "tr"), lambda tr: F.transform(elements(tr, "td"), lambda td: normalised(without_tags(td))))
    hits = F.filter(rows, lambda cells: (F.size(cells) > 0) & F.contains(F.get(cells, F.lit(0)), normalised(product)))
    numbers = F.transform(F.slice(F.get(hits, F.lit(0)), F.lit(2), F.lit(1 << 20)), plain_number)
    return F.try_element_at(F.filter(numbers, lambda n: n > 0), F.lit(-1))


def region_price(html: Column, region: Column) -> Column:
    """The headline average of a page, or the first number after the label of a region."""
    text, key = normalised(without_tags(html)), normalised(region)
    number = F.regexp_extract_all(text, F.concat(F.lit(r"\Q"), key, F.lit(r"\E\s*([\d.,]{5,})")), F.lit(1))
    headline = F.regexp_extract_all(text, F.lit(HEADLINE), F.lit(1))
    return plain_number(F.get(F.when(key.isin(*HEADLINE_KEYS), headline).otherwise(number), F.lit(0)))


def list_price(body: Column, product: Column) -> Column:
    """``giaban`` of the first item of ``data`` whose ``masp`` is ``product``, whatever the case."""
    data = F.from_json(body, "data array<struct<masp:string,giaban:string>>")["data"]
    hit = F.get(F.filter(data, lambda x: F.upper(F.trim(x["masp"])) == F.upper(F.trim(product))), F.lit(0))
    return hit["giaban"].try_cast("double")


def board_price(body: Column, title: Column) -> Column:
    """``Zone1Price`` of the first of ``Objects`` that has ``title`` as its Title or EnglishTitle."""
    items = F.from_json(body, "Objects array<struct<Title:string,EnglishTitle:string,Zone1Price:string>>")["Objects"]
    own = normalised(title)
    hit = F.get(F.filter(items, lambda x: (normalised(x["Title"]) == own) | (normalised(x["EnglishTitle"]) == own)), F.lit(0))
    return hit["Zone1Price"].try_cast("double")


def dated_prices(body: Column, sell: str, buy: str) -> Column:
    """An array of (date, sell, buy) of ``results``, whose ``datetime`` are seconds; rows without a positive sell are left out."""
    rows = F.from_json(body, f"results array<struct<datetime:string,`{sell}`:string,`{buy}`:string>>")["results"]
    day = lambda x: F.timestamp_seconds(x["datetime"].try_cast("long")).cast("date")
    typed = F.transform(rows, lambda x: F.struct(day(x).alias("date"), x[sell].try_cast("double").alias("sell"), x[buy].try_cast("double").alias("buy")))
    return F.filter(typed, lambda x: x["date"].isNotNull() & (x["sell"] > 0))


def chart_closes(body: Column, scale: float = 1.0) -> Column:
    """An array of (date, close) of the arrays ``t`` (seconds) and ``c``; closes that are no positive number are left out."""
    arrays = F.from_json(body, "t array<string>, c array<string>")
    n = F.least(F.size(arrays["t"]), F.size(arrays["c"]))
    pairs = F.arrays_zip(F.slice(arrays["t"], F.lit(1), n), F.slice(arrays["c"], F.lit(1), n))
    typed = F.transform(pairs, lambda x: F.struct(F.timestamp_seconds(x["0"].try_cast("long")).cast("date").alias("date"), (x["1"].try_cast("double") * scale).alias("close")))
    fine = F.when(n > 0, F.filter(typed, lambda x: x["date"].isNotNull() & (x["close"] > 0) & (x["close"] < float("inf"))))
    return F.coalesce(fine, F.array().cast("array<struct<date:date,close:double>>"))


def power_values(body: Column, sentinel: float = -999.0) -> Column:
    """An array of (parameter, date, value) of a map of maps by yyyymmdd; ``sentinel`` stands for no value."""
    maps = F.map_entries(F.from_json(body, "map<string,map<string,double>>"))
    day = lambda k: F.try_to_timestamp(k, F.lit("yyyyMMdd")).cast("date")
    flat = F.flatten(F.transform(maps, lambda m: F.transform(F.map_entries(m["value"]), lambda e: F.struct(m["key"].alias("parameter"), day(e["key"]).alias("date"), e["value"].alias("value")))))
    return F.filter(flat, lambda x: x["date"].isNotNull() & (x["value"] != sentinel))


def season_value(line: Column) -> Column:
    """(date, value) of a line ``year season total anomaly``: the season's last month; null for other lines."""
    parts = F.split(F.trim(line), r"\s+")
    ends = F.create_map(*(F.lit(x) for pair in SEASON_END.items() for x in pair))
    season = F.get(parts, F.lit(1))
    month = ends[season]
    year = F.get(parts, F.lit(0)).try_cast("int") + F.when(season == "NDJ", 1).otherwise(0)
    value = F.get(parts, F.lit(3)).try_cast("double")
    return F.when((F.size(parts) >= 4) & year.isNotNull() & month.isNotNull() & value.isNotNull(), F.struct(F.make_date(year, month, F.lit(1)).alias("date"), value.alias("value")))


def url_origin(url: Column) -> Column:
    """Scheme and host (with its port) of a url, lower case; null if it has no scheme."""
    found = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    return F.when(found != "", found)


def record_id(*parts: Column) -> Column:
    return F.concat_ws(":", *parts)


def short_url(url: Column, most: int = 120) -> Column:
    return F.when(F.length(url) > most, F.concat(F.lit("sha256:"), F.substring(F.sha2(url, 256), 1, 16))).otherwise(url)


def short_hash(text: Column, n: int = 12) -> Column:
    return F.substring(F.sha2(text, 256), 1, n)


def title_case(text: Column) -> Column:
    return F.initcap(F.replace(text, F.lit("_"), F.lit(" ")))


def is_url(text: Column) -> Column:
    return text.rlike("^https?://")


def needed_and_had(reason: Column) -> tuple[Column, Column]:
    """The numbers of a reason like ``need >= 252 prices, have 10``."""
    number = lambda group: F.regexp_extract(reason, r"need\s*>=\s*(\d+).*?have\s+(\d+)", group).try_cast("int")
    return number(1), number(2)
