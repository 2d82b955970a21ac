"""The as-of panel against its definition, and what a later release may not change."""

from __future__ import annotations

import datetime as dt
import random

from tidemark.operators import asof

DAY = dt.date(2024, 1, 1)
SCHEMA = "commodity_key int, dim_key int, metric_code string, observation_date date, release_date date, revision int, metric_value double, source_fact_id long"


def day(n: int) -> dt.date:
    return DAY + dt.timedelta(n)


def facts(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        obs = rng.randrange(20)
        rows.append((rng.choice([1, 2]), rng.choice([None, 1]), "m", day(obs), day(obs + rng.randrange(6)), rng.randrange(3), float(k), k))
    return rows


def brute(rows: list[tuple], last: int) -> set[tuple]:
    out = set()
    for t in range(last + 1):
        for c, d in {(r[0], r[1]) for r in rows}:
            seen = [r for r in rows if r[:2] == (c, d) and r[3] <= day(t) and r[4] <= day(t)]
            if seen:
                best = max(seen, key=lambda r: (r[3], r[4], r[5], r[7]))
                out.add((day(t), c, d, best[6]))
    return out


def run(spark, rows: list[tuple], last: int) -> set[tuple]:
    dims = spark.createDataFrame([(1,), (2,)], "commodity_key int")
    df = asof.as_of(spark.createDataFrame(rows, SCHEMA), str(DAY), str(day(last)), dims)
    return {(r.as_of_date, r.commodity_key, r.dim_key, r.metric_value) for r in df.collect()}


def test_same_as_definition(spark):
    rows = facts(80, 1)
    assert run(spark, rows, 25) == brute(rows, 25)


def test_late_revision_of_an_old_date_does_not_win(spark):
    rows = [(1, None, "m", day(0), day(0), 0, 1.0, 1), (1, None, "m", day(1), day(1), 0, 2.0, 2), (1, None, "m", day(0), day(4), 1, 9.0, 3)]
    assert {r[3] for r in run(spark, rows, 6) if r[0] >= day(4)} == {2.0}


def test_the_future_changes_nothing_before_it(spark):
    rows = facts(60, 2)
    more = [(c, d, m, o, day(15 + k % 3), 9, -1.0, 1000 + k) for k, (c, d, m, o, *_) in enumerate(rows)]
    before = {r for r in run(spark, rows, 25) if r[0] < day(15)}
    assert before == {r for r in run(spark, rows + more, 25) if r[0] < day(15)}


def test_rows_of_no_commodity_reach_each(spark):
    dims = spark.createDataFrame([(1, "a"), (2, "b")], "commodity_key int, commodity_code string")
    rows = spark.createDataFrame([(None, None, "m", DAY, DAY, 0, 5.0, 1), (1, None, "m", DAY, DAY, 0, 6.0, 2), (7, None, "m", DAY, DAY, 0, 7.0, 3)], SCHEMA)
    got = {(r.commodity_key, r.metric_value) for r in asof.for_every_commodity(rows, dims).collect()}
    assert got == {(1, 5.0), (2, 5.0), (1, 6.0)}


def test_empty(spark):
    assert run(spark, [], 5) == set()
