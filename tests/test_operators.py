"""Snapshots, kernels, streaming and business days on small inputs."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemark.functions import dates
from tidemark.operators import asof, boosting, forecast, kernels
from tidemark.operators.snapshot import Cutover, Snapshot
from tidemark.streaming import ingest, panel


def test_snapshot_switches_and_rolls_back(spark, tmp_path):
    snap = Snapshot(spark, f"file://{tmp_path}/snap")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert snap.replace(one, ["k"]) == 1
    assert snap.replace(one.withColumn("v", F.upper("v")), ["k"]) == 2
    assert {r.v for r in snap.read().collect()} == {"A", "B"}
    with pytest.raises(ValueError, match="repeated grain"):
        snap.replace(one.union(one), ["k"])
    with pytest.raises(ValueError, match="no rows"):
        snap.replace(one.limit(0), ["k"])
    assert snap.roll_back() == 1
    assert {r.v for r in snap.read().collect()} == {"a", "b"}


def test_business_days(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(k) for k in range(14)]
    df = spark.createDataFrame([(d, n) for d in days for n in (1, 4, 5, 11)], "d date, n int")
    for n in (1, 4, 5, 11):
        for r in df.filter(F.col("n") == n).select("d", dates.business_day_after(F.col("d"), n).alias("e")).collect():
            want, left = r.d, n
            while left:
                want += dt.timedelta(1)
                left -= want.weekday() < 5
            assert r.e == want


def test_kernels():
    days = np.arange(800.0)
    ly = 0.1 * np.sin(2 * np.pi * days / 50) + days / 4000
    found = kernels.cycles(ly, 365.25, 10)
    assert abs(found[0][0] - 50) < 3 and kernels.cycles(ly[:80], 365.25, 10) == []
    ahead = days[-1] + np.arange(1, 31)
    assert np.allclose(kernels.ridge_path(ly[:40], days[:40], ahead), np.exp(ly[39]))
    season = 0.2 * np.sin(2 * np.pi * days / 365.25)
    assert np.allclose(np.log(kernels.fourier(season, days, ahead)), 0.2 * np.sin(2 * np.pi * ahead / 365.25), atol=0.01)
    trend = kernels.fourier(days / 100, days, ahead, damping=0.5)
    assert np.allclose(np.log(trend), days[-1] / 100 + np.cumsum(0.5 ** np.arange(1, 31)) / 100, atol=1e-6)
    low, high = kernels.band(ly, np.ones(4))
    assert np.allclose(np.log(high), -np.log(low)) and np.allclose(np.log(high)[3], 2 * np.log(high)[0])


def test_cycles_that_have_gone_do_not_stand():
    t = np.arange(1200)
    rng = np.random.default_rng(1)
    wave = np.sin(2 * np.pi * t / 40) + rng.normal(0, 0.1, 1200)
    early = np.where(t < 700, wave, np.sin(2 * np.pi * t / 90) + rng.normal(0, 0.1, 1200))
    assert kernels.standing(wave, np.array([40.0])).tolist() == [True] and kernels.standing(early, np.array([40.0])).tolist() == [False]
    both = wave + np.where(t < 500, np.sin(2 * np.pi * t / 150), 0)
    assert kernels.standing(both, np.array([40.0, 150.0])).tolist() == [True, False]
    assert kernels.standing(wave[:50], np.array([40.0])).all() and not len(kernels.standing(wave, np.array([])))


def test_scalogram_is_the_transform_by_its_definition():
    rng = np.random.default_rng(3)
    signal, scales = rng.normal(size=90), np.array([7.0, 12.5])
    got = kernels.scalogram(signal, scales)
    for k, a in enumerate(scales):
        for b in (10, 45, 80):
            u = (np.arange(90) - b) / a
            psi = np.exp(-(u**2) / kernels.WIDTH) * np.exp(-2j * np.pi * u) / np.sqrt(np.pi * kernels.WIDTH)
            assert got[k, b] == pytest.approx(abs((signal * psi).sum() / np.sqrt(a)) ** 2, rel=1e-6, abs=1e-9)


def test_explained_share_is_that_of_each_fit():
    rng = np.random.default_rng(5)
    rows, periods = np.arange(60, 400), np.array([33.0, 80.0])
    later = np.sin(2 * np.pi * rows / 33) + rng.normal(size=len(rows))
    later -= later.mean()
    for p, got in zip(periods, kernels.explained_share(later, rows, periods)):
        x = np.column_stack([np.ones(len(rows)), np.sin(2 * np.pi * rows / p), np.cos(2 * np.pi * rows / p)])
        rest = later - x @ np.linalg.lstsq(x, later, rcond=None)[0]
        assert got == pytest.approx(1 - rest @ rest / (later @ later), abs=1e-6)


def test_tree_splits_are_the_best_of_all():
    rng = np.random.default_rng(6)
    x, slope = rng.integers(0, 12, (200, 4)).astype(float), rng.normal(size=200)
    edges = boosting.edges_of(x)
    width = max(map(len, edges)) + 1
    place = boosting.binned(x, edges) + np.arange(4) * width
    column, bin_, gain = boosting.best_splits(place, slope, 4 * width, 1, width)
    value = lambda s: s.sum() ** 2 / (len(s) + boosting.LEAF_PENALTY)
    every = {(c, e): value(slope[x[:, c] <= e]) + value(slope[x[:, c] > e]) - value(slope) for c in range(4) for e in edges[c]}
    best = max(every, key=every.get)
    assert gain[0] == pytest.approx(every[best]) and (column[0], edges[column[0]][bin_[0]]) == best


def test_boosted_trees_learn_what_lines_cannot():
    rng = np.random.default_rng(7)
    x = rng.uniform(-1, 1, (600, 3))
    y = np.where(x[:, 0] * x[:, 1] > 0, 1.0, -1.0) + rng.normal(0, 0.1, 600)
    asked = rng.uniform(-1, 1, (200, 3))
    made = boosting.boosted(x, y, asked)
    assert np.mean(np.sign(made) == np.sign(asked[:, 0] * asked[:, 1])) > 0.93 and (made == boosting.boosted(x, y, asked)).all()
    assert not boosting.boosted(x[:50], y[:50], asked).any()
    assert np.allclose(boosting.boosted(np.zeros((100, 2)), np.full(100, 3.0), np.zeros((1, 2))), 3.0)


def test_features_and_ridge_by_definition():
    rng = np.random.default_rng(4)
    ly, days = rng.normal(0, 0.02, 200).cumsum(), np.arange(200.0)
    x = kernels.tabular(ly, days)
    i = 130
    day = dt.date(1970, 1, 1) + dt.timedelta(i)
    angle = 2 * np.pi * day.timetuple().tm_yday / 365.25
    want = [1, ly[i] - ly[i - 1], ly[i] - ly[i - 5], ly[i] - ly[i - 20], ly[i] - ly[i - 19 : i + 1].mean(), ly[i] - ly[i - 59 : i + 1].mean(), np.diff(ly[i - 20 : i + 1]).std(), np.sin(angle), np.cos(angle)]
    assert np.allclose(x[i - kernels.LOOK_BACK], want)
    target = rng.normal(size=len(x))
    beta = kernels.ridge(x, target)
    gradient = x.T @ (x @ beta - target) + kernels.PENALTY * np.array([0, *beta[1:]])
    assert np.abs(gradient).max() < 1e-8


def test_mean_reversion_in_both_forms(spark):
    rng = np.random.default_rng(7)
    y = np.exp(4 + rng.normal(0, 0.02, 400).cumsum())
    rows = [(c, dt.date(2020, 1, 1) + dt.timedelta(k), float(v)) for c, n in ((1, 400), (2, 100)) for k, v in enumerate(y[:n])]
    df = spark.createDataFrame(rows, "commodity_key int, price_date date, y double")
    got = {(r.commodity_key, r.step): r.predicted for r in forecast.ou_forecast(forecast.ou_parameters(df, 30), 30).collect()}
    for c, n in ((1, 400), (2, 100)):
        want = kernels.reverting(np.log(y[:n]), np.arange(float(n)), n - 1 + np.arange(1.0, 31))
        assert np.allclose([got[c, k] for k in range(1, 31)], want)
    assert np.allclose(want, y[99])


def test_future_does_not_reach_backtest(spark):
    rows = [(1, dt.date(2020, 1, 1) + dt.timedelta(k), float(100 + k % 17)) for k in range(300)]
    schema = "commodity_key int, price_date date, y double"
    cut = lambda r: spark.createDataFrame(r, schema)
    run = lambda df: sorted(r for r in kernels.backtest(df, 200, 10, 3).select("cut", "model", "predicted").collect() if r.cut == 200)
    assert run(cut(rows)) == run(cut(rows[:200] + [(c, d, y * 3) for c, d, y in rows[200:]]))
    assert [r.reason for r in kernels.forecasts(cut(rows[:9]), 5).collect()] == ["need >= 252 prices, have 9"]


def test_stream_takes_each_record_once(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    events.limit(50).write.mode("append").parquet(f"{tmp_path}/in")
    stream = ingest.once(ingest.read_landed(spark, f"{tmp_path}/in", events.schema), "event_id", "ts", "60 days")
    ingest.append_to(stream, f"{tmp_path}/out", f"{tmp_path}/check")
    assert spark.read.parquet(f"{tmp_path}/out").count() == events.count()


def test_cutover_in_two_commands(spark, tmp_path):
    """prepare stops, cutover refuses what has changed, roll_back restores, clean_up takes the candidate and orphans alone."""
    state = {"rows": [(1, dt.date(2024, 1, 1), 1.0), (1, dt.date(2024, 1, 2), 2.0)], "source": 1, "jump": False}

    def build():
        df = spark.createDataFrame(state["rows"], "commodity_key int, as_of_date date, v double")
        if state["jump"]:
            state["source"] += 1
        return df

    root = f"file://{tmp_path}/wide"
    table = Cutover(spark, root, build, lambda: state["source"], ["commodity_key", "as_of_date"], "as_of_date", "commodity_key")
    values = lambda: sorted(r.v for r in table.read().collect())
    assert table.cutover().phase == "revalidate" and table.roll_back().status == "failed" and table.clean_up().status == "cleanup_noop"
    done = table.prepare()
    assert done.status == "prepared" and done.parity["rows"] == 2 and done.parity["max_day"] == "2024-01-02" and table.current() is None
    assert table.prepare().phase == "occupied"
    assert table.cutover().status == "cutover_applied" and values() == [1.0, 2.0] and table.states()["backup"] is None
    state["rows"] = [(1, dt.date(2024, 1, 3), 9.0)]
    assert table.prepare().status == "prepared" and values() == [1.0, 2.0]
    state["jump"] = True
    refused = table.cutover()
    assert (refused.status, refused.phase) == ("failed", "final_refresh") and table.states()["candidate"] and values() == [1.0, 2.0]
    state["jump"] = False
    state["rows"] = [(1, dt.date(2024, 1, 3), 9.0), (2, dt.date(2024, 1, 3), 8.0)]  # the candidate is made anew
    assert table.cutover().status == "cutover_applied" and values() == [8.0, 9.0]
    states = table.states()
    assert states["backup"] and states["candidate"] is None and not states["orphans"]
    assert table.prepare().phase == "occupied"  # while there is a backup
    assert table.roll_back().status == "rolled_back" and values() == [1.0, 2.0] and table.states()["backup"] is None
    spark.range(3).write.parquet(f"{root}/data-left")
    assert table.prepare().status == "prepared" and table.states()["orphans"] == ["data-left"]
    assert table.clean_up().status == "cleaned" and table.states()["orphans"] == [] and values() == [1.0, 2.0]
    state["rows"] = [(1, dt.date(2024, 1, 1), 1.0)] * 2
    failed = table.prepare()
    assert failed.phase == "prepare_parity" and failed.parity["duplicate_grains"] == 1 and table.states()["candidate"] is None
    state["rows"] = []
    assert table.prepare().phase == "prepare_parity" and not table.states()["orphans"]
    (tmp_path / "wide" / "lock").write_text("x")
    with pytest.raises(RuntimeError, match="at work"):
        table.prepare()
    with pytest.raises(ValueError, match="minutes"):
        Cutover(spark, root, build, lambda: 0, ["commodity_key"], "as_of_date", "commodity_key", minutes=0)


def test_panel_follows_late_rows(spark, tmp_path):
    """After every batch the kept points are those of all facts so far, and a batch writes its own changes alone."""
    rng = random.Random(5)
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(k)

    def fact(n):
        observed = rng.randrange(40)
        return (rng.choice([1, 2, None]), rng.choice([None, 7]), rng.choice("ab"), day(observed), day(observed + rng.randrange(12)), rng.randrange(2), n, float(rng.randrange(9)))

    schema = "commodity_key int, dim_key int, metric_code string, observation_date date, release_date date, revision int, source_fact_id long, metric_value double"
    dims = spark.createDataFrame([(1,), (2,)], "commodity_key int")
    facts = [fact(n) for n in range(150)]
    folder, seen = f"file://{tmp_path}/panel", []
    for number, size in enumerate((90, 1, 59)):
        batch = facts[len(seen) : len(seen) + size]
        seen += batch
        panel.apply(spark, folder, spark.createDataFrame(batch, schema), number, dims)
        if number == 2:  # a batch that runs twice
            panel.apply(spark, folder, spark.createDataFrame(batch, schema), number, dims)
        got = {tuple(r[:5]) for r in panel.intervals(panel.points(spark, folder)).select(*asof.KEYS, "since", "until").collect()}
        whole = asof.winners(spark.createDataFrame(seen, schema), dims)
        runs = whole.groupBy(*asof.KEYS, "winner").agg(F.min("since").alias("since"), F.max(F.coalesce("until", F.to_date(F.lit("9999-12-31")))).alias("until"))
        want = {(r.commodity_key, r.dim_key, r.metric_code, r.since, None if r.until.year == 9999 else r.until) for r in runs.collect()}
        assert got == want
        held = {(*r[:4], r.winner) for r in panel.points(spark, folder).select(*asof.KEYS, "since", "winner").collect()}
        assert held == {(r.commodity_key, r.dim_key, r.metric_code, r.since, r.winner) for r in runs.select(*asof.KEYS, "since", "winner").collect()}
    written = {r.batch: r["count"] for r in spark.read.schema(panel.POINTS).parquet(folder).groupBy("batch").count().collect()}
    assert written[0] > 20 and written.get(1, 0) <= 6  # one fact of no commodity has two keys
    panel.compact(spark, folder, f"file://{tmp_path}/compact")
    assert {tuple(r) for r in panel.points(spark, f"file://{tmp_path}/compact").collect()} == {tuple(r) for r in panel.points(spark, folder).collect()}
    spark.createDataFrame(facts[:60], schema).repartition(2).write.parquet(f"{tmp_path}/in")
    panel.follow(ingest.read_landed(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, 1), f"{tmp_path}/out", f"{tmp_path}/check", dims)
    spark.createDataFrame(facts[60:], schema).write.mode("append").parquet(f"{tmp_path}/in")
    panel.follow(ingest.read_landed(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, 1), f"{tmp_path}/out", f"{tmp_path}/check", dims)
    assert {tuple(r) for r in panel.points(spark, f"{tmp_path}/out").collect()} == {tuple(r) for r in panel.points(spark, folder).collect()}
