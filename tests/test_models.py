"""The supply model, the oscillator, handed-out forecasts and comparisons, against plain computations on small inputs."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import asof, cashflow, forecast, kernels, model_store, payload

CONFIG = cashflow.Config()


def months(n, start=24000):
    return [dt.date((start + k) // 12, (start + k) % 12 + 1, 1) for k in range(n)]


def monthly_rows(n, key=1, seed=3):
    r = np.random.RandomState(seed)
    area, imports, stock = (r.uniform(50, 150, n) for _ in range(3))
    price = 20 + r.uniform(0, 5, n) + np.arange(n) / 10
    return [(key, m, float(p), float(a), float(i), float(s)) for m, p, a, i, s in zip(months(n), price, area, imports, stock)]


def framed(spark, rows):
    df = spark.createDataFrame(rows, "commodity_key int, month date, price double, area double, arrivals double, stock double")
    return cashflow.frame(df, {"planted_area": "area", "import_volume": "arrivals", "inventory": "stock"})


def by_hand(rows, n_future=0, config=CONFIG):
    """price parts of the rows and of months after them with the last row's drivers, one month at a time"""
    price = [r[2] for r in rows]
    area, imports, stock = ([r[k] for r in rows] + [rows[-1][k]] * n_future for k in (3, 4, 5))
    n, q, flow = len(rows), [], []
    for t in range(n + n_future):
        gross = stock[t] + (area[t - 6] * 10.0 if t >= 6 else 0.0) + (imports[t - 1] if t >= 1 else 0.0)
        q.append(max(gross - 0.1 * max(gross, 0.0), 1e-6))
        flow.append(np.mean([price[s] * q[s] for s in range(max(0, t - 11), t + 1)]) if t < n else flow[n - 1])
    mechanical = np.array(flow) / np.array(q)
    x = np.array([[1, t, t * t] + [f(2 * np.pi * t / p) for p in (12, 6, 24) for f in (np.cos, np.sin)] for t in range(n + n_future)], float)
    beta = np.linalg.lstsq(x[:n], np.array(price) - mechanical[:n], rcond=None)[0]
    return np.array(q), np.array(flow), mechanical, x @ beta


def test_supply_model_is_the_plain_computation(spark):
    rows = monthly_rows(40)
    own = framed(spark, rows + monthly_rows(14, key=2))
    got = {(r.commodity_key, r.month): r for r in cashflow.components(own, CONFIG).collect()}
    q, flow, mechanical, rest = by_hand(rows)
    for t, m in enumerate(months(40)):
        r = got[1, m]
        assert np.allclose([r.q, r.m_flow, r.p_mechanical, r.p_rest, r.p_total], [q[t], flow[t], mechanical[t], rest[t], mechanical[t] + rest[t]])
    # fourteen months are too few for a fit, their mechanical part is there
    assert all(r.p_rest is None and r.p_total is None and r.p_mechanical > 0 for (k, _), r in got.items() if k == 2)


def test_supply_forecast_and_holdout(spark):
    rows = monthly_rows(40)
    own = framed(spark, rows)
    ahead = spark.createDataFrame([(1, m) for m in months(45)[40:]], "commodity_key int, month date")
    made = sorted(cashflow.predicted(own, cashflow.carried(own, ahead), CONFIG).collect(), key=lambda r: r.month)
    *_, mechanical, rest = by_hand(rows, 5)
    assert np.allclose([r.p_total for r in made], (mechanical + rest)[40:])
    # of 40 rows the last 8 are held out; with constant drivers the parts are those carried forward
    even = [(1, r[1], r[2], 100.0, 80.0, 90.0) for r in rows]
    got = cashflow.holdout(framed(spark, even), CONFIG).first()
    *_, mechanical, rest = by_hand(even[:32], 8)
    error = np.abs((mechanical + rest)[32:] - [r[2] for r in even[32:]])
    assert got.n_test == 8 and np.allclose([got.mae, got.rmse], [error.mean(), np.sqrt((error**2).mean())])
    assert cashflow.holdout(framed(spark, rows[:16]), CONFIG).count() == 0
    with pytest.raises(ValueError, match="inventory"):
        cashflow.frame(own.drop("inventory"), {"planted_area": "planted_area", "import_volume": "import_volume"})


def test_supply_path_starts_at_the_last_price(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(k) for k in range(900)]
    rows = [(1, d, 30.0 + (k % 40) / 10, 90.0 + k % 7, 70.0, 80.0) for k, d in enumerate(days)] + [(2, d, 5.0, 1.0, 1.0, 1.0) for d in days[:100]]
    df = spark.createDataFrame(rows, "commodity_key int, price_date date, price double, a double, i double, s double")
    daily = cashflow.frame(df, {"planted_area": "a", "import_volume": "i", "inventory": "s"})
    got = sorted(cashflow.daily_path(daily, CONFIG, 30).collect(), key=lambda r: (r.commodity_key, r.step))
    assert len(got) == 60 and all(r.target_date.weekday() < 5 for r in got)
    assert got[0].predicted == pytest.approx(rows[899][2]) and {r.predicted for r in got[30:]} == {5.0}
    for a, b in zip(got[:29], got[1:30]):  # one value a month
        assert (a.predicted == b.predicted) == (a.target_date.month == b.target_date.month)


def test_oscillator():
    # a path of the equation itself, sampled finely, is recovered and goes on as it would
    z = kernels.swing(np.array([0.5, 0.0]), 0.02, 0.01, 600)
    fine = kernels.swing(np.array([0.5, 0.0]), 0.02, 0.01, 630)
    assert np.allclose(z, fine[:600]) and np.abs(z).max() < 2.5
    assert kernels.swing(np.array([7.0, 5.0]), -5.0, 0.01, 50) is None
    days = np.arange(600.0)
    ahead = days[-1] + np.arange(1, 31)
    ly = 0.2 * z
    mu, w2, scale = kernels.oscillation(ly)
    off = ly - kernels.trailing_mean(ly)
    x = off / scale
    at, v, a = x[1:-1], x[1:-1] - x[:-2], x[2:] - 2 * x[1:-1] + x[:-2]
    gram = np.array([[((1 - at**2) * v) @ ((1 - at**2) * v), -((1 - at**2) * v) @ at], [-((1 - at**2) * v) @ at, at @ at]])
    assert np.allclose([mu, w2], np.linalg.solve(gram, [((1 - at**2) * v) @ a, -at @ a]))
    path = kernels.oscillating(ly, days, ahead)
    assert len(path) == 30 and np.abs(np.log(path) - ly[-1]).max() <= 0.5 + 1e-9
    assert np.allclose(kernels.oscillating(ly[:100], days[:100], ahead), np.exp(ly[99]))
    assert np.allclose(kernels.oscillating(np.zeros(300), days[:300], ahead), 1.0)


def series(spark):
    r = np.random.RandomState(1)
    start, rows = dt.date(2020, 1, 1), []
    swing = 0.0
    for k in range(500):
        swing = 0.9 * swing + 0.02 * r.randn()
        rows.append((1, start + dt.timedelta(k), float(50 * np.exp(swing))))
    rows += [(2, start + dt.timedelta(k), 10.0) for k in range(251)] + [(2, dt.date(2019, 1, 1), 0.0), (3, start, -1.0)]
    return spark.createDataFrame(rows, "commodity_key int, price_date date, y double")


def test_payload_holds_the_chosen_models_path(spark):
    rows = series(spark)
    made = payload.payloads(rows, horizons=(10, 30), min_train=252, folds=4, models=("ridge", "ou")).cache()
    got = {r.commodity_key: r for r in made.collect()}
    assert [got[k].available for k in (1, 2, 3)] == [True, False, False]
    assert got[2].reason == "need >= 252 prices, have 251" and got[2].horizons is None and got[3].history_points == 0 and got[3].last_price is None
    pdf = rows.filter("commodity_key = 1").toPandas()
    ly, days = kernels.positive(pdf)
    for h in (10, 30):
        own = got[1].horizons[h]
        mapes = {}
        for m in ("naive", "ridge", "ou"):
            cuts = sorted({252 + k * (500 - h - 252) // 3 for k in range(4)})
            ends = [float(kernels.MODELS[m](ly[:c], days[:c], days[c - 1] + np.arange(1, h + 1))[-1]) for c in cuts]
            true = [float(np.exp(ly[c + h - 1])) for c in cuts]
            mapes[m] = 100 * np.mean([abs((t - e) / t) for t, e in zip(true, ends)])
        best = min(("ridge", "ou"), key=mapes.get)
        want = best if mapes[best] < 0.98 * mapes["naive"] else "naive"
        assert own.model_used == want and own.backtest.folds == 4 and own.backtest.beats_naive == (want != "naive")
        assert own.backtest.mape_pct == pytest.approx(mapes[want], abs=0.006) and own.backtest.candidates["ou"] == pytest.approx(mapes["ou"], abs=0.006)
        point = kernels.MODELS[want](ly, days, days[-1] + np.arange(1, h + 1))
        assert np.allclose([p.value for p in own.points], point, atol=1e-4) and [p.step for p in own.points] == list(range(1, h + 1))
        assert all(p.lower <= p.value <= p.upper and p.date.weekday() < 5 for p in own.points)
    assert payload.path(made, 30).count() == 30
    why = {r.commodity_key: r for r in payload.explained(made, 30).collect()}
    assert why[1].model_used == got[1].horizons[30].model_used and why[2].model_used is None and why[2].reason
    assert payload.recheck(made, 30).first()[:2] == (3, 1)
    first = got[1].horizons[10].points[0]
    actuals = spark.createDataFrame([(1, first.date, first.value * 1.25), (1, dt.date(1990, 1, 1), 1.0)], "commodity_key int, price_date date, y double")
    real = payload.realized(made, actuals, 10).first()
    assert real.n == 1 and real.mae == pytest.approx(first.value * 0.25) and real.mape == pytest.approx(20.0)


def test_requests_and_pools(spark):
    scores = spark.createDataFrame(
        [(1, "naive", 10.0), (1, "ridge", 9.9), (1, "ou", 8.0), (2, "naive", 10.0), (2, "ridge", float("nan")), (3, "ridge", 1.0)], "commodity_key int, model string, mape double"
    ).withColumns({"n_folds": F.lit(4), "rmse": F.lit(1.0), "mae": F.lit(1.0)})
    asked = spark.createDataFrame([(1, "statsmodels"), (1, "xgboost"), (1, "vector"), (1, None), (4, "fourier")], "commodity_key int, family string")
    got = {(r.commodity_key, r.family): (r.status, r.model, r.error, r.beats_naive) for r in payload.run(asked, scores).collect()}
    assert got[1, "statsmodels"] == ("ok", "ridge", None, True) and got[4, "fourier"] == ("skipped", "ridge", None, False)
    assert got[1, "xgboost"] == ("skipped", "gbm", None, False) and got[1, "vector"][2] == "unsupported family vector" and got[1, None][0] == "failed"
    pools = {(r.commodity_key, r.pool): (r.choice, r.mape, r.edge) for r in payload.pools(scores, {"a": ("ridge",), "b": ("ridge", "ou")}).collect()}
    assert pools == {(1, "a"): ("naive", 10.0, 0.0), (1, "b"): ("ou", 8.0, 2.0), (2, "a"): ("naive", 10.0, 0.0), (2, "b"): ("naive", 10.0, 0.0)}


def test_kernels_of_whole_series_are_those_of_one(spark):
    rows = series(spark).filter("commodity_key < 3")
    ly, days = kernels.positive(rows.filter("commodity_key = 1").toPandas())
    got = {(r.commodity_key, r.model, r.step): r for r in kernels.forecasts(rows, 5, ("naive", "ou")).collect()}
    assert np.allclose([got[1, "ou", k].predicted for k in range(1, 6)], kernels.reverting(ly, days, days[-1] + np.arange(1, 6)))
    assert got[2, None, None].status == "unavailable" and len(got) == 11
    folds = kernels.backtest(rows, 100, 20, 3, tuple(kernels.RESEARCH)).collect()
    assert {(r.commodity_key, r.cut) for r in folds} == {(1, 100), (1, 290), (1, 480), (2, 100), (2, 165), (2, 231)}
    for r in folds:
        if r.commodity_key == 1:
            assert r.actual == pytest.approx(np.exp(ly[r.cut + 19]))
            assert r.predicted == pytest.approx(kernels.RESEARCH[r.model](ly[: r.cut], days[: r.cut], days[r.cut - 1] + np.arange(1, 21))[-1])
    assert set(forecast.accuracy(kernels.backtest(rows, 100, 20, 3), "model").toPandas()["model"]) == set(kernels.MODELS)
    wave = spark.createDataFrame([(1, dt.date(2020, 1, 1) + dt.timedelta(k), float(np.exp(0.1 * np.sin(2 * np.pi * k / 50)))) for k in range(800)], "commodity_key int, price_date date, y double")
    found = kernels.find_cycles(wave, 10).collect()
    assert abs(found[0].period - 50) < 3 and found[0].r2 > 0.9


def test_drivers_are_those_known_on_each_day(spark):
    """A later revision changes no row of the design before its release, and so no earlier fold."""
    days = [dt.date(2022, 1, 1) + dt.timedelta(k) for k in range(420)]
    r = np.random.RandomState(2)
    rain = np.repeat(r.randn(60), 7)
    y = 50 * np.exp(np.cumsum(0.01 * r.randn(420)) + 0.05 * np.concatenate([np.zeros(10), np.cumsum(rain[:-10]) / 20]))
    prices = spark.createDataFrame([(1, d, float(v)) for d, v in zip(days, y)], "commodity_key int, price_date date, y double")
    dims = spark.createDataFrame([(1,)], "commodity_key int")
    schema = "commodity_key int, dim_key int, metric_code string, observation_date date, release_date date, revision int, source_fact_id long, metric_value double"
    facts = [(1, None, "rain", days[7 * k], days[7 * k] + dt.timedelta(2), 0, k, float(rain[7 * k])) for k in range(60)]
    late = [(1, None, "rain", days[7 * k], days[350], 1, 100 + k, 99.0) for k in range(60) if 7 * k < 350]

    def rows(own):
        panel = asof.wide(asof.collapse(asof.as_of(spark.createDataFrame(own, schema), "2022-01-01", "2023-03-01", dims)), ["rain"])
        return payload.with_drivers(prices, panel, ["rain"])

    plain, revised = (sorted((r.price_date, r.drivers) for r in rows(f).collect()) for f in (facts, facts + late))
    assert plain[:350] == revised[:350] and plain[350:] != revised[350:]
    assert plain[0][1] == [0.0] and plain[2][1] == [float(rain[0])] and len(plain) == 420
    judged = [{(r.horizon): r for r in kernels.judged(rows(f).filter(F.col("price_date") < F.lit(days[350])), (10,), 200, 4, ("ridge", "gbm"), 200, 0.02).collect()} for f in (facts, facts + late)]
    assert judged[0][10].candidates == judged[1][10].candidates
    bare = kernels.judged(prices.filter(F.col("price_date") < F.lit(days[350])), (10,), 200, 4, ("ridge", "gbm"), 200, 0.02).first()
    assert set(bare.candidates) == {"ridge", "gbm"} and bare.candidates != judged[0][10].candidates
    # the fit itself: drivers are columns of the design
    ly, d = np.log(y), np.arange(420.0)
    x, later = kernels.fitted_rows(ly, d, 10, np.array([v for _, v in plain]))
    assert x.shape == (360, 10) and len(later) == 350 and np.allclose(x[:, -1], [v[0] for _, v in plain[60:]])
    path = kernels.ridge_path(ly, d, d[-1] + np.arange(1, 11), np.array([v for _, v in plain]))
    assert np.log(path[-1] / y[-1]) == pytest.approx(float(x[-1] @ kernels.ridge(x[:350], later)))


def test_supply_model_is_a_candidate(spark):
    """Seasons are what the supply model forecasts better than the last price; its folds are the daily path's."""
    days = [dt.date(2015, 1, 1) + dt.timedelta(k) for k in range(2600)]
    days = [d for d in days if d.weekday() < 5]
    rows = [(1, d, 30.0 + 8 * float(np.cos(2 * np.pi * (d.month - 1) / 12)) + (0.001 if k % 2 else 0.0), 100.0, 60.0, 70.0) for k, d in enumerate(days)]
    df = spark.createDataFrame(rows, "commodity_key int, price_date date, price double, a double, i double, s double")
    daily = cashflow.frame(df, {"planted_area": "a", "import_volume": "i", "inventory": "s"})
    prices = df.select("commodity_key", "price_date", F.col("price").alias("y"))
    folds = {r.cut: r for r in cashflow.fold_errors(daily, CONFIG, 60, 1300, 3).collect()}
    assert sorted(folds) == kernels.cut_points(len(rows), 1300, 60, 3)
    cut = sorted(folds)[1]
    alone = cashflow.daily_path(daily.filter(F.col("price_date") < F.lit(days[cut])), CONFIG, 60).filter("step = 60").first()
    assert folds[cut].predicted == pytest.approx(alone.predicted) and folds[cut].actual == pytest.approx(rows[cut + 59][2])
    made = payload.payloads(prices, (60,), 1300, 3, (), daily=daily, config=CONFIG).first().horizons[60]
    mape = 100 * np.mean([abs(f.actual - f.predicted) / f.actual for f in folds.values()])
    assert made.model_used == "supply" and made.backtest.candidates["supply"] == pytest.approx(mape, abs=0.006) and made.backtest.supply_considered
    assert made.backtest.mape_pct == pytest.approx(mape, abs=0.006) and len(made.points) == 60 and all(p.lower <= p.value <= p.upper for p in made.points)
    without = payload.payloads(prices, (60,), 1300, 3, ("ou",)).first().horizons[60]
    assert "supply" not in without.backtest.candidates and not without.backtest.supply_considered


def test_models_that_are_kept(spark, tmp_path):
    """Coefficients come back as they were fitted, score as the kernel does, and get a version each time."""
    rows = series(spark).filter("commodity_key < 3")
    coefficients = model_store.fitted(rows, 10)
    scores = spark.createDataFrame([(1, 4.0, 5.0), (2, 6.0, 5.0)], "commodity_key int, mape double, naive_mape double")
    new = model_store.entries(coefficients, scores, "ridge", 10, "t1")
    folder = f"file://{tmp_path}/models"
    assert [r.version for r in model_store.register(spark, folder, new).collect()] == [1, 1] and model_store.read(spark, folder).count() == 0
    model_store.register(spark, folder, new, allow_write=True)
    better = model_store.entries(coefficients, scores.withColumn("mape", F.lit(1.0)), "ridge2", 10, "t2").filter("commodity_key = 1")
    model_store.register(spark, folder, better, allow_write=True)
    model_store.register(spark, folder, new.filter("commodity_key = 1"), allow_write=True)
    store = model_store.read(spark, folder)
    assert sorted((r.commodity_key, r.model_code, r.version) for r in store.collect()) == [(1, "ridge", 1), (1, "ridge", 2), (1, "ridge2", 1), (2, "ridge", 1)]
    assert sorted((r.commodity_key, r.model_code, r.version) for r in model_store.latest(store).collect()) == [(1, "ridge", 2), (1, "ridge2", 1), (2, "ridge", 1)]
    assert [(r.commodity_key, r.model_code) for r in model_store.best(store).collect()] == [(1, "ridge2")]
    got = {r.price_date: r.predicted for r in model_store.scored(rows, model_store.latest(store).filter("commodity_key = 1 and model_code = 'ridge'")).collect()}
    ly, days = kernels.positive(rows.filter("commodity_key = 1").toPandas())
    last = max(got)
    assert len(got) == 500 and got[last] == pytest.approx(kernels.ridge_path(ly, days, days[-1] + np.arange(1, 11))[-1])
    store.withColumn("format", F.lit(7)).write.parquet(f"{tmp_path}/other")
    with pytest.raises(Exception, match="format 7"):
        model_store.latest(model_store.read(spark, f"file://{tmp_path}/other")).collect()


def test_stale_series_are_no_movers(spark):
    rows = spark.createDataFrame([(1, dt.date(2024, 5, 10)), (2, dt.date(2024, 5, 3)), (3, dt.date(2024, 5, 7)), (4, None)], "commodity_key int, last_date date")
    got = {r.commodity_key: (r.lag, r.skew, r.fresh, r.refused) for r in forecast.fresh(rows, "2024-05-13", 2, 3).collect()}
    assert got == {1: (1, 0, True, False), 2: (1, 5, False, False), 3: (1, 3, True, False), 4: (1, 999, False, False)}
    assert {r.refused for r in forecast.fresh(rows, "2024-06-13", 2, 3).collect()} == {True}
    assert {(r.lag, r.skew, r.fresh) for r in forecast.fresh(rows.filter("last_date is null"), "2024-05-13", 2, 3).collect()} == {(999, 999, False)}
