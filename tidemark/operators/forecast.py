"""Forecasts, walk-forward backtests, selection, the forecast log and its evaluation, in DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.dates import business_day_after, trading_days_between
from tidemark.functions.features import ordered
from tidemark.operators.kernels import BAND_Z, DAMPING, DRIFT_ROWS, MEAN_ROWS, MOST_PHI

#: A model must beat the naive forecast by this share to be chosen.
MARGIN = 0.02


def numbered(series: DataFrame) -> DataFrame:
    """Rows with their number i (from 0) and the series' length n."""
    whole = Window.partitionBy("commodity_key")
    return series.withColumn("i", F.row_number().over(ordered()) - 1).withColumn("n", F.count("*").over(whole))


def cut_points(sizes: DataFrame, min_train: int, horizon: int, folds: int) -> DataFrame:
    """commodity_key, cut: distinct training sizes, evenly spread from ``min_train`` to n - ``horizon``, cut to integers."""
    spread = F.transform(F.sequence(F.lit(0), F.lit(folds - 1)), lambda k: F.floor(min_train + k * (F.col("n") - horizon - min_train) / (folds - 1)))
    return sizes.filter(F.col("n") - horizon >= min_train).select("commodity_key", F.explode(F.array_distinct(spread)).alias("cut"))


def fold_errors(series: DataFrame, models: dict[str, Column], min_train: int, horizon: int, folds: int) -> DataFrame:
    """commodity_key, cut, model, predicted, actual for models that are window expressions over the rows so far."""
    rows = numbered(series).withColumns({f"__{m}": c for m, c in models.items()})
    sizes = rows.groupBy("commodity_key").agg(F.max("n").alias("n"))
    cuts = cut_points(sizes, min_train, horizon, folds)
    each = F.array(*(F.struct(F.lit(m).alias("model"), F.col(f"__{m}").alias("predicted")) for m in models))
    made = rows.select("commodity_key", (F.col("i") + 1).alias("cut"), each.alias("__each"))
    later = rows.select("commodity_key", (F.col("i") + 1 - horizon).alias("cut"), F.col("y").alias("actual"))
    both = cuts.join(made, ["commodity_key", "cut"]).join(later, ["commodity_key", "cut"])
    return both.select("commodity_key", "cut", "actual", F.inline("__each"))


def naive_errors(series: DataFrame, min_train: int, horizon: int, folds: int) -> DataFrame:
    """For each fold the naive (last value) forecast and the actual value ``horizon`` rows on."""
    return fold_errors(series, {"naive": F.col("y")}, min_train, horizon, folds).drop("model")


def accuracy(errors: DataFrame, *by: str) -> DataFrame:
    """Folds, MAPE (without actual values of 0), RMSE and MAE by commodity and ``by``."""
    share = F.when(F.abs("actual") >= 1e-12, F.abs((F.col("actual") - F.col("predicted")) / F.col("actual")))
    return errors.groupBy("commodity_key", *by).agg(
        F.count("*").alias("n_folds"),
        (100 * F.avg(share)).alias("mape"),
        F.sqrt(F.avg(F.pow(F.col("actual") - F.col("predicted"), 2))).alias("rmse"),
        F.avg(F.abs(F.col("actual") - F.col("predicted"))).alias("mae"),
    )


def ou_parameters(series: DataFrame, steps: int) -> DataFrame:
    """phi, drift and last deviation of log prices from their causal trailing mean, for each series; fitted is false, and
    the forecast the last value, where there is too little history for ``steps``."""
    w = ordered()
    logs = numbered(series).withColumn("ly", F.log("y"))
    logs = logs.withColumn("mean", F.avg("ly").over(w.rowsBetween(1 - MEAN_ROWS, 0))).withColumn("d", F.col("ly") - F.col("mean")).withColumn("d0", F.lag("d").over(w))
    sums = logs.groupBy("commodity_key").agg(
        F.sum(F.col("d0") * F.col("d")).alias("cross"),
        F.sum(F.when(F.col("d0").isNotNull(), F.col("d0") * F.col("d0"))).alias("square"),
        F.max_by("ly", "i").alias("last_ly"),
        F.max_by("d", "i").alias("last_d"),
        F.max(F.when(F.col("i") == F.col("n") - 1 - DRIFT_ROWS, F.col("mean"))).alias("mean_then"),
        F.max_by("mean", "i").alias("mean_now"),
        F.max("n").alias("n"),
        F.count_if(F.col("ly").isNull()).alias("bad"),
    )
    fitted = (F.col("n") >= max(MEAN_ROWS + steps + 5, DRIFT_ROWS + 5, 30)) & (F.col("bad") == 0)
    phi = F.greatest(F.lit(0.0), F.least(F.lit(MOST_PHI), F.try_divide("cross", "square")))
    drift = (F.col("mean_now") - F.col("mean_then")) / DRIFT_ROWS
    return sums.select("commodity_key", F.when(fitted, F.coalesce(phi, F.lit(0.0))).alias("phi"), F.when(fitted, drift).alias("drift"), "last_ly", "last_d", fitted.alias("fitted"))


def ou_forecast(parameters: DataFrame, steps: int) -> DataFrame:
    """step, predicted: the last value moved by the damped drift and by the deviation's decay with phi."""
    k = F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step")
    rows = parameters.select("*", k)
    damped = F.col("drift") * (1 - F.pow(F.lit(DAMPING), "step")) / (1 - DAMPING)
    move = F.when(F.col("fitted"), damped + F.col("last_d") * (F.pow("phi", "step") - 1)).otherwise(0.0)
    return rows.select("commodity_key", "step", F.exp(F.col("last_ly") + move).alias("predicted"))


def log_rows(steps: DataFrame, last: DataFrame, model: str, horizons: tuple[int, ...]) -> DataFrame:
    """A pending row for the last step of each horizon that is forecast above 0; ``last`` has as_of_date and baseline."""
    own = steps.filter(F.col("step").isin(*horizons) & (F.col("predicted") > 0)).join(last, "commodity_key")
    target = F.coalesce(*(F.when(F.col("step") == h, business_day_after(F.col("as_of_date"), h)) for h in horizons))
    return own.select("commodity_key", "as_of_date", target.alias("target_date"), F.col("step").alias("horizon"), F.lit(model).alias("model"), "predicted", "baseline", F.lit("pending").alias("status"))


def updated(log: DataFrame, judged: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``log`` after an evaluation (keys, status): rows that are still pending take the new status, others keep theirs."""
    new = judged.select(*keys, F.col("status").alias("__new"))
    took = F.when(F.col("status") == "pending", F.coalesce("__new", "status")).otherwise(F.col("status"))
    return log.join(new, list(keys), "left").withColumn("status", took).drop("__new")


def pending(log: DataFrame, models: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """The pending rows by target date, optionally of some models or the first few."""
    rows = log.filter("status = 'pending'")
    if models is not None:
        rows = rows.filter(F.col("model").isin(models))
    rows = rows.orderBy("target_date", *(c for c in ("commodity_key", "as_of_date", "horizon", "model") if c in log.columns))
    return rows if limit is None else rows.limit(limit)


def best_registered(entries: DataFrame, by: str) -> DataFrame:
    """The entry of least error among those that beat the naive forecast."""
    best = entries.filter("beats_naive").groupBy(by).agg(F.min_by(F.struct("*"), F.struct("mape", "model")).alias("x"))
    return best.select("x.*")


def gram(features: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """commodity_key, a, b, total: the sums of products of the columns (1: the intercept) and of each with the target,
    which are the normal equations of a least-squares fit, by partial aggregation."""
    value = {"1": F.lit(1.0), **{c: F.col(c) for c in columns}, "target": F.col(target)}
    names = list(value)
    pairs = [(a, b) for k, a in enumerate(names[:-1]) for b in names[k:]]
    sums = features.groupBy("commodity_key").agg(*(F.sum(value[a] * value[b]).alias(f"s{k}") for k, (a, b) in enumerate(pairs)))
    rows = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"s{k}").alias("total")) for k, (a, b) in enumerate(pairs)))
    return sums.select("commodity_key", F.inline(rows))


def supply(monthly: DataFrame, harvest_months: int, import_months: int, yield_: float, loss: float, floor: float, order: str = "month") -> DataFrame:
    """q: stock, the lagged harvest (area by yield, weather, pests, quality) and lagged imports, less the loss, from a floor up."""
    w = ordered(day=order)
    lagged = lambda c, n: F.lag(c, n, 0.0).over(w)
    harvest = lagged("planted_area", harvest_months) * yield_ * F.col("weather_index") * F.col("pest_index") * (1 + F.col("quality_delta"))
    gross = F.col("inventory") + harvest + lagged("import_volume", import_months) * (1 + F.col("import_shock"))
    return monthly.withColumn("q", F.greatest(gross - loss * F.greatest(gross, F.lit(0.0)), F.lit(floor)))


def naive_interval(series: DataFrame, steps: int) -> DataFrame:
    """The last value with a band that widens with the root of the step, from the deviation of one-step log returns."""
    w = ordered()
    rows = series.withColumn("r", F.log("y") - F.log(F.lag("y").over(w)))
    own = rows.groupBy("commodity_key").agg(F.max_by("y", "price_date").alias("point"), F.stddev_samp("r").alias("sigma"))
    each = own.select("*", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"))
    wide = BAND_Z * F.col("sigma") * F.sqrt("step")
    return each.select("commodity_key", "step", "point", (F.col("point") * F.exp(-wide)).alias("lower"), (F.col("point") * F.exp(wide)).alias("upper"))


def select_model(scores: DataFrame, naive: str = "naive", margin: float = MARGIN) -> DataFrame:
    """The model of least error for each commodity if it beats the naive one by the margin, else the naive one."""
    own = scores.groupBy("commodity_key").agg(
        F.min_by("model", F.struct("mape", "model")).alias("best"),
        F.min("mape").alias("best_mape"),
        F.max(F.when(F.col("model") == naive, F.col("mape"))).alias("naive_mape"),
    )
    wins = F.col("best_mape") < F.col("naive_mape") * (1 - margin)
    return own.withColumn("selected", F.when(wins, F.col("best")).otherwise(F.lit(naive)))


def log_new(rows: DataFrame, log: DataFrame) -> DataFrame:
    """The forecasts that the log lacks; equal keys within ``rows`` count once."""
    keys = ["commodity_key", "as_of_date", "target_date", "horizon", "model"]
    return rows.dropDuplicates(keys).join(log.select(*keys), keys, "left_anti")


def evaluate(log: DataFrame, actuals: DataFrame, today: str, grace: int, expiry: int) -> DataFrame:
    """Each forecast with the earliest actual value in [target, target + grace], and its status.

    The range join is an equi-join on the commodity and the 32-day bucket of the date (a range meets two at most).
    """
    span = 32
    if grace >= span:
        raise ValueError(f"grace must be under {span} days")
    epoch = F.to_date(F.lit("1970-01-01"))
    bucket = lambda c: F.floor(F.datediff(c, epoch) / span)
    wanted = log.withColumn("__b", F.explode(F.array_distinct(F.array(bucket(F.col("target_date")), bucket(F.date_add("target_date", grace))))))
    have = actuals.select("commodity_key", F.col("price_date").alias("actual_date"), F.col("y").alias("actual"), bucket(F.col("price_date")).alias("__b"))
    hit = F.when(F.col("actual_date").between(F.col("target_date"), F.date_add("target_date", grace)), F.col("actual_date"))
    keys = list(log.columns)
    joined = wanted.join(have, ["commodity_key", "__b"], "left")
    found = joined.groupBy(*keys).agg(F.min(hit).alias("actual_date"), F.min_by(F.when(hit.isNotNull(), F.col("actual")), hit).alias("actual"))
    status = F.when(F.col("actual").isNotNull(), "evaluated").when(F.date_add("target_date", expiry) < F.to_date(F.lit(today)), "expired").otherwise("pending")
    return found.withColumn("status", status)


def fresh(forecasts: DataFrame, today: str, most_lag: int, most_skew: int) -> DataFrame:
    """``forecasts`` (with last_date) with lag and skew in trading days (of the latest date behind ``today``, of each row
    behind the latest), fresh (its skew is no larger than ``most_skew``) and refused (all of them lag more than
    ``most_lag``). Rows without a date are 999 days behind."""
    latest = forecasts.agg(F.max("last_date")).first()[0]
    newest = F.lit(latest).cast("date")
    lag = F.lit(999) if latest is None else trading_days_between(newest, F.to_date(F.lit(today)))
    skew = F.when(F.col("last_date").isNull(), 999).otherwise(trading_days_between(F.col("last_date"), newest))
    return forecasts.withColumns({"lag": lag, "skew": skew}).withColumns({"fresh": F.col("skew") <= most_skew, "refused": F.col("lag") > most_lag})


def movers(forecasts: DataFrame, k: int) -> DataFrame:
    """The ``k`` largest rises and falls of each section; rises only above 0, falls only below."""
    pct = (F.col("end_value") / F.col("last_value") - 1) * 100
    rows = forecasts.withColumn("pct", pct).filter(F.col("pct") != 0).withColumn("direction", F.when(F.col("pct") > 0, "up").otherwise("down"))
    order: Column = F.row_number().over(Window.partitionBy("section", "direction").orderBy(F.desc(F.abs("pct")), "commodity_key"))
    return rows.withColumn("rank", order).filter(F.col("rank") <= k)
