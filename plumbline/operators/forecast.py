"""Forecasts of many bucketed series in parallel.

A series is one row with its buckets in arrays: one value per bucket, never facts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions import fits as X
from plumbline.functions.tails import root_p
from plumbline.operators.series import MIN_POINTS, series_frequency, short_reason
from plumbline.plans.staging import checkpoint_parquet, join_on_group

MODELS = ("arima", "sarimax", "ets")
ETS_SEASON = 12
# Published response surface of the unit-root statistic with a constant, in powers of 1/rows.
CRITICAL = {
    "1%": (-3.43035, -6.5393, -16.786, -79.433),
    "5%": (-2.86154, -2.8903, -4.234, -40.040),
    "10%": (-2.56677, -1.5384, -2.809, 0.0),
}


def _keyed(series: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (series, list(by)) if by else (series.withColumn("_all", F.lit(0)), ["_all"])


def _folded(series: DataFrame, keys: Sequence[str], exog: Sequence[str] = ()) -> DataFrame:
    """One row per key: n, ``y`` and ``x0`` … in order of the bucket."""
    names = ["value", *exog]
    points = F.array_sort(F.collect_list(F.struct("bucket", *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)])))
    rows = series.groupBy(*keys).agg(points.alias("_points"))
    arrays = {("y" if i == 0 else f"x{i - 1}"): F.col(f"_points.c{i}") for i in range(len(names))}
    return rows.withColumns({**arrays, "n": F.size("_points").cast("long")}).drop("_points")


def _tested(rows: DataFrame, max_lag: int | None = None) -> DataFrame:
    """Add lag, statistic, p-value and decision of the unit-root test."""
    usable = (F.col("n") >= MIN_POINTS) & (F.array_max("y") > F.array_min("y"))
    lag = F.when(usable, X.unit_root_lag(F.col("y"), X.largest_lag(F.col("n"), max_lag)))
    rows = checkpoint_parquet(rows.withColumn("adf_lag", lag))
    rows = rows.withColumn("adf_statistic", F.when(F.col("adf_lag").isNotNull(), X.unit_root_t(F.col("y"), F.coalesce("adf_lag", F.lit(0)))))
    return checkpoint_parquet(rows.withColumn("adf_p", root_p(F.col("adf_statistic"))).withColumn("is_stationary", F.col("adf_p") < 0.05))


def adf(series: DataFrame, by: Sequence[str] = (), max_lag: int | None = None) -> DataFrame:
    """Unit-root test per key: statistic, p-value, decision and the critical values for its number of rows.

    The number of lagged differences, up to ``max_lag``, is chosen by AIC on a common
    sample. A key with under ten points or without change is not tested: no statistic,
    p-value 1, not stationary.
    """
    keyed, keys = _keyed(series, by)
    rows = (F.col("n") - 1 - F.col("adf_lag")).cast("double")
    level = lambda c: c[0] + c[1] / rows + c[2] / (rows * rows) + c[3] / (rows * rows * rows)
    levels = F.create_map(*[x for name, c in CRITICAL.items() for x in (F.lit(name), level(c))])
    tested = _tested(_folded(keyed, keys), max_lag)
    return tested.select(*keys, "n", "adf_statistic", "adf_p", "is_stationary", "adf_lag", levels.alias("critical_values")).drop("_all")


def _arima(rows: DataFrame, periods: int, weights: Sequence[float] | None) -> DataFrame:
    plain = F.col("d") == 0
    rows = rows.filter(F.size("z") >= 3).withColumn("_centre", F.when(plain, X.mean(F.col("z"))).otherwise(0.0))
    rows = rows.withColumn("_w", F.transform("z", lambda v: v - F.col("_centre")))
    rows = checkpoint_parquet(rows.withColumn("_weights", X.arma_weights("_w", weights)))
    return rows.withColumn("_fit", X.arma_forecast(F.col("y"), F.col("_w"), F.col("_centre"), F.col("d"), F.col("_weights"), periods))


def _ets(rows: DataFrame, periods: int, weights: Sequence[float] | None) -> DataFrame:
    rows = rows.filter(F.col("n") >= 2 * ETS_SEASON)
    rows = checkpoint_parquet(rows.withColumn("_weights", X.seasonal_weights("y", ETS_SEASON, weights)))
    return rows.withColumn("_fit", X.seasonal_forecast(F.col("y"), ETS_SEASON, F.col("_weights"), periods))


def _regression(rows: DataFrame, periods: int, count: int, factor: float) -> DataFrame:
    """(1,d,1) × (1,d,1,season) with outside columns, in two least-squares stages.

    The residuals of a long autoregression (short lags, the season and one beyond it, the
    outside columns) stand in for the shocks; the series is then regressed on its own
    value and shock one step, one season and one season and a step back. All columns are
    differenced as the series is, once more over the season if that is long enough;
    otherwise the seasonal terms are left out. Outside columns keep their last value,
    times ``factor``.
    """
    season, differenced = F.col("seasonal_period").cast("int"), F.col("d") == 1
    long = F.size("z") - F.when(differenced, season).otherwise(0)
    rows = rows.withColumn("_seasonal", (season > 1) & (long >= 3 * season + 8 + count))
    seasonal = F.col("_seasonal")
    twice = differenced & seasonal
    paths = {}
    for j in range(count):
        path = F.concat(F.col(f"x{j}"), F.array_repeat(F.element_at(F.col(f"x{j}"), -1) * factor, periods))
        path = F.when(differenced, X.differences(path)).otherwise(path)
        paths[f"_a{j}"] = F.when(twice, X.differences(path, season)).otherwise(path)
    rows = rows.withColumns(paths | {"_z": F.when(twice, X.differences(F.col("z"), season)).otherwise(F.col("z"))})
    z, size = F.col("_z"), F.size("_z")
    first = F.when(seasonal, season + 1).otherwise(X.LONG_LAGS)
    second = first + F.when(seasonal, season + 1).otherwise(1)
    rows = rows.withColumn("_first", first).withColumn("_second", second).withColumn("_m", size - second)
    active = count + 2 + F.when(seasonal, 4).otherwise(0) + F.when(differenced, 0).otherwise(1)
    rows = rows.filter(F.col("_m") >= active + 2)

    def back(a: Column, start: Column, rest: Column, lag: Column | int, only: Column | None = None) -> Column:
        """The values ``lag`` steps before those from place ``start`` (from 0) on; zeros, which weigh nothing, where not ``only``."""
        own = F.slice(a, start + 1 - lag, rest)
        return own if only is None else F.when(only, own).otherwise(F.array_repeat(F.lit(0.0), rest))

    def constant(rest: Column) -> Column:
        return F.array_repeat(F.when(differenced, 0.0).otherwise(1.0), rest)

    at, rest = F.col("_first"), size - F.col("_first")
    stage = [constant(rest), *[back(z, at, rest, k) for k in range(1, X.LONG_LAGS + 1)], back(z, at, rest, season, seasonal)]
    stage += [back(z, at, rest, season + 1, seasonal), *[back(F.col(f"_a{j}"), at, rest, 0) for j in range(count)]]
    shocks = X.swept(F.array(*stage, back(z, at, rest, 0)), F.lit(len(stage)))["left"][0]
    rows = checkpoint_parquet(rows.withColumn("_e", F.concat(F.array_repeat(F.lit(0.0), at), shocks)))
    at, m, e = F.col("_second"), F.col("_m"), F.col("_e")
    columns = [back(a, at, m, lag, only) for a in (z, e) for lag, only in ((1, None), (season, seasonal), (season + 1, seasonal))]
    columns += [*[back(F.col(f"_a{j}"), at, m, 0) for j in range(count)], constant(m)]
    beta, sse = X.least_squares(columns, back(z, at, m, 0))
    rows = checkpoint_parquet(rows.withColumn("_b", F.array(*beta)).withColumn("_sse", sse))
    b = F.col("_b")
    # What lies a season back without one does not matter: its weight is zero.
    near, far = F.when(seasonal, season).otherwise(1), F.when(seasonal, season + 1).otherwise(1)
    lags = (F.lit(1), near, far)
    outside = lambda h: sum((b[6 + j] * F.col(f"_a{j}")[size + h] for j in range(count)), F.lit(0.0))
    steps = F.sequence(F.lit(0), F.lit(periods - 1))

    def ahead(s: Column, h: Column) -> Column:
        own = sum((b[i] * F.element_at(s["z"], -lag) + b[3 + i] * F.element_at(s["e"], -lag) for i, lag in enumerate(lags)), b[6 + count])
        return F.struct(F.concat(s["z"], F.array(own + outside(h))).alias("z"), F.concat(s["e"], F.array(F.lit(0.0))).alias("e"))

    path = F.slice(F.aggregate(steps, F.struct(z.alias("z"), e.alias("e")), ahead)["z"], size + 1, periods)

    def added(out: Column, v: Column) -> Column:
        """The differences undone, given all values so far."""
        far_back = F.when(twice, F.element_at(out, -near) - F.element_at(out, -far)).otherwise(0.0)
        return F.concat(out, F.array(v + F.when(differenced, F.element_at(out, -1)).otherwise(0.0) + far_back))

    mean = F.slice(F.aggregate(path, F.col("y"), added), F.size("y") + 1, periods)

    def response(s: Column, h: Column) -> Column:
        before = lambda a, lag: F.when(h >= lag, F.try_element_at(a, -lag)).otherwise(0.0)
        own = F.when(h == 0, 1.0).otherwise(sum((b[i] * before(s["z"], lag) for i, lag in enumerate(lags)), F.lit(0.0)))
        own = own + sum((F.when(h == lag, b[3 + i]).otherwise(0.0) for i, lag in enumerate(lags)), F.lit(0.0))
        summed = own + F.when(differenced, before(s["y"], lags[0])).otherwise(0.0)
        summed = summed + F.when(twice, before(s["y"], near) - before(s["y"], far)).otherwise(0.0)
        return F.struct(F.concat(s["z"], F.array(own)).alias("z"), F.concat(s["y"], F.array(summed)).alias("y"))

    none = F.array().cast("array<double>")
    psi = F.aggregate(steps, F.struct(none.alias("z"), none.alias("y")), response)["y"]
    half = X._band(psi, F.col("_sse") / m)
    aic, bic = X.criteria(F.col("_sse"), m, active + 1, F.size("y"))
    return rows.withColumn("_fit", F.struct(mean.alias("mean"), half.alias("half"), aic.alias("aic"), bic.alias("bic")))


def fit_models(
    series: DataFrame,
    periods: int = 12,
    by: Sequence[str] = (),
    exog: Sequence[str] = (),
    models: Sequence[str] = MODELS,
    scenario: float | None = None,
    weights: Mapping[str, Sequence[float]] | None = None,
    difference: int | None = None,
) -> DataFrame:
    """Every model that could be fitted, one row per (key, model, step), with status ``ok``.

    A key that no model fits has one row without model and step, whose status and reason
    say why: under ten points, or too few for every model asked for.

    ``weights`` fixes the parameters of a model (arima: two, ets: three) instead of
    picking them from the grids; ``difference`` (0 or 1) overrules the stationarity test.

    Outside columns keep their last value. With ``scenario`` a further model name,
    ``scenario``, carries the outside-regressor forecast with that value scaled.
    """
    if difference not in (None, 0, 1):
        raise ValueError("difference is 0 or 1")
    # Buckets are few and read twice; what they are made of is read once.
    keyed, keys = _keyed(checkpoint_parquet(series), by)
    frequency = checkpoint_parquet(series_frequency(keyed, keys).select(*keys, "seasonal_period", "frequency", "gaps_detected"))
    every = join_on_group(_tested(_folded(keyed, keys, exog)), frequency, keys)
    rows = every.filter(F.col("n") >= MIN_POINTS)
    d = F.when(F.col("is_stationary"), 0).otherwise(1) if difference is None else F.lit(difference)
    rows = rows.withColumn("d", d)
    rows = checkpoint_parquet(rows.withColumn("z", F.when(F.col("d") == 1, X.differences(F.col("y"))).otherwise(F.col("y"))))
    tries = [(name, name, 1.0) for name in models] + ([("scenario", "sarimax", scenario)] if scenario is not None else [])
    out = None
    for label, name, factor in tries:
        given = (weights or {}).get(name)
        if name == "sarimax" and not exog:
            continue
        fitted = _arima(rows, periods, given) if name == "arima" else _ets(rows, periods, given) if name == "ets" else _regression(rows, periods, len(exog), factor)
        fitted = fitted.select(*keys, F.lit(label).alias("model"), "_fit", "n", "adf_p", "is_stationary", "frequency", "gaps_detected")
        out = fitted if out is None else out.unionByName(fitted)
    if out is None:
        raise ValueError("no model can be fitted without outside columns")
    fit = checkpoint_parquet(out)
    same = None
    none = fit.select(*[F.col(c).alias(f"_f_{c}") for c in keys]).distinct()
    for c in keys:
        equal = F.col(c).eqNullSafe(F.col(f"_f_{c}"))
        same = equal if same is None else same & equal
    left = every.join(none, same, "left_anti")
    steps = fit.select("*", F.posexplode(F.arrays_zip(F.col("_fit.mean").alias("mean"), F.col("_fit.half").alias("half"))).alias("_h", "_s"))
    known = ["n", "adf_p", "is_stationary", "frequency", "gaps_detected"]
    done = steps.select(
        *keys,
        "model",
        (F.col("_h") + 1).cast("int").alias("step"),
        F.col("_s")["mean"].alias("forecast"),
        (F.col("_s")["mean"] - F.col("_s")["half"]).alias("lower"),
        (F.col("_s")["mean"] + F.col("_s")["half"]).alias("upper"),
        F.col("_fit.aic").alias("aic"),
        F.col("_fit.bic").alias("bic"),
        *known,
        F.lit("ok").alias("status"),
        F.lit(None).cast("string").alias("reason"),
    )
    short = F.col("n") < MIN_POINTS
    empty = [F.lit(None).cast(kind).alias(c) for c, kind in done.dtypes if c in ("model", "step", "forecast", "lower", "upper", "aic", "bic")]
    status = F.when(short, "insufficient_data").otherwise("no_model").alias("status")
    reason = F.when(short, short_reason(F.col("n"))).otherwise(F.lit("too few points for every model")).alias("reason")
    return done.unionByName(left.select(*keys, *empty, *known, status, reason)).drop("_all")


def best_model(fits: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The rows of the model with the lowest AIC of each key."""
    w = W.partitionBy(*(by or [F.lit(0)])).orderBy("aic", "model")
    return fits.withColumn("_rank", F.dense_rank().over(w)).filter("_rank = 1").drop("_rank")


def forecast(
    series: DataFrame, periods: int = 12, by: Sequence[str] = (), exog: Sequence[str] = (), model: str = "auto"
) -> DataFrame:
    """Forecast steps with bands, of the best model or of the one named."""
    models = [m for m in MODELS if exog or m != "sarimax"] if model == "auto" else [model]
    return best_model(fit_models(series, periods, by, exog, models), by)


def forecast_trend(slope: Column, mean: Column) -> Column:
    """up, down or flat by the slope in percent of the mean."""
    percent = F.coalesce(slope / F.nullif(mean, F.lit(0.0)) * 100, F.lit(0.0))
    return F.when(percent > 5, "up").when(percent < -5, "down").otherwise("flat")


def forecast_confidence(stationary: Column, n: Column, aic: Column) -> Column:
    """0.5, more for a stationary and for a long series, less for a poor fit."""
    score = F.lit(0.5) + F.when(stationary, 0.2).otherwise(0.0)
    score = score + F.when(n > 50, 0.2).when(n > 30, 0.1).otherwise(0.0)
    score = score - F.when(aic > 2 * n, 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def forecast_notes(stationary: Column, gaps: Column, aic: Column) -> Column:
    notes = F.concat_ws(
        "; ",
        F.when(~stationary, F.lit("series not stationary, differences were modelled")),
        F.when(gaps > 2, F.concat(gaps.cast("string"), F.lit(" gaps in time"))),
        F.when(aic > 1000, F.lit("poor information criterion")),
    )
    return F.when(notes == "", "no remarks").otherwise(notes)


def summarize_forecast(steps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per key: model, direction, confidence, notes, status and reason.

    A key without a forecast has no model, no total and no confidence; its notes are the reason.
    """
    x = F.col("step").cast("double")
    per_key = steps.groupBy(*by, "model", "n", "aic", "bic", "is_stationary", "frequency", "gaps_detected", "status", "reason").agg(
        F.count("step").alias("periods"),
        F.sum("forecast").alias("forecast_total"),
        F.regr_slope("forecast", x).alias("_slope"),
        F.avg("forecast").alias("_mean"),
    )
    stationary, n, aic, done = F.col("is_stationary"), F.col("n"), F.col("aic"), F.col("status") == "ok"
    return per_key.select(
        *by,
        F.col("model").alias("model_selected"),
        n.alias("sample_size"),
        "periods",
        "forecast_total",
        "aic",
        "bic",
        "is_stationary",
        "frequency",
        F.when(F.col("periods") < 2, "flat").otherwise(forecast_trend(F.col("_slope"), F.col("_mean"))).alias("trend_direction"),
        F.when(done, forecast_confidence(stationary, n, aic)).otherwise(0.0).alias("model_confidence"),
        F.when(done, forecast_notes(stationary, F.col("gaps_detected"), aic)).otherwise(F.col("reason")).alias("notes"),
        "status",
        "reason",
    )


def simulate(
    series: DataFrame,
    exog: str,
    delta_percent: float,
    periods: int = 12,
    by: Sequence[str] = (),
    models: Sequence[str] = MODELS,
    difference: int | None = None,
) -> DataFrame:
    """Forecast totals as things are and with ``exog`` changed, and the difference, one row per key.

    The baseline is the best of ``models``; the scenario is the outside-regressor model.
    ``status`` and ``reason`` say why a key has no forecast or no scenario.
    """
    by = list(by)
    factor = 1 + delta_percent / 100.0
    fits = fit_models(series, periods, by, [exog], models, factor, difference=difference)
    changed = F.coalesce(F.col("model"), F.lit("")) == "scenario"
    keyed = W.partitionBy(*(by or [F.lit(0)]), changed).orderBy("aic", "model")
    base = ~changed & (F.col("_rank") == 1)
    joined = fits.withColumn("_rank", F.dense_rank().over(keyed)).groupBy(*by).agg(
        F.max(F.when(base, F.col("model"))).alias("baseline_model"),
        F.sum(F.when(base, F.col("forecast"))).alias("baseline_total"),
        F.sum(F.when(changed, F.col("forecast"))).alias("scenario_total"),
        F.max("status").alias("_status"),
        F.max("reason").alias("_reason"),
    )
    impact = F.col("scenario_total") - F.col("baseline_total")
    without = (F.col("_status") == "ok") & F.col("scenario_total").isNull()
    return joined.select(
        *by,
        "baseline_model",
        "baseline_total",
        "scenario_total",
        F.lit(float(delta_percent)).alias("delta_percent"),
        impact.alias("impact_absolute"),
        F.when(impact.isNotNull(), F.coalesce(impact / F.nullif("baseline_total", F.lit(0.0)) * 100, F.lit(0.0))).alias("impact_percent"),
        F.when(without, "no_scenario").otherwise(F.col("_status")).alias("status"),
        F.when(without, "too few points for the model with outside columns").otherwise(F.col("_reason")).alias("reason"),
    )
