"""Bucketed series per key: preparation, frequency, seasonality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.columns import seconds
from plumbline.operators.metrics import measure
from plumbline.operators.spec import GRAINS

MIN_POINTS = 10
MIN_SEASONAL_POINTS = 24
MAX_LAG = 20


def _by(by: Sequence[str]) -> list:
    return list(by) or [F.lit(0)]


def to_series(
    df: DataFrame,
    metric: str,
    time: str,
    grain: str = "daily",
    by: Sequence[str] = (),
    agg: str = "SUM",
    exog: Sequence[str] = (),
    exog_agg: str = "SUM",
) -> DataFrame:
    """(by…, bucket, value[, exog…], points) without empty values.

    ``points`` is the number of buckets of the key. Keys with under ten stay; what needs
    more points says so in a row of theirs. Facts are reduced by one aggregate; everything
    later sees buckets only.
    """
    if grain not in GRAINS:
        raise ValueError(f"grain is one of {sorted(GRAINS)}")
    bucket = F.date_trunc(GRAINS[grain], F.col(time)).cast("timestamp_ntz").alias("bucket")
    aggs = [measure(metric, agg, time).cast("double").alias("value")]
    aggs += [measure(c, exog_agg, time).cast("double").alias(c) for c in exog]
    points = df.filter(F.col(time).isNotNull()).groupBy(*by, bucket).agg(*aggs).na.drop(subset=["value", *exog])
    return points.withColumn("points", F.count("*").over(W.partitionBy(*_by(by))))


def short_reason(n: Column) -> Column:
    return F.concat(F.lit(f"fewer than {MIN_POINTS} points: "), n.cast("string"))


def series_frequency(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per key: frequency, seasonal period, number of gaps and confidence; unknown for a key of one point."""
    w = W.partitionBy(*_by(by)).orderBy("bucket")
    t = seconds(F.col("bucket"))
    steps = series.withColumn("_gap", t - F.lag(t).over(w))
    # A key has one row per bucket, so its gaps are few enough for an exact median.
    median = F.percentile("_gap", F.lit(0.5)).over(W.partitionBy(*_by(by)))
    counted = steps.withColumn("_median", median).groupBy(*by).agg(
        F.max("_median").alias("median_gap_seconds"), F.count_if(F.col("_gap") > 2 * F.col("_median")).alias("gaps_detected")
    )
    days = F.col("median_gap_seconds") / 86400.0
    return counted.select(
        *by,
        "median_gap_seconds",
        "gaps_detected",
        F.when(days <= 1, "daily").when(days <= 7, "weekly").when(days <= 31, "monthly").otherwise("unknown").alias("frequency"),
        F.when(days <= 1, 7).when(days <= 7, 52).otherwise(12).alias("seasonal_period"),
        F.when(days.isNull(), 0.3).when(F.col("gaps_detected") < 3, 0.9).otherwise(0.6).alias("confidence"),
    )


def _lag_cells(series: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by…, n, cells): lag and autocorrelation for lags 1 to min(20, n/2), from one pass over the buckets."""
    by = list(by)
    whole = W.partitionBy(*_by(by))
    ordered = whole.orderBy("bucket")
    centred = series.select(*by, "bucket", (F.col("value") - F.avg("value").over(whole)).alias("_d"))
    lagged = centred.withColumns({f"_l{k}": F.lag("_d", k).over(ordered) for k in range(1, MAX_LAG + 1)})
    sums = lagged.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.sum(F.col("_d") * F.col("_d")).alias("_var"),
        *[F.sum(F.col("_d") * F.col(f"_l{k}")).alias(f"_c{k}") for k in range(1, MAX_LAG + 1)],
    )
    cells = [
        F.struct(F.lit(k).alias("lag"), (F.col(f"_c{k}") / F.nullif("_var", F.lit(0.0))).alias("acf"))
        for k in range(1, MAX_LAG + 1)
    ]
    return sums.select(*by, "n", F.filter(F.array(*cells), lambda c: c["lag"] <= F.floor(F.col("n") / 2)).alias("cells"))


def autocorrelation(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by…, n, lag, acf) for lags 1 to min(20, n/2)."""
    return _lag_cells(series, by).select(*by, "n", F.inline("cells"))


def seasonality(series: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per key: are there lags beyond the 95 % band, and which (true lags, 1 = next)."""
    band = 1.96 / F.sqrt(F.col("n").cast("double"))
    hits = F.transform(F.filter("cells", lambda c: F.abs(c["acf"]) > band), lambda c: c["lag"])
    found = _lag_cells(series, by).withColumn("lags", hits).withColumn("hits", F.size("lags"))
    enough: Column = F.col("n") >= MIN_SEASONAL_POINTS
    return found.select(
        *by,
        "n",
        band.alias("confidence_band"),
        (enough & (F.col("hits") > 0)).alias("seasonal"),
        F.when(enough, F.col("lags")).otherwise(F.array().cast("array<int>")).alias("significant_lags"),
    )
