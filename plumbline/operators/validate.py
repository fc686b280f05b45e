"""Grading results: checks, confidence, verdict, evidence and selection.

Everything is a column of the results table, so one row per group costs no more than
one row per spec.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.columns import seconds
from plumbline.plans.staging import checkpoint_parquet, join_on_group

MIN_ROWS = 30
LABELS = {"high": 3, "medium": 2, "low": 1}
VERDICTS = {"accept": 2, "weak_signal": 1, "reject": 0}


class _Checks:
    """Collects named checks and the factors they put on the confidence."""

    def __init__(self) -> None:
        self.factor: Column = F.lit(1.0)
        self.passed: list[Column] = []
        self.failed: list[Column] = []
        self.reasons: list[Column] = []

    def add(
        self, name: str, applies: Column, good: Column, if_good: float = 1.0, if_bad: float = 1.0, why: str = "", *figures: Column, failed: str = ""
    ) -> None:
        """``why`` is a format of ``figures``; ``failed`` the name under which a failure is listed, if another."""
        applies, good = F.coalesce(applies, F.lit(False)), F.coalesce(good, F.lit(False))
        self.passed.append(F.when(applies & good, F.lit(name)))
        self.failed.append(F.when(applies & ~good, F.lit(failed or name)))
        if why:
            self.reasons.append(F.when(applies & ~good, F.format_string(why, *figures) if figures else F.lit(why)))
        self.factor = self.factor * F.when(applies & good, if_good).when(applies & ~good, if_bad).otherwise(1.0)


def validate(results: DataFrame, table_rows: int | None = None) -> DataFrame:
    """Add ``confidence_score``, ``verdict``, ``passed_checks``, ``failed_checks`` and ``rejection_reason``.

    The reason says in words, with its figures, what each failed check found; null if none failed.

    Reads the results columns; an optional ``is_stable`` column comes from
    ``stability_corr`` or ``stability_trend``. ``table_rows`` stands in for a missing
    sample size, at a price.
    """
    have = set(results.columns)

    def col(name: str, kind: str = "double") -> Column:
        return F.col(name) if name in have else F.lit(None).cast(kind)

    kind = F.col("analysis_type")
    always = F.lit(True)
    size = F.coalesce(col("sample_size", "bigint"), F.lit(table_rows).cast("bigint"))
    checks = _Checks()
    checks.add("sample_size_reported", always, col("sample_size", "bigint").isNotNull(), 1.0, 0.3, "sample size not reported", failed="sample_size_missing")
    checks.add("sample_size_adequate", always, size >= MIN_ROWS, 1.0, 0.2, f"sample size %d below {MIN_ROWS}", size)

    forecast = kind == "forecast"
    checks.add("model_confidence", forecast & col("model_confidence").isNotNull(), col("model_confidence") >= 0.5, 1.0, 1.0, "model confidence %.3f below 0.500", col("model_confidence"))
    checks.add("aic_reported", forecast & col("aic").isNotNull(), always)
    checks.add("forecast_horizon_valid", forecast & (col("periods", "int") > 0), always)

    anomaly = kind == "anomaly"
    rate = F.coalesce(col("anomaly_rate"), F.lit(0.0))
    checks.add("anomalies_found", anomaly, F.coalesce(col("anomalies_found", "bigint"), F.lit(0)) != 0, 1.0, 0.1, "no anomalies found")
    checks.add("anomaly_rate_reasonable", anomaly, rate <= 0.3, 1.0, 0.5, "anomaly rate %.3f above 0.300", rate)
    checks.add("high_severity_anomalies", anomaly & (col("mean_severity") > 2.0), always, 1.1)

    correlation = kind == "correlation"
    p, r = col("p_value"), col("correlation")
    checks.add("p_value_significant", correlation & p.isNotNull(), p <= 0.05, 0.95, 0.3, "p-value %.3f above 0.050", p)
    checks.add("correlation_strength", correlation & r.isNotNull(), F.abs(r) >= 0.3, 0.9, 0.4, "correlation %.3f weaker than 0.300", r)

    causal = kind == "causal"
    trust = col("causal_confidence", "string")
    weak = trust.isin("low", "none")
    checks.add("causal_confidence", causal & weak, F.lit(False), 1.0, 0.3, "causal confidence is %s", trust)
    checks.add("causal_confidence_medium", causal & (trust == "medium"), always, 0.8)
    checks.add("causal_confidence_high", causal & trust.isNotNull() & ~weak & (trust != "medium"), always)
    checks.add("refutation_tests", causal & (col("refutations_run", "int") > 0), col("refutations_passed", "int") >= 2, 1.05, 0.7, "%d of %d refutation tests passed", F.coalesce(col("refutations_passed", "int"), F.lit(0)), col("refutations_run", "int"))
    error = col("standard_error")
    checks.add("standard_error_available", causal, error.isNotNull() & (error != 0), 1.0, 0.6, "no standard error")

    trend = kind == "trend"
    r2 = col("r_squared")
    checks.add("trend_direction_detected", trend & (F.length(col("trend_direction", "string")) > 0), always)
    checks.add("trend_fit", trend & r2.isNotNull(), r2 >= 0.3, 1.0, 0.5, "r squared %.3f below 0.300", r2)

    stable = col("is_stable", "boolean")
    checks.add("temporal_stability", kind.isin("correlation", "trend") & stable.isNotNull(), stable, 1.0, 0.6, "not stable over time")
    checks.add("data_quality", always, ~(F.coalesce(col("null_percentage"), F.lit(0.0)) > 50), 1.0, 0.3, "%.1f percent of the values are null", col("null_percentage"))

    def present(marks: list[Column]) -> Column:
        return F.filter(F.array(*marks), lambda m: m.isNotNull())

    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), checks.factor))
    graded = results.withColumns(
        {"confidence_score": score, "passed_checks": present(checks.passed), "failed_checks": present(checks.failed)}
    ).withColumn("rejection_reason", F.nullif(F.concat_ws("; ", *checks.reasons), F.lit("")))
    c = F.col("confidence_score")
    return graded.withColumn("verdict", F.when(c > 0.75, "accept").when(c >= 0.4, "weak_signal").otherwise("reject"))


def label_confidence(validated: DataFrame) -> DataFrame:
    """Add the label that readers see: high, medium or low."""
    c = F.col("confidence_score")
    return validated.withColumn("confidence_label", F.when(c >= 0.75, "high").when(c >= 0.4, "medium").otherwise("low"))


def level(column: str, levels: dict[str, int]) -> Column:
    """A label column as a number to sort by."""
    out = F.lit(0)
    for name, value in levels.items():
        out = F.when(F.col(column) == name, value).otherwise(out)
    return out


def rank_results(labelled: DataFrame, *ties: str) -> DataFrame:
    """Best label first, then best verdict, then the named columns."""
    return labelled.orderBy(level("confidence_label", LABELS).desc(), level("verdict", VERDICTS).desc(), *ties)


def key_evidence(results: DataFrame, limit: int = 4) -> DataFrame:
    """Add up to four labelled figures that speak for a result."""
    have = set(results.columns)

    def item(label: str, column: str, text) -> Column:
        if column not in have:
            return F.lit(None).cast("struct<label:string,value:string>")
        c = F.col(column)
        return F.when(c.isNotNull(), F.struct(F.lit(label).alias("label"), text(c).alias("value")))

    rate = F.coalesce(F.col("anomaly_rate"), F.lit(0.0)) if "anomaly_rate" in have else F.lit(0.0)
    interval = F.lit(None).cast("struct<label:string,value:string>")
    if {"estimated_effect", "standard_error"} <= have:
        middle, half = F.col("estimated_effect"), 1.96 * F.col("standard_error")
        shown = F.format_string("[%.2f, %.2f]", middle - half, middle + half)
        interval = F.when((middle + half).isNotNull(), F.struct(F.lit("95% Interval").alias("label"), shown.alias("value")))
    items = [
        item("P-value", "p_value", lambda c: F.format_string("%.4f", c)),
        item("Correlation", "correlation", lambda c: F.format_string("%.3f", c)),
        item("Effect Size", "estimated_effect", lambda c: F.format_string("%.3f", c)),
        interval,
        item("Sample Size", "sample_size", lambda c: F.format_number(c, 0)),
        item("Model Confidence", "model_confidence", lambda c: F.format_string("%.2f%%", c * 100)),
        item("Anomalies", "anomalies_found", lambda c: F.format_string("%d (%.1f%%)", c, 100 * rate)),
        item("Causal Confidence", "causal_confidence", F.upper),
    ]
    found = F.filter(F.array(*items), lambda e: e.isNotNull())
    return results.withColumn("key_evidence", F.slice(found, 1, limit))


def summarize_results(labelled: DataFrame, lens: str = "lens", per_lens: int = 3, tie: str = "spec_id") -> DataFrame:
    """The results a summary shows: with five or more, no low ones; three per lens.

    Every row also carries how many high and medium results were kept.
    """
    total = labelled.agg(F.count("*").alias("_total"))
    kept = labelled.crossJoin(F.broadcast(total)).filter((F.col("_total") < 5) | (F.col("confidence_label") != "low"))
    counts = kept.agg(
        F.count_if(F.col("confidence_label") == "high").alias("high_results"),
        F.count_if(F.col("confidence_label") == "medium").alias("medium_results"),
    )
    w = W.partitionBy(lens).orderBy(level("confidence_label", LABELS).desc(), tie)
    top = kept.withColumn("rank_in_lens", F.row_number().over(w)).filter(F.col("rank_in_lens") <= per_lens)
    return top.crossJoin(F.broadcast(counts)).drop("_total")


# --- stability over time --------------------------------------------------------------


def _in_windows(df: DataFrame, time: str, by: Sequence[str], columns: Sequence[str], whole: list[Column], windows: int):
    """Facts with their time window number, and per group the figures over all rows."""
    rows = df.filter(F.col(time).isNotNull()).select(
        *by, seconds(F.col(time)).alias("_t"), *[F.col(c).cast("double").alias(c) for c in columns]
    )
    bounds = checkpoint_parquet(rows.groupBy(*by).agg(F.min("_t").alias("_from"), F.max("_t").alias("_to"), *whole))
    placed = join_on_group(rows, bounds.select(*by, "_from", "_to"), list(by))
    # The maximum itself falls one bucket beyond the last.
    number = F.when(
        F.col("_from") < F.col("_to"), F.least(F.width_bucket("_t", "_from", "_to", F.lit(windows)), F.lit(windows))
    ).otherwise(1)
    return placed.withColumn("window", number), bounds


def stability_corr(df: DataFrame, a: str, b: str, time: str, by: Sequence[str] = (), windows: int = 3) -> DataFrame:
    """Does the correlation hold in each time window? One row per group."""
    by = list(by)
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    overall = [F.corr(F.when(both, F.col(a)), F.when(both, F.col(b))).alias("correlation")]
    placed, bounds = _in_windows(df, time, by, [a, b], overall, windows)
    per_window = placed.groupBy(*by, "window").agg(
        F.count("*").alias("_rows"), F.count_if(both).alias("_pairs"), F.corr(F.when(both, F.col(a)), F.when(both, F.col(b))).alias("_r")
    )
    usable = per_window.filter("_rows > 10 and _pairs > 5 and _r is not null")
    joined = join_on_group(usable, bounds.drop("_from", "_to"), by)
    r, r0 = F.col("_r"), F.col("correlation")
    found = joined.groupBy(*by).agg(
        F.max("correlation").alias("correlation"),
        F.count("*").alias("window_count"),
        F.var_pop("_r").alias("variance"),
        F.bool_and((r > 0) == (r0 > 0)).alias("same_sign"),
        F.bool_and(F.abs(r) > 0.7 * F.abs(r0)).alias("magnitude_similar"),
    )
    steady = (F.col("variance") < 0.1) & F.col("same_sign") & F.col("magnitude_similar")
    return found.withColumn("is_stable", F.when(F.col("window_count") < 2, True).otherwise(steady))


def stability_trend(df: DataFrame, y: str, time: str, by: Sequence[str] = (), windows: int = 3) -> DataFrame:
    """Do the window means all rise or all fall? One row per group."""
    by = list(by)
    placed, _ = _in_windows(df, time, by, [y], [], windows)
    means = placed.groupBy(*by, "window").agg(F.count("*").alias("_rows"), F.avg(y).alias("_mean"))
    usable = means.filter("_rows > 5 and _mean is not null")
    w = W.partitionBy(*(by or [F.lit(0)])).orderBy("window")
    steps = usable.withColumn("_step", F.col("_mean") - F.lag("_mean").over(w))
    found = steps.groupBy(*by).agg(
        F.count("*").alias("window_count"),
        F.var_pop("_mean").alias("variance"),
        F.bool_and(F.col("_step") > 0).alias("_up"),
        F.bool_and(F.col("_step") < 0).alias("_down"),
    )
    one_way = F.coalesce(F.col("_up") | F.col("_down"), F.lit(True))
    return found.withColumn("is_stable", F.when(F.col("window_count") < 2, True).otherwise(one_way)).drop("_up", "_down")
