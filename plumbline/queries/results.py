"""Validation, evidence and selection queries over results made from customers' orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import validate as V
from plumbline.plans.running import running_totals
from plumbline.queries.registry import query, register, rounded
from plumbline.sources.views import table

# One result per customer; the kind of result and its figures follow from the orders.
# The text is the same for both engines.
FIGURES = {
    "spec_id": "concat('c', CAST(o_custkey AS VARCHAR(20)))",
    "analysis_type": "CASE o_custkey % 5 WHEN 0 THEN 'correlation' WHEN 1 THEN 'trend' WHEN 2 THEN 'anomaly' WHEN 3 THEN 'causal' ELSE 'forecast' END",
    "sample_size": "CASE WHEN o_custkey % 17 <> 0 THEN count(*) * 4 END",
    "p_value": "CASE WHEN o_custkey % 7 <> 0 THEN CAST(min(o_orderkey) % 10 AS DOUBLE) / 1e2 END",
    "correlation": "CASE WHEN o_custkey % 11 <> 0 THEN CAST(max(o_orderkey) % 200 AS DOUBLE) / 1e2 - 1e0 END",
    "r_squared": "CAST(max(o_orderkey) % 100 AS DOUBLE) / 1e2",
    "trend_direction": "CASE WHEN o_custkey % 3 <> 0 THEN 'increasing' ELSE '' END",
    "anomalies_found": "CAST(count(CASE WHEN o_totalprice > 4.5e5 THEN 1 END) AS BIGINT)",
    "anomaly_rate": "CAST(count(CASE WHEN o_totalprice > 3.5e5 THEN 1 END) AS DOUBLE) / count(*)",
    "mean_severity": "CAST(min(o_orderkey) % 40 AS DOUBLE) / 1e1",
    "model_confidence": "CAST(min(o_orderkey) % 10 AS DOUBLE) / 1e1",
    "aic": "CASE WHEN o_custkey % 2 = 0 THEN CAST(max(o_orderkey) AS DOUBLE) END",
    "periods": "CAST(o_custkey % 4 AS INT)",
    "estimated_effect": "CASE WHEN o_custkey % 5 = 3 THEN CAST(max(o_orderkey) % 50 AS DOUBLE) / 1e1 END",
    "standard_error": "CASE WHEN o_custkey % 4 <> 0 THEN CAST(min(o_orderkey) % 3 AS DOUBLE) END",
    "causal_confidence": "CASE max(o_orderkey) % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END",
    "refutations_run": "CAST(CASE WHEN o_custkey % 3 = 0 THEN 0 ELSE 3 END AS INT)",
    "refutations_passed": "CAST(min(o_orderkey) % 4 AS INT)",
    "is_stable": "CASE WHEN o_custkey % 6 < 2 THEN NULL ELSE max(o_orderkey) % 3 = 0 END",
    "null_percentage": "CAST(o_custkey % 60 AS DOUBLE)",
    "lens": "concat('lens_', CAST(o_custkey % 6 AS VARCHAR(2)))",
}


def figures(spark, folder):
    orders = table(spark, folder, "orders")
    return orders.groupBy("o_custkey").agg(*[F.expr(e).alias(c) for c, e in FIGURES.items()]).drop("o_custkey")


def _checks_sql() -> list[tuple[str, str, str, str, str]]:
    """(name, applies, good, factor if good, factor if bad), in the order they are reported."""
    low = "coalesce(causal_confidence IN ('low', 'none'), FALSE)"
    return [
        ("sample_size_reported", "TRUE", "sample_size IS NOT NULL", "1", "0.3"),
        ("sample_size_adequate", "TRUE", "coalesce(sample_size, 500) >= 30", "1", "0.2"),
        ("model_confidence", "analysis_type = 'forecast' AND model_confidence IS NOT NULL", "model_confidence >= 0.5", "1", "1"),
        ("aic_reported", "analysis_type = 'forecast' AND aic IS NOT NULL", "TRUE", "1", "1"),
        ("forecast_horizon_valid", "analysis_type = 'forecast' AND periods > 0", "TRUE", "1", "1"),
        ("anomalies_found", "analysis_type = 'anomaly'", "anomalies_found <> 0", "1", "0.1"),
        ("anomaly_rate_reasonable", "analysis_type = 'anomaly'", "anomaly_rate <= 0.3e0", "1", "0.5"),
        ("high_severity_anomalies", "analysis_type = 'anomaly' AND mean_severity > 2", "TRUE", "1.1", "1"),
        ("p_value_significant", "analysis_type = 'correlation' AND p_value IS NOT NULL", "p_value <= 0.05e0", "0.95", "0.3"),
        ("correlation_strength", "analysis_type = 'correlation' AND correlation IS NOT NULL", "abs(correlation) >= 0.3e0", "0.9", "0.4"),
        ("causal_confidence", f"analysis_type = 'causal' AND {low}", "FALSE", "1", "0.3"),
        ("causal_confidence_medium", "analysis_type = 'causal' AND causal_confidence = 'medium'", "TRUE", "0.8", "1"),
        ("causal_confidence_high", "analysis_type = 'causal' AND causal_confidence = 'high'", "TRUE", "1", "1"),
        ("refutation_tests", "analysis_type = 'causal' AND refutations_run > 0", "refutations_passed >= 2", "1.05", "0.7"),
        ("standard_error_available", "analysis_type = 'causal'", "standard_error IS NOT NULL AND standard_error <> 0", "1", "0.6"),
        ("trend_direction_detected", "analysis_type = 'trend' AND trend_direction <> ''", "TRUE", "1", "1"),
        ("trend_fit", "analysis_type = 'trend' AND r_squared IS NOT NULL", "r_squared >= 0.3e0", "1", "0.5"),
        ("temporal_stability", "analysis_type IN ('correlation', 'trend') AND is_stable IS NOT NULL", "is_stable", "1", "0.6"),
        ("data_quality", "TRUE", "null_percentage <= 50", "1", "0.3"),
    ]


# What a failed check found, as printf text and its figures, in the order of the checks.
REASONS = {
    "sample_size_reported": "'sample size not reported'",
    "sample_size_adequate": "printf('sample size %d below 30', coalesce(sample_size, 500))",
    "model_confidence": "printf('model confidence %.3f below 0.500', model_confidence)",
    "anomalies_found": "'no anomalies found'",
    "anomaly_rate_reasonable": "printf('anomaly rate %.3f above 0.300', round(anomaly_rate, 3))",
    "p_value_significant": "printf('p-value %.3f above 0.050', p_value)",
    "correlation_strength": "printf('correlation %.3f weaker than 0.300', correlation)",
    "causal_confidence": "'causal confidence is ' || causal_confidence",
    "refutation_tests": "printf('%d of %d refutation tests passed', refutations_passed, refutations_run)",
    "standard_error_available": "'no standard error'",
    "trend_fit": "printf('r squared %.3f below 0.300', r_squared)",
    "temporal_stability": "'not stable over time'",
    "data_quality": "printf('%.1f percent of the values are null', null_percentage)",
}


def graded_sql() -> str:
    factor, passed, failed, reasons = "1e0", [], [], []
    for name, applies, good, up, down in _checks_sql():
        yes = f"coalesce(({applies}) AND ({good}), FALSE)"
        no = f"coalesce(({applies}), FALSE) AND NOT coalesce(({good}), FALSE)"
        factor += f" * CASE WHEN {yes} THEN {up}::DOUBLE WHEN {no} THEN {down}::DOUBLE ELSE 1e0 END"
        passed.append(f"CASE WHEN {yes} THEN '{name}' END")
        failed.append(f"CASE WHEN {no} THEN '{name.replace('size_reported', 'size_missing')}' END")
        if name in REASONS:
            reasons.append(f"CASE WHEN {no} THEN {REASONS[name]} END")
    return (
        "WITH figures AS (SELECT "
        + ", ".join(f"{e} AS {c}" for c, e in FIGURES.items())
        + " FROM orders GROUP BY o_custkey)\n, graded AS (SELECT *, "
        + f"greatest(0e0, least(1e0, {factor})) AS score, concat_ws(',', {', '.join(passed)}) AS passed, concat_ws(',', {', '.join(failed)}) AS failed, "
        + f"nullif(concat_ws('; ', {', '.join(reasons)}), '') AS rejection_reason FROM figures),\n"
        + """labelled AS (SELECT *, CASE WHEN score > 0.75::DOUBLE THEN 'accept' WHEN score >= 0.4::DOUBLE THEN 'weak_signal' ELSE 'reject' END AS verdict,
  CASE WHEN score >= 0.75::DOUBLE THEN 'high' WHEN score >= 0.4::DOUBLE THEN 'medium' ELSE 'low' END AS label FROM graded)
"""
    )


GRADED = graded_sql()
LEVEL = "CASE label WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"


def graded(spark, folder):
    return V.label_confidence(V.validate(figures(spark, folder), table_rows=500))


def _verdicts(kind: str) -> None:
    def run(spark, folder):
        out = graded(spark, folder).filter(F.col("analysis_type") == kind)
        return rounded(
            out.select(
                "spec_id",
                "confidence_score",
                "verdict",
                "confidence_label",
                F.array_join("passed_checks", ",").alias("passed_checks"),
                F.array_join("failed_checks", ",").alias("failed_checks"),
                "rejection_reason",
            ),
            9,
        )

    sql = f"""SELECT spec_id, round(score, 9) AS confidence_score, verdict, label AS confidence_label, passed AS passed_checks,
  failed AS failed_checks, rejection_reason FROM labelled WHERE analysis_type = '{kind}'"""
    register(f"validate_{kind}", run, GRADED + sql)


for _kind in ("correlation", "trend", "anomaly", "causal", "forecast"):
    _verdicts(_kind)


@query(
    GRADED
    + f"""SELECT spec_id, label AS confidence_label, verdict, row_number() OVER (ORDER BY {LEVEL} DESC,
  CASE verdict WHEN 'accept' THEN 2 WHEN 'weak_signal' THEN 1 ELSE 0 END DESC, spec_id) AS place FROM labelled"""
)
def ranked_results(spark, folder):
    """All results with their places, numbered without bringing them into one task."""
    levels = {"_label": V.level("confidence_label", V.LABELS), "_verdict": V.level("verdict", V.VERDICTS), "_one": F.lit(1).cast("long")}
    rows = V.rank_results(graded(spark, folder), "spec_id").select("spec_id", "confidence_label", "verdict").withColumns(levels)
    placed = running_totals(rows, [("_label", "desc"), ("_verdict", "desc"), "spec_id"], {"place": "_one"})
    return placed.select("spec_id", "confidence_label", "verdict", "place")


@query(
    GRADED
    + """, e AS (SELECT spec_id, list_filter([CASE WHEN p_value IS NOT NULL THEN 'P-value=' || format('{:.4f}', p_value) END,
  CASE WHEN correlation IS NOT NULL THEN 'Correlation=' || format('{:.3f}', correlation) END,
  CASE WHEN estimated_effect IS NOT NULL THEN 'Effect Size=' || format('{:.3f}', estimated_effect) END,
  CASE WHEN estimated_effect IS NOT NULL AND standard_error IS NOT NULL THEN '95% Interval=' ||
    printf('[%.2f, %.2f]', round(estimated_effect - 1.96e0 * standard_error, 2), round(estimated_effect + 1.96e0 * standard_error, 2)) END,
  CASE WHEN sample_size IS NOT NULL THEN 'Sample Size=' || format('{:,}', sample_size) END,
  CASE WHEN model_confidence IS NOT NULL THEN 'Model Confidence=' || format('{:.2f}%', model_confidence * 100) END,
  CASE WHEN anomalies_found IS NOT NULL THEN 'Anomalies=' || printf('%d (%.1f%%)', anomalies_found, round(anomaly_rate * 100, 1)) END,
  CASE WHEN causal_confidence IS NOT NULL THEN 'Causal Confidence=' || upper(causal_confidence) END], lambda x: x IS NOT NULL)[1:4] AS ev FROM labelled)
SELECT spec_id, array_to_string(ev, '; ') AS evidence, CAST(len(ev) AS INT) AS pieces FROM e"""
)
def key_evidence(spark, folder):
    out = V.key_evidence(graded(spark, folder))
    shown = F.transform("key_evidence", lambda e: F.concat(e["label"], F.lit("="), e["value"]))
    return out.select("spec_id", F.array_join(shown, "; ").alias("evidence"), F.size("key_evidence").alias("pieces"))


@query(
    GRADED
    + f""", k AS (SELECT * FROM labelled WHERE (SELECT count(*) FROM labelled) < 5 OR label <> 'low'),
r AS (SELECT spec_id, lens, label, row_number() OVER (PARTITION BY lens ORDER BY {LEVEL} DESC, spec_id) AS rn FROM k)
SELECT spec_id, lens, label AS confidence_label, CAST(rn AS INT) AS rank_in_lens, (SELECT count(*) FROM k WHERE label = 'high') AS high_results,
  (SELECT count(*) FROM k WHERE label = 'medium') AS medium_results FROM r WHERE rn <= 3"""
)
def summary_selection(spark, folder):
    out = V.summarize_results(graded(spark, folder))
    return out.select("spec_id", "lens", "confidence_label", "rank_in_lens", "high_results", "medium_results")
