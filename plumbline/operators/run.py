"""Many specs on one table: one aggregate per (filter, guardrail, grouping)."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.metrics import (
    SIGNIFICANT_ROWS,
    _growth,
    _pieces,
    _value,
    _with_totals,
    _needs_total,
    apply_filter,
    apply_guardrail,
    keep_condition,
)
from plumbline.operators.spec import GRAINS, MetricSpec, deduplicate

# Columns of the results table and their types, in order.
RESULT_COLUMNS = {
    "spec_id": "string",
    "analysis_type": "string",
    "metric": "string",
    "group_key": "map<string,string>",
    "value": "double",
    "sample_size": "bigint",
    "is_significant": "boolean",
    "p_value": "double",
    "correlation": "double",
    "r_squared": "double",
    "trend_direction": "string",
    "trend_slope": "double",
    "anomalies_found": "bigint",
    "anomaly_rate": "double",
    "mean_severity": "double",
    "model_confidence": "double",
    "aic": "double",
    "periods": "int",
    "estimated_effect": "double",
    "standard_error": "double",
    "causal_confidence": "string",
    "refutations_run": "int",
    "refutations_passed": "int",
    "null_percentage": "double",
}


def to_results(df: DataFrame) -> DataFrame:
    """Bring a frame to the results columns; what it lacks becomes null."""
    return df.select(
        *[
            (F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name)
            for name, kind in RESULT_COLUMNS.items()
        ]
    )


def spec_id(spec: MetricSpec) -> str:
    parts = [spec.name, spec.scope, *spec.dims, spec.grain or "", spec.motif or spec.title[:15]]
    return ":".join(p for p in parts if p)


def bundles(specs: Iterable[MetricSpec]) -> list[list[MetricSpec]]:
    """Deduplicated specs that can share one pass over the table."""
    groups: dict[tuple, list[MetricSpec]] = {}
    for spec in deduplicate(specs):
        time_key = (spec.time, spec.grain) if spec.scope == "TEMPORAL" else None
        dims = spec.dims if spec.scope != "GLOBAL" else ()
        groups.setdefault((spec.filter, spec.guardrail, dims, time_key), []).append(spec)
    return list(groups.values())


def _run_bundle(df: DataFrame, specs: list[MetricSpec]) -> DataFrame:
    first = specs[0]
    temporal = first.scope == "TEMPORAL"
    dims = list(first.dims) if first.scope != "GLOBAL" else []
    df = apply_guardrail(df, first)
    if first.filter:
        df = apply_filter(df, first.filter)

    # Specs with the same fitness test share a filter that can reach the scan;
    # otherwise each aggregate looks only at its own rows.
    tests = {(s.columns, s.denominator) if s.sanitized else None for s in specs}
    shared = len(tests) == 1
    if shared and first.sanitized:
        df = df.filter(keep_condition(first.columns, first.denominator))

    def condition(spec: MetricSpec) -> Column | None:
        return None if shared or not spec.sanitized else keep_condition(spec.columns, spec.denominator)

    tagged = [(f"m{i}", s) for i, s in enumerate(specs)]
    keys: list[Column] = [F.col(d) for d in dims]
    if temporal:
        keys.append(F.date_trunc(GRAINS[first.grain], F.col(first.time)).cast("timestamp_ntz").alias("bucket"))
    pieces = [p for tag, s in tagged for p in _pieces(s, tag, condition(s))]
    frame = df.groupBy(*keys).agg(*pieces) if keys else df.agg(*pieces)
    if keys:
        frame = _with_totals(frame, tagged, ["bucket"] if temporal else [])
    else:
        frame = frame.withColumns({f"{t}_total": F.col(f"{t}_d") for t, s in tagged if _needs_total(s)})

    shown = [*dims, *(["bucket"] if temporal else [])]
    group_key = (
        F.create_map(*[x for k in shown for x in (F.lit(k), F.col(k).cast("string"))])
        if shown
        else F.lit(None).cast("map<string,string>")
    )
    rows = []
    for tag, spec in tagged:
        rows.append(
            F.struct(
                F.lit(spec_id(spec)).alias("spec_id"),
                F.lit("metric").alias("analysis_type"),
                F.lit(spec.name).alias("metric"),
                _growth(spec, _value(spec, tag), dims).alias("value") if temporal else _value(spec, tag).alias("value"),
                F.col(f"{tag}_rows").alias("sample_size"),
            )
        )
    # Window values must exist before the rows are unpivoted.
    long = frame.select(group_key.alias("group_key"), F.array(*rows).alias("_rows")).select(
        "group_key", F.inline("_rows")
    )
    if keys:
        long = long.filter(F.col("sample_size") > 0)
    return to_results(long.withColumn("is_significant", F.col("sample_size") >= SIGNIFICANT_ROWS))


def run_specs(df: DataFrame, specs: Iterable[MetricSpec]) -> DataFrame:
    """All specs as one results table, one row per (spec, group)."""
    parts = [_run_bundle(df, bundle) for bundle in bundles(specs)]
    return reduce(DataFrame.unionByName, parts)
