"""From a raw CSV to graded results in one call."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from plumbline.operators.grain import discover_grain
from plumbline.operators.health import health_columns, health_report
from plumbline.operators.metrics import eligible
from plumbline.operators.profile import profile_columns
from plumbline.operators.run import run_specs
from plumbline.operators.spec import MetricSpec, deduplicate
from plumbline.operators.validate import label_confidence, rank_results, validate
from plumbline.plans.staging import checkpoint_parquet
from plumbline.session import prepare
from plumbline.sources.tables import load_csv, require_rows, write_results


@dataclass(frozen=True)
class Analysis:
    """Frames of one run; the later ones are None when the health gate stopped it.

    ``specs`` says of every spec asked for whether it was computed, and if not, why;
    ``results`` holds all computed ones with their verdicts, rejected ones too.
    """

    data: DataFrame
    cast_log: DataFrame
    health: DataFrame
    proceed: bool
    profile: DataFrame | None = None
    grain: DataFrame | None = None
    specs: DataFrame | None = None
    results: DataFrame | None = None


def analyze(
    spark: SparkSession, path: str, specs: Sequence[MetricSpec], out: str | None = None, min_score: float = 70.0, force: bool = False
) -> Analysis:
    """Load and type a CSV, score its health, profile it, find its grain, compute the specs
    that its columns allow, grade the results and write them to ``out``.

    The typed table is staged once, so the text is parsed by two passes in all.
    """
    prepare(spark)
    loaded = load_csv(spark, path)
    data = require_rows(checkpoint_parquet(loaded.data))
    columns = checkpoint_parquet(health_columns(data))
    health = checkpoint_parquet(health_report(data, min_score, columns))
    verdict = health.first()
    if not (verdict["should_proceed"] or force):
        return Analysis(data, loaded.log, health, False)

    profile = profile_columns(data)
    grain = discover_grain(data, profile)
    nulls = {r["column_name"]: r["null_percentage"] for r in profile.select("column_name", "null_percentage").collect()}
    chosen, fit, states = {id(s) for s in deduplicate(specs)}, [], []
    for s in specs:
        missing = [c for c in (*s.columns, *s.dims, *([s.time] if s.time else [])) if c not in data.columns]
        if missing:
            states.append((s.name, "skipped", "no column " + ", ".join(missing)))
        elif id(s) not in chosen:  # another one stands for it
            states.append((s.name, "skipped", "repeats another spec"))
        elif not eligible(data.schema, s, nulls[s.numerator] / 100):
            states.append((s.name, "skipped", f"column {s.numerator} is not eligible"))
        else:
            chosen.remove(id(s))
            states.append((s.name, "computed", None))
            fit.append(s)
    asked = spark.createDataFrame(states, "spec string, status string, reason string")
    if not fit:
        return Analysis(data, loaded.log, health, True, profile, grain, asked)
    graded = label_confidence(validate(run_specs(data, fit), table_rows=verdict["row_count"]))
    results = checkpoint_parquet(rank_results(graded, "spec_id"))
    if out is not None:
        write_results(results, out)
    return Analysis(data, loaded.log, health, True, profile, grain, asked, results)
