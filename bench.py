"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [name part ...]

Each query runs once to warm up code generation, then is timed to a full result. With
``BENCH_DUCKDB=1`` the SQL of the same queries is timed in DuckDB next to it.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from plumbline.queries import ORACLES, QUERIES  # noqa: E402
from plumbline.session import local_session  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "infer_and_cast",
    "health_report",
    "basic_stats",
    "profile_sales",
    "distinct_counts",
    "grain_transactional",
    "composite_key",
    "temporal_frequency_rows",
    "metric_global_ratio",
    "metric_by_dims",
    "metric_over_time_monthly",
    "metric_trend",
    "formula_share_of_group",
    "formula_growth",
    "pareto_brand",
    "pareto_customer",
    "benchmark_by_brand",
    "insight_domains",
    "run_specs_bundled",
    "derived_margin",
    "anomalies_iqr",
    "anomalies_iqr_by_part",
    "anomalies_zscore",
    "anomaly_consensus_two",
    "anomaly_consensus_three",
    "pearson_by_segment",
    "spearman_by_segment",
    "linear_trend_by_brand",
    "causal_refutation",
    "stability_of_correlation",
    "series_seasonality",
    "forecast_best_model",
    "validate_correlation",
    "summary_selection",
]


def run(spark, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def duckdb_times(names: list[str]) -> dict[str, float]:
    import duckdb

    con = duckdb.connect()
    con.execute(f"SET threads = {int(CPUS)}")
    for path in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    times = {}
    for name in names:
        if name in ORACLES:
            start = time.perf_counter()
            con.execute(ORACLES[name]).fetchall()
            times[name] = round(time.perf_counter() - start, 3)
    return times


def main() -> None:
    parts = sys.argv[1:]
    names = [n for n in HEADLINE if not parts or any(p in n for p in parts)]
    spark = local_session(CPUS, os.environ.get("BENCH_MEMORY", "16g"), int(CPUS))
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        run(spark, name)
        times[name] = round(run(spark, name), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    line = {
        "metric": "headline queries, total wall-clock",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": Path(FOLDER).name.removeprefix("sf"),
    }
    if os.environ.get("BENCH_DUCKDB") == "1":
        line["duckdb"] = duckdb_times(names)
    print(json.dumps(line))


if __name__ == "__main__":
    main()
