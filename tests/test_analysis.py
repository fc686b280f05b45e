"""The whole way from a CSV file to graded results."""

from plumbline.analysis import analyze
from plumbline.operators.spec import MetricSpec

SPECS = [
    MetricSpec("sales", "sales", template="SUM", scope="DIMENSIONAL", dims=("category",)),
    MetricSpec("roas", "sales", "adcost", scope="DIMENSIONAL", dims=("category",)),
    MetricSpec("trend", "sales", template="SUM", scope="TEMPORAL", time="date", grain="monthly"),
    MetricSpec("text", "category"),
    MetricSpec("absent", "nothing"),
]


def write_csv(path, rows):
    lines = ["Date,Category,Sales,AdCost,Order ID"]
    for i in range(rows):
        lines.append(f"{1 + i % 28:02d}-{1 + i % 12:02d}-2024,{'shoes' if i % 3 else 'bags'},\"${1000 + i * 7:,}\",{i % 11},o{i}")
    path.write_text("\n".join(lines) + "\n")


def test_csv_to_results(spark, tmp_path):
    write_csv(tmp_path / "sales.csv", 400)
    run = analyze(spark, str(tmp_path / "sales.csv"), SPECS, str(tmp_path / "out"))
    assert dict(run.data.dtypes) == {"date": "timestamp", "category": "string", "sales": "double", "adcost": "double", "order_id": "string"}
    assert run.proceed and run.health.first()["overall_score"] == 100.0
    assert run.grain.first()["primary_grain"] == "transactional"
    ids = {r["spec_id"] for r in run.results.select("spec_id").distinct().collect()}
    assert ids == {"sales:DIMENSIONAL:category", "roas:DIMENSIONAL:category", "trend:TEMPORAL:monthly"}
    written = spark.read.parquet(str(tmp_path / "out"))
    assert written.count() == 2 + 2 + 12
    shoes = [r for r in run.results.collect() if r["spec_id"] == "sales:DIMENSIONAL:category" and r["group_key"]["category"] == "shoes"]
    assert shoes[0]["value"] == sum(1000 + i * 7 for i in range(400) if i % 3)
    assert shoes[0]["verdict"] == "accept" and shoes[0]["confidence_label"] == "high"


def test_every_spec_is_accounted_for(spark, tmp_path):
    write_csv(tmp_path / "sales.csv", 400)
    odd = [MetricSpec("odd", "nowhere"), SPECS[0]]
    run = analyze(spark, str(tmp_path / "sales.csv"), [*SPECS, *odd])
    states = [(r["spec"], r["status"]) for r in run.specs.collect()]
    assert len(states) == len(SPECS) + len(odd)
    assert ("odd", "skipped") in states and ("text", "skipped") in states and ("absent", "skipped") in states
    assert sum(s == "computed" for _, s in states) == run.results.select("spec_id").distinct().count()


def test_health_gate_stops(spark, tmp_path):
    write_csv(tmp_path / "few.csv", 20)
    run = analyze(spark, str(tmp_path / "few.csv"), SPECS)
    assert not run.proceed and run.profile is None and run.health.first()["critical_issues"] == 1
    assert analyze(spark, str(tmp_path / "few.csv"), SPECS, force=True).profile is not None
