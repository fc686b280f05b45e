"""Thresholds and edge cases on small hand-made tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from plumbline.functions.columns import safe_div, transform
from plumbline.operators import derived as D
from plumbline.operators import grain as G
from plumbline.operators import health as H
from plumbline.operators import measures
from plumbline.operators import metrics as M
from plumbline.operators import motifs
from plumbline.operators import profile as P
from plumbline.operators import validate as V
from plumbline.operators.run import bundles, run_specs, spec_id
from plumbline.operators.spec import Guardrail, MetricSpec, deduplicate
from plumbline.sources import tables as S
from plumbline.sources.views import funnel_view


# --- sources --------------------------------------------------------------------------


def test_header_rules(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "`A b` int, `A-b` int, `  ` int, `Größe (m)` int")
    assert S.normalize_headers(df).columns == ["a_b", "a_b_2", "col_2", "gr_e_m"]
    assert S.normalize_headers(df, unicode=True).columns == ["a_b", "a_b_2", "col_2", "größe_m"]


@pytest.mark.parametrize("valid, kind", [(70, "double"), (69, "string")])
def test_cast_threshold(spark, valid, kind):
    rows = [(str(i) if i < valid else "x",) for i in range(100)] + [(None,)] * 20
    result = S.infer_and_cast(spark.createDataFrame(rows, "c string"))
    assert dict(result.data.dtypes)["c"] == kind
    assert result.log.first()["rate"] == pytest.approx(valid / 100)


@pytest.mark.parametrize(
    "texts, decision, label",
    [
        (["2024-01-05", "2024-02-30x"], "string", None),
        (["2024-01-05", "2024-12-31 10:00:00"], "timestamp", "ISO 8601"),
        (["05-01-2024", "31-12-2024"], "timestamp", "dd-MM-yyyy"),
        (["05/01/2024", "06/07/2024"], "timestamp", "dd/MM/yyyy"),
        (["05/13/2024", "12/31/2024"], "timestamp", "MM/dd/yyyy"),
        (["2024/01/05"], "timestamp", "yyyy/MM/dd"),
        (["05-Jan-2024"], "timestamp", "dd-MMM-yyyy"),
        (["05 Jan 2024"], "timestamp", "dd MMM yyyy"),
        (["1997", "1998"], "double", None),
        (["$1,234.50", " 7 % "], "double", None),
        ([None, None], "empty", None),
    ],
)
def test_cast_decisions(spark, texts, decision, label):
    log = S.infer_and_cast(spark.createDataFrame([(t,) for t in texts], "c string")).log.first()
    assert (log["decision"], log["format"]) == (decision, label)


@pytest.mark.parametrize(
    "text, number",
    [("$1,234.50", 1234.5), (" -7 % ", -7.0), ("1e3", 1000.0), (".5", 0.5), ("5.", 5.0), ("+3", 3.0), ("12d", None), ("1-2", None), ("", None), ("n/a", None)],
)
def test_numeric_texts(spark, text, number):
    assert spark.createDataFrame([(text,)], "t string").select(S.clean_numeric("t")).first()[0] == number


def test_ragged_lines_are_cut(spark, tmp_path):
    path = tmp_path / "ragged.csv"
    path.write_text("a,b\n1,2\n3,4,5\n6\n")
    rows = [tuple(r) for r in S.read_csv_strings(spark, str(path)).collect()]
    assert rows == [("1", "2"), ("3", "4"), ("6", None)]


def test_empty_tables_are_refused(spark):
    with pytest.raises(ValueError):
        S.require_rows(spark.createDataFrame([], "a int"))
    with pytest.raises(ValueError):
        S.require_rows(spark.range(3).drop("id"))


def test_write_results_formats(spark, tmp_path):
    S.write_results(spark.range(3), str(tmp_path / "r"), "json")
    assert spark.read.json(str(tmp_path / "r")).count() == 3
    with pytest.raises(ValueError):
        S.write_results(spark.range(3), str(tmp_path / "x"), "html")


# --- health and profile ---------------------------------------------------------------


@pytest.mark.parametrize("nulls, score", [(5, 100.0), (6, 80.0), (20, 80.0), (21, 50.0), (50, 50.0), (51, 0.0)])
def test_health_bands(spark, nulls, score):
    df = spark.createDataFrame([(None if i < nulls else float(i),) for i in range(100)], "v double")
    row = H.health_columns(df).first()
    assert row["score"] == score and row["is_critical"] == (nulls > 50)


def test_health_report_small_and_constant(spark):
    df = spark.createDataFrame([(1.0, str(i)) for i in range(29)], "c double, t string")
    r = H.health_report(df).first()
    # 29 rows are critical; the constant column scores 30, the text 100.
    assert r["critical_issues"] == 1 and r["overall_score"] == pytest.approx(0.5 * 65) and not r["should_proceed"]


def test_empty_table_has_a_profile(spark):
    empty = spark.createDataFrame([], "a double, b string")
    assert [r["unique_count"] for r in measures.column_measures(empty).collect()] == [0, 0]
    assert H.health_report(empty).first()["should_proceed"] is False


def test_distinct_counts_null_and_zero(spark):
    df = spark.createDataFrame([(0.0, "a", True), (-0.0, None, None), (float("nan"), "a", True), (float("nan"), "b", None)], "d double, s string, f boolean")
    got = {r["column_name"]: r["unique_count"] for r in measures.distinct_counts(df).collect()}
    assert got == {"d": 2, "s": 3, "f": 2}


def test_approximate_counts_are_close(spark):
    df = spark.range(20_000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 50).alias("few"))
    got = {r["column_name"]: r["unique_count"] for r in measures.distinct_counts(df, approximate=True).collect()}
    assert got["id"] == pytest.approx(20_000, rel=0.05) and got["few"] == pytest.approx(51, abs=2)


@pytest.mark.parametrize(
    "values, confidence",
    [
        (list(range(1, 21)), 0.99),
        ([1, 2, 3, 4, 5] * 4, 0.75),
        ([1, 2, 3, 4, 5, 6, 7, 10, 10, 10], 0.60),
        ([-1, 1, 2, 3], 0.0),
        ([0, 0, 0], 0.0),
        ([5], 0.0),
        ([1, 50, 100], 0.0),
        ([1.5, 2.0, 3.0], 0.0),
    ],
)
def test_ordinal_bands(spark, values, confidence):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert P.ordinal_confidence(df).first()["ordinal_confidence"] == pytest.approx(confidence)


def type_of(spark, name, values, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"`{name}` {kind}")
    return P.statistical_type(measures.column_measures(df)).first()["statistical_type"]


def test_statistical_types(spark):
    many = [str(i) for i in range(300)]
    assert type_of(spark, "user_id", many) == "identifier"
    assert type_of(spark, "label", many) == "categorical"
    assert type_of(spark, "order_key", list(range(300)), "int") == "identifier"
    assert type_of(spark, "amount", list(range(300)), "int") == "numeric"
    assert type_of(spark, "position", list(range(1, 21)) * 3, "int") == "categorical"
    assert type_of(spark, "is_new", ["y", "n"] * 150) == "boolean"
    assert type_of(spark, "colour", ["y", "n"] * 150) == "categorical"


def test_distribution_shapes(spark):
    import numpy as np

    rng = np.random.default_rng(1)

    def shape(values):
        return P.distribution_type(spark.createDataFrame([(float(v),) for v in values], "v double")).first()["distribution_type"]

    assert shape(rng.normal(size=3000)) == "normal"
    assert shape(rng.uniform(size=3000)) == "uniform"
    assert shape(rng.gamma(4, size=3000)) == "skewed"
    assert shape(rng.lognormal(sigma=2, size=3000)) == "long_tail"
    assert shape([0.0] * 80 + list(range(1, 21))) == "sparse"
    assert shape(range(9)) == "unknown"


def zeros(spark, rows, role="financial"):
    df = spark.createDataFrame(rows, "revenue double, clicks int")
    r = P.validate_zeros(df, "revenue", role).first()
    return r["zeros_valid"], r["reason"]


def test_zero_validation(spark):
    assert zeros(spark, [(0.0, 1)] * 2 + [(1.0, 1)] * 8) == (True, "few zeros")
    assert zeros(spark, [(0.0, 1)] * 8 + [(1.0, 1)] * 2) == (True, "no nulls")
    assert zeros(spark, [(0.0, 1)] * 12 + [(None, 1)] * 2) == (True, "many more zeros than nulls")
    follows = [(0.0, 0)] * 9 + [(5.0, 0)] + [(None, 3)] * 10
    assert zeros(spark, follows) == (True, "follows clicks")
    assert zeros(spark, follows, "inventory") == (False, "not confirmed")


def test_roles_time_check_and_tables(spark):
    df = spark.createDataFrame([(f"{i}", float(i % 7)) for i in range(50)], "order_date string, price double")
    typed = P.statistical_type(measures.column_measures(df))
    roles = {r["column_name"]: r["semantic_guess"] for r in P.semantic_roles(typed).collect()}
    # A text column named after a date is not taken for time.
    assert roles["order_date"] != "time" and roles["price"] == "financial"


def test_funnel_amounts_do_not_depend_on_the_order_of_events(spark, tmp_path):
    """0.1 + 0.2 + 0.3 as doubles is more than 0.3 + 0.2 + 0.1: one amount, not two."""
    rows = [(u, "click", v) for u, values in ((1, (0.1, 0.2, 0.3)), (2, (0.3, 0.2, 0.1))) for v in values]
    events = spark.createDataFrame(rows + [(1, "view", None), (2, "purchase", None)], "user_id long, event_type string, value double")
    events.withColumn("ts", F.timestamp_seconds(F.lit(0))).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    view = funnel_view(spark, str(tmp_path))
    assert [(r["spend"], r["revenue"]) for r in view.collect()] == [(0.6, 0.0)] * 2
    assert measures.distinct_counts(view).filter("column_name = 'spend'").first()["unique_count"] == 1


def test_sample_values_of_a_sparse_column(spark):
    df = spark.range(5000).select(F.when(F.col("id") > 4990, F.col("id")).alias("late"), F.col("id").alias("first")).coalesce(1)
    got = {r["column_name"]: r["sample_values"] for r in P.sample_values(df).collect()}
    assert len(got["late"]) == 5 and len(got["first"]) == 5


def test_sample_values_by_bounds_are_those_of_the_whole_table(spark, monkeypatch):
    """The share of rows that sets the bounds is read beforehand; the result is that of the whole table."""
    monkeypatch.setattr(P, "FOLDED", 20)
    df = spark.range(20_000).selectExpr("id AS many", "id % 3 AS few", "if(id % 5000 = 7, id, null) AS `a.sparse`", "cast(null as string) AS nothing")
    got = {r["column_name"]: r["sample_values"] for r in P.sample_values(df).collect()}
    lowest = sorted(map(str, range(20_000)), key=lambda v: hashlib.md5(v.encode()).hexdigest()[:15])[:5]
    few = sorted("012", key=lambda v: hashlib.md5(v.encode()).hexdigest()[:15])
    assert got["many"] == lowest and got["few"] == [*few, *few[:2]] and got["nothing"] == []
    assert sorted(got["a.sparse"], key=int) == ["7", "5007", "10007", "15007"]
    plan = P.sample_values(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0") == 1


def test_sample_values_are_the_lowest_hashes(spark):
    def hashed(text):
        return hashlib.md5(text.encode()).hexdigest()[:15]

    hot = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("v"), F.col("id") % 700))
    df = spark.range(3000).select(
        hot.alias("skewed"),
        (F.col("id") % 2 == 0).alias("flag"),
        F.when(F.col("id") < 2, F.lit("x")).alias("rare"),
        F.lit(None).cast("string").alias("none"),
    )
    got = {r["column_name"]: r["sample_values"] for r in P.sample_values(df).collect()}
    values = {"hot"} | {f"v{i % 700}" for i in range(3000) if i % 3}
    assert got["skewed"] == sorted(values, key=hashed)[:5]
    pair = sorted(["true", "false"], key=hashed)
    assert got["flag"] == (pair * 3)[:5]
    assert got["rare"] == ["x", "x"] and got["none"] == []
    again = {r["column_name"]: r["sample_values"] for r in P.sample_values(df.repartition(7)).collect()}
    assert again == got
    empty = {r["column_name"]: r["sample_values"] for r in P.sample_values(df.limit(0)).collect()}
    assert empty == {c: [] for c in df.columns}


def test_small_tables_are_sampled_whole(spark):
    df = spark.range(9).withColumnRenamed("id", "k")
    assert P.diverse_sample(df, ["k"]).count() == 9
    picked = sorted(r["k"] for r in P.diverse_sample(spark.range(20).withColumnRenamed("id", "k"), ["k"]).collect())
    assert picked == [0, 1, 2, 8, 9, 10, 11, 17, 18, 19]


@pytest.mark.parametrize(
    "pairs, label", [([(1, 1), (2, 2)], "1:1"), ([(1, 1), (1, 2)], "1:Many"), ([(1, 1), (2, 1)], "Many:1"), ([(1, 1), (1, 2), (2, 1)], "Many:Many")]
)
def test_cardinality(spark, pairs, label):
    assert P.cardinality(spark.createDataFrame(pairs * 3, "a int, b int"), "a", "b").first()["cardinality"] == label


# --- grain ----------------------------------------------------------------------------


def test_null_part_makes_the_key_null(spark):
    df = spark.createDataFrame([("a", None), ("b", None), ("a", 1), ("a", 1)], "x string, y int")
    assert G.uniqueness(df, ["x", "y"]).first()["unique_count"] == 2
    assert G.uniqueness(df, ["x"], approximate=True).first()["unique_count"] == 2


@pytest.mark.parametrize("step, label", [(1, "daily"), (7, "weekly"), (8, "weekly"), (9, "monthly"), (30, "monthly"), (36, "irregular")])
def test_frequency_bands(spark, step, label):
    df = spark.range(20).selectExpr(f"timestamp'2024-01-01' + make_dt_interval(cast(id * {step} as int)) as t")
    assert G.temporal_frequency(df, "t").first()["frequency"] == label


def test_frequency_modes_and_single_row(spark):
    df = spark.range(40).selectExpr("timestamp'2024-01-01' + make_dt_interval(cast((id % 4) * 7 as int)) as t")
    assert G.temporal_frequency(df, "t").first()["frequency"] == "daily"
    assert G.temporal_frequency(df, "t", "distinct").first()["frequency"] == "weekly"
    one = G.temporal_frequency(df.limit(1), "t").first()
    assert (one["gaps"], one["frequency"]) == (0, "unknown")


def test_key_search_stops_early(spark):
    df = spark.range(100).selectExpr("id % 10 as t", "id as a", "id % 3 as b")
    r = G.find_key(df, "t", ["a", "b"]).first()
    assert (r["composite_key"], r["is_unique"]) == ("t,a", True)
    r = G.find_key(df, "t", ["b"]).first()
    assert (r["composite_key"], r["is_unique"]) == ("t,b", False)


# --- metrics --------------------------------------------------------------------------


@pytest.fixture(scope="module")
def facts(spark):
    rows = [("a", "x", 10.0, 2.0), ("a", "y", 20.0, 0.0), ("b", "x", 30.0, 5.0), ("b", "y", None, 5.0), ("b", "y", 6.0, None)]
    return spark.createDataFrame(rows, "g string, h string, n double, d double")


def test_safe_div_and_transform(spark):
    row = spark.range(1).select(
        safe_div(F.lit(1.0), F.lit(0.0)).alias("none"),
        safe_div(F.lit(1.0), F.lit(0.0), default=0.0).alias("zero"),
        transform(F.lit(-5.0), "LOG").alias("log"),
        transform(F.lit(-1.0), "SQRT").alias("sqrt"),
    ).first()
    assert tuple(row) == (None, 0.0, None, None)


def test_sanitised_groups(facts):
    spec = MetricSpec("m", "n", "d", scope="DIMENSIONAL", dims=("g",))
    got = {r["g"]: (r["value"], r["sample_size"]) for r in M.metric_by(facts, spec).collect()}
    assert got == {"a": (5.0, 1), "b": (6.0, 1)}


def test_share_of_parent_is_null_safe(spark):
    df = spark.createDataFrame([(None, "x", 1.0), (None, "y", 3.0), ("p", "x", 5.0)], "g string, h string, n double")
    spec = MetricSpec("s", "n", "n", "RATIO", "DIMENSIONAL", "GROUP_SUM", ("g", "h"))
    got = {(r["g"], r["h"]): r["value"] for r in M.metric_by(df, spec).collect()}
    assert got == {(None, "x"): 0.25, (None, "y"): 0.75, ("p", "x"): 1.0}


def test_trend_of_one_point_is_flat(spark):
    df = spark.createDataFrame([(1.0, "2024-01-01")], "n double, t string").withColumn("t", F.to_timestamp("t"))
    spec = MetricSpec("m", "n", template="SUM", scope="TEMPORAL", time="t", grain="daily")
    r = M.trend(M.metric_over_time(df, spec)).first()
    assert (r["trend_direction"], r["trend_slope"], r["last_value"]) == ("flat", 0.0, 1.0)


def test_spec_rules():
    with pytest.raises(ValueError):
        MetricSpec("m", "n", scope="TEMPORAL")
    with pytest.raises(ValueError):
        MetricSpec("m", "n", scope="DIMENSIONAL")
    with pytest.raises(ValueError):
        MetricSpec("m", "n", numerator_agg="LAST")
    assert MetricSpec("m", "n").kind == "MEAN" and MetricSpec("m", "n", "d").kind == "RATIO"
    assert MetricSpec("m", "n", "d", denominator_scope="?").share_of == "SAME_ROW"


def test_deduplication_keeps_the_higher_priority():
    a = MetricSpec("m", "n", scope="DIMENSIONAL", dims=("x", "y"), title="Sales by brand and city", priority=3)
    b = MetricSpec("m", "n", scope="DIMENSIONAL", dims=("y", "x"), title="Sales by brand and town", priority=1)
    c = MetricSpec("m", "n", scope="DIMENSIONAL", dims=("x", "y"), motif="Pareto")
    assert deduplicate([a, b, c]) == [b, c]


def test_bundles_give_what_single_runs_give(facts):
    specs = [
        MetricSpec("sum", "n", template="SUM", scope="DIMENSIONAL", dims=("g",)),
        MetricSpec("ratio", "n", "d", scope="DIMENSIONAL", dims=("g",)),
        MetricSpec("share", "n", "d", "RATIO", "DIMENSIONAL", "GLOBAL_SUM", ("g",)),
        MetricSpec("all", "n", "d", "RATIO", denominator_scope="GLOBAL_SUM"),
        MetricSpec("max", "n", numerator_agg="MAX", guardrail=Guardrail("d", filter_condition="d > 1")),
    ]
    assert len(bundles(specs)) == 3
    got = {(r["spec_id"], tuple((r["group_key"] or {}).values())): (r["value"], r["sample_size"]) for r in run_specs(facts, specs).collect()}
    for spec in specs:
        if spec.scope == "GLOBAL":
            r = M.metric_global(facts, spec).first()
            assert got[(spec_id(spec), ())] == (r["value"], r["sample_size"])
        else:
            for r in M.metric_by(facts, spec).collect():
                assert got[(spec_id(spec), (r["g"],))] == (pytest.approx(r["value"]), r["sample_size"])


def test_pareto_ties_of_equal_sums_do_not_depend_on_the_order_of_rows(spark):
    """0.1 + 0.2 + 0.3 as doubles is more than 0.3 + 0.2 + 0.1; both keys hold the same amounts."""
    rows = [("b", 0.1), ("b", 0.2), ("b", 0.3), ("a", 0.3), ("a", 0.2), ("a", 0.1), ("c", 1e300), ("d", 1 / 3)]
    df = spark.createDataFrame(rows, "k string, v double").coalesce(1)
    for window_rows in (100, 1):
        got = motifs.pareto(df.filter("v < 1"), "k", "v", window_rows=window_rows).orderBy("rank").collect()
        assert [(r["k"], r["value"]) for r in got] == [("a", 0.6), ("b", 0.6), ("d", 1 / 3)]
        assert got[1]["cumulative_share"] == pytest.approx(1.2 / (1.2 + 1 / 3)) and got[2]["cumulative_share"] == 1.0
    largest = motifs.pareto(df, "k", "v", 1).first()
    assert (largest["k"], largest["value"]) == ("c", 1e300)


def test_pareto_top_n_and_ties(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 5.0), ("c", 1.0), ("d", None)], "k string, v double")
    rows = motifs.pareto(df, "k", "v", 2).orderBy("rank").collect()
    assert [(r["k"], r["rank"]) for r in rows] == [("a", 1), ("b", 2)]
    assert rows[1]["cumulative_share"] == pytest.approx(10 / 11)


def test_derived_lookup_and_levels(facts):
    assert D.find_derived("ltv-cac") == "LTV_CAC" and D.find_derived("Click Through Rate") == "CTR"
    assert all(D.find_derived(x) is None for x in ("nothing like it", "", "rate", "cost"))
    assert [r["value"] for r in D.derive(facts, "roas", ("n", "d")).limit(2).collect()] == [5.0, None]
    groups = {r["g"]: r["value"] for r in D.derive(facts, "ROI", ("n", "d"), "group", ["g"]).collect()}
    assert groups == {"a": 14.0, "b": pytest.approx(2.6)}
    with pytest.raises(ValueError):
        D.derive(facts, "nothing", ("n", "d"))


# --- validation -----------------------------------------------------------------------


def grade(spark, schema, *row, **kw):
    return V.label_confidence(V.validate(spark.createDataFrame([row], schema), **kw)).first()


def test_verdict_and_label_edges(spark):
    base = "analysis_type string, sample_size bigint"
    assert grade(spark, base, "metric", 30)["verdict"] == "accept"
    small = grade(spark, base, "metric", 29)
    assert (small["verdict"], small["failed_checks"]) == ("reject", ["sample_size_adequate"])
    missing = grade(spark, base, "metric", None, table_rows=100)
    assert missing["confidence_score"] == pytest.approx(0.3)
    corr = base + ", p_value double, correlation double"
    assert grade(spark, corr, "correlation", 50, 0.05, 0.3)["confidence_score"] == pytest.approx(0.95 * 0.9)
    assert grade(spark, corr, "correlation", 50, 0.051, 0.3)["verdict"] == "reject"
    assert grade(spark, corr, "correlation", 50, 0.01, -0.29)["confidence_score"] == pytest.approx(0.95 * 0.4)


def test_anomaly_and_causal_grades(spark):
    a = "analysis_type string, sample_size bigint, anomalies_found bigint, anomaly_rate double, mean_severity double"
    assert grade(spark, a, "anomaly", 50, 3, 0.3, 2.1)["confidence_score"] == 1.0
    assert grade(spark, a, "anomaly", 50, 3, 0.31, 2.1)["confidence_score"] == pytest.approx(0.55)
    assert grade(spark, a, "anomaly", 50, 0, 0.0, 0.0)["confidence_score"] == pytest.approx(0.1)
    c = "analysis_type string, sample_size bigint, causal_confidence string, refutations_run int, refutations_passed int, standard_error double"
    assert grade(spark, c, "causal", 50, "high", 3, 2, 0.1)["confidence_score"] == 1.0
    assert grade(spark, c, "causal", 50, "medium", 3, 1, None)["confidence_score"] == pytest.approx(0.8 * 0.7 * 0.6)
    assert grade(spark, c, "causal", 50, "low", 0, 0, 0.1)["confidence_score"] == pytest.approx(0.3)


def test_few_results_keep_the_low_ones(spark):
    rows = [(f"s{i}", "l", "low") for i in range(4)]
    df = spark.createDataFrame(rows, "spec_id string, lens string, confidence_label string")
    assert V.summarize_results(df).count() == 3
    more = spark.createDataFrame(rows + [("s9", "l", "high")], "spec_id string, lens string, confidence_label string")
    assert [r["spec_id"] for r in V.summarize_results(more).collect()] == ["s9"]


def test_stability_windows(spark):
    steady = spark.range(90).selectExpr(
        "timestamp'2024-01-01' + make_dt_interval(cast(id as int)) as t", "cast(id as double) as a", "cast(id * 2 + id % 3 as double) as b"
    )
    assert V.stability_corr(steady, "a", "b", "t").first()["is_stable"]
    assert V.stability_trend(steady, "b", "t").first()["is_stable"]
    turning = steady.withColumn("b", F.abs(F.col("a") - 45))
    assert not V.stability_trend(turning, "b", "t").first()["is_stable"]
    assert not V.stability_corr(turning, "a", "b", "t").first()["is_stable"]
    same_time = steady.withColumn("t", F.lit("2024-01-01").cast("timestamp"))
    assert V.stability_trend(same_time, "b", "t").first()["window_count"] == 1
