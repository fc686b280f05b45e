"""Helpers that must stay exact when groups are split, and the shape of plans."""

import random
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import metrics as M
from plumbline.operators.spec import MetricSpec
from plumbline.plans.quantiles import exact_percentiles
from plumbline.plans.running import percentiles_from_counts, previous_value, running_totals
from plumbline.plans.staging import broadcast_if_small, checkpoint_root
from plumbline.sources.views import sales_view


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows; values repeat and some are missing."""
    rng = random.Random(5)
    rows = []
    for i in range(6000):
        key = "hot" if rng.random() < 0.7 else rng.choice(["a", "b", None])
        value = rng.choice([None, 0.0, round(rng.lognormvariate(2, 1), 2), round(rng.gauss(50, 9), 3)])
        rows.append((i, key, value))
    return rows, spark.createDataFrame(rows, "id long, key string, value double").repartition(7)


def by_key(rows):
    groups = {}
    for _, key, value in rows:
        if value is not None:
            groups.setdefault(key, []).append(value)
    return groups


@pytest.mark.parametrize("accuracy", [50, 10_000])
@pytest.mark.parametrize("window_rows", [10, 1_000_000])
def test_percentiles_match_numpy(skewed, accuracy, window_rows):
    rows, df = skewed
    probs = {"p1": 0.01, "q1": 0.25, "mid": 0.5, "q3": 0.75, "top": 1.0}
    small = {50: 100, 10_000: None}[accuracy]
    got = {r["key"]: r for r in exact_percentiles(df, "value", probs, ["key"], accuracy, window_rows, small).collect()}
    expected = by_key(rows)
    assert set(got) == set(expected)
    for key, values in expected.items():
        assert got[key]["n"] == len(values)
        for name, p in probs.items():
            assert got[key][name] == pytest.approx(np.percentile(values, 100 * p)), (key, name)


def test_large_and_small_groups_meet_in_one_result(skewed):
    rows, df = skewed
    # "hot" is bracketed, the others are counted directly.
    got = {r["key"]: r["mid"] for r in exact_percentiles(df, "value", {"mid": 0.5}, ["key"], small_group=1500).collect()}
    assert got == {key: pytest.approx(np.percentile(values, 50)) for key, values in by_key(rows).items()}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 30, 199, 201, 450])
def test_percentiles_of_small_groups(spark, n):
    values = [float((i * 37) % 101) + i / 7 for i in range(n)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    row = exact_percentiles(df, "v", {"q1": 0.25, "q2": 0.5, "q3": 0.75}).first()
    assert [row["q1"], row["q2"], row["q3"]] == pytest.approx(list(np.percentile(values, [25, 50, 75])))


@pytest.mark.parametrize("window_rows", [10, 1_000_000])
def test_running_totals_by_group(skewed, window_rows):
    rows, df = skewed
    out = running_totals(df.filter("value is not null"), [("value", "desc"), "id"], {"cum": "value"}, ["key"], window_rows)
    got = {r["id"]: r["cum"] for r in out.collect()}
    groups = {}
    for i, key, value in rows:
        if value is not None:
            groups.setdefault(key, []).append((-value, i, value))
    for items in groups.values():
        total = 0.0
        for _, i, value in sorted(items):
            total += value
            assert got[i] == pytest.approx(total)


def test_running_totals_split_without_groups(skewed):
    _, df = skewed
    split = running_totals(df.select("id", F.lit(1).cast("long").alias("one")), ["id"], {"rank": "one"}, window_rows=10)
    assert all(r["rank"] == r["id"] + 1 for r in split.collect())


@pytest.mark.parametrize("window_rows", [5, 1_000_000])
def test_previous_value_across_ranges(spark, window_rows):
    values = [float(i * i) for i in range(400)]
    df = spark.createDataFrame([(v,) for v in values], "t double").repartition(5)
    got = {r["t"]: r["before"] for r in previous_value(df, "t", "before", window_rows=window_rows).collect()}
    assert got[0.0] is None
    assert all(got[values[i]] == values[i - 1] for i in range(1, 400))


@pytest.mark.parametrize("window_rows", [3, 1_000_000])
def test_percentile_of_counts(spark, window_rows):
    counts = [(1.0, 3), (2.0, 1), (10.0, 4), (11.0, 2)]
    whole = [v for v, n in counts for _ in range(n)]
    df = spark.createDataFrame(counts, "v double, n long")
    row = percentiles_from_counts(df, "v", "n", {"m": 0.5, "q": 0.25}, window_rows=window_rows).first()
    assert (row["n"], row["m"], row["q"]) == (10, np.percentile(whole, 50), np.percentile(whole, 25))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filter_and_columns_reach_the_scan(spark, folder):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    spec = MetricSpec("tax", "l_extendedprice", "l_tax", "RATIO", "DIMENSIONAL", "DIMENSIONAL", ("l_returnflag",))
    plan = plan_of(M.metric_by(lines, spec, ordered=False))
    assert "GreaterThan(l_tax,0.0)" in plan and "IsNotNull(l_extendedprice)" in plan
    assert "ReadSchema: struct<l_extendedprice:double,l_tax:double,l_returnflag:string>" in plan
    assert "Python" not in plan


def test_unused_dimensions_are_not_joined(spark, folder):
    plan = plan_of(sales_view(spark, folder, "date", "sales", trusted_keys=True))
    assert "Join" not in plan and "Join" in plan_of(sales_view(spark, folder, "date", "sales"))


def test_no_single_partition_exchange_over_rows(spark, folder):
    spec = MetricSpec("sales", "sales", template="SUM", scope="TEMPORAL", time="date", grain="monthly", dims=("brand",))
    plan = plan_of(M.metric_over_time(sales_view(spark, folder, "brand", "date", "sales"), spec))
    assert "SinglePartition" not in plan


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_partitioning_does_not_change_hashed_results(spark, folder, partitions):
    from plumbline.operators.causal import refute

    rows = spark.range(3000).select(
        F.col("id"), (F.col("id") % 50).cast("double").alias("c"), ((F.col("id") * 7) % 13 + F.col("id") % 50).cast("double").alias("t")
    )
    rows = rows.withColumn("y", 2 * F.col("t") + F.col("c")).repartition(partitions)
    r = refute(rows, "t", "y", ["c"], "id").first()
    assert r["estimated_effect"] == pytest.approx(2.0)
    assert r["subset_effect"] == pytest.approx(2.0)
    # Fixed by the hash of the key alone.
    assert round(r["placebo_effect"], 9) == round(PLACEBO.setdefault("seen", r["placebo_effect"]), 9)


PLACEBO = {}


def test_staging_needs_a_named_folder():
    def session(setting, folder):
        conf = SimpleNamespace(get=lambda key, default: setting)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getCheckpointDir=lambda: folder))

    with pytest.raises(ValueError):
        checkpoint_root(session(None, None))
    assert checkpoint_root(session("s3://shared/", None)) == "s3://shared"
    assert checkpoint_root(session(None, "file:/here")) == "file:/here"


def test_broadcast_is_bounded_in_bytes(spark):
    wide = spark.range(40).withColumn("text", F.repeat(F.lit("x"), 2_000_000))
    assert "hint" not in broadcast_if_small(wide)._jdf.queryExecution().logical().toString().lower()
    assert "hint" in broadcast_if_small(spark.range(40))._jdf.queryExecution().logical().toString().lower()
