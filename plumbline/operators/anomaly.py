"""Unusual values by fences, by z-score, by isolation, and where methods agree.

Thresholds may be per group. They are one row per group, so the facts are read twice
(once for the thresholds, once for the flags) and never shuffled while the groups fit
a checked broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.columns import hash_uniform
from plumbline.plans.quantiles import exact_percentiles
from plumbline.plans.running import WINDOW_ROWS
from plumbline.plans.staging import checkpoint_parquet, join_on_group

MIN_VALUES = 10
# Defaults of the isolation forest: trees, rows a tree rests on, draws over those wanted, draws of a row at most.
TREES = 100
SAMPLE = 256
SPARE = 1.3
MOST_DRAWS = 64
EULER = 0.5772156649015329


def iqr_bounds(df: DataFrame, col: str, by: Sequence[str] = (), window_rows: int = WINDOW_ROWS) -> DataFrame:
    """q1, q3, iqr and fences per group."""
    q = exact_percentiles(df, col, {"q1": 0.25, "q3": 0.75}, by, window_rows=window_rows)
    iqr = F.col("q3") - F.col("q1")
    return q.select(
        *by, "n", "q1", "q3", iqr.alias("iqr"), (F.col("q1") - 1.5 * iqr).alias("lower"), (F.col("q3") + 1.5 * iqr).alias("upper")
    )


def zscore_bounds(df: DataFrame, col: str, by: Sequence[str] = (), threshold: float = 3.0) -> DataFrame:
    """Mean, population deviation and limits per group."""
    c = F.col(col).cast("double")
    m = df.groupBy(*by).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"))
    return m.select(
        *by,
        "n",
        "mean",
        "std",
        (F.col("mean") - threshold * F.col("std")).alias("lower"),
        (F.col("mean") + threshold * F.col("std")).alias("upper"),
    )


def _classify(value: Column, lower: Column, upper: Column) -> Column:
    """Spike or drop and how far; a value of exactly zero is called that on either side."""
    spike = F.when(value > upper * 2, "extreme_spike").otherwise("spike")
    drop = F.when((value <= 0) | (value < lower / 2), "extreme_drop").otherwise("drop")
    return F.when(value == 0, "zero_value").when(value > upper, spike).when(value < lower, drop)


def classify_anomalies(df: DataFrame, col: str, lower: str = "lower", upper: str = "upper") -> DataFrame:
    """Add ``classification`` to rows that carry their bounds."""
    return df.withColumn("classification", _classify(F.col(col), F.col(lower), F.col(upper)))


def _with_bounds(df: DataFrame, col: str, bounds: DataFrame, by: Sequence[str]) -> DataFrame:
    return join_on_group(df.filter(F.col(col).isNotNull()), bounds, list(by))


def _iqr_severity(value: Column) -> Column:
    beyond = F.when(value > F.col("upper"), value - F.col("upper")).otherwise(F.col("lower") - value)
    return F.when(F.col("iqr") > 0, beyond / F.nullif("iqr", F.lit(0.0))).otherwise(0.0)


def flag_iqr(df: DataFrame, col: str, by: Sequence[str] = (), bounds: DataFrame | None = None) -> DataFrame:
    """Every non-null row with its fences, ``is_anomaly`` and ``severity``."""
    bounds = checkpoint_parquet(iqr_bounds(df, col, by)) if bounds is None else bounds
    v = F.col(col).cast("double")
    out = (v < F.col("lower")) | (v > F.col("upper"))
    flagged = _with_bounds(df, col, bounds, by).withColumn("is_anomaly", (F.col("n") >= MIN_VALUES) & out)
    return flagged.withColumn("severity", F.when(F.col("is_anomaly"), _iqr_severity(v)))


def flag_zscore(df: DataFrame, col: str, threshold: float = 3.0, by: Sequence[str] = ()) -> DataFrame:
    """Every non-null row with its limits, ``is_anomaly`` and ``severity`` (the z-score)."""
    bounds = checkpoint_parquet(zscore_bounds(df, col, by, threshold))
    z = F.abs((F.col(col).cast("double") - F.col("mean")) / F.nullif("std", F.lit(0.0)))
    flagged = _with_bounds(df, col, bounds, by).withColumn("_z", z)
    usable = (F.col("n") >= MIN_VALUES) & F.col("_z").isNotNull()
    return flagged.withColumn("is_anomaly", usable & F.coalesce(F.col("_z") > threshold, F.lit(False))).withColumn(
        "severity", F.when(F.col("is_anomaly"), F.col("_z"))
    ).drop("_z")


def _only(flagged: DataFrame, df: DataFrame, col: str) -> DataFrame:
    rows = classify_anomalies(flagged.filter("is_anomaly"), col)
    return rows.select(*df.columns, "lower", "upper", "severity", "classification")


def anomalies_iqr(df: DataFrame, col: str, by: Sequence[str] = (), window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Rows beyond the fences; all columns of the row stay as context."""
    fences = checkpoint_parquet(iqr_bounds(df, col, by, window_rows))
    return _only(flag_iqr(df, col, by, fences), df, col)


def anomalies_zscore(df: DataFrame, col: str, threshold: float = 3.0, by: Sequence[str] = ()) -> DataFrame:
    """Rows more than ``threshold`` population deviations from the mean."""
    return _only(flag_zscore(df, col, threshold, by), df, col)


def anomaly_summary(flagged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Count, rate, bounds and severity of flagged rows."""
    return flagged.groupBy(*by).agg(
        F.count("*").alias("sample_size"),
        F.count_if("is_anomaly").alias("anomalies_found"),
        F.avg(F.col("is_anomaly").cast("double")).alias("anomaly_rate"),
        F.max("lower").alias("lower"),
        F.max("upper").alias("upper"),
        F.coalesce(F.avg(F.when(F.col("is_anomaly"), F.col("severity"))), F.lit(0.0)).alias("mean_severity"),
        F.coalesce(F.max(F.when(F.col("is_anomaly"), F.col("severity"))), F.lit(0.0)).alias("max_severity"),
    )


def contamination(df: DataFrame, col: str, by: Sequence[str] = (), bounds: DataFrame | None = None) -> DataFrame:
    """Share of rows beyond the fences, held between 1 % and 15 %."""
    rate = F.avg(F.col("_out").cast("double"))
    bounds = checkpoint_parquet(iqr_bounds(df, col, by)) if bounds is None else bounds
    v = F.col(col).cast("double")
    rows = _with_bounds(df, col, bounds, by).withColumn("_out", (v < F.col("lower")) | (v > F.col("upper")))
    return rows.groupBy(*by).agg(rate.alias("iqr_rate")).withColumn(
        "contamination", F.greatest(F.lit(0.01), F.least(F.lit(0.15), F.col("iqr_rate")))
    )


# --- isolation forest on one column ---------------------------------------------------


def _expected_path(n: Column) -> Column:
    """Mean depth of an unsuccessful search among n values."""
    several = 2 * (F.log(F.greatest(n - 1, F.lit(1)).cast("double")) + EULER) - 2 * (n - 1) / n
    return F.when(n > 2, several).when(n == 2, 1.0).otherwise(0.0)


def _samples(df: DataFrame, col: str, key: Column, seed: int, trees: int, sample: int) -> DataFrame:
    """(tree, v): hashed samples of at most ``sample`` rows a tree, by one rule for any table.

    Each row makes the same number of draws, just enough for all samples together and
    MOST_DRAWS at most; a draw takes part by one hash and picks its tree by another.
    Each tree keeps the lowest hashes.
    """
    facts = df.select(F.col(col).cast("double").alias("v"), key.cast("long").alias("k")).filter("v is not null and not isnan(v)")
    n = max(1, facts.count())
    want = SPARE * sample * trees
    draws = min(MOST_DRAWS, max(1, math.ceil(want / n)))
    drawn = facts.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    drawn = drawn.withColumn("u", hash_uniform("k", F.lit(seed) + 2 * F.col("j"))).filter(F.col("u") < min(1.0, want / (n * draws)))
    drawn = drawn.withColumn("tree", F.floor(hash_uniform("k", F.lit(seed) + 2 * F.col("j") + 1) * trees).cast("int"))
    lowest = W.partitionBy("tree").orderBy("u", "v")
    return drawn.withColumn("_place", F.row_number().over(lowest)).filter(F.col("_place") <= sample).select("tree", "v")


def _leaves(samples: DataFrame, seed: int, sample: int) -> DataFrame:
    """(tree, low, high, path in billionths): the values low ≤ v < high end in this leaf.

    All trees grow one level at a time: a node's values are cut at a hashed place between
    its least and its greatest. The rows of a tree stay together, so there is one shuffle.
    """
    depth = max(1, math.ceil(math.log2(max(sample, 2))))
    none = F.lit(None).cast("double")
    rows = samples.repartition("tree").select("tree", "v", F.lit(1).cast("long").alias("node"), F.lit(0).alias("depth"), none.alias("low"), none.alias("high"))
    node = W.partitionBy("tree", "node")
    for _ in range(depth):
        place = hash_uniform(F.col("tree").cast("long") * (1 << (depth + 1)) + F.col("node"), seed - 1)
        least, greatest = F.min("v").over(node), F.max("v").over(node)
        cut = least + (greatest - least) * place
        rows = rows.withColumn("cut", F.when((cut > least) & (cut <= greatest), cut))
        left, cuts = F.col("v") < F.col("cut"), F.col("cut").isNotNull()
        rows = rows.select(
            "tree",
            "v",
            F.when(~cuts, F.col("node")).when(left, 2 * F.col("node")).otherwise(2 * F.col("node") + 1).alias("node"),
            (F.col("depth") + cuts.cast("int")).alias("depth"),
            F.when(cuts & ~left, F.col("cut")).otherwise(F.col("low")).alias("low"),
            F.when(cuts & left, F.col("cut")).otherwise(F.col("high")).alias("high"),
        )
    size = F.count("*")
    return rows.groupBy("tree", "node", "low", "high", "depth").agg(
        size.alias("n"), F.round((F.col("depth") + _expected_path(size)) * 1e9).cast("long").alias("path")
    )


def _score_steps(leaves: DataFrame) -> DataFrame:
    """(edge, severity): the score of values from ``edge`` up to the next; null is the start.

    At most trees × sample rows, which bounds the one ordered window over them.
    """
    whole = leaves.groupBy("tree").agg(F.sum("n").alias("n")).agg(F.count("*").alias("trees"), F.max("n").alias("size"))
    turns = leaves.select(F.col("low").alias("edge"), "path").union(
        leaves.filter("high is not null").select("high", (-F.col("path")).alias("path"))
    )
    order = W.orderBy(F.col("edge").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    total = turns.groupBy("edge").agg(F.sum("path").alias("turn")).withColumn("total", F.sum("turn").over(order))
    mean = F.col("total") / 1e9 / F.col("trees")
    score = F.pow(F.lit(2.0), -mean / F.greatest(_expected_path(F.col("size")), F.lit(1e-12)))
    return total.crossJoin(F.broadcast(whole)).select("edge", F.round(score, 9).alias("severity"))


def flag_iforest(
    df: DataFrame,
    col: str,
    key: Column | str,
    seed: int = 42,
    rate: float | None = None,
    source: DataFrame | None = None,
    trees: int = TREES,
    sample: int = SAMPLE,
) -> DataFrame:
    """Every non-null row with its isolation score in ``severity`` and ``is_anomaly``.

    ``key`` is an integer that identifies the row; the samples are drawn by its hash.
    ``source`` may name the same rows with fewer columns made, for the passes before.
    The score is a step function of the value: rows find their step by a binary search
    over the bounded edges, and the cut comes from exact counts per step, not from a sort
    of all rows.
    """
    key = F.col(key) if isinstance(key, str) else key
    source = df if source is None else source
    leaves = checkpoint_parquet(_leaves(_samples(source, col, key, seed, trees, sample), seed, sample))
    steps = checkpoint_parquet(_score_steps(leaves))
    edges = [r["edge"] for r in steps.filter("edge is not null").orderBy("edge").select("edge").collect()]  # ≤ trees × sample
    named = steps.select((F.row_number().over(W.orderBy(F.col("edge").asc_nulls_first())) - 1).cast("double").alias("_b"), "severity")

    def scored_rows(rows: DataFrame) -> DataFrame:
        value = F.col(col).cast("double")
        rows = rows.filter(value.isNotNull()).withColumn("_v", value)
        if edges:
            rows = Bucketizer(splits=[-math.inf, *edges, math.inf], inputCol="_v", outputCol="_at", handleInvalid="keep").transform(rows)
        else:
            rows = rows.withColumn("_at", F.lit(0.0))
        return rows.join(F.broadcast(named), F.col("_at") == F.col("_b"), "left").drop("_v", "_at", "_b")

    levels = scored_rows(source.select(col)).groupBy("severity").agg(F.count("*").alias("rows")).filter("severity is not null")
    levels = levels.orderBy(F.col("severity").desc()).toPandas()  # one row per step at most
    n = int(levels["rows"].sum())
    if rate is None:
        rate = contamination(source, col).first()["contamination"]
    rate = 0.01 if rate is None else rate
    # The cut is the interpolated percentile of −severity at ``rate``.
    reached, severity = levels["rows"].cumsum().to_numpy(), levels["severity"].to_numpy()
    at = rate * (n - 1)
    low = severity[reached.searchsorted(math.floor(at), side="right")] if n else 0.0
    high = severity[reached.searchsorted(math.ceil(at), side="right")] if n else 0.0
    cut = low + (high - low) * (at - math.floor(at))
    flag = F.lit(n >= MIN_VALUES) & F.coalesce(F.col("severity") > F.lit(float(cut)), F.lit(False))
    return scored_rows(df).withColumn("is_anomaly", flag)


def anomalies_iforest(
    df: DataFrame,
    col: str,
    key: Column | str,
    seed: int = 42,
    rate: float | None = None,
    trees: int = TREES,
    sample: int = SAMPLE,
) -> DataFrame:
    """Rows that isolate early; classified against two population deviations."""
    flagged = flag_iforest(df, col, key, seed, rate, None, trees, sample)
    bounds = zscore_bounds(df, col, (), 2.0).select("lower", "upper")
    rows = flagged.filter("is_anomaly").crossJoin(F.broadcast(bounds))
    return classify_anomalies(rows, col).select(*df.columns, "lower", "upper", "severity", "classification")


def anomalies_consensus(
    df: DataFrame,
    col: str,
    min_methods: int = 2,
    by: Sequence[str] = (),
    key: Column | str | None = None,
    seed: int = 42,
    threshold: float = 3.0,
) -> DataFrame:
    """Rows flagged by at least ``min_methods`` methods, most severe first.

    Flags sit on the same row, so methods are counted without a join. Without ``key`` the
    isolation forest is left out; it looks at the whole column, not at groups. Severity
    and class come from the first method that flagged the row.
    """
    names = df.columns

    def tagged(flagged: DataFrame, tag: str) -> DataFrame:
        kept = flagged.withColumns({f"_{tag}": F.col("is_anomaly"), f"_{tag}_s": F.col("severity")})
        return kept.withColumn(f"_{tag}_c", _classify(F.col(col), F.col("lower"), F.col("upper")))

    def own(frame: DataFrame) -> DataFrame:
        return frame.select(*names, *[c for c in frame.columns if c.startswith("_")])

    fences = checkpoint_parquet(iqr_bounds(df, col, by))
    rows = own(tagged(flag_iqr(df, col, by, fences), "iqr"))
    rows = own(tagged(flag_zscore(rows, col, threshold, by), "zscore"))
    tags = ["iqr", "zscore"]
    if key is not None:
        bounds = zscore_bounds(df, col, (), 2.0).select("lower", "upper")
        rate = contamination(df, col, (), None if by else fences).first()["contamination"]
        scored = flag_iforest(rows, col, key, seed, rate, df).crossJoin(F.broadcast(bounds))
        rows = own(tagged(scored, "isolation_forest"))
        tags.append("isolation_forest")

    count = sum((F.col(f"_{t}").cast("int") for t in tags), F.lit(0))
    agreed = F.filter(F.array(*[F.when(F.col(f"_{t}"), F.lit(t)) for t in tags]), lambda m: m.isNotNull())
    first = F.coalesce(*[F.when(F.col(f"_{t}"), F.struct(F.col(f"_{t}_s").alias("s"), F.col(f"_{t}_c").alias("c"))) for t in tags])
    return (
        rows.withColumn("agreement_count", count)
        .filter(F.col("agreement_count") >= min_methods)
        .select(
            *names,
            "agreement_count",
            F.array_join(agreed, ",").alias("methods_agreed"),
            F.when(F.col("agreement_count") >= 3, "high").when(F.col("agreement_count") >= 2, "medium").otherwise("low").alias("consensus_confidence"),
            first["s"].alias("severity"),
            first["c"].alias("classification"),
        )
        .orderBy(F.col("severity").desc(), col)
    )
