"""What one row of a table stands for."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import seconds
from plumbline.plans.running import percentiles_from_counts, previous_value
from plumbline.plans.staging import checkpoint_parquet

UNIQUE = 0.99


def _any_null(cols: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])


def uniqueness(df: DataFrame, cols: Sequence[str], approximate: bool = False) -> DataFrame:
    """(columns, unique_count, row_count, ratio) of a column list as a key.

    A null in any part makes the key null, and the null key is one value. Exact: rows
    are folded on the whole key, map side first, so no single column value is hot.
    """
    cols = list(cols)
    if approximate:
        key = F.when(~_any_null(cols), F.struct(*cols))
        distinct = F.approx_count_distinct(F.xxhash64(key), 0.01)
        counted = df.agg(distinct.alias("unique_count"), F.count("*").alias("row_count"))
    else:
        hole = _any_null(cols)
        keys = df.select(hole.alias("_hole"), *[F.when(~hole, F.col(c)).alias(f"_k{i}") for i, c in enumerate(cols)])
        folded = keys.groupBy("_hole", *[f"_k{i}" for i in range(len(cols))]).agg(F.count("*").alias("n"))
        counted = folded.agg(F.count("*").alias("unique_count"), F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("row_count"))
    return counted.select(
        F.lit(",".join(cols)).alias("columns"),
        "unique_count",
        "row_count",
        F.coalesce(F.col("unique_count") / F.nullif("row_count", F.lit(0)), F.lit(0.0)).alias("ratio"),
    )


def key_candidates(profile: DataFrame, limit: int | None = None) -> DataFrame:
    """Columns worth trying in a key: identifiers, then ranks, then rich categories.

    All of them, unless ``limit`` names how many.
    """
    sure = F.col("confidence") >= 0.70
    tier = (
        F.when((F.col("semantic_guess") == "identifier") & sure, 1)
        .when(F.col("is_ordinal"), 2)
        .when((F.col("statistical_type") == "categorical") & sure & (F.col("unique_ratio") > 0.05), 3)
    )
    found = (
        profile.filter(F.col("statistical_type") != "temporal")
        .withColumn("tier", tier)
        .filter("tier is not null")
        .select("column_name", "tier", "position")
        .orderBy("tier", "position")
    )
    return found if limit is None else found.limit(limit)


def find_key(df: DataFrame, time: str | None, dims: Sequence[str], approximate: bool = False) -> DataFrame:
    """Time, time+d1, time+d1+d2, …: the first key that is unique enough, else the best.

    Without ``time`` the keys are d1, d1+d2, …; all dimensions are tried.

    One job per key tried, each reading only its columns, and the search ends at the
    first success: a table with a real key never pays for the longer ones.
    """
    columns = [time, *dims] if time else list(dims)
    best = None
    for i in range(1, len(columns) + 1):
        tried = uniqueness(df, columns[:i], approximate).first()
        if best is None or tried["ratio"] > best["ratio"]:
            best = tried
        if tried["ratio"] >= UNIQUE:
            break
    return df.sparkSession.range(1).select(
        F.lit(best["columns"]).alias("composite_key"),
        F.lit(best["ratio"]).alias("uniqueness_ratio"),
        F.lit(best["ratio"] >= UNIQUE).alias("is_unique"),
    )


def _gaps(df: DataFrame, time: str, mode: str) -> tuple[DataFrame, DataFrame]:
    """(gap in seconds, how often) and the rows per timestamp."""
    stamps = checkpoint_parquet(
        df.filter(F.col(time).isNotNull()).groupBy(seconds(F.col(time)).alias("t")).agg(F.count("*").alias("rows"))
    )
    stepped = previous_value(stamps.select("t"), "t", "before").filter("before is not null")
    gaps = stepped.select((F.col("t") - F.col("before")).alias("gap")).groupBy("gap").agg(F.count("*").alias("times"))
    if mode == "rows":
        # Rows sharing a timestamp stand zero seconds apart.
        same = stamps.agg(F.sum(F.col("rows") - 1).alias("times")).select(F.lit(0.0).alias("gap"), "times")
        gaps = gaps.unionByName(same.filter("times > 0"))
    return gaps, stamps


def temporal_frequency(df: DataFrame, time: str, mode: str = "rows") -> DataFrame:
    """One row: median gap between consecutive rows and the frequency it stands for.

    ``mode='rows'`` counts the zero gaps of rows with equal time, ``'distinct'`` looks at
    distinct times only.
    """
    gaps, _ = _gaps(df, time, mode)
    median = percentiles_from_counts(gaps, "gap", "times", {"median_gap": 0.5})
    days = F.floor(F.col("median_gap") / 86400)
    label = (
        F.when(F.col("median_gap").isNull(), "unknown")
        .when(days <= 1.5, "daily")
        .when(days <= 8, "weekly")
        .when(days <= 35, "monthly")
        .otherwise("irregular")
    )
    # An aggregate without keys keeps one row when there is no gap at all.
    return median.agg(F.max("n").alias("gaps"), F.max("median_gap").alias("median_gap")).select(
        F.coalesce("gaps", F.lit(0).cast("long")).alias("gaps"), F.col("median_gap").alias("median_gap_seconds"), label.alias("frequency")
    )


def rows_per_period(df: DataFrame, time: str) -> DataFrame:
    """Mean number of rows per distinct timestamp (a missing one counts as its own)."""
    return df.groupBy(time).agg(F.count("*").alias("rows")).agg(
        F.count("*").alias("periods"), F.avg("rows").alias("avg_rows_per_period")
    )


def discover_grain(df: DataFrame, profile: DataFrame) -> DataFrame:
    """One row: grain class, frequency, key, uniqueness and rows per period.

    The profile has one row per column, so its names may come to the driver.
    """
    times = [r[0] for r in profile.filter("statistical_type = 'temporal'").orderBy("position").select("column_name").collect()]
    dims = [r[0] for r in key_candidates(profile).select("column_name").collect()]

    if not times:
        if dims:
            key = find_key(df, None, dims).drop("is_unique")
        else:
            key = df.sparkSession.range(1).select(
                F.lit(None).cast("string").alias("composite_key"), F.lit(0.0).alias("uniqueness_ratio")
            )
        return key.select(
            F.lit("snapshot").alias("primary_grain"),
            F.lit(None).cast("string").alias("temporal_frequency"),
            "composite_key",
            "uniqueness_ratio",
            (F.col("uniqueness_ratio") >= UNIQUE).alias("is_unique"),
            F.lit(False).alias("aggregation_needed"),
            F.lit(None).cast("double").alias("avg_rows_per_period"),
        )

    time = times[0]
    frequency = temporal_frequency(df, time).select(F.col("frequency").alias("temporal_frequency"))
    key = find_key(df, time, dims)
    density = rows_per_period(df, time).select("avg_rows_per_period")
    joined = key.crossJoin(F.broadcast(frequency)).crossJoin(F.broadcast(density))
    series = F.col("is_unique") & (F.col("composite_key") == time)
    regular = F.col("temporal_frequency").isin("daily", "weekly", "monthly")
    grain = (
        F.when(series & regular, F.concat(F.lit("timeseries_"), F.col("temporal_frequency")))
        .when(series, "unknown")
        .when(F.col("is_unique"), "transactional")
        .otherwise("row_index")
    )
    return joined.select(
        grain.alias("primary_grain"),
        "temporal_frequency",
        "composite_key",
        "uniqueness_ratio",
        "is_unique",
        (~series).alias("aggregation_needed"),
        F.when(series, 1.0).otherwise(F.col("avg_rows_per_period")).alias("avg_rows_per_period"),
    )
