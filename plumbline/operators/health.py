"""Data health: score per column and for the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.measures import column_measures


def health_columns(df: DataFrame, measures: DataFrame | None = None, approximate: bool = False) -> DataFrame:
    """One row per column: null share, score, and the marks behind warnings."""
    m = measures if measures is not None else column_measures(df, approximate=approximate)
    rows = F.nullif("row_count", F.lit(0))
    null_pct = F.coalesce(100.0 * (F.col("row_count") - F.col("present")) / rows, F.lit(0.0))
    ratio = F.coalesce(F.col("unique_count") / rows, F.lit(0.0))
    base = (
        F.when(F.col("null_percentage") > 50, 0.0)
        .when(F.col("null_percentage") > 20, 50.0)
        .when(F.col("null_percentage") > 5, 80.0)
        .otherwise(100.0)
    )
    return (
        m.withColumn("null_percentage", null_pct)
        .withColumn("unique_ratio", ratio)
        .select(
            "column_name",
            "row_count",
            "null_percentage",
            "unique_count",
            "unique_ratio",
            (F.col("null_percentage") > 50).alias("is_critical"),
            ((F.col("null_percentage") > 20) & (F.col("null_percentage") <= 50)).alias("many_nulls"),
            F.coalesce(F.col("std") == 0, F.lit(False)).alias("zero_variance"),
            (F.col("unique_count") > 1000).alias("high_cardinality"),
            ((F.col("unique_ratio") > 0.95) & (F.col("unique_count") > 100)).alias("likely_identifier"),
            F.when(F.col("std") == 0, F.least(base, F.lit(30.0))).otherwise(base).alias("score"),
        )
    )


def health_report(df: DataFrame, min_score: float = 70.0, columns: DataFrame | None = None) -> DataFrame:
    """One row: overall score, issue counts and whether to go on."""
    cols = columns if columns is not None else health_columns(df)

    def marks(name: str):
        return F.sum(F.col(name).cast("long"))

    counted = cols.agg(
        F.max("row_count").alias("row_count"),
        F.count("*").alias("column_count"),
        F.avg("score").alias("_mean"),
        (marks("is_critical") + F.when(F.max("row_count") < 30, 1).otherwise(0)).alias("critical_issues"),
        (
            marks("many_nulls") + marks("zero_variance") + marks("high_cardinality") + marks("likely_identifier")
        ).alias("warnings"),
    )
    critical = F.col("critical_issues") > 0
    score = F.coalesce(F.col("_mean"), F.lit(0.0)) * F.when(critical, 0.5).otherwise(1.0)
    return counted.withColumn("overall_score", score).select(
        "overall_score",
        "critical_issues",
        "warnings",
        "row_count",
        "column_count",
        ((F.col("overall_score") >= min_score) & ~critical).alias("should_proceed"),
    )
