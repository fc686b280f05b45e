"""One row per column with everything the profile rules need.

Moments come from one aggregate over the unpivoted numbers. Exact distinct counts come
from one shuffle of the distinct (column, value) pairs; medians from the bracketed
percentile over the unpivoted numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.fixed_values import TRIGGER_WORDS
from plumbline.functions.columns import is_integer, is_numeric, is_temporal
from plumbline.plans.quantiles import exact_percentiles
from plumbline.plans.staging import checkpoint_parquet


def _quoted(name: str) -> Column:
    return F.col(f"`{name}`")


def quote(name: str) -> str:
    """A column name inside expression text."""
    return "`" + name.replace("`", "``") + "`"


def text(value: str) -> str:
    """A string literal inside expression text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def distinct_counts(df: DataFrame, approximate: bool = False) -> DataFrame:
    """(column_name, unique_count) where a null counts as one more value.

    Values travel in a slot of their own type, so nothing is turned into text. The
    second shuffle carries one partial count per column and task.
    """
    if approximate:
        counts = df.agg(
            *[
                (F.approx_count_distinct(_quoted(c), 0.01) + F.max(_quoted(c).isNull().cast("int"))).alias(f"u_{i}")
                for i, c in enumerate(df.columns)
            ]
        )
        rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"u_{i}").cast("long").alias("unique_count")) for i, c in enumerate(df.columns)]
        return counts.select(F.inline(F.array(*rows)))

    cells = []
    for i, f in enumerate(df.schema.fields):
        c, slots = quote(f.name), {"whole": "CAST(NULL AS BIGINT)", "double": "CAST(NULL AS DOUBLE)", "text": "CAST(NULL AS STRING)"}
        if is_integer(f.dataType) or isinstance(f.dataType, T.BooleanType):
            slots["whole"] = f"CAST({c} AS BIGINT)"
        elif is_temporal(f.dataType):
            slots["whole"] = f"unix_micros(CAST({c} AS TIMESTAMP))"
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            slots["double"] = f"CAST({c} AS DOUBLE)"
        else:
            slots["text"] = f"CAST({c} AS STRING)"
        cells.append(f"struct({i} AS i, " + ", ".join(f"{v} AS {k}" for k, v in slots.items()) + ")")
    counts = (
        df.select(F.expr(f"inline(array({', '.join(cells)}))"))
        .groupBy("i", "whole", "double", "text")
        .agg(F.lit(1).cast("long").alias("one"))
        .groupBy("i")
        .agg(F.sum("one").alias("unique_count"))
    )
    name = F.element_at(F.array(*[F.lit(c) for c in df.columns]), F.col("i") + 1)
    return counts.select(name.alias("column_name"), "unique_count")


def column_measures(df: DataFrame, distinct: bool = True, approximate: bool = False) -> DataFrame:
    """Counts, moments, ordinal sums and zero tests for every column, one row each.

    Rows are unpivoted to (column number, present, number), so one small aggregate
    serves any width; partial sums leave one row per column and task for the shuffle.
    """
    fields = df.schema.fields
    triggers = [f.name for f in fields if is_numeric(f.dataType) and any(w in f.name.lower() for w in TRIGGER_WORDS)]
    cells = ", ".join(
        f"struct({i} AS i, {quote(f.name)} IS NOT NULL AS present, "
        + (f"CAST({quote(f.name)} AS DOUBLE)" if is_numeric(f.dataType) else "CAST(NULL AS DOUBLE)")
        + " AS d)"
        for i, f in enumerate(fields)
    )
    zero_marks = [F.expr(f"{quote(t)} = 0").alias(f"_z{j}") for j, t in enumerate(triggers)]
    moments = df.select(*zero_marks, F.expr(f"inline(array({cells}))")).groupBy("i").agg(
        F.count("*").alias("row_count"),
        F.count_if("present").alias("present"),
        F.avg("d").alias("mean"),
        F.stddev_samp("d").alias("std"),
        F.min("d").alias("min"),
        F.max("d").alias("max"),
        F.sum("d").alias("sum"),
        F.skewness("d").alias("skew"),
        F.kurtosis("d").alias("kurt"),
        F.expr("count_if(d = 0)").alias("zero"),
        F.expr("bool_and(d = floor(d))").alias("whole"),
        *[F.expr(f"count_if(_z{j})").alias(f"_t{j}") for j in range(len(triggers))],
        *[F.expr(f"count_if(d = 0 AND _z{j})").alias(f"_b{j}") for j in range(len(triggers))],
    )
    # The first other column of which: this is 0 in more than 80 % of its zero rows.
    tests = " ".join(
        f"WHEN column_name <> {text(t)} AND _b{j} / nullif(_t{j}, 0) > 0.8 THEN {text(t)}" for j, t in enumerate(triggers)
    )
    trigger = F.expr(f"CASE WHEN is_numeric THEN CASE {tests} END END") if triggers else F.lit(None).cast("string")
    facts = ", ".join(
        f"struct({i} AS i, {text(f.name)} AS column_name, {text(f.dataType.simpleString())} AS data_type, "
        f"{is_numeric(f.dataType)} AS is_numeric, {is_integer(f.dataType)} AS is_integer, {is_temporal(f.dataType)} AS is_temporal, "
        f"{isinstance(f.dataType, T.BooleanType)} AS is_boolean, {isinstance(f.dataType, T.StringType)} AS is_text)"
        for i, f in enumerate(fields)
    )
    described = df.sparkSession.range(1).select(F.expr(f"inline(array({facts}))"))
    # All three sides have one row per column of the table. An empty table has no cells.
    measures = described.join(F.broadcast(moments), "i", "left").withColumn("trigger", trigger)
    measures = measures.withColumnRenamed("i", "position").drop(*[f"_{k}{j}" for k in "tb" for j in range(len(triggers))])
    measures = measures.na.fill(0, ["row_count", "present"])
    if not distinct:
        return measures
    counts = distinct_counts(df, approximate)
    return measures.join(F.broadcast(counts), "column_name", "left").na.fill(0, ["unique_count"])


def medians(df: DataFrame) -> DataFrame:
    """(column_name, median) of every numeric column, exact."""
    numeric = [f.name for f in df.schema.fields if is_numeric(f.dataType)]
    if not numeric:
        return df.sparkSession.createDataFrame([], "column_name string, median double")
    cells = [F.struct(F.lit(c).alias("column_name"), _quoted(c).cast("double").alias("number")) for c in numeric]
    long = df.select(F.inline(F.array(*cells)))
    halves = exact_percentiles(long, "number", {"median": 0.5}, ["column_name"], small_group=None)
    return halves.select("column_name", "median")


def basic_stats(df: DataFrame) -> DataFrame:
    """Null count and share for all columns; mean, median, std, min, max for numbers."""
    measures = column_measures(df)
    null_count = F.col("row_count") - F.col("present")
    stats = measures.join(F.broadcast(medians(df)), "column_name", "left")
    return stats.select(
        "column_name",
        null_count.alias("null_count"),
        F.coalesce(100.0 * null_count / F.nullif("row_count", F.lit(0)), F.lit(0.0)).alias("null_percentage"),
        "unique_count",
        "mean",
        "median",
        "std",
        "min",
        "max",
    )
