"""Metric formulas over the whole table, by dimension and over time."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import is_numeric, safe_div, transform
from plumbline.operators.spec import GRAINS, MetricSpec
from plumbline.plans.staging import broadcast_if_small, checkpoint_parquet

SIGNIFICANT_ROWS = 30
MAX_NULL_SHARE = 0.7


# --- rows ----------------------------------------------------------------------------


def keep_condition(columns: Sequence[str], denominator: str | None) -> Column:
    """Every used column holds a value and the denominator is positive."""
    tests = [F.col(c).isNotNull() for c in columns]
    if denominator:
        tests.append(F.col(denominator) > 0)
    return reduce(lambda a, b: a & b, tests)


def sanitize(df: DataFrame, cols: Sequence[str], denominator: str | None = None) -> DataFrame:
    """Rows fit for a metric; the predicate reaches the scan when the columns are stored."""
    return df.filter(keep_condition(cols, denominator))


def apply_filter(df: DataFrame, condition: str) -> DataFrame:
    """Rows that meet a SQL predicate."""
    return df.filter(F.expr(condition))


def invert_rank(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """max+1−x for a rank where low is good; the maximum is a one-row broadcast."""
    top = df.agg(F.max(col).alias("_top"))
    return df.crossJoin(F.broadcast(top)).withColumn(out or col, F.col("_top") + 1 - F.col(col)).drop("_top")


def apply_guardrail(df: DataFrame, spec: MetricSpec) -> DataFrame:
    """Filter, inversion and transformation of the spec's guardrail, in this order."""
    rule = spec.guardrail
    if rule is None:
        return df
    if rule.filter_condition:
        df = apply_filter(df, rule.filter_condition)
    if rule.invert:
        df = invert_rank(df, rule.column)
    if rule.transformation:
        df = df.withColumn(rule.column, transform(rule.column, rule.transformation))
    return df


def calendar_flags(df: DataFrame, time: str) -> DataFrame:
    """Weekend, first-of-month and last-of-month marks."""
    day = F.to_date(time)
    return df.withColumns(
        {
            "is_weekend": F.dayofweek(day).isin(1, 7),
            "is_month_start": F.dayofmonth(day) == 1,
            "is_month_end": day == F.last_day(day),
        }
    )


def _numeric(schema: T.StructType, spec: MetricSpec) -> bool:
    return all(is_numeric(schema[c].dataType) for c in spec.columns)


def eligible(schema: T.StructType, spec: MetricSpec, null_share: float) -> bool:
    """Are both columns numeric and is the numerator at most 70 % null?"""
    return _numeric(schema, spec) and null_share <= MAX_NULL_SHARE


def check_metric_columns(df: DataFrame, spec: MetricSpec) -> DataFrame:
    """The same test as one row, with the null share measured."""
    null_share = 1 - safe_div(F.count(spec.numerator), F.count("*"))
    numeric = F.lit(_numeric(df.schema, spec))
    return df.agg(null_share.alias("null_share")).select(
        F.lit(spec.name).alias("metric"),
        numeric.alias("numeric"),
        "null_share",
        (numeric & (F.col("null_share") <= MAX_NULL_SHARE)).alias("eligible"),
    )


def with_metric(df: DataFrame, spec: MetricSpec, out: str = "value") -> DataFrame:
    """Row-level value of a formula: n/d on the row, or n over the table's total of d."""
    n = F.col(spec.numerator).cast("double")
    if spec.kind != "RATIO":
        return df.withColumn(out, n)
    if spec.share_of == "GLOBAL_SUM":
        total = df.agg(F.sum(spec.denominator).alias("_total"))
        return df.crossJoin(F.broadcast(total)).withColumn(out, safe_div(n, "_total")).drop("_total")
    return df.withColumn(out, safe_div(n, spec.denominator))


# --- one spec as aggregate columns ---------------------------------------------------


def measure(col: str, agg: str, time: str | None = None, where: Column | None = None) -> Column:
    """SUM, MEAN, LAST, MAX, MIN or DISTINCT_COUNT of a column; LAST breaks ties by value."""
    c = F.col(col) if where is None else F.when(where, F.col(col))
    if agg == "SUM":
        return F.sum(c)
    if agg == "MEAN":
        return F.avg(c)
    if agg == "MAX":
        return F.max(c)
    if agg == "MIN":
        return F.min(c)
    if agg == "DISTINCT_COUNT":
        return F.count_distinct(c)
    if agg == "LAST":
        return F.max_by(c, F.when(c.isNotNull(), F.struct(F.col(time), c)))
    raise ValueError(f"unknown aggregation {agg!r}")


def _pieces(spec: MetricSpec, tag: str, ok: Column | None) -> list[Column]:
    """Aggregates that one spec needs from its group."""
    def kept(c: Column) -> Column:
        return c if ok is None else F.when(ok, c)

    rows = F.count("*") if ok is None else F.count_if(ok)
    pieces = [rows.alias(f"{tag}_rows")]
    n = F.col(spec.numerator).cast("double")
    if spec.is_kpi:
        pieces.append(measure(spec.numerator, spec.numerator_agg, spec.time, ok).cast("double").alias(f"{tag}_n"))
        if spec.denominator:
            d_agg = spec.denominator_agg or "SUM"
            pieces.append(measure(spec.denominator, d_agg, spec.time, ok).cast("double").alias(f"{tag}_d"))
    elif spec.kind == "RATIO" and spec.share_of == "SAME_ROW":
        pieces.append(F.avg(kept(safe_div(n, spec.denominator))).alias(f"{tag}_n"))
    elif spec.kind == "RATIO":
        pieces.append(F.sum(kept(n)).alias(f"{tag}_n"))
        pieces.append(F.sum(kept(F.col(spec.denominator).cast("double"))).alias(f"{tag}_d"))
    elif spec.kind == "MEAN":
        pieces.append(F.avg(kept(n)).alias(f"{tag}_n"))
    elif spec.kind in ("SUM", "GROWTH", "PERCENT_CHANGE"):
        pieces.append(F.sum(kept(n)).alias(f"{tag}_n"))
    elif spec.kind == "RATE" and spec.scope != "TEMPORAL":
        pieces.append(rows.cast("double").alias(f"{tag}_n"))
        bucket = F.date_trunc(GRAINS[spec.grain], F.col(spec.time))
        pieces.append(F.count_distinct(kept(bucket)).cast("double").alias(f"{tag}_d"))
    else:
        pieces.append(rows.cast("double").alias(f"{tag}_n"))
    return pieces


def _value(spec: MetricSpec, tag: str) -> Column:
    """The metric from its pieces; totals must have been attached as ``{tag}_total``."""
    n = F.col(f"{tag}_n")
    if spec.is_kpi:
        return safe_div(n, f"{tag}_d") if spec.denominator else n
    if spec.kind == "RATIO" and spec.share_of == "DIMENSIONAL":
        return safe_div(n, f"{tag}_d")
    if spec.kind == "RATIO" and spec.share_of in ("GLOBAL_SUM", "GROUP_SUM"):
        return safe_div(n, f"{tag}_total")
    if spec.kind == "RATE" and spec.scope != "TEMPORAL":
        return safe_div(n, f"{tag}_d")
    return n


def _needs_total(spec: MetricSpec) -> bool:
    return not spec.is_kpi and spec.kind == "RATIO" and spec.share_of in ("GLOBAL_SUM", "GROUP_SUM")


def attach_totals(frame: DataFrame, keys: Sequence[str], totals: dict[str, Column]) -> DataFrame:
    """Add sums over ``keys`` (or over everything) to a staged, aggregated frame."""
    sums = frame.groupBy(*keys).agg(*[c.alias(name) for name, c in totals.items()])
    if not keys:
        return frame.crossJoin(F.broadcast(sums))
    sums = checkpoint_parquet(sums.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *totals))
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return frame.join(broadcast_if_small(sums), match).drop(*[f"_k_{k}" for k in keys])


def parent_keys(spec: MetricSpec) -> list[str]:
    """Keys whose total a share is taken of: none, or all dims but the last."""
    return [] if spec.share_of == "GLOBAL_SUM" else list(spec.dims[:-1])


def _with_totals(frame: DataFrame, tagged: list[tuple[str, MetricSpec]], time_keys: Sequence[str] = ()) -> DataFrame:
    wanted: dict[tuple, dict[str, Column]] = {}
    for tag, spec in tagged:
        if _needs_total(spec):
            keys = tuple(list(time_keys) * (spec.share_of == "GROUP_SUM") + parent_keys(spec))
            wanted.setdefault(keys, {})[f"{tag}_total"] = F.sum(f"{tag}_d")
    if wanted:
        frame = checkpoint_parquet(frame)
    for keys, totals in wanted.items():
        frame = attach_totals(frame, keys, totals)
    return frame


def _growth(spec: MetricSpec, value: Column, dims: Sequence[str]) -> Column:
    """(x − previous)/previous × 100 along the buckets of one key."""
    if spec.is_kpi or spec.kind not in ("GROWTH", "PERCENT_CHANGE"):
        return value
    before = F.lag(value).over(W.partitionBy(*(dims or [F.lit(0)])).orderBy("bucket"))
    return safe_div(value - before, before) * 100


# --- the three scopes ----------------------------------------------------------------


def _prepared(df: DataFrame, spec: MetricSpec) -> DataFrame:
    df = apply_guardrail(df, spec)
    if spec.filter:
        df = apply_filter(df, spec.filter)
    return sanitize(df, spec.columns, spec.denominator) if spec.sanitized else df


def metric_global(df: DataFrame, spec: MetricSpec) -> DataFrame:
    """One row: value over the sanitised table and how many rows it rests on."""
    frame = _prepared(df, spec).agg(*_pieces(spec, "m", None))
    if _needs_total(spec):
        frame = frame.withColumn("m_total", F.col("m_d"))
    return frame.select(
        F.lit(spec.name).alias("metric"),
        _value(spec, "m").alias("value"),
        F.col("m_rows").alias("sample_size"),
        (F.col("m_rows") >= SIGNIFICANT_ROWS).alias("is_significant"),
        F.lit(spec.formula()).alias("formula"),
    )


def metric_by(df: DataFrame, spec: MetricSpec, dims: Sequence[str] | None = None, ordered: bool = True) -> DataFrame:
    """One row per group with value and size, best first."""
    dims = list(dims or spec.dims)
    frame = _prepared(df, spec).groupBy(*dims).agg(*_pieces(spec, "m", None))
    frame = _with_totals(frame, [("m", spec)])
    out = frame.select(
        *dims,
        _value(spec, "m").alias("value"),
        F.col("m_rows").alias("sample_size"),
        (F.col("m_rows") >= SIGNIFICANT_ROWS).alias("is_significant"),
    )
    return out.orderBy(F.col("value").desc_nulls_last(), *dims) if ordered else out


def top_segment(groups: DataFrame, dims: Sequence[str]) -> DataFrame:
    """The best group of a ``metric_by`` frame and the size of all groups together."""
    best = F.max_by(F.struct(*dims), F.struct("value", *[F.col(d) for d in dims]))
    return groups.agg(best.alias("_top"), F.max("value").alias("value"), F.sum("sample_size").alias("sample_size")).select(
        *[F.col(f"_top.{d}").alias(d) for d in dims], "value", "sample_size"
    )


def metric_over_time(
    df: DataFrame, spec: MetricSpec, time: str | None = None, grain: str | None = None, dims: Sequence[str] | None = None
) -> DataFrame:
    """One row per non-empty bucket (and group) with value and size."""
    time, grain = time or spec.time, grain or spec.grain
    dims = list(spec.dims if dims is None else dims)
    bucket = F.date_trunc(GRAINS[grain], F.col(time)).cast("timestamp_ntz").alias("bucket")
    frame = _prepared(df, spec).groupBy(*dims, bucket).agg(*_pieces(spec, "m", None))
    frame = _with_totals(frame, [("m", spec)], ["bucket"])
    value = _growth(spec, _value(spec, "m"), dims)
    return frame.select(*dims, "bucket", value.alias("value"), F.col("m_rows").alias("sample_size"))


def trend(buckets: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Straight line through a bucketed series by position; one row per group.

    The window runs over buckets, never over facts. Missing values keep their position
    and are left out of the fit.
    """
    by = list(by)
    position = F.row_number().over(W.partitionBy(*(by or [F.lit(0)])).orderBy("bucket")) - 1
    value = F.when(~F.isnan("value"), F.col("value"))
    numbered = buckets.withColumn("_x", position.cast("double")).withColumn("_y", value)
    fitted = numbered.groupBy(*by).agg(
        F.count("_y").alias("points"),
        F.regr_slope("_y", "_x").alias("_slope"),
        F.regr_intercept("_y", "_x").alias("_intercept"),
        F.regr_r2("_y", "_x").alias("_r2"),
        F.max_by("value", "bucket").alias("last_value"),
        F.sum("sample_size").alias("sample_size"),
    )
    enough = F.col("points") > 1
    return fitted.select(
        *by,
        "last_value",
        "sample_size",
        F.when(enough, F.col("_slope")).otherwise(0.0).alias("trend_slope"),
        F.when(enough, F.col("_intercept")).alias("trend_intercept"),
        F.when(enough, F.col("_r2")).alias("r_squared"),
        F.when(~enough, "flat").when(F.col("_slope") > 0, "increasing").otherwise("decreasing").alias("trend_direction"),
    )


def metric_mean_of_groups(df: DataFrame, spec: MetricSpec) -> DataFrame:
    """The unsanitised path: mean over groups with missing as 0, size = table rows."""
    frame = df.groupBy(*spec.dims).agg(*_pieces(spec, "m", None))
    frame = _with_totals(frame, [("m", spec)])
    return frame.agg(
        F.avg(F.coalesce(_value(spec, "m"), F.lit(0.0))).alias("value"), F.sum("m_rows").alias("sample_size")
    ).select(F.lit(spec.name).alias("metric"), "value", "sample_size")


def kpi(df: DataFrame, spec: MetricSpec, by: Sequence[str] = ()) -> DataFrame:
    """agg(numerator) / agg(denominator), each with its own aggregation."""
    by = list(by)
    frame = _prepared(df, spec).groupBy(*by).agg(*_pieces(spec, "m", None))
    return frame.select(*by, _value(spec, "m").alias("value"), F.col("m_rows").alias("sample_size"))
