"""Cumulative sums, previous values and weighted percentiles over ordered tables.

A plain window needs a whole group in one task. These helpers count the table first:
small ones use the window, large ones are range-partitioned on (group, order), so that
a group holding a third of all rows is spread over many tasks and only one row per
(group, partition) is summed across them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.plans.staging import checkpoint_parquet, join_on_group

# Up to this many rows one task may hold a group; more rows are split by range.
WINDOW_ROWS = 1_000_000
ROWS_PER_RANGE = 500_000
# More shuffle partitions than this cost more than the larger ranges they would save.
MAX_RANGES = 20_000


def _order(spec: str | tuple[str, str]) -> Column:
    name, direction = (spec, "asc") if isinstance(spec, str) else spec
    return F.col(name).desc_nulls_last() if direction == "desc" else F.col(name).asc_nulls_first()


def split_by_range(df: DataFrame, rows: int, by: Sequence[str], order: list[Column]) -> DataFrame:
    """Rows with a range number in ``_pid`` that is fixed once written."""
    parts = min(MAX_RANGES, max(2, -(-rows // ROWS_PER_RANGE)))
    keys = [F.col(c).asc_nulls_first() for c in by] + order
    ranged = df.repartitionByRange(parts, *keys).withColumn("_pid", F.spark_partition_id())
    return checkpoint_parquet(ranged)


def _plus(a: Column, b: Column, kind: str) -> Column:
    """a + b; Spark drops the last digit of a sum of two decimals of 38 digits, which 37 leave room for."""
    if kind.startswith("decimal"):
        room = f"decimal(37,{kind.rstrip(')').split(',')[1]})"
        a, b = a.cast(room), b.cast(room)
    return a + b


def running_totals(
    df: DataFrame,
    order_by: Sequence[str | tuple[str, str]],
    sums: Mapping[str, str],
    by: Sequence[str] = (),
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """Add inclusive running sums ``{new_column: summed_column}`` within each group.

    ``order_by`` must be a total order inside the group (add a tie-break column).
    """
    by = list(by)
    order = [_order(o) for o in order_by]
    staged = checkpoint_parquet(df)
    rows = staged.count()
    if rows <= window_rows:
        w = W.partitionBy(*(by or [F.lit(0)])).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return staged.withColumns({out: F.sum(src).over(w) for out, src in sums.items()})

    ranged = split_by_range(staged, rows, by, order)
    chunk = ranged.groupBy(*by, "_pid").agg(*[F.sum(src).alias(f"_t_{out}") for out, src in sums.items()])
    before = W.partitionBy(*(by or [F.lit(0)])).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = checkpoint_parquet(
        chunk.select(
            *by,
            "_pid",
            *[F.coalesce(F.sum(f"_t_{out}").over(before), F.lit(0)).alias(f"_o_{out}") for out in sums],
        )
    )
    inside = W.partitionBy(*by, "_pid").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    joined = join_on_group(ranged, offsets, [*by, "_pid"])
    kinds = dict(joined.dtypes)
    return joined.withColumns(
        {out: _plus(F.sum(src).over(inside), F.col(f"_o_{out}"), kinds[src]) for out, src in sums.items()}
    ).drop("_pid", *[f"_o_{out}" for out in sums])


def previous_value(
    df: DataFrame,
    order_col: str,
    out: str,
    by: Sequence[str] = (),
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """Add the preceding ``order_col`` of the same group; ``order_col`` must be unique there."""
    by = list(by)
    staged = checkpoint_parquet(df)
    rows = staged.count()
    if rows <= window_rows:
        w = W.partitionBy(*(by or [F.lit(0)])).orderBy(order_col)
        return staged.withColumn(out, F.lag(order_col).over(w))

    ranged = split_by_range(staged, rows, by, [F.col(order_col).asc_nulls_first()])
    last = ranged.groupBy(*by, "_pid").agg(F.max(order_col).alias("_last"))
    w_chunk = W.partitionBy(*(by or [F.lit(0)])).orderBy("_pid")
    carried = checkpoint_parquet(last.select(*by, "_pid", F.lag("_last").over(w_chunk).alias("_carry")))
    inside = W.partitionBy(*by, "_pid").orderBy(order_col)
    joined = join_on_group(ranged, carried, [*by, "_pid"])
    return joined.withColumn(out, F.coalesce(F.lag(order_col).over(inside), F.col("_carry"))).drop("_pid", "_carry")


def percentiles_from_counts(
    counts: DataFrame,
    value: str,
    weight: str,
    probs: Mapping[str, float],
    by: Sequence[str] = (),
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """Exact interpolated percentiles of a table of (value, how often).

    ``value`` must be unique within its group. One row per group: ``n`` and one column
    per entry of ``probs``.
    """
    by = list(by)
    clean = counts.filter(F.col(value).isNotNull() & (F.col(weight) > 0))
    cum = running_totals(clean, [value], {"_cum": weight}, by, window_rows)
    totals = checkpoint_parquet(clean.groupBy(*by).agg(F.sum(weight).alias("_n")))
    ranked = join_on_group(cum, totals, by)
    picks = []
    for name, p in probs.items():
        rank = F.lit(float(p)) * (F.col("_n") - 1)
        picks.append(F.min(F.when(F.col("_cum") > F.floor(rank), F.col(value))).alias(f"_lo_{name}"))
        picks.append(F.min(F.when(F.col("_cum") > F.ceil(rank), F.col(value))).alias(f"_hi_{name}"))
    picked = ranked.groupBy(*by).agg(F.max("_n").alias("n"), *picks)
    return picked.select(*by, "n", *[interpolate(name, p).alias(name) for name, p in probs.items()])


def interpolate(name: str, p: float) -> Column:
    """Linear interpolation between the two order statistics around rank p·(n−1)."""
    rank = F.lit(float(p)) * (F.col("n") - 1)
    share = rank - F.floor(rank)
    low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
    return low + (high - low) * share
