"""Association of two columns and straight-line trends, with p-values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.functions.columns import seconds
from plumbline.functions.tails import correlation_p, student_p
from plumbline.plans.running import WINDOW_ROWS, running_totals, split_by_range
from plumbline.plans.staging import BROADCAST_ROWS, checkpoint_parquet, join_on_group

# Ranks of this many values of a side are looked up in a broadcast table.
LOOKED_UP = BROADCAST_ROWS // 2


def strength(r: Column) -> Column:
    size = F.abs(r)
    return F.when(size < 0.3, "weak").when(size < 0.7, "moderate").otherwise("strong")


def pearson(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation over rows where both columns hold a value."""
    pairs = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    return pairs.groupBy(*by).agg(
        F.count("*").alias("n"), F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias("pearson")
    )


def _window_rank(side: str, by: list[str]) -> Column:
    """Average rank of a counted value within its group, by windows over the pairs."""
    group = W.partitionBy(*(by or [F.lit(0)]))
    reached = F.sum("_w").over(group.orderBy(side).rangeBetween(W.unboundedPreceding, W.currentRow))
    return reached - (F.sum("_w").over(W.partitionBy(*by, side)) - 1) / 2


def _joined_ranks(pairs: DataFrame, side: str, by: list[str], window_rows: int) -> DataFrame:
    """The same ranks by running totals over the side's values, which are few enough to look up."""
    values = pairs.groupBy(*by, side).agg(F.sum("_w").alias("_c"))
    cum = running_totals(values, [side], {"_cum": "_c"}, by, window_rows)
    middle = F.col("_cum") - (F.col("_c") - 1) / 2
    ranks = checkpoint_parquet(cum.select(*by, side, middle.alias(f"_r{side}")))
    return join_on_group(pairs, ranks, [*by, side])


def _ranged_ranks(pairs: DataFrame, side: str, by: list[str], rows: int) -> DataFrame:
    """The same ranks where a side has many values: the pairs themselves are dealt by ranges.

    A frequent value may lie over several ranges, as the other side breaks its ties. It is
    then the last value of one range and the first of the next, so a range needs only the
    weight before it, and how much of its first and last value lies in other ranges.
    """
    other = "_b" if side == "_a" else "_a"
    ranged = split_by_range(pairs, rows, by, [F.col(side), F.col(other)])
    keys = [*by, "_pid"]
    ends = checkpoint_parquet(ranged.groupBy(*keys).agg(F.min(side).alias("_min"), F.max(side).alias("_max")))
    at = lambda end: F.sum(F.when(F.col(side) == F.col(end), F.col("_w")))
    chunks = checkpoint_parquet(
        join_on_group(ranged, ends, keys)
        .groupBy(*keys, "_min", "_max")
        .agg(F.sum("_w").alias("_t"), at("_min").alias("_wmin"), at("_max").alias("_wmax"))
    )
    first, last = F.struct(F.col("_min").alias("v"), F.col("_wmin").alias("w")), F.struct(F.col("_max").alias("v"), F.col("_wmax").alias("w"))
    edges = chunks.select(*keys, "_min", "_max", F.inline(F.when(F.col("_min") == F.col("_max"), F.array(first)).otherwise(F.array(first, last))))
    same = W.partitionBy(*by, "v").orderBy("_pid")
    earlier = F.coalesce(F.sum("w").over(same.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    later = F.coalesce(F.sum("w").over(same.rowsBetween(1, W.unboundedFollowing)), F.lit(0))
    elsewhere = edges.withColumn("_earlier", earlier).withColumn("_later", later).groupBy(*keys).agg(
        F.max(F.when(F.col("v") == F.col("_min"), F.col("_earlier"))).alias("_earlier"),
        F.max(F.when(F.col("v") == F.col("_max"), F.col("_later"))).alias("_later"),
    )
    before = W.partitionBy(*(by or [F.lit(0)])).orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = chunks.withColumn("_o", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t", "_wmin", "_wmax")
    offsets = checkpoint_parquet(join_on_group(offsets, checkpoint_parquet(elsewhere), keys))
    inside = W.partitionBy(*keys).orderBy(side).rangeBetween(W.unboundedPreceding, W.currentRow)
    reached = F.sum("_w").over(inside)
    below = reached - F.sum("_w").over(W.partitionBy(*keys, side))
    upto = F.col("_o") + F.col("_upto") + F.when(F.col(side) == F.col("_max"), F.col("_later")).otherwise(0)
    less = F.col("_o") + F.col("_less") - F.when(F.col(side) == F.col("_min"), F.col("_earlier")).otherwise(0)
    ranked = join_on_group(ranged, offsets, keys).withColumns({"_upto": reached, "_less": below})
    return ranked.withColumn(f"_r{side}", (less + upto + 1) / 2).drop("_pid", "_min", "_max", "_o", "_earlier", "_later", "_upto", "_less")


def spearman(df: DataFrame, a: str, b: str, by: Sequence[str] = (), window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Rank correlation with average ranks for ties.

    Rows are first folded to counted (a, b) pairs. Beyond ``window_rows`` pairs the ranks of
    a side with few values are looked up; a side with many has its pairs dealt by ranges,
    which splits a hot group, or a hot value, over many tasks.
    """
    by = list(by)
    x, y = F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b")
    pairs = df.select(*by, x, y).filter("_a is not null and _b is not null")
    pairs = checkpoint_parquet(pairs.groupBy(*by, "_a", "_b").agg(F.count("*").alias("_w")))

    # Estimates decide the way only.
    distinct = [F.approx_count_distinct(F.struct(*by, side)) for side in ("_a", "_b")]
    rows, *values = pairs.agg(F.count("*"), *distinct).first()
    if rows <= window_rows:
        ranked = pairs.withColumns({f"_r{side}": _window_rank(side, by) for side in ("_a", "_b")})
    else:
        ranked = pairs
        for found, side in sorted(zip(values, ("_a", "_b"))):
            few = found <= LOOKED_UP
            ranked = _joined_ranks(ranked, side, by, window_rows) if few else _ranged_ranks(ranked, side, by, rows)
    w, u, v = F.col("_w").cast("double"), F.col("_r_a"), F.col("_r_b")
    sums = ranked.groupBy(*by).agg(
        F.sum("_w").alias("n"),
        F.sum(w * u * v).alias("_uv"),
        F.sum(w * u * u).alias("_uu"),
        F.sum(w * v * v).alias("_vv"),
    )
    centre = F.col("n") * F.pow((F.col("n") + 1) / 2, F.lit(2.0))
    spread = (F.col("_uu") - centre) * (F.col("_vv") - centre)
    rho = F.when(spread > 0, (F.col("_uv") - centre) / F.sqrt(spread))
    return sums.select(*by, "n", rho.alias("spearman"))


def association(df: DataFrame, a: str, b: str, by: Sequence[str] = (), ranks: bool = True) -> DataFrame:
    """Pearson and Spearman with p-values and a reading of the strength, per group."""
    by = list(by)
    if ranks:
        # Read by both; what the rows are made of is read once.
        both = df.select(*dict.fromkeys([*by, a, b]))
        df = checkpoint_parquet(both.filter(F.col(a).isNotNull() & F.col(b).isNotNull()))
    out = pearson(df, a, b, by)
    if ranks:
        rho = spearman(df, a, b, by).drop("n")
        out = join_on_group(out, checkpoint_parquet(rho), by)
        out = out.withColumn("spearman_p", correlation_p(F.col("spearman"), F.col("n")))
    out = out.withColumn("pearson_p", correlation_p(F.col("pearson"), F.col("n")))
    significant = F.coalesce(F.col("pearson_p") < 0.05, F.lit(False))
    return out.withColumns(
        {
            "strength": strength(F.col("pearson")),
            "direction": F.when(F.col("pearson") > 0, "positive").otherwise("negative"),
            "is_significant": significant,
        }
    )


def linear_trend(df: DataFrame, y: str, time: str, by: Sequence[str] = ()) -> DataFrame:
    """Slope of ``y`` per day with standard error, r² and p-value, per group."""
    days = seconds(F.col(time)) / 86400.0
    points = df.select(*by, F.col(y).cast("double").alias("_y"), days.alias("_x")).filter("_y is not null and _x is not null")
    fit = points.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.regr_slope("_y", "_x").alias("slope"),
        F.regr_r2("_y", "_x").alias("r_squared"),
        F.regr_sxx("_y", "_x").alias("_sxx"),
        F.regr_syy("_y", "_x").alias("_syy"),
    )
    left = (1 - F.col("r_squared")) * F.col("_syy") / F.nullif(F.col("n") - 2, F.lit(0))
    error = F.when(F.col("n") > 2, F.sqrt(left / F.nullif("_sxx", F.lit(0.0))))
    out = fit.withColumn("standard_error", error)
    t = F.col("slope") / F.nullif("standard_error", F.lit(0.0))
    return out.withColumn("p_value", student_p(t, F.when(F.col("n") > 2, F.col("n") - 2))).drop("_sxx", "_syy")
