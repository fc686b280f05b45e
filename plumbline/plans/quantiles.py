"""Exact percentiles of fact columns without holding a group in one task.

``percentile`` keeps a value→count map of the whole group. Here a mergeable sketch
brackets each wanted rank first; the second pass counts rows below, between and above
the brackets and keeps single values only inside them, so the shuffle carries a few
permille of the values and the answer is still exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.plans.running import WINDOW_ROWS, interpolate, running_totals
from plumbline.plans.staging import checkpoint_parquet, join_on_group, mark_groups


# Up to this many values a group is counted in one map.
SMALL_GROUP = 20_000
# Margin in probability for groups too small for the sketch margin.
WIDE = 0.02


def exact_percentiles(
    df: DataFrame,
    value: str,
    probs: Mapping[str, float],
    by: Sequence[str] = (),
    accuracy: int = 10_000,
    window_rows: int = WINDOW_ROWS,
    small_group: int | None = SMALL_GROUP,
) -> DataFrame:
    """One row per group: ``n`` non-null values and one column per entry of ``probs``.

    Groups are counted first. Small ones use the built-in percentile, whose map is then
    bounded; only large ones are bracketed. ``small_group=None`` brackets all of them
    without counting, for callers whose groups are few.
    """
    by = list(by)
    facts = df.select(*by, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    if not by or small_group is None:
        return _bracketed(facts, probs, by, accuracy, window_rows)
    sizes = checkpoint_parquet(facts.groupBy(*by).agg(F.count("*").alias("_n")))
    total, large = sizes.count(), sizes.filter(F.col("_n") > small_group).select(*by)
    hot = large.count()
    if hot == 0:
        return _direct(facts, probs, by)
    marked = mark_groups(facts, large, by, hot)
    out = _bracketed(marked.filter("_marked").drop("_marked"), probs, by, accuracy, window_rows)
    if hot < total:
        out = out.unionByName(_direct(marked.filter("not _marked").drop("_marked"), probs, by))
    return out


def _direct(facts: DataFrame, probs: Mapping[str, float], by: list[str]) -> DataFrame:
    wanted = F.percentile("_v", F.array(*[F.lit(float(p)) for p in probs.values()]))
    picked = facts.groupBy(*by).agg(F.count("*").alias("n"), wanted.alias("_p"))
    return picked.select(*by, "n", *[F.col("_p")[i].alias(name) for i, name in enumerate(probs)])


def _bracketed(facts: DataFrame, probs: Mapping[str, float], by: list[str], accuracy: int, window_rows: int) -> DataFrame:
    # The sketch is off by at most n/accuracy ranks, so a bracket must reach further, and
    # at least over the two neighbouring ranks: narrow for large groups, wider for
    # middling ones, everything for small ones.
    wanted = []
    for p in probs.values():
        for margin in (3.0 / accuracy, WIDE):
            wanted += [F.lit(max(0.0, p - margin)), F.lit(min(1.0, p + margin))]
    sketch = facts.groupBy(*by).agg(
        F.count("*").alias("n"), F.percentile_approx("_v", F.array(*wanted), accuracy).alias("_b")
    )
    ends = []
    for i in range(len(probs)):
        for j, (side, whole) in enumerate((("low", "-inf"), ("high", "inf"))):
            end = F.when(F.col("n") <= 4 / WIDE, F.lit(float(whole)))
            end = end.when(F.col("n") <= 2 * accuracy, F.col("_b")[4 * i + 2 + j]).otherwise(F.col("_b")[4 * i + j])
            ends.append(end.alias(f"_{side}_{i}"))
    brackets = checkpoint_parquet(sketch.select(*by, "n", *ends))

    placed = join_on_group(facts, brackets, by)
    position, inside = F.lit(0), F.lit(False)
    for i in range(len(probs)):
        low, high = F.col(f"_low_{i}"), F.col(f"_high_{i}")
        position = position + (F.col("_v") >= low).cast("int") + (F.col("_v") > high).cast("int")
        inside = inside | F.col("_v").between(low, high)
    # ``_pos`` never falls as the value rises, so (_pos, _cell) orders like the value.
    cells = placed.groupBy(*by, "n", position.alias("_pos"), F.when(inside, F.col("_v")).alias("_cell")).agg(
        F.count("*").alias("_c")
    )
    cum = running_totals(cells, ["_pos", "_cell"], {"_cum": "_c"}, by, window_rows)

    picks, missed = [], F.lit(False)
    for name, p in probs.items():
        rank = F.lit(float(p)) * (F.col("n") - 1)
        for side, at in (("lo", F.floor(rank)), ("hi", F.ceil(rank))):
            covers = (F.col("_cum") > at) & (F.col("_cum") - F.col("_c") <= at)
            picks.append(F.max(F.when(covers, F.col("_cell"))).alias(f"_{side}_{name}"))
            missed = missed | (covers & F.col("_cell").isNull())
    picked = cum.groupBy(*by, "n").agg(*picks, F.max(missed).alias("_missed"))
    checked = F.when(F.col("_missed"), F.raise_error(F.lit("percentile bracket missed a rank: raise accuracy")))
    return picked.select(
        *by,
        "n",
        *[F.coalesce(checked.cast("double"), interpolate(name, p)).alias(name) for name, p in probs.items()],
    )
