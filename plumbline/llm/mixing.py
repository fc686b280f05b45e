"""Mixing sources to target weights: raked token weights, then calibrated sampling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import quoted, staged, without
from plumbline.plans.staging import broadcast_if_small

SWEEPS = 8  # of proportional fitting over all dimensions
POWER = 0.7  # tempering of the default targets: small categories gain, large ones lose
BUDGET = 0.9  # share of all tokens that the sample shall hold
SEED = "mix"
DRAW_BITS = 52

# Kind of text, by the first pattern that fits.
TOPICS = (("legal", "(?i)licen[sc]e|copyright"), ("contact", "@|https?://"), ("table", " \\| |\t"), ("figures", "[0-9]"))


def token_count(text: Column) -> Column:
    """Runs of characters other than ASCII white space; none in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic_of(text: Column) -> Column:
    topic = F.lit("prose")
    for name, pattern in reversed(TOPICS):
        topic = F.when(text.rlike(pattern), F.lit(name)).otherwise(topic)
    return topic


def draw_of(*key: Column) -> Column:
    """A number in [0, 1) that the seed and the key fix."""
    digest = F.md5(F.concat_ws("|", F.lit(SEED), *[F.coalesce(k.cast("string"), F.lit("")) for k in key]).cast("binary"))
    return F.conv(F.substring(digest, 1, DRAW_BITS // 4), 16, 10).cast("long") / float(1 << DRAW_BITS)


def tempered(cells: DataFrame, dims: Sequence[str], power: float = POWER) -> DataFrame:
    """``cells`` with a target share per dimension, in proportion to its tokens to ``power``."""
    for d in dims:
        sums = staged(cells.groupBy(d).agg(F.pow(F.sum("tokens"), F.lit(power)).alias("p")))
        total = sums.agg(F.sum("p")).first()[0] or 1.0
        share = sums.select(F.col(d).alias("_d"), (F.col("p") / (total or 1.0)).alias(f"target_{d}"))
        cells = cells.join(share, F.col(d).eqNullSafe(F.col("_d"))).drop("_d")
    return cells


def given(cells: DataFrame, dims: Sequence[str], targets: Mapping[str, DataFrame]) -> DataFrame:
    """``cells`` with targets from tables (category, share); a category not listed keeps its own share."""
    whole = float(cells.agg(F.sum("tokens")).first()[0] or 1.0)
    for d in dims:
        known = targets[d].toDF("_d", "_share")
        own = cells.groupBy(d).agg((F.sum("tokens") / whole).alias("_own"))
        both = own.join(known, F.col(d).eqNullSafe(F.col("_d")), "left").select(F.col(d).alias("_c"), F.coalesce("_share", "_own").alias("_t"))
        both = staged(both)
        total = both.agg(F.sum("_t")).first()[0] or 1.0
        cells = cells.join(both.select("_c", (F.col("_t") / total).alias(f"target_{d}")), F.col(d).eqNullSafe(F.col("_c"))).drop("_c")
    return cells


def rake(cells: DataFrame, dims: Sequence[str], sweeps: int = SWEEPS) -> DataFrame:
    """``cells`` (dims, tokens, targets) with ``weight``, whose marginals are the targets.

    Iterative proportional fitting from the token counts: in turn for each dimension,
    every cell is scaled by its category's target over its category's present sum.
    """
    out = cells.withColumn("weight", F.col("tokens").cast("double"))
    for _ in range(sweeps):
        for d in dims:
            present = F.sum("weight").over(Window.partitionBy(d))
            out = out.withColumn("weight", F.coalesce(F.try_divide(F.col("weight") * F.col(f"target_{d}"), present), F.lit(0.0)))
    return staged(out)


def probabilities(raked: DataFrame, budget: float = BUDGET) -> DataFrame:
    """``raked`` with ``probability``: in proportion to weight per token, one at most.

    The factor is such that ``budget`` of all tokens is expected. Cells that it lifts to
    one are set to one and the factor is solved for the others until none is added.
    """
    ratio = F.coalesce(F.try_divide(F.col("weight"), F.col("tokens")), F.lit(0.0))
    cells = raked.withColumn("_ratio", ratio)
    whole = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    factor, capped = 0.0, -1
    while True:
        full = F.lit(factor) * F.col("_ratio") >= 1
        now = cells.agg(
            F.count(F.when(full, 1)).alias("cells"),
            F.coalesce(F.sum(F.when(full, F.col("tokens"))), F.lit(0)).alias("tokens"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).alias("weight"),
        ).first()
        if now["cells"] == capped or not now["weight"]:
            break
        capped, factor = now["cells"], max(factor, (budget * whole - float(now["tokens"])) / now["weight"])
    one = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.lit(factor) * F.col("_ratio"))).otherwise(F.lit(1.0))
    return staged(cells.withColumn("probability", one).drop("_ratio"))


def mixed(
    df: DataFrame,
    dims: Sequence[Column],
    tokens: Column,
    key: Sequence[Column],
    targets: Mapping[str, DataFrame] | None = None,
    budget: float = BUDGET,
) -> DataFrame:
    """``df`` with n_tokens, probability and sampled.

    Token counts by ``dims`` (source, language, topic; null is a category) are raked to
    target marginals (``targets`` by d0, d1, …; else tempered ones); a row is sampled if
    a hash of ``key`` falls below its cell's probability, so rows with equal keys in one
    cell fare alike and the choice never depends on the partitioning. Cells without a
    token have probability one; an empty table stays empty. Columns called like the new
    ones are replaced, all others kept whatever their names. Cells are counted with
    map-side sums and joined back, by broadcast only if counted few.
    """
    df = without(df, "n_tokens", "probability", "sampled")
    names = [f"d{i}" for i in range(len(dims))]
    columns = df.columns
    record = F.struct(*[quoted(c).alias(f"r{i}") for i, c in enumerate(columns)]).alias("record")
    rows = df.select(*[d.alias(n) for d, n in zip(dims, names)], tokens.alias("n_tokens"), draw_of(*key).alias("draw"), record)
    cells = staged(rows.groupBy(*names).agg(F.sum("n_tokens").alias("tokens")))
    aimed = given(cells, names, targets) if targets else tempered(cells, names)
    chances = probabilities(rake(staged(aimed), names), budget).select(*[F.col(n).alias(f"_{n}") for n in names], "probability")
    match = F.lit(True)
    for n in names:
        match = match & F.col(n).eqNullSafe(F.col(f"_{n}"))
    joined = rows.join(broadcast_if_small(chances), match)
    return joined.select(
        *[F.col(f"record.r{i}").alias(c) for i, c in enumerate(columns)],
        "n_tokens", "probability", (F.col("draw") < F.col("probability")).alias("sampled"),
    )
