"""Ready-made analyses built from the metric formulas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from plumbline.fixed_values import COST_WORDS, SALES_WORDS
from plumbline.functions.columns import exact_parts, joined_parts, safe_div
from plumbline.operators.metrics import attach_totals, metric_by, metric_over_time
from plumbline.operators.spec import MetricSpec
from plumbline.plans.running import WINDOW_ROWS, running_totals
from plumbline.plans.staging import checkpoint_parquet


def pareto(df: DataFrame, dim: str, metric: str, n: int | None = None, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Values of ``dim`` by their share of the total, largest first, with running share.

    Sums stay exact up to the shares, so that equal sums tie however the rows are dealt and
    ``dim`` decides between them.
    """
    floating = dict(df.dtypes)[metric] in ("float", "double")
    held, rest = exact_parts(metric) if floating else (F.col(metric), F.lit(0.0))
    rows = df.filter(F.col(metric).isNotNull())
    sums = rows.groupBy(dim).agg(F.coalesce(F.sum(held), F.lit(0)).alias("_held"), F.sum(rest).alias("_rest"))
    value = joined_parts("_held", "_rest") if floating else F.col("_held")
    sums = sums.withColumn("value", value).withColumn("_one", F.lit(1).cast("long"))
    running = {"_held_to": "_held", "_rest_to": "_rest", "rank": "_one"}
    ranked = running_totals(sums, [("value", "desc"), dim], running, window_rows=window_rows)
    total = ranked.agg(joined_parts(F.sum("_held"), F.sum("_rest")).alias("_total"))
    shares = ranked.crossJoin(F.broadcast(total)).select(
        dim,
        "value",
        safe_div("value", "_total").alias("share"),
        safe_div(joined_parts("_held_to", "_rest_to"), "_total").alias("cumulative_share"),
        "rank",
    )
    return shares if n is None else shares.filter(F.col("rank") <= n)


def elasticity(df: DataFrame, x: str, y: str, dims: Sequence[str]) -> DataFrame:
    """Units of ``y`` per unit of ``x`` in each segment (ratio of sums)."""
    spec = MetricSpec(f"{y}_per_{x}", y, x, "RATIO", "DIMENSIONAL", "DIMENSIONAL", tuple(dims), motif="Elasticity")
    return metric_by(df, spec)


def velocity(df: DataFrame, metric: str, time: str, grain: str, by: Sequence[str] = ()) -> DataFrame:
    """Percent change of the metric's sum from one bucket to the next."""
    spec = MetricSpec(
        f"{metric}_growth", metric, template="GROWTH", scope="TEMPORAL", time=time, grain=grain, dims=tuple(by), motif="Velocity"
    )
    return metric_over_time(df, spec)


def benchmark(df: DataFrame, metric: str, dims: Sequence[str]) -> DataFrame:
    """Average of each segment over the average of all rows."""
    dims = list(dims)
    groups = checkpoint_parquet(
        df.groupBy(*dims).agg(F.sum(metric).alias("_sum"), F.count(metric).alias("sample_size"))
    )
    total = {"_all": F.sum("_sum"), "_rows": F.sum("sample_size")}
    return attach_totals(groups, [], total).select(
        *dims,
        safe_div("_sum", "sample_size").alias("segment_average"),
        safe_div("_all", "_rows").alias("overall_average"),
        safe_div(safe_div("_sum", "sample_size"), safe_div("_all", "_rows")).alias("index"),
        "sample_size",
    )


def pick_column(columns: Sequence[str], words: Sequence[str]) -> str | None:
    """The first column whose name holds one of the words."""
    return next((c for c in columns if any(w in c.lower() for w in words)), None)


def impact_metrics(
    df: DataFrame, col: str, financial: Sequence[str] = (), n: int = 5, sales: str | None = None, cost: str | None = None
) -> DataFrame:
    """Top values of a categorical column by rows, by sales and by cost.

    Sales and cost columns are named, or found among ``financial`` by their names.
    """
    sales = sales or pick_column(financial, SALES_WORDS)
    cost = cost or pick_column(financial, COST_WORDS)
    aggs = [F.count("*").cast("double").alias("frequency")]
    aggs += [F.sum(sales).alias("sales")] if sales else []
    aggs += [F.sum(cost).alias("cost")] if cost else []
    groups = checkpoint_parquet(df.groupBy(col).agg(*aggs))
    totals = groups.agg(F.sum("frequency").alias("_rows"), F.sum("sales" if sales else "frequency").alias("_sales"))
    groups = groups.crossJoin(F.broadcast(totals))

    def top(kind: str, pct) -> DataFrame:
        best = groups.orderBy(F.col(kind).desc_nulls_last(), F.col(col)).limit(n)
        return best.select(
            F.lit(kind).alias("ranked_by"), F.col(col).cast("string").alias("value"), F.col(kind).alias("amount"), pct.alias("pct")
        )

    out = top("frequency", F.round(100 * F.col("frequency") / F.col("_rows"), 1))
    if sales:
        share = F.when(F.col("_sales") > 0, F.round(100 * F.col("sales") / F.col("_sales"), 1)).otherwise(0.0)
        out = out.unionByName(top("sales", share))
    if cost:
        out = out.unionByName(top("cost", F.lit(None).cast("double")))
    return out


def insight_domains(df: DataFrame, dims: Sequence[str], metrics: Sequence[str], k: int | None = None, top: int = 5) -> DataFrame:
    """(dimension, metric) pairs by how concentrated the metric is over the dimension.

    The score is the Herfindahl index of the shares, rescaled so that equal shares give
    0 and a single value gives 1. All pairs come back unless ``k`` names how many; ``top``
    members of each are named.
    """
    pairs = F.inline(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("member")) for d in dims]))
    amounts = [F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias(f"_m{i}") for i, m in enumerate(metrics)]
    cells = df.select(pairs, *amounts).groupBy("dimension", "member").agg(
        *[F.sum(f"_m{i}").alias(f"_m{i}") for i in range(len(metrics))]
    )
    unpivoted = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"_m{i}").alias("amount")) for i, m in enumerate(metrics)]))
    long = checkpoint_parquet(cells.select("dimension", "member", unpivoted))
    shares = attach_totals(long, ["dimension", "metric"], {"_total": F.sum("amount"), "members": F.count("*")})
    shares = shares.withColumn("share", safe_div("amount", "_total"))

    w = W.partitionBy("dimension", "metric").orderBy(F.col("amount").desc_nulls_last(), "member")
    best = shares.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= top)
    leaders = best.groupBy("dimension", "metric").agg(
        F.concat_ws("|", F.transform(F.array_sort(F.collect_list(F.struct("_rn", "member"))), lambda s: s["member"])).alias("top_values")
    )
    scored = shares.groupBy("dimension", "metric").agg(
        F.sum(F.col("share") * F.col("share")).alias("_hhi"), F.max("share").alias("top_share"), F.max("members").alias("members")
    )
    even = 1 / F.col("members")
    score = F.when(F.col("members") == 1, 1.0).otherwise((F.col("_hhi") - even) / F.nullif(1 - even, F.lit(0.0)))
    ranked = (
        scored.withColumn("variance_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
        .join(leaders, ["dimension", "metric"])
        .select("dimension", "metric", "members", "top_share", "variance_score", "top_values")
        .orderBy(F.col("variance_score").desc(), "dimension", "metric")
    )
    return ranked if k is None else ranked.limit(k)


def usage_rollup(log: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls and units overall, by phase and by model, with the cost of each model.

    ``log``: phase, model, input_units, output_units. ``prices``: model and price per
    million input and output units, a list with one row per model.
    """
    sums = log.groupingSets([["phase"], ["model"], []], "phase", "model").agg(
        F.grouping("phase").alias("_no_phase"),
        F.grouping("model").alias("_no_model"),
        F.count("*").alias("calls"),
        F.sum("input_units").alias("input_units"),
        F.sum("output_units").alias("output_units"),
    )
    level = F.when(F.col("_no_phase") == 0, "phase").when(F.col("_no_model") == 0, "model").otherwise("overall")
    costs = sums.join(prices, "model", "left")
    priced = F.col("input_units") / 1e6 * F.col("input_price") + F.col("output_units") / 1e6 * F.col("output_price")
    out = costs.select(
        level.alias("level"),
        F.coalesce("phase", "model", F.lit("all")).alias("name"),
        "calls",
        "input_units",
        "output_units",
        (F.col("input_units") + F.col("output_units")).alias("total_units"),
        F.when(level == "model", priced).alias("cost"),
    )
    return out
