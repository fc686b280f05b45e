"""Star, funnel and usage views over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.columns import exact_sum


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stored table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


# Columns of the sales view, the tables each one needs besides lineitem, and how it is made.
SALES_COLUMNS = {
    "date": ((), "l_shipdate"),
    "sales": ((), "l_extendedprice * (1 - l_discount)"),
    "ad_cost": ((), "l_extendedprice * l_discount"),
    "cost": (("part",), "p_retailprice * l_quantity"),
    "inventory": ((), "l_quantity"),
    "our_position": ((), "l_linenumber"),
    "order_id": ((), "l_orderkey"),
    "product_id": ((), "l_partkey"),
    "customer_id": (("orders",), "o_custkey"),
    "category": (("part",), "p_type"),
    "brand": (("part",), "p_brand"),
    "segment": (("orders", "customer"), "c_mktsegment"),
    "priority": (("orders",), "o_orderpriority"),
    "country": (("orders", "customer", "nation"), "n_name"),
}
JOIN_KEYS = {
    "part": ("l_partkey", "p_partkey"),
    "orders": ("l_orderkey", "o_orderkey"),
    "customer": ("o_custkey", "c_custkey"),
    "nation": ("c_nationkey", "n_nationkey"),
}
# The table that holds the key of each.
HOLDERS = {"part": "lineitem", "orders": "lineitem", "customer": "orders", "nation": "customer"}


def sales_view(spark: SparkSession, folder: str, *columns: str, trusted_keys: bool = False) -> DataFrame:
    """One row per line item with the named columns (all of them by default).

    All tables are joined, so that every selection rests on the same rows. With
    ``trusted_keys`` the caller vouches that each line item has its part, order, customer
    and nation; then only the tables the columns need are read. No side is broadcast by
    hand: Spark broadcasts a dimension below the session's threshold and sort-merges it
    otherwise. Orders meet their customers before the line items do, so that line items
    are shuffled once for their part and once for their order, and not for the customer.
    """
    wanted = columns or tuple(SALES_COLUMNS)
    needed = {t for c in wanted for t in SALES_COLUMNS[c][0]}
    frames = {name: table(spark, folder, name) for name in ("lineitem", *JOIN_KEYS)}
    for name in reversed(JOIN_KEYS):
        if name in needed or not trusted_keys:
            left, right = JOIN_KEYS[name]
            frames[HOLDERS[name]] = frames[HOLDERS[name]].join(frames[name], F.col(left) == F.col(right))
    facts = frames["lineitem"]
    return facts.select(*[F.expr(SALES_COLUMNS[c][1]).alias(c) for c in wanted])


def funnel_view(spark: SparkSession, folder: str) -> DataFrame:
    """Per user and day, how many events of each class and what the clicks cost."""

    def of(kind: str):
        return F.count_if(F.col("event_type") == kind)

    def amount(kind: str):
        # Equal amounts must be one value to a distinct count, in whatever order the events come.
        return F.coalesce(exact_sum(F.when(F.col("event_type") == kind, F.col("value"))), F.lit(0.0))

    return (
        table(spark, folder, "events")
        .groupBy("user_id", F.to_date("ts").alias("day"))
        .agg(
            of("view").alias("impressions"),
            of("click").alias("clicks"),
            of("signup").alias("signups"),
            of("purchase").alias("conversions"),
            of("error").alias("errors"),
            amount("click").alias("spend"),
            amount("purchase").alias("revenue"),
        )
    )


def usage_view(spark: SparkSession, folder: str) -> DataFrame:
    """One row per call: phase, model, input and output units."""
    units = F.size(F.split("text", " ")).cast("long")
    is_input = F.col("role") == "user"
    return table(spark, folder, "conversations").select(
        F.col("role").alias("phase"),
        F.concat(F.lit("model_"), (F.col("conv_id") % 2).cast("string")).alias("model"),
        F.when(is_input, units).otherwise(F.lit(0)).cast("long").alias("input_units"),
        F.when(is_input, F.lit(0)).otherwise(units).cast("long").alias("output_units"),
    )
