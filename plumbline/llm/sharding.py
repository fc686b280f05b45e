"""Sharding by a two-pass external shuffle, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import quoted, without
from plumbline.plans.staging import broadcast_if_small

BUCKET_BYTES = 32 << 20


def text_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of a text, none if null, and eight for the rest of the record."""
    return F.coalesce(F.octet_length(quoted(text)).cast("long"), F.lit(0).cast("long")) + 8


def shuffled(
    df: DataFrame,
    shards: int,
    size: Column,
    key: Sequence[Column] | None = None,
    seed: int = 42,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """``df`` in a random order that ``seed`` fixes, with ``shard`` and ``slot``.

    First pass: every record goes to bucket hash(seed, key) modulo the number of buckets,
    which is chosen so that a bucket holds about ``bucket_bytes`` of ``size``. Second
    pass: each bucket is one task, is brought into a fixed order and shuffled in memory
    (Fisher-Yates, in place of an array). The buckets one after another are the new
    order; shard s gets the places from s·n/shards on, so that counts are at most one
    apart, and ``slot`` counts from 0 inside a shard.

    ``key`` tells records apart (default: all columns); records with equal keys share a
    bucket, so give a row number where rows repeat often. Nulls are values like any
    other; an empty table stays empty; input columns called shard or slot are replaced,
    others are kept whatever their names.
    """
    df = without(df, "shard", "slot")
    columns = df.columns
    flat = df.toDF(*[f"_c{i}" for i in range(len(columns))]) if key is None else df
    key = [F.col(c) for c in flat.columns] if key is None else list(key)
    total = df.agg(F.sum(size).alias("bytes"), F.count("*").alias("rows")).first()
    rows, buckets = total["rows"], max(1, -(-(total["bytes"] or 0) // bucket_bytes))
    spread = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(buckets)).cast("int")
    inner = F.xxhash64(F.lit(seed + 1), *key)

    counts = flat.groupBy(spread.alias("_bucket")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row per bucket
    offsets = counts.select(F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))

    record = F.struct(*[quoted(c).alias(f"r{i}") for i, c in enumerate(flat.columns)])
    scattered = flat.select(spread.alias("_bucket"), inner.alias("_order"), record.alias("_record"))
    # A partition is a bucket and their number is fixed: a task that runs again draws the same order.
    bucketed = scattered.repartitionById(buckets, F.col("_bucket")).sortWithinPartitions("_bucket", "_order")
    mixed = bucketed.groupBy("_bucket").agg(F.collect_list("_record").alias("_all"))
    mixed = mixed.select("_bucket", F.shuffle("_all", F.lit(seed)).alias("_all"))
    placed = mixed.select("_bucket", F.posexplode("_all").alias("_at", "_record"))
    placed = placed.join(broadcast_if_small(offsets, buckets), F.col("_bucket") == F.col("_b"))
    at = F.col("_offset") + F.col("_at")
    shard = F.expr(f"(_offset + _at) * {shards} div {max(1, rows)}")
    start = F.expr(f"(((_offset + _at) * {shards} div {max(1, rows)}) * {rows} + {shards - 1}) div {shards}")
    return placed.select(
        *[F.col(f"_record.r{i}").alias(c) for i, c in enumerate(columns)], shard.cast("int").alias("shard"), (at - start).alias("slot")
    )


def write_shards(df: DataFrame, path: str, shards: int, size: Column, **options) -> None:
    """Write the shuffled records as one folder per shard; each bucket touches two at most."""
    shuffled(df, shards, size, **options).write.partitionBy("shard").parquet(path)
