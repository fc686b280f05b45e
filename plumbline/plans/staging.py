"""Writing intermediate tables where every executor can read them back.

A staged table cuts lineage: once it is on the shared folder a lost executor costs a
re-read, and a value that could differ between two evaluations (a sketch, a range
partition number) is fixed for all later readers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side below this many rows and bytes is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``; nothing is staged without one.

    ``SparkContext.setCheckpointDir`` names one as well.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{checkpoint_root(spark)}/plumbline/{label}-{uuid.uuid4().hex}"


def checkpoint_parquet(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet and read it back with the same schema."""
    spark = df.sparkSession
    path = path or new_path(spark, "stage")
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _wide(kind: str) -> bool:
    return kind in ("string", "binary") or kind.startswith(("array", "map", "struct"))


def broadcast_if_small(small: DataFrame, rows: int | None = None) -> DataFrame:
    """Hint a broadcast only when the (staged) table is known to be small.

    Rows are counted unless given; columns of variable size are measured as text, all
    others count 16 bytes. Beyond a limit the table is returned as it is, so that Spark
    shuffles the join and splits hot keys at run time (spark.sql.adaptive.skewJoin, on by
    default).
    """
    wide = [F.coalesce(F.octet_length(F.to_json(F.struct(f"`{c}`"))), F.lit(0)) for c, kind in small.dtypes if _wide(kind)]
    if rows is None or (wide and rows <= BROADCAST_ROWS):
        size = F.coalesce(F.sum(sum(wide, F.lit(0).cast("long"))), F.lit(0))
        rows, measured = small.agg(F.count("*"), size).first()
    else:
        measured = 0
    fixed = 16 * rows * (len(small.columns) - len(wide))
    return F.broadcast(small) if rows <= BROADCAST_ROWS and measured + fixed <= BROADCAST_BYTES else small


def mark_groups(facts: DataFrame, groups: DataFrame, by: list[str], rows: int) -> DataFrame:
    """Add ``_marked``: does the row belong to one of the (staged, distinct) groups?"""
    listed = groups.select(*[F.col(name).alias(f"__g_{name}") for name in by], F.lit(True).alias("_hit"))
    condition = F.lit(True)
    for name in by:
        condition = condition & F.col(name).eqNullSafe(F.col(f"__g_{name}"))
    joined = facts.join(broadcast_if_small(listed, rows), condition, "left")
    return joined.withColumn("_marked", F.col("_hit").isNotNull()).drop("_hit", *[f"__g_{name}" for name in by])


def join_on_group(facts: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """Attach one row per group to every fact row; null group keys match each other.

    ``groups`` must be staged or a one-row aggregate. With no keys it is one row, so a
    broadcast cross join is bounded by construction.
    """
    if not by:
        return facts.crossJoin(F.broadcast(groups))
    renamed = groups
    for name in by:
        renamed = renamed.withColumnRenamed(name, f"__g_{name}")
    condition = None
    for name in by:
        equal = facts[name].eqNullSafe(renamed[f"__g_{name}"])
        condition = equal if condition is None else condition & equal
    joined = facts.join(broadcast_if_small(renamed), condition, "inner")
    return joined.drop(*[f"__g_{name}" for name in by])
