"""What the operators share: reading, picking columns, staging, byte-bounded slices of a batch."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.staging import checkpoint_parquet

# Texts of one Arrow batch are worked on in slices of about this many bytes.
SLICE_BYTES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, by exact spelling; of equal names the first counts.

    Other columns, even those whose names differ in case alone, stay outside.
    """
    columns = df.columns
    if len({c.lower() for c in columns}) < len(columns):
        df = df.toDF(*[f"_c{i}" for i in range(len(columns))])
        return df.select(*[F.col(f"_c{columns.index(n)}").alias(n) for n in names])
    return df.select(*[quoted(n).alias(n) for n in names])


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that an operator is about to add (any case)."""
    taken = {n.lower() for n in names}
    gone = [c for c in df.columns if c.lower() in taken]
    return df.drop(*gone) if gone else df


def staged(df: DataFrame) -> DataFrame:
    """Written to the shared checkpoint folder and read back: lineage ends here."""
    return checkpoint_parquet(df)


def slices(sizes: list[int], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes add up to about ``most``, one row at least."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n + 1
    if start < len(sizes):
        yield start, len(sizes)


def lean(run: Callable) -> Callable:
    """``run`` over the batches of a task; what it no longer needs goes back to the system at its end.

    Workers live on between tasks, and the allocators keep what was freed.
    """

    @wraps(run)
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return work
