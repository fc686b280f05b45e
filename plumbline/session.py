"""Session set-up: settings for local runs and shipping the package to executors."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


# Bytes of one Arrow batch that Spark sends to a Python worker.
ARROW_BYTES = 8 << 20

# Applications that already have the package.
_SHIPPED: set[str] = set()


def local_session(cores: int | str = "*", memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("plumbline")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def _local_staging(spark: SparkSession) -> None:
    """Name a staging folder for a session in one process that has none; it goes at exit."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if context.master.startswith("local[") and not named:
        folder = tempfile.mkdtemp(prefix="plumbline-staging-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)


def prepare(spark: SparkSession) -> SparkSession:
    """Fix the time zone and send the package to the Python workers, once per session.

    On a cluster ``spark.checkpoint.dir`` must be set; only a session in one process, as in
    tests, is given a folder of its own.
    """
    _local_staging(spark)
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    # What a Python worker holds at a time is bounded by bytes, however long the texts are.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    application = spark.sparkContext.applicationId
    if application not in _SHIPPED:
        root = Path(__file__).resolve().parent
        archive = shutil.make_archive(
            str(Path(tempfile.mkdtemp(prefix="plumbline-")) / "plumbline"), "zip", root.parent, root.name
        )
        spark.sparkContext.addPyFile(archive)
        _SHIPPED.add(application)
    return spark
