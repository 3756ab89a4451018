"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings every operator relies on.  Timestamps are compared as
# naive UTC, duplicate header names keep their last value, and a rebuild only
# replaces the partitions it writes.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}

# Set when a session is built: capturing the Python call site of every Column
# costs milliseconds per expression, seconds for the larger queries.
BUILD_SETTINGS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}

_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"

_local_scratch: dict[str, str] = {}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session and return it."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def create_session(app_name: str = "fieldlake", master: str | None = None, **extra: str) -> SparkSession:
    """Build (or fetch) a session with the settings above."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SQL_SETTINGS, **BUILD_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


@contextmanager
def side_by_side_writers(spark: SparkSession, most: int = 8) -> Iterator[None]:
    """Partitioned writes with one open file for each of a task's first ``most`` partitions.

    Spark sorts a task's rows by partition otherwise, all of them in memory although
    most tasks write to one partition; with more partitions it sorts what is left.
    """
    before = spark.conf.get(_WRITERS, None)
    spark.conf.set(_WRITERS, str(most))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_WRITERS)
        else:
            spark.conf.set(_WRITERS, before)


def scratch_root(spark: SparkSession) -> str:
    """Folder for staged tables, streaming checkpoints and round trips.

    The cluster names it in ``spark.checkpoint.dir``.  A machine-local folder is
    used only on a local master, where driver and tasks share one disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="fieldlake-")
    return _local_scratch[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the scratch folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in shared storage and read it back.

    Cuts the lineage in a way that survives lost executors, and keeps column
    pruning for the readers.  Pass ``path`` to reuse one folder between runs.
    """
    spark = df.sparkSession
    target = path or scratch_path(spark, name)
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(target)
    return spark.read.schema(df.schema).parquet(target)
