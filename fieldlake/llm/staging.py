"""Written tables in the shared folder, and bounded Arrow batches, for the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldlake.session import scratch_path

BATCH_BYTES = 4 << 20
"""Bytes of rows that a task hands to Python at once."""


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as zstd Parquet below ``spark.checkpoint.dir`` and read it back: lineage ends in files that outlive executors."""
    target = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def bounded_batches(spark: SparkSession) -> None:
    """Cut the Arrow batches of this session by bytes: rows of long texts make large batches by count."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have, in any spelling of case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
