"""Run status as a small JSON table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

STATUS_SCHEMA = (
    "last_run string, status string, instrument_id string, instrument_status string, batches_written bigint, "
    "error string, files map<string,bigint>"
)


def write_run_status(status: DataFrame, path: str) -> None:
    """Replace the status of the last run: one row per instrument, one file."""
    status.coalesce(1).write.mode("overwrite").json(path)


def read_run_status(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATUS_SCHEMA).json(path)
