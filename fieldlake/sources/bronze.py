"""The Bronze line table, its per-object statistics, and the ledger of landed byte ranges.

A batch writes its lines, then their statistics, then its ledger entries.  A batch
without ledger entries did not end: its folders are removed when its lines are read
again under another checkpoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlake.functions.text import sanitize_stem
from fieldlake.functions.times import partition_columns
from fieldlake.operators.consolidate import object_stats
from fieldlake.session import side_by_side_writers
from fieldlake.sources.versions import hadoop_files

PARTITIONS = ["instrument_id", "year", "month", "run_id", "batch_id"]
# A batch number starts anew with each checkpoint; only with the run does it name a batch.
BATCH = ["instrument_id", "run_id", "batch_id"]
BRONZE_SCHEMA = (
    "object_key string, pos bigint, line string, source_file string, range_start bigint, range_end bigint, "
    "ingest_ts timestamp_ntz, instrument_id string, year string, month string, run_id string, batch_id bigint"
)

BRONZE_COLUMNS = [part.split()[0] for part in BRONZE_SCHEMA.split(", ")]
STATS_SCHEMA = (
    "object_key string, size bigint, modified_at timestamp_ntz, data_rows bigint, other_rows bigint, "
    "first_data_pos bigint, last_data_pos bigint, first_other_pos bigint, instrument_id string, run_id string, batch_id bigint"
)
STATS_COLUMNS = [part.split()[0] for part in STATS_SCHEMA.split(", ")]
LEDGER_SCHEMA = (
    "source_file string, range_start bigint, range_end bigint, lines bigint, ingest_ts timestamp_ntz, "
    "instrument_id string, run_id string, batch_id bigint"
)
LEDGER_COLUMNS = [part.split()[0] for part in LEDGER_SCHEMA.split(", ")]


def _digits(number: Column, width: int) -> Column:
    """A number from 0 with zeros in front; one that is longer stays whole."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def object_key(instrument, source_file, start, end, ingest_ts, run_id, batch_id):
    """Deterministic key of one byte range landed by one batch.

    The file's stem, a digest of its full path, the byte range, and the run and
    batch that landed it: neither two files of one name, nor a file that was cut
    and grew to the same end again, can meet in one key.  A batch that runs again
    gives the same keys.
    """
    year, month = partition_columns(ingest_ts)
    name = F.element_at(F.split(source_file, "/"), -1)
    return F.concat(
        instrument, F.lit("/bronze/year="), year, F.lit("/month="), month, F.lit("/"), sanitize_stem(name),
        F.lit("__"), F.substring(F.sha2(source_file, 256), 1, 8),
        F.lit("__"), _digits(start, 20), F.lit("-"), _digits(end, 20),
        F.lit("__"), run_id, F.lit("-"), _digits(batch_id, 10), F.lit(".txt"),
    )


def bronze_rows_from_tail(tailed: DataFrame, instrument_id: str) -> DataFrame:
    """Bronze columns out of the growing-file source.

    On a stream, ``current_timestamp`` is fixed by the offset log of the batch,
    so a replayed batch lands in the same partitions.
    """
    now = F.current_timestamp().cast("timestamp_ntz")
    rows = tailed.select(
        F.lit(instrument_id).alias("instrument_id"),
        F.col("path").alias("source_file"),
        "range_start", "range_end", "pos", "line",
        now.alias("ingest_ts"),
    )
    year, month = partition_columns(F.col("ingest_ts"))
    return rows.withColumns({"year": year, "month": month})


def with_object_key(rows: DataFrame, run_id: str, batch_id: int) -> DataFrame:
    """Name the objects of one batch of ``bronze_rows_from_tail``."""
    columns = (F.col(c) for c in ("instrument_id", "source_file", "range_start", "range_end", "ingest_ts"))
    return rows.withColumn("object_key", object_key(*columns, F.lit(run_id), F.lit(batch_id).cast("bigint")))


def write_bronze(rows: DataFrame, path: str, run_id: str, batch_id: int) -> None:
    """Land one batch; running it again for the same run and batch replaces it, and nothing else.

    ``run_id`` names the checkpoint that numbers the batches.
    """
    named = rows.withColumns({"run_id": F.lit(run_id), "batch_id": F.lit(batch_id).cast("bigint")}).select(*BRONZE_COLUMNS)
    # The lines of a batch mostly share their folder.
    with side_by_side_writers(rows.sparkSession):
        named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path)


def write_bronze_stats(stats: DataFrame, path: str) -> None:
    """Replace the statistics of the batches present in ``stats``."""
    (
        stats.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*BATCH)
        .parquet(path)
    )


def read_bronze_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATS_SCHEMA).parquet(path)


def read_bronze(spark: SparkSession, path: str) -> DataFrame:
    """The Bronze line table; instrument, year, month and batch prune partitions."""
    return spark.read.schema(BRONZE_SCHEMA).parquet(path)


def bronze_stats(classified: DataFrame, run_id: str, batch_id: int) -> DataFrame:
    """One row per object that one batch landed: listing columns and line statistics.

    Kept up to date by landing, so an inventory or a header search reads this
    small table and not the lines.  Ranges of nothing but blank lines are no
    objects.
    """
    stats = object_stats(
        classified,
        F.max(F.col("range_end") - F.col("range_start")).alias("size"),
        F.max("ingest_ts").alias("modified_at"),
    )
    identity = {"run_id": F.lit(run_id), "batch_id": F.lit(batch_id).cast("bigint")}
    return stats.filter(F.col("data_rows") + F.col("other_rows") > 0).withColumns(identity).select(*STATS_COLUMNS)


def landed_ranges(landed: DataFrame) -> DataFrame:
    """Ledger entries: one row per byte range of a batch's landed lines."""
    return landed.groupBy("instrument_id", "run_id", "batch_id", "source_file", "range_start", "range_end").agg(
        F.count(F.lit(1)).alias("lines"), F.max("ingest_ts").alias("ingest_ts")
    ).select(*LEDGER_COLUMNS)


def write_ledger(ranges: DataFrame, path: str) -> None:
    """Replace the entries of the batches present in ``ranges``; the last write of a batch."""
    (
        ranges.coalesce(1)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*BATCH)
        .parquet(path)
    )


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all ended batches; empty before the first one."""
    files, folder = hadoop_files(spark, path)
    if not files.exists(folder):
        return spark.createDataFrame([], LEDGER_SCHEMA)
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)


def remove_half_landed(spark: SparkSession, path: str, ledger: DataFrame, instrument_id: str) -> list[str]:
    """Remove Bronze folders of an instrument's batches that the ledger does not have; returns their names.

    Only folder names and the ledger are read.  No query may be landing the instrument.
    """
    ended = {(r.run_id, r.batch_id) for r in ledger.filter(F.col("instrument_id") == instrument_id).select("run_id", "batch_id").distinct().collect()}
    files, folder = hadoop_files(spark, f"{path}/instrument_id={instrument_id}/year=*/month=*/run_id=*/batch_id=*")
    removed = []
    for status in files.globStatus(folder) or []:
        run, batch = status.getPath().getParent().getName(), status.getPath().getName()
        if (run.removeprefix("run_id="), int(batch.removeprefix("batch_id="))) not in ended:
            files.delete(status.getPath(), True)
            removed.append(f"{run}/{batch}")
    return sorted(removed)


def bronze_objects(stats: DataFrame) -> DataFrame:
    """Object listing of the line table."""
    return stats.select("instrument_id", "object_key", "size", "modified_at")


def batch_ledger(bronze: DataFrame) -> DataFrame:
    """One entry per landed byte range with its object, out of the lines."""
    return bronze.groupBy(
        "instrument_id", F.col("object_key").alias("s3_key"), "run_id", "batch_id", "source_file",
        F.col("range_start").alias("start_offset"), F.col("range_end").alias("end_offset"),
    ).agg(F.count(F.lit(1)).alias("lines"), F.lit(1).alias("uploaded"))


def file_offsets(bronze: DataFrame) -> DataFrame:
    """Offset reached per source file, out of lines or the ledger; the latest batch decides, also across runs."""
    return bronze.groupBy("instrument_id", F.col("source_file").alias("file")).agg(
        F.max_by("range_end", F.struct("ingest_ts", "batch_id", "range_end")).alias("offset")
    )
