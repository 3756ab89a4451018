"""Silver tables on storage: rows, headers, preambles, statistics, text export.

The four tables of a build are published together (``sources.versions``): a reader
sees all of them or none.  Rows lie in storage order, in row groups that are small
enough for their bounds on ``source_index`` and ``ts`` to leave out most of a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlake.functions.text import split_lines
from fieldlake.sources import versions

SILVER_SCHEMA = (
    "source_index bigint, object_key string, pos bigint, raw string, fields array<string>, "
    "values map<string,string>, timestamp string, timestamp_iso string, ts timestamp_ntz, row_key string, "
    "instrument_id string"
)
HEADER_SCHEMA = "instrument_id string, object_key string, raw string, columns array<string>"
PREAMBLE_SCHEMA = "seq bigint, line string, instrument_id string"
STATS_SCHEMA = (
    "instrument_id string, bronze_objects bigint, data_rows_total bigint, data_rows_unique bigint, "
    "duplicates_removed bigint"
)
# Fixed value: the statistics line of a metadata sidecar.
UNIQUE_ROWS_MARK = "# data_rows_unique:"


TABLES = ["rows", "preamble", "header", "stats"]
ROW_GROUP_BYTES = 16 * 1024 * 1024


def write_rows(rows: DataFrame, path: str, build: str) -> None:
    """Silver rows of one build, a folder per instrument, in order inside every file."""
    (
        rows.sortWithinPartitions("instrument_id", "source_index")
        .write.option("parquet.block.size", ROW_GROUP_BYTES)
        .partitionBy("instrument_id")
        .parquet(f"{path}/rows/build={build}")
    )


def write_table(df: DataFrame, path: str, table: str, build: str) -> None:
    """One of the small tables of a build."""
    df.write.parquet(f"{path}/{table}/build={build}")


def _live(spark: SparkSession, path: str) -> DataFrame:
    return versions.manifest(spark, path).filter("build is not null")


def read_silver(spark: SparkSession, path: str, instrument_id: str | None = None) -> DataFrame:
    """Silver rows of the current version; the instrument prunes folders, ``source_index`` and ``ts`` bounds reach the scan.

    Instruments whose last good build kept no rows have none.
    """
    live = _live(spark, path).filter("data_rows_unique > 0")
    if instrument_id is not None:
        live = live.filter(F.col("instrument_id") == instrument_id)
    rows = versions.read_live(spark, path, "rows", SILVER_SCHEMA, live)
    return rows if instrument_id is None else rows.filter(F.col("instrument_id") == instrument_id)


def read_header(spark: SparkSession, path: str) -> DataFrame:
    return versions.read_live(spark, path, "header", HEADER_SCHEMA, _live(spark, path))


def read_preamble(spark: SparkSession, path: str) -> DataFrame:
    return versions.read_live(spark, path, "preamble", PREAMBLE_SCHEMA, _live(spark, path))


def read_silver_stats(spark: SparkSession, path: str) -> DataFrame:
    """Statistics of every instrument; they are part of the manifest."""
    return _live(spark, path).select(*[part.split()[0] for part in STATS_SCHEMA.split(", ")])


def read_build_errors(spark: SparkSession, path: str) -> DataFrame:
    """Instruments whose last build failed: ``instrument_id, attempt, error``."""
    return versions.manifest(spark, path).filter("error is not null").select("instrument_id", "attempt", "error")


def silver_rows_from_sidecar(sidecars: DataFrame) -> DataFrame:
    """Unique row count out of ``instrument_id, text`` metadata sidecars.

    The first statistics line counts; text that is no number gives null.
    """
    marked = F.filter(split_lines(F.col("text")), lambda line: F.startswith(line, F.lit(UNIQUE_ROWS_MARK)))
    value = F.trim(F.substring_index(F.get(marked, F.lit(0)), ":", -1)).try_cast("bigint")
    return sidecars.select("instrument_id", value.alias("data_rows_unique"))


def sidecar_lines(stats: DataFrame, preamble: DataFrame, generated_at: str) -> DataFrame:
    """Ordered text lines of each instrument's metadata sidecar: ``n, line``."""
    fixed = [
        F.concat(F.lit("# Silver metadata for "), F.col("instrument_id")),
        F.lit(f"# generated_at: {generated_at}"),
        F.concat(F.lit("# bronze_objects: "), F.col("bronze_objects").cast("string")),
        F.concat(F.lit("# data_rows_total: "), F.col("data_rows_total").cast("string")),
        F.concat(F.lit(f"{UNIQUE_ROWS_MARK} "), F.col("data_rows_unique").cast("string")),
        F.concat(F.lit("# duplicates_removed: "), F.col("duplicates_removed").cast("string")),
        F.lit("# --- header / preamble lines from bronze ---"),
    ]
    head = stats.select("instrument_id", F.posexplode(F.array(*fixed)).alias("n", "line"))
    head = head.withColumn("n", (F.col("n") - len(fixed)).cast("bigint"))
    return head.unionByName(preamble.select("instrument_id", F.col("seq").alias("n"), "line"))


def export_text(rows: DataFrame, path: str, order: str) -> None:
    """Write ``instrument_id, line`` as text parts whose file order is ``order``.

    A range-partitioned sort: parts follow each other, no task holds a whole
    instrument.
    """
    (
        rows.repartitionByRange("instrument_id", order)
        .sortWithinPartitions("instrument_id", order)
        .select("instrument_id", "line")
        .write.mode("overwrite")
        .partitionBy("instrument_id")
        .text(path)
    )
