"""Inventory, freshness, run status and month-to-date totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.functions.display import display_name

# Status words.
ONLINE, DEGRADED, NO_INSTRUMENT = "ONLINE", "DEGRADED", "NONE"
OK, ERROR, RUN_DEGRADED = "ok", "error", "degraded"
GROWING_FILE = "growing_file"
STALE_AFTER_HOURS = 24.0


def dimension_left_join(instruments: DataFrame, facts: DataFrame) -> DataFrame:
    """Every instrument of the dimension, with its facts where there are any."""
    return instruments.join(facts, "instrument_id", "left")


def inventory(instruments: DataFrame, objects: DataFrame, rows: DataFrame, silver: DataFrame) -> DataFrame:
    """One row per instrument: sizes, row counts and the last update.

    ``instruments``: instrument_id, ordinal; ``objects``: instrument_id, size,
    modified_at; ``rows``: instrument_id, bronze_rows; ``silver``: instrument_id,
    data_rows_unique.  The facts are aggregated to one row per instrument before
    they meet the dimension.
    """
    sizes = objects.groupBy("instrument_id").agg(
        F.sum("size").cast("bigint").alias("bronze_size"), F.max("modified_at").alias("last_update")
    )
    joined = dimension_left_join(dimension_left_join(dimension_left_join(instruments, sizes), rows), silver)
    return joined.select(
        F.col("instrument_id").alias("id"),
        display_name(F.col("instrument_id")).alias("name"),
        F.coalesce("bronze_size", F.lit(0).cast("bigint")).alias("bronze_size"),
        F.coalesce("bronze_rows", F.lit(0).cast("bigint")).alias("bronze_rows"),
        F.col("data_rows_unique").alias("silver_rows"),
        "last_update",
        "ordinal",
    )


def latest_instrument(stock: DataFrame) -> DataFrame:
    """Newest update and its instrument; the lower ordinal wins a tie."""
    seen = F.col("last_update").isNotNull()
    newest = F.max_by("id", F.when(seen, F.struct(F.col("last_update"), -F.col("ordinal"))))
    return stock.agg(
        F.max("last_update").alias("refresh_time"), F.coalesce(newest, F.lit(NO_INSTRUMENT)).alias("latest_instrument")
    )


def system_status(stock: DataFrame) -> DataFrame:
    any_data = F.max("last_update").isNotNull()
    return stock.agg(F.when(any_data, ONLINE).otherwise(DEGRADED).alias("system_status"))


def mtd_total(dated: DataFrame, as_of, date: str = "date", amount: str = "amount") -> DataFrame:
    """Month-to-date sum over ``[first of month, as_of)``; 0.0 on the first day."""
    today = F.lit(str(as_of)[:10]).cast("date").cast("timestamp_ntz")
    first = F.date_trunc("month", F.lit(str(as_of)[:10]).cast("date")).cast("timestamp_ntz")
    kept = dated.filter((F.col(date) >= first) & (F.col(date) < today))
    return kept.agg(F.round(F.coalesce(F.sum(F.col(amount)), F.lit(0.0)), 2).alias("mtd_total"))


def kpi_row(stock: DataFrame, total: DataFrame, site_name: str) -> DataFrame:
    """Dashboard headline: one row out of three one-row aggregates."""
    return (
        latest_instrument(stock)
        .withColumn("_one", F.lit(1))
        .join(system_status(stock).withColumn("_one", F.lit(1)), "_one")
        .join(total.withColumn("_one", F.lit(1)), "_one")
        .select("refresh_time", "system_status", "latest_instrument", F.lit(site_name).alias("site_name"), "mtd_total")
    )


def freshness_hours(stock: DataFrame, as_of, stale_after: float = STALE_AFTER_HOURS) -> DataFrame:
    """Hours since the last object of each instrument and a ``stale`` mark."""
    now = F.lit(str(as_of)).cast("timestamp_ntz")
    seconds = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("last_update").cast("timestamp"))
    hours = F.round(seconds / 3600.0, 2)
    return stock.select(
        "id", hours.alias("freshness_hours"), F.coalesce(hours > stale_after, F.lit(True)).alias("stale")
    )


def instrument_run_status(instruments: DataFrame) -> DataFrame:
    """``ok`` for growing files, ``error`` with a message for any other ingestion type."""
    known = F.col("ingestion_type").eqNullSafe(GROWING_FILE)
    label = F.coalesce("ingestion_type", F.lit("None"))
    return instruments.select(
        "instrument_id",
        F.when(known, OK).otherwise(ERROR).alias("instrument_status"),
        F.when(~known, F.concat(F.lit("Unknown ingestion_type: "), label)).alias("error"),
    )


def active_filter(instruments: DataFrame) -> DataFrame:
    return instruments.filter(F.coalesce("active", F.lit(True)))


def run_status(results: DataFrame, status: str = "instrument_status") -> DataFrame:
    """``ok`` when every instrument is ok (also with none at all), else ``degraded``."""
    all_ok = F.coalesce(F.bool_and(F.col(status) == OK), F.lit(True))
    return results.agg(F.when(all_ok, OK).otherwise(RUN_DEGRADED).alias("status"), F.count(F.lit(1)).alias("instruments"))


def ledger_summary(ledger: DataFrame) -> DataFrame:
    """Batches and uploaded batches per instrument."""
    return ledger.groupBy("instrument_id").agg(
        F.count(F.lit(1)).alias("batches"), F.sum("uploaded").cast("bigint").alias("uploaded_batches")
    )


def pending_batches(ledger: DataFrame) -> DataFrame:
    """Batches still to land, in id order; entries without a payload are skipped."""
    return ledger.filter((F.col("uploaded") == 0) & F.col("raw_data").isNotNull()).orderBy("id")


def uncommitted_batches(ledger: DataFrame, committed: DataFrame) -> DataFrame:
    """Ledger entries whose object is not among the committed ones."""
    return ledger.join(committed.select("s3_key"), "s3_key", "left_anti")


