"""Inventory and headline figures from the lake's statistics tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.functions.display import duplicates_shown, format_bytes, is_reporting
from fieldlake.functions.times import format_local_time
from fieldlake.operators import totals


def lake_inventory(instruments: DataFrame, bronze_stats: DataFrame, silver_stats: DataFrame) -> DataFrame:
    """Inventory from the per-object and per-instrument statistics, not the lines."""
    rows = bronze_stats.groupBy("instrument_id").agg(F.sum("data_rows").alias("bronze_rows"))
    silver = silver_stats.select("instrument_id", "data_rows_unique")
    return totals.inventory(instruments.select("instrument_id", "ordinal"), bronze_stats, rows, silver)


def dashboard_rows(stock: DataFrame) -> DataFrame:
    """Inventory as display text."""
    return stock.select(
        "id",
        "name",
        is_reporting(F.col("last_update")).alias("reporting"),
        "bronze_rows",
        format_bytes(F.col("bronze_size")).alias("size_text"),
        "silver_rows",
        duplicates_shown(F.col("bronze_rows"), F.col("silver_rows")).alias("duplicates_shown"),
        format_local_time(F.col("last_update")).alias("last_update_text"),
    )
