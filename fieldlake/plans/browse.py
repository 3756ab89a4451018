"""Record browse: filter, order, page, then reviews for the rows of the page."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlake.functions.display import sample_values
from fieldlake.functions.times import datetime_for_compare
from fieldlake.operators import paging
from fieldlake.operators.reviews import attach_reviews

RECORD = ["row_key", "source_index", "timestamp", "timestamp_iso", "values", "raw", "flags", "corrections", "status"]


def parse_bound(spark: SparkSession, text: str | None) -> datetime | None:
    """A range bound as naive UTC; unreadable text counts as no bound."""
    if text is None:
        return None
    row = spark.range(1).select(datetime_for_compare(F.lit(str(text))).alias("t")).first()
    return row.t


def browse_records(
    silver: DataFrame,
    items: DataFrame,
    instrument_id: str,
    start: str | None = None,
    end: str | None = None,
    limit: int | None = None,
    cursor: int = 0,
    order: str = "asc",
) -> DataFrame:
    """One page of records with their flags, corrections and status.

    The instrument prunes folders; time bounds, and the bounds of the page on
    ``source_index``, are literals that leave out row groups.  Silver holds every index
    of an instrument, so without time bounds the cursor is the bound.  Reviews meet only
    the rows of the page.
    """
    spark = silver.sparkSession
    rows = silver.filter(F.col("instrument_id") == instrument_id)
    bounds = parse_bound(spark, start), parse_bound(spark, end)
    turn = paging.page_dense if bounds == (None, None) else paging.page
    page = turn(paging.time_range_filter(rows, *bounds), cursor, paging.clamp_limit(limit), order)
    own = items.filter(F.col("instrument_id") == instrument_id)
    return paging.in_order(attach_reviews(page, own), order).select("instrument_id", *RECORD)


def browse_response(silver: DataFrame, headers: DataFrame, items: DataFrame, instrument_id: str, **query) -> dict:
    """The answer to a browse request: lazy tables for columns, rows and counts."""
    rows = browse_records(silver, items, instrument_id, **query)
    return {
        "columns": headers.filter(F.col("instrument_id") == instrument_id).select("columns"),
        "rows": rows,
        "next_cursor": paging.next_cursor(rows, query.get("cursor", 0), paging.clamp_limit(query.get("limit"))),
        "review_object_count": items.filter(F.col("instrument_id") == instrument_id).agg(
            F.count(F.lit(1)).alias("review_object_count")
        ),
    }


def latest_sample(silver: DataFrame, headers: DataFrame, instrument_id: str, limit: int, columns: int = 6) -> DataFrame:
    """Latest rows of an instrument with the values of its first columns."""
    rows = paging.latest_rows(silver.filter(F.col("instrument_id") == instrument_id), limit)
    named = rows.join(headers.select("instrument_id", "columns"), "instrument_id", "left")
    return paging.in_order(named, "desc").select(
        "source_index", "row_key", "timestamp", sample_values(F.col("columns"), F.col("values"), columns).alias("sample_values")
    )


def latest_summary(silver: DataFrame, headers: DataFrame, stats: DataFrame, limit: int = 5, columns: int = 6) -> DataFrame:
    """Counts of every instrument and its latest rows, each with the values of its first columns.

    Silver holds every index from 0, so the statistics say where the latest rows begin:
    one join for all instruments, no sort of any of them.
    """
    counted = stats.select(
        "instrument_id", F.col("bronze_objects").alias("objects"), F.col("data_rows_total").alias("bronze_rows"),
        F.col("data_rows_unique").alias("silver_rows"),
    )
    latest = silver.join(counted, "instrument_id").filter(F.col("source_index") >= F.col("silver_rows") - limit)
    named = latest.join(headers.select("instrument_id", "columns"), "instrument_id", "left")
    return named.select(
        "instrument_id", "objects", "bronze_rows", "silver_rows", "source_index", "row_key", "timestamp",
        sample_values(F.col("columns"), F.col("values"), columns).alias("sample_values"),
    )
