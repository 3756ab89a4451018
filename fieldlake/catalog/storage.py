"""Readers and writers, each checked by a round trip over derived data."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlake.catalog.registry import query
from fieldlake.catalog.standins import (
    DOCUMENT_RULES, EV, EVENT_HEADER, EVENT_RULES, ITEMS, ROWS, STATS, document_lines, event_lines, event_log, object_listing,
    review_items, table,
)
from fieldlake.functions.times import partition_columns
from fieldlake.operators import totals
from fieldlake.plans import silver as silver_plan
from fieldlake.session import scratch_path
from fieldlake.sources import bronze, files, reviews, silver, status

# What a session has already written, so that queries over one data set share it.
_written: dict[tuple, str] = {}


def once(spark, sf, name, write) -> str:
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _written:
        path = scratch_path(spark, name)
        write(path)
        _written[key] = path
    return _written[key]


def event_lake(spark, sf) -> str:
    """Silver of the event log, built once per session and data set."""
    return once(spark, sf, "event-lake", lambda path: silver_plan.build_silver(event_log(spark, sf), EVENT_RULES, path))


def raw_files(spark, sf) -> str:
    """Event lines as text objects below ``instrument_id=/year=/month=``."""

    def write(path):
        lines = event_lines(spark, sf)
        year, month = partition_columns(F.col("ts"))
        (
            lines.select("instrument_id", year, month, "line", "object_key")
            .repartition("instrument_id", "object_key")
            .drop("object_key")
            .write.partitionBy("instrument_id", "year", "month")
            .text(path)
        )

    return once(spark, sf, "raw-files", write)


RAW_PATTERN = "instrument_id=*/year=*/month=*/*.txt"


@query(
    "discover_files",
    """SELECT DISTINCT event_type AS instrument_id, strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month,
      true AS has_bytes FROM events""",
)
def discover_files(spark, sf):
    root = raw_files(spark, sf)
    found = files.discover_files(spark, [f"{root}/{RAW_PATTERN}", f"{root}/instrument_id=c*/*/*/*", f"{root}/none/*"])
    part = {k: F.regexp_extract("path", f"{k}=([^/]+)", 1) for k in ("instrument_id", "year", "month")}
    listed = found.select(*[c.alias(k) for k, c in part.items()], "size")
    return listed.groupBy("instrument_id", "year", "month").agg((F.sum("size") > 0).alias("has_bytes"))


@query(
    "union_globs",
    "SELECT event_type AS instrument_id, sum(octet_length(encode(line)) + 1)::BIGINT AS bytes FROM (SELECT event_type, "
    "concat_ws(',', event_id::VARCHAR, strftime(ts, '%Y-%m-%d %H:%M:%S'), user_id::VARCHAR, printf('%.2f', value), props) AS line "
    "FROM events) GROUP BY 1",
)
def union_globs(spark, sf):
    root = raw_files(spark, sf)
    found = files.discover_files(spark, [f"{root}/{RAW_PATTERN}", f"{root}/instrument_id=*/*/*/part*.txt"])
    return found.groupBy(F.regexp_extract("path", "instrument_id=([^/]+)", 1).alias("instrument_id")).agg(
        F.sum("size").alias("bytes")
    )


@query("scan_bronze_lines", f"WITH {EV} SELECT instrument_id, line FROM ev")
def scan_bronze_lines(spark, sf):
    root = raw_files(spark, sf)
    return files.scan_bronze_lines(spark, root, f"{root}/{RAW_PATTERN}").select("instrument_id", "line")


@query("scan_large_objects", f"WITH {EV} SELECT instrument_id, line FROM ev")
def scan_large_objects(spark, sf):
    root = raw_files(spark, sf)
    lines = files.scan_bronze_lines(spark, root, f"{root}/{RAW_PATTERN}", range_bytes=20_000)
    return lines.select("instrument_id", "line")


@query(
    "scan_bronze_objects",
    f"WITH {EV} SELECT instrument_id, sum(octet_length(encode(line)) + 1)::BIGINT AS size, true AS listed FROM ev GROUP BY 1",
)
def scan_bronze_objects(spark, sf):
    root = raw_files(spark, sf)
    listed = files.scan_bronze_objects(spark, root, f"{root}/{RAW_PATTERN}")
    return listed.groupBy("instrument_id").agg(
        F.sum("size").alias("size"), F.bool_and(F.col("modified_at").isNotNull()).alias("listed")
    )


@query("scan_silver", f'WITH {ROWS} SELECT instrument_id, source_index, raw, row_key, "timestamp", ts FROM rows_')
def scan_silver(spark, sf):
    rows = silver.read_silver(spark, event_lake(spark, sf))
    return rows.select("instrument_id", "source_index", "raw", "row_key", "timestamp", "ts")


@query(
    "write_silver",
    f"""WITH {EV} SELECT instrument_id, 'header' AS part, 0::BIGINT AS n, '{EVENT_HEADER}' AS line FROM (SELECT DISTINCT instrument_id FROM ev)
    UNION ALL SELECT instrument_id, 'preamble', 0, '{EVENT_HEADER}' FROM (SELECT DISTINCT instrument_id FROM ev)
    UNION ALL SELECT instrument_id, 'row', row_number() OVER (PARTITION BY instrument_id ORDER BY object_key, pos) - 1, line FROM ev""",
)
def write_silver(spark, sf):
    lake = event_lake(spark, sf)
    header = silver.read_header(spark, lake).select(
        "instrument_id", F.lit("header").alias("part"), F.lit(0).cast("bigint").alias("n"), F.col("raw").alias("line")
    )
    preamble = silver.read_preamble(spark, lake).select("instrument_id", F.lit("preamble").alias("part"), F.col("seq").alias("n"), "line")
    rows = silver.read_silver(spark, lake).select(
        "instrument_id", F.lit("row").alias("part"), F.col("source_index").alias("n"), F.col("raw").alias("line")
    )
    return header.unionByName(preamble).unionByName(rows)


@query(
    "build_silver",
    f"""WITH {STATS} SELECT instrument_id, bronze_objects AS objects, data_rows_total AS rows, data_rows_unique AS unique,
      duplicates_removed AS duplicates, bronze_objects > 0 AS written, NULL::VARCHAR AS error FROM st""",
)
def build_silver(spark, sf):
    """The whole rebuild of the documents: four tables and one commit."""
    path = scratch_path(spark, "document-lake")
    return silver_plan.build_silver(document_lines(spark, sf), DOCUMENT_RULES, path, object_listing(spark, sf))


@query(
    "build_with_a_failure",
    f"""WITH {EV} SELECT instrument_id, instrument_id = 'view' AS failed, count(*) AS rows,
      count(*) FILTER (instrument_id = 'view' OR pos % 2 = 0) AS rows_after FROM ev GROUP BY 1""",
)
def build_with_a_failure(spark, sf):
    """A second build with half of the lines, in which one instrument fails: it keeps its rows, the others are replaced."""
    path = scratch_path(spark, "half-failed-lake")
    lines = event_log(spark, sf)
    broken = F.when((F.col("instrument_id") == "view") & (F.col("pos") == -1), F.col("line").cast("int").cast("string")).otherwise(F.col("line"))
    silver_plan.build_silver(lines, EVENT_RULES, path)
    before = silver.read_silver(spark, path).groupBy("instrument_id").agg(F.count(F.lit(1)).alias("rows"))
    results = silver_plan.build_silver(lines.filter("pos % 2 = 0 or pos = -1").withColumn("line", broken), EVENT_RULES, path)
    after = silver.read_silver(spark, path).groupBy("instrument_id").agg(F.count(F.lit(1)).alias("rows_after"))
    failed = results.select("instrument_id", F.col("error").contains("CAST_INVALID_INPUT").alias("failed"))
    failed = failed.withColumn("failed", F.coalesce("failed", F.lit(False)))
    return before.join(after, "instrument_id").join(failed, "instrument_id")


@query(
    "read_silver_stats",
    f"WITH {EV} SELECT instrument_id, count(*) AS data_rows_unique, count(*) AS from_sidecar FROM ev GROUP BY 1",
)
def read_silver_stats(spark, sf):
    lake = event_lake(spark, sf)
    stats = silver.read_silver_stats(spark, lake)

    def write(path):
        lines = silver.sidecar_lines(stats, silver.read_preamble(spark, lake), "2024-01-31T00:00:00+00:00")
        silver.export_text(lines, path, "n")

    path = once(spark, sf, "sidecars", write)
    texts = spark.read.text(path, wholetext=True).select("instrument_id", F.col("value").alias("text"))
    sidecar = silver.silver_rows_from_sidecar(texts).groupBy("instrument_id").agg(F.max("data_rows_unique").alias("from_sidecar"))
    return stats.join(sidecar, "instrument_id").select("instrument_id", "data_rows_unique", "from_sidecar")


@query(
    "write_bronze",
    f"WITH {EV} SELECT instrument_id, strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month, pos, line FROM ev",
)
def write_bronze(spark, sf):
    def write(path):
        lines = event_lines(spark, sf)
        year, month = partition_columns(F.col("ts"))
        rows = lines.select(
            "instrument_id", year, month, "object_key", "pos", "line",
            F.concat(F.lit("/raw/"), "object_key").alias("source_file"),
            F.col("pos").alias("range_start"), (F.col("pos") + 1).alias("range_end"), F.col("ts").alias("ingest_ts"),
        )
        # The second write of a batch replaces the first.
        bronze.write_bronze(rows, path, "run", 1)
        bronze.write_bronze(rows, path, "run", 1)

    path = once(spark, sf, "bronze", write)
    return bronze.read_bronze(spark, path).select("instrument_id", "year", "month", "pos", "line")


def _item_store(spark, sf) -> str:
    return once(spark, sf, "items", lambda path: reviews.write_review_items(review_items(spark, sf), path))


@query(
    "read_review_items",
    f"""WITH {ITEMS} SELECT id, type, instrument_id, coalesce(status, '-') AS status,
      strftime(t0, '%Y-%m-%dT%H:%M:%SZ') AS start_time, NULL::BIGINT AS listed FROM ranges_
    UNION ALL SELECT id, type, instrument_id, 'active', NULL, count(*) FROM keys_ GROUP BY ALL
    UNION ALL SELECT id, type, instrument_id, 'active', NULL, NULL FROM fixes_""",
)
def read_review_items(spark, sf):
    items = reviews.read_review_items(spark, _item_store(spark, sf))
    return items.select(
        "id", "type", "instrument_id", F.coalesce("status", F.lit("-")).alias("status"), "start_time",
        F.when(F.col("row_keys").isNotNull(), F.size("row_keys")).cast("bigint").alias("listed"),
    )


@query(
    "write_run_status",
    """SELECT event_type AS instrument_id, CASE WHEN event_type = 'view' THEN 'error' ELSE 'ok' END AS instrument_status,
      count(*) AS batches_written, 'degraded' AS status FROM events GROUP BY 1""",
)
def write_run_status(spark, sf):
    def write(path):
        counted = table(spark, sf, "events").groupBy(F.col("event_type").alias("instrument_id")).agg(
            F.count(F.lit(1)).alias("batches_written")
        )
        rows = counted.withColumn("instrument_status", F.when(F.col("instrument_id") == "view", "error").otherwise("ok"))
        overall = totals.run_status(rows).select("status", F.lit(1).alias("_one"))
        joined = rows.withColumn("_one", F.lit(1)).join(overall, "_one").drop("_one")
        status.write_run_status(joined.withColumn("last_run", F.lit("2024-01-31T00:00:00")), path)

    path = once(spark, sf, "run-status", write)
    return status.read_run_status(spark, path).select("instrument_id", "instrument_status", "batches_written", "status")
