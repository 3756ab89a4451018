"""Inventory, status, totals, offsets and ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlake.catalog.consolidation import dedup_keep_first
from fieldlake.catalog.registry import query
from fieldlake.catalog.standins import ITEMS, OBJ, STOCK, classified_documents, object_listing, review_items, source_dimension, table
from fieldlake.operators import consolidate as cs
from fieldlake.operators import offsets, totals
from fieldlake.operators.reviews import review_counts as count_reviews
from fieldlake.plans.inventory import dashboard_rows

AS_OF = "1999-03-17"
NOW = "2024-01-31 00:00:00"
SITE = "North Site"


def _stock(spark, sf):
    silver = dedup_keep_first(spark, sf).groupBy("instrument_id").agg(F.count(F.lit(1)).alias("data_rows_unique"))
    rows = cs.bronze_rows(classified_documents(spark, sf))
    return totals.inventory(source_dimension(spark, sf), object_listing(spark, sf), rows, silver)


def _listed(spark, sf):
    """Inventory without row counts, for figures that only need the listing."""
    none = spark.createDataFrame([], "instrument_id string, bronze_rows bigint, data_rows_unique bigint")
    return totals.inventory(
        source_dimension(spark, sf), object_listing(spark, sf),
        none.select("instrument_id", "bronze_rows"), none.select("instrument_id", "data_rows_unique"),
    )


@query("inventory", f"WITH {STOCK} SELECT id, name, bronze_size, bronze_rows, silver_rows, last_update FROM stock")
def inventory(spark, sf):
    return _stock(spark, sf).drop("ordinal")


@query(
    "dimension_left_join",
    f"""WITH {OBJ} SELECT dim.instrument_id, dim.ordinal, o.objects FROM dim
    LEFT JOIN (SELECT instrument_id, count(*) AS objects FROM obj GROUP BY 1) o USING (instrument_id)""",
)
def dimension_left_join(spark, sf):
    counted = object_listing(spark, sf).groupBy("instrument_id").agg(F.count(F.lit(1)).alias("objects"))
    return totals.dimension_left_join(source_dimension(spark, sf), counted)


_LATEST = """
latest AS (
  SELECT max(last_update) AS refresh_time,
         coalesce((SELECT id FROM stock WHERE last_update IS NOT NULL ORDER BY last_update DESC, ordinal LIMIT 1), 'NONE') AS latest_instrument,
         CASE WHEN max(last_update) IS NOT NULL THEN 'ONLINE' ELSE 'DEGRADED' END AS system_status
  FROM stock
)"""


@query("latest_instrument", f"WITH {STOCK}, {_LATEST} SELECT refresh_time, latest_instrument FROM latest")
def latest_instrument(spark, sf):
    return totals.latest_instrument(_listed(spark, sf))


@query("system_status", f"WITH {STOCK}, {_LATEST} SELECT system_status FROM latest")
def system_status(spark, sf):
    return totals.system_status(_listed(spark, sf))


_MTD = f"""
mtd AS (
  SELECT round(coalesce(sum(o_totalprice), 0), 2) AS mtd_total FROM orders
  WHERE o_orderdate >= date_trunc('month', DATE '{AS_OF}') AND o_orderdate < DATE '{AS_OF}'
)"""


@query("mtd_total", f"WITH {_MTD} SELECT mtd_total FROM mtd")
def mtd_total(spark, sf):
    return totals.mtd_total(table(spark, sf, "orders"), AS_OF, "o_orderdate", "o_totalprice")


@query(
    "kpi_row",
    f"""WITH {STOCK}, {_LATEST}, {_MTD}
    SELECT refresh_time, system_status, latest_instrument, '{SITE}' AS site_name, mtd_total FROM latest, mtd""",
)
def kpi_row(spark, sf):
    return totals.kpi_row(_listed(spark, sf), mtd_total(spark, sf), SITE)


@query(
    "freshness_hours",
    f"""WITH {STOCK} SELECT id, round((epoch(TIMESTAMP '{NOW}') - floor(epoch(last_update))) / 3600.0, 2) AS freshness_hours,
      coalesce(round((epoch(TIMESTAMP '{NOW}') - floor(epoch(last_update))) / 3600.0, 2) > 24, true) AS stale FROM stock""",
)
def freshness_hours(spark, sf):
    return totals.freshness_hours(_listed(spark, sf), NOW)


_DASH = f"""WITH {STOCK} SELECT id, last_update IS NOT NULL AS reporting,
  CASE WHEN bronze_rows > silver_rows THEN bronze_rows - silver_rows END AS duplicates_shown FROM stock"""


@query("duplicates_shown", _DASH.replace("last_update IS NOT NULL AS reporting,", ""))
def duplicates_shown(spark, sf):
    return dashboard_rows(_stock(spark, sf)).select("id", "duplicates_shown")


@query("is_reporting", f"WITH {STOCK} SELECT id, last_update IS NOT NULL AS reporting FROM stock")
def is_reporting(spark, sf):
    return dashboard_rows(_listed(spark, sf)).select("id", "reporting")


def _suppliers(spark, sf):
    kinds = F.array(F.lit("growing_file"), F.lit("api"), F.lit(None).cast("string"))
    return table(spark, sf, "supplier").select(
        F.col("s_name").alias("instrument_id"),
        F.get(kinds, F.col("s_nationkey") % 3).alias("ingestion_type"),
        F.when(F.col("s_nationkey") > 4, F.col("s_acctbal") >= 2000).alias("active"),
    )


_SUP = """
sup AS (
  SELECT s_name AS instrument_id, ['growing_file', 'api', NULL][s_nationkey % 3 + 1] AS ingestion_type,
         CASE WHEN s_nationkey > 4 THEN s_acctbal >= 2000 END AS active FROM supplier
),
res AS (
  SELECT instrument_id, CASE WHEN ingestion_type = 'growing_file' THEN 'ok' ELSE 'error' END AS instrument_status,
         CASE WHEN ingestion_type IS DISTINCT FROM 'growing_file'
              THEN 'Unknown ingestion_type: ' || coalesce(ingestion_type, 'None') END AS error
  FROM sup
)"""


@query("active_filter", f"WITH {_SUP} SELECT instrument_id FROM sup WHERE coalesce(active, true)")
def active_filter(spark, sf):
    return totals.active_filter(_suppliers(spark, sf)).select("instrument_id")


@query("supported_ingestion", f"WITH {_SUP} SELECT * FROM res")
def supported_ingestion(spark, sf):
    return totals.instrument_run_status(_suppliers(spark, sf))


@query(
    "run_status",
    f"""WITH {_SUP} SELECT CASE WHEN bool_and(instrument_status = 'ok') THEN 'ok' ELSE 'degraded' END AS status,
      count(*) AS instruments FROM res""",
)
def run_status(spark, sf):
    return totals.run_status(supported_ingestion(spark, sf))


@query(
    "review_counts",
    f"""WITH {ITEMS} SELECT instrument_id, count(*) AS review_count FROM (
      SELECT instrument_id, item_key FROM ranges_ UNION ALL SELECT instrument_id, item_key FROM fixes_
      UNION ALL SELECT DISTINCT instrument_id, item_key FROM keys_) GROUP BY 1""",
)
def review_counts(spark, sf):
    return count_reviews(review_items(spark, sf))


def _ledger(spark, sf):
    """Orders as landed batches; open orders are still pending."""
    orders = table(spark, sf, "orders")
    return orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("instrument_id"),
        F.concat_ws("/", "o_orderpriority", F.lit("bronze"), F.col("o_orderkey").cast("string")).alias("s3_key"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("raw_data"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("uploaded"),
    )


_LEDGER = """
ledger AS (
  SELECT o_orderkey AS id, o_orderpriority AS instrument_id, o_orderpriority || '/bronze/' || o_orderkey AS s3_key,
         CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS raw_data,
         CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS uploaded
  FROM orders
)"""


@query(
    "ledger_summary",
    f"WITH {_LEDGER} SELECT instrument_id, count(*) AS batches, sum(uploaded)::BIGINT AS uploaded_batches FROM ledger GROUP BY 1",
)
def ledger_summary(spark, sf):
    return totals.ledger_summary(_ledger(spark, sf))


@query(
    "pending_batches",
    f"WITH {_LEDGER} SELECT id, instrument_id, s3_key FROM ledger WHERE uploaded = 0 AND raw_data IS NOT NULL ORDER BY id",
)
def pending_batches(spark, sf):
    return totals.pending_batches(_ledger(spark, sf)).select("id", "instrument_id", "s3_key")


@query(
    "uncommitted_batches",
    f"""WITH {_LEDGER} SELECT id, s3_key FROM ledger
    WHERE s3_key NOT IN (SELECT o_orderpriority || '/bronze/' || o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
)
def uncommitted_batches(spark, sf):
    ledger = _ledger(spark, sf)
    return totals.uncommitted_batches(ledger, ledger.filter("uploaded = 1")).select("id", "s3_key")


def _offsets(spark, sf, local):
    """Every order is an offset of one side: finished ones are local, all others remote."""
    finished = F.col("o_orderstatus").eqNullSafe("F")
    orders = table(spark, sf, "orders").filter(finished if local else ~finished)
    return orders.groupBy(F.col("o_orderpriority").alias("instrument_id"), F.col("o_custkey").cast("string").alias("file")).agg(
        F.max("o_orderkey").alias("offset")
    )


_OFFSETS = """
loc AS (SELECT o_orderpriority AS instrument_id, o_custkey::VARCHAR AS file, max(o_orderkey) AS "offset" FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2),
rem AS (SELECT o_orderpriority AS instrument_id, o_custkey::VARCHAR AS file, max(o_orderkey) AS "offset" FROM orders WHERE o_orderstatus IS DISTINCT FROM 'F' GROUP BY 1, 2)"""


@query(
    "checkpoint_merge",
    f"""WITH {_OFFSETS} SELECT instrument_id, file, greatest(coalesce(loc."offset", 0), coalesce(rem."offset", 0)) AS "offset",
      coalesce(rem."offset", 0) > coalesce(loc."offset", 0) AS recovered
    FROM loc FULL JOIN rem USING (instrument_id, file)""",
)
def checkpoint_merge(spark, sf):
    return offsets.checkpoint_merge(_offsets(spark, sf, True), _offsets(spark, sf, False))


@query("union_checkpoint_keys", f"WITH {_OFFSETS} SELECT instrument_id, file FROM loc UNION SELECT instrument_id, file FROM rem")
def union_checkpoint_keys(spark, sf):
    return offsets.checkpoint_keys(_offsets(spark, sf, True), _offsets(spark, sf, False))


@query(
    "checkpoint_normalize",
    """
    WITH pay AS (SELECT c_name AS instrument_id, c_custkey,
           CASE WHEN c_custkey % 2 = 0 THEN true ELSE false END AS has_map,
           CASE WHEN c_custkey % 5 = 1 THEN 0 ELSE c_custkey * 10 END AS legacy FROM customer),
    files AS (SELECT c_name AS instrument_id, o_orderkey::VARCHAR AS file FROM orders JOIN customer ON o_custkey = c_custkey),
    lastf AS (SELECT instrument_id, max(file) AS file FROM files GROUP BY 1)
    SELECT instrument_id, 'a.txt' AS file, c_custkey AS "offset" FROM pay WHERE has_map
    UNION ALL SELECT instrument_id, 'b.txt', 0 FROM pay WHERE has_map
    UNION ALL SELECT instrument_id, lastf.file, legacy FROM pay JOIN lastf USING (instrument_id) WHERE NOT has_map AND legacy > 0
    """,
)
def checkpoint_normalize(spark, sf):
    customers = table(spark, sf, "customer")
    has_map = F.col("c_custkey") % 2 == 0
    stored = F.create_map(F.lit("a.txt"), F.col("c_custkey"), F.lit("b.txt"), F.lit(None).cast("bigint"))
    payloads = customers.select(
        F.col("c_name").alias("instrument_id"),
        F.when(has_map, stored).alias("files"),
        F.when(F.col("c_custkey") % 5 == 1, F.lit(0)).otherwise(F.col("c_custkey") * 10).cast("bigint").alias("offset"),
    )
    known = table(spark, sf, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("c_name").alias("instrument_id"), F.col("o_orderkey").cast("string").alias("file")
    )
    return offsets.checkpoint_normalize(payloads, known)
