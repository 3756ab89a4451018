"""Headers, preambles, duplicates, positions and their statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlake.catalog.registry import query
from fieldlake.catalog.standins import (
    CL, DD, DL, DOCUMENT_RULES, OBJ, STATS, classified_documents, conversation_lines, document_lines, object_listing,
)
from fieldlake.functions.rules import classify_lines
from fieldlake.operators import consolidate as cs
from fieldlake.operators import positions
from fieldlake.session import stage


@query("previous_nondata_line", f"WITH {CL} SELECT object_key, pos, previous_nondata FROM prev")
def previous_nondata_line(spark, sf):
    return positions.previous_nondata_line(conversation_lines(spark, sf)).select("object_key", "pos", "previous_nondata")


@query(
    "recover_header",
    f"""WITH {CL} SELECT instrument_id, arg_min(previous_nondata, (object_key, pos)) AS header
    FROM prev WHERE is_data AND previous_nondata IS NOT NULL GROUP BY 1""",
)
def recover_header(spark, sf):
    return cs.recover_header(conversation_lines(spark, sf)).select("instrument_id", F.col("line").alias("header"))


@query(
    "collect_preamble",
    f"""WITH {DL}, firsts AS (
      SELECT instrument_id, line, object_key, pos FROM dl WHERE NOT is_data AND trim(line) <> ''
      QUALIFY row_number() OVER (PARTITION BY instrument_id, line ORDER BY object_key, pos) = 1)
    SELECT instrument_id, row_number() OVER (PARTITION BY instrument_id ORDER BY object_key, pos) - 1 AS seq, line FROM firsts""",
)
def collect_preamble(spark, sf):
    # Staged, because numbering reads the distinct lines twice.
    other = cs.distinct_lines(classified_documents(spark, sf).filter(~F.col("is_data")))
    return cs.number_preamble(stage(other, "preamble-lines"))


@query("dedup_keep_first", f"WITH {DD} SELECT instrument_id, object_key, pos, line, copies FROM dd")
def dedup_keep_first(spark, sf):
    # Classifying after the aggregate tests each distinct line once.
    distinct = classify_lines(cs.distinct_lines(document_lines(spark, sf)), DOCUMENT_RULES)
    return distinct.filter("is_data").select("instrument_id", "object_key", "pos", "line", "copies")


@query(
    "first_occurrence",
    f"""WITH {DL} SELECT object_key, pos,
      row_number() OVER (PARTITION BY instrument_id, line ORDER BY object_key, pos) = 1 AS is_first FROM dl WHERE is_data""",
)
def first_occurrence(spark, sf):
    return cs.first_occurrence(classified_documents(spark, sf)).select("object_key", "pos", "is_first")


@query(
    "assign_source_index",
    f"""WITH {DD} SELECT instrument_id, object_key, pos,
      row_number() OVER (PARTITION BY instrument_id ORDER BY object_key, pos) - 1 AS source_index FROM dd""",
)
def assign_source_index(spark, sf):
    distinct = stage(cs.dedup_keep_first(classified_documents(spark, sf)).drop("line", "copies"), "keep-first")
    return positions.assign_source_index(distinct).select("instrument_id", "object_key", "pos", "source_index")


@query("silver_stats", f"WITH {STATS} SELECT * FROM st")
def silver_stats(spark, sf):
    return cs.silver_stats(dedup_keep_first(spark, sf), object_listing(spark, sf))


@query(
    "count_data_rows",
    f"WITH {DL} SELECT instrument_id, object_key, count(*) FILTER (is_data) AS data_rows FROM dl GROUP BY 1, 2",
)
def count_data_rows(spark, sf):
    return cs.count_data_rows(classified_documents(spark, sf))


@query("bronze_rows", f"WITH {DL} SELECT instrument_id, count(*) FILTER (is_data) AS bronze_rows FROM dl GROUP BY 1")
def bronze_rows(spark, sf):
    return cs.bronze_rows(classified_documents(spark, sf))


@query("ordered_listing", f"WITH {OBJ} SELECT * FROM obj ORDER BY instrument_id, object_key")
def ordered_listing(spark, sf):
    return cs.ordered_listing(object_listing(spark, sf))


@query(
    "union_bronze",
    f"""WITH {DL}, p AS (SELECT 'page' AS instrument_id, page_id AS object_key, html AS line FROM pages)
    SELECT instrument_id, object_key, pos, line FROM dl
    UNION ALL SELECT instrument_id, object_key, 0, line FROM p""",
)
def union_bronze(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select(
        F.lit("page").alias("instrument_id"), F.col("page_id").alias("object_key"),
        F.lit(0).cast("bigint").alias("pos"), F.col("html").alias("line"),
    )
    return cs.union_bronze(document_lines(spark, sf), pages)
