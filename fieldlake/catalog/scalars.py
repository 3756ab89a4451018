"""Row-level functions: text, numbers, timestamps, display."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlake.catalog.registry import query
from fieldlake.catalog.standins import (
    DL, EV, EVENT_HEADER, classified_documents, document_lines, event_lines, table,
)
from fieldlake.functions import display as dp
from fieldlake.functions import text as tx
from fieldlake.functions import times as tm
from fieldlake.functions.rules import InstrumentRule, RuleSet

_FIELDS = EV + """,
f AS (
  SELECT event_id, (i - 1)::INT AS idx, string_split(line, ',')[i] AS value
  FROM (SELECT event_id, line, unnest(range(1, len(string_split(line, ',')) + 1)) AS i FROM ev)
)"""


def _event_fields(spark, sf):
    lines = event_lines(spark, sf)
    return lines.select(F.col("pos").alias("event_id"), F.posexplode(tx.split_fields(F.col("line"))).alias("idx", "value"))


@query(
    "clean_field",
    f"WITH {DL} SELECT object_key, pos, trim(trim(trim(line), '\"')) AS cleaned FROM dl",
)
def clean_field(spark, sf):
    wrapped = F.concat(F.lit(tx.BYTE_ORDER_MARK + '"'), F.col("line"), F.lit('" \t'))
    return document_lines(spark, sf).select("object_key", "pos", tx.clean_field(wrapped).alias("cleaned"))


@query(
    "split_fields",
    f"""WITH {DL},
    g AS (SELECT object_key, pos, line, unnest(range(1, len(string_split(line, ',')) + 1)) AS i FROM dl WHERE line <> '')
    SELECT object_key, pos, (i - 1)::INT AS idx, trim(trim(trim(string_split(line, ',')[i]), '"')) AS value FROM g""",
)
def split_fields(spark, sf):
    return document_lines(spark, sf).select(
        "object_key", "pos", F.posexplode(tx.split_fields(F.col("line"))).alias("idx", "value")
    )


@query(
    "is_blank_or_comment",
    f"WITH {EV} SELECT event_id, event_id % 4 <> 3 AS skipped FROM ev",
)
def is_blank_or_comment(spark, sf):
    kind = F.col("pos") % 4
    text = F.when(kind == 0, F.concat(F.lit("% "), "line")).when(kind == 1, F.concat(F.lit(" #"), "line")).when(
        kind == 2, F.lit(" \t")
    ).otherwise(F.col("line"))
    return event_lines(spark, sf).select(F.col("pos").alias("event_id"), tx.is_blank_or_comment(text).alias("skipped"))


@query("classify_lines", f"WITH {DL} SELECT object_key, pos, is_data FROM dl")
def classify(spark, sf):
    return classified_documents(spark, sf).select("object_key", "pos", "is_data")


@query("is_digits", f"WITH {_FIELDS} SELECT event_id, idx, regexp_full_match(value, '[0-9]+') AS digits FROM f")
def is_digits(spark, sf):
    return _event_fields(spark, sf).select("event_id", "idx", tx.is_digits(F.col("value")).alias("digits"))


@query(
    "is_float",
    f"WITH {_FIELDS} SELECT event_id, idx, try_cast(value AS DOUBLE) IS NOT NULL AS number FROM f",
)
def is_float(spark, sf):
    return _event_fields(spark, sf).select("event_id", "idx", tx.is_float(F.col("value")).alias("number"))


def _events_with_header(spark, sf):
    """Event lines next to their header, with parsed columns and fields."""
    rules = RuleSet([], default=InstrumentRule("*", 1, timestamp_columns=("timestamp",)))
    return (
        event_lines(spark, sf)
        .withColumn("columns", tx.split_fields(F.lit(EVENT_HEADER)))
        .withColumn("at", rules.timestamp_positions(F.col("instrument_id"), F.col("columns")))
        .withColumn("fields", tx.split_fields(F.col("line")))
    )


@query("record_timestamp", f'WITH {EV} SELECT event_id, ts_text AS "timestamp" FROM ev')
def record_timestamp(spark, sf):
    from fieldlake.functions.rules import record_timestamp as stamp

    rows = _events_with_header(spark, sf)
    return rows.select(F.col("pos").alias("event_id"), stamp(F.col("at"), F.col("fields")).alias("timestamp"))


@query("column_lookup", f"WITH {EV} SELECT event_id, printf('%.2f', value) AS value, 3 AS position FROM ev")
def column_lookup(spark, sf):
    rows = _events_with_header(spark, sf).withColumn("position", tx.column_position(F.col("columns"), "none", "VALUE"))
    return rows.select(
        F.col("pos").alias("event_id"), F.get(F.col("fields"), F.col("position")).alias("value"), "position"
    )


@query(
    "values_map",
    f"""WITH {_FIELDS}
    SELECT event_id, ['Event_ID', 'Timestamp', 'User', 'Value', 'column_5'][idx + 1] AS name, value FROM f""",
)
def values_map(spark, sf):
    rows = _events_with_header(spark, sf)
    return rows.select(
        F.col("pos").alias("event_id"), F.explode(tx.values_map(F.col("columns"), F.col("fields"))).alias("name", "value")
    )


@query(
    "parse_datetime",
    """
    SELECT event_id, coalesce(
        try_strptime(v, '%Y-%m-%dT%H:%M:%S.%f'), try_strptime(v, '%Y/%m/%d %H:%M:%S'),
        try_strptime(v, '%d/%m/%Y %H:%M:%S'), try_strptime(v, '%m/%d/%Y %H:%M:%S'), try_strptime(v, '%m/%d/%Y %H:%M')
      ) AS parsed
    FROM (SELECT event_id, CASE event_id % 5
        WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') WHEN 1 THEN strftime(ts, '%Y/%m/%d %H:%M:%S')
        WHEN 2 THEN strftime(ts, '%-m/%-d/%Y %H:%M:%S') WHEN 3 THEN strftime(ts, '%-m/%-d/%Y %H:%M')
        ELSE 'at ' || strftime(ts, '%Y') END AS v FROM events)
    """,
)
def parse_datetime(spark, sf):
    kind = F.col("event_id") % 5
    text = (
        F.when(kind == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        .when(kind == 1, F.date_format("ts", "yyyy/MM/dd HH:mm:ss"))
        .when(kind == 2, F.date_format("ts", "M/d/yyyy HH:mm:ss"))
        .when(kind == 3, F.date_format("ts", "M/d/yyyy HH:mm"))
        .otherwise(F.concat(F.lit("at "), F.date_format("ts", "yyyy")))
    )
    rows = table(spark, sf, "events").select("event_id", text.alias("v"))
    return tm.with_times(rows, "v", wall="parsed").select("event_id", "parsed")


@query(
    "datetime_for_compare",
    """
    SELECT event_id, CASE event_id % 3 WHEN 0 THEN ts WHEN 1 THEN ts + INTERVAL 7 HOUR
           ELSE ts - INTERVAL 330 MINUTE END AS compared
    FROM events
    """,
)
def datetime_for_compare(spark, sf):
    zone = F.element_at(F.array(F.lit(""), F.lit("-07:00"), F.lit("+05:30")), (F.col("event_id") % 3 + 1).cast("int"))
    rows = table(spark, sf, "events").select(
        "event_id", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), zone).alias("v")
    )
    return tm.with_times(rows, "v", compare="compared").select("event_id", "compared")


@query(
    "iso_format",
    """
    SELECT event_id, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
           ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '-07:00' END AS iso
    FROM events
    """,
)
def iso_format(spark, sf):
    text = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy/MM/dd HH:mm:ss")).otherwise(
        F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("-0700"))
    )
    rows = table(spark, sf, "events").select("event_id", text.alias("v"))
    return tm.with_times(rows, "v", iso="iso").select("event_id", "iso")


@query("row_key", f"WITH {EV} SELECT event_id, sha256(instrument_id || '|' || ts_text || '|' || line)[1:32] AS row_key FROM ev")
def row_key(spark, sf):
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return event_lines(spark, sf).select(
        F.col("pos").alias("event_id"), tx.row_key(F.col("instrument_id"), stamp, F.col("line")).alias("row_key")
    )


@query(
    "valid_instrument",
    "SELECT event_id, event_type IN ('click', 'purchase', 'view') AS valid FROM events",
)
def valid_instrument(spark, sf):
    rules = RuleSet([InstrumentRule(i, 1) for i in ("click", "purchase", "view")])
    return table(spark, sf, "events").select("event_id", rules.valid_instrument(F.col("event_type")).alias("valid"))


@query(
    "sanitize_stem",
    r"""
    SELECT page_id, regexp_replace(regexp_replace(name, '^(\.*[^.].*)\.[^.]*$', '\1'), '[^A-Za-z0-9._-]+', '_', 'g') AS stem
    FROM (SELECT page_id, string_split(url, '/')[-1] || '.v' || page_id || '.txt' AS name FROM pages)
    """,
)
def sanitize_stem(spark, sf):
    base = F.element_at(F.split("url", "/"), -1)
    name = F.concat(base, F.lit(".v"), F.col("page_id").cast("string"), F.lit(".txt"))
    return table(spark, sf, "pages").select("page_id", tx.sanitize_stem(name).alias("stem"))


@query(
    "partition_columns",
    "SELECT o_orderkey, strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%m') AS month FROM orders",
)
def partition_columns(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", *tm.partition_columns(F.col("o_orderdate")))


@query("display_name", "SELECT o_orderkey, replace(o_orderpriority, '-', ' ') AS name FROM orders")
def display_name(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", dp.display_name(F.col("o_orderpriority")).alias("name"))


@query(
    "format_bytes",
    """
    WITH s AS (SELECT doc_id, CASE WHEN doc_id % 7 = 6 THEN 0 ELSE n_chars * [1, 37, 1024, 99991, 1048576, 6700417903][doc_id % 7 + 1] END::BIGINT AS size FROM documents),
    u AS (SELECT doc_id, size, CASE WHEN size >= 1099511627776 THEN 4 WHEN size >= 1073741824 THEN 3
                 WHEN size >= 1048576 THEN 2 WHEN size >= 1024 THEN 1 ELSE 0 END AS p FROM s),
    t AS (SELECT doc_id, size, p, ((size::HUGEINT * 20 + (1024 ** p)::HUGEINT) // (2 * (1024 ** p)::HUGEINT))::BIGINT AS tenths FROM u)
    SELECT doc_id, CASE WHEN size <= 0 THEN '0 B' ELSE (tenths // 10)::VARCHAR
           || CASE WHEN tenths % 10 > 0 THEN '.' || (tenths % 10)::VARCHAR ELSE '' END
           || ' ' || ['B', 'KB', 'MB', 'GB', 'TB'][p + 1] END AS size_text FROM t
    """,
)
def format_bytes(spark, sf):
    factors = F.array(*[F.lit(f).cast("bigint") for f in (1, 37, 1024, 99991, 1048576, 6700417903)])
    slot = (F.col("doc_id") % 7).cast("int")
    size = F.when(slot == 6, F.lit(0).cast("bigint")).otherwise(F.col("n_chars") * F.get(factors, slot))
    return table(spark, sf, "documents").select("doc_id", dp.format_bytes(size).alias("size_text"))


@query(
    "format_local_time",
    """
    SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'NO DATA'
           ELSE strftime(ts - INTERVAL 8 HOUR, '%b %-d, %I:%M:%S %p') END AS shown FROM events
    """,
)
def format_local_time(spark, sf):
    seen = F.when(F.col("event_id") % 50 != 0, F.col("ts"))
    return table(spark, sf, "events").select("event_id", tm.format_local_time(seen).alias("shown"))


@query(
    "select_first_n_columns",
    f"""WITH {_FIELDS} SELECT event_id, ['Event_ID', 'Timestamp', 'User', 'Value'][idx + 1] AS name, value
    FROM f WHERE idx < 3""",
)
def select_first_n_columns(spark, sf):
    rows = _events_with_header(spark, sf)
    sample = dp.sample_values(F.col("columns"), tx.values_map(F.col("columns"), F.col("fields")), 3)
    return rows.select(F.col("pos").alias("event_id"), F.explode(sample).alias("name", "value"))


@query(
    "changed_values",
    """
    SELECT event_id, 'value' AS name, printf('%.2f', value + 1) AS value FROM events WHERE event_id % 3 = 0
    UNION ALL SELECT event_id, 'note', 'new' FROM events
    """,
)
def changed_values(spark, sf):
    old, user = F.format_string("%.2f", F.col("value")), F.col("user_id").cast("string")
    new = F.when(F.col("event_id") % 3 == 0, F.format_string("%.2f", F.col("value") + 1)).otherwise(old)
    original = F.create_map(F.lit("value"), old, F.lit("user"), user)
    corrected = F.create_map(F.lit("value"), new, F.lit("user"), user, F.lit("note"), F.lit("new"))
    return table(spark, sf, "events").select("event_id", F.explode(dp.changed_values(corrected, original)).alias("name", "value"))


@query(
    "nonblank_line_count",
    """
    SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))::BIGINT AS lines FROM documents
    """,
)
def nonblank_line_count(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.nonblank_line_count(F.col("text")).alias("lines"))


@query(
    "time_range_filter",
    """
    SELECT event_id, event_type, ts FROM events
    WHERE ts >= TIMESTAMP '2024-01-08 06:00:00' AND ts <= TIMESTAMP '2024-01-20 18:30:00'
    """,
)
def time_range_filter(spark, sf):
    from fieldlake.operators.paging import time_range_filter as keep

    kept = keep(table(spark, sf, "events"), "2024-01-08 06:00:00", "2024-01-20 18:30:00")
    return kept.select("event_id", "event_type", "ts")


