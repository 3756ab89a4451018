"""The given tables in the roles of instrument data.

``events`` play five instruments with one object per day and a data line per
event, ``documents`` twenty instruments whose objects are multi-line texts,
``conversations`` objects with preamble lines (system turns) between data lines.
Each stand-in has a SQL twin used as a common table expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlake.functions import text as tx
from fieldlake.functions.rules import InstrumentRule, RuleSet, classify_lines
from fieldlake.functions.times import iso_text
from fieldlake.sources.reviews import with_item_columns

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
EVENT_HEADER = "Event_ID,Timestamp,User,Value"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_line() -> Column:
    return F.concat_ws(
        ",",
        F.col("event_id").cast("string"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
        F.col("user_id").cast("string"),
        F.format_string("%.2f", F.col("value")),
        F.col("props"),
    )


# A data line of an event log: five fields, a number, a time, a number, a float.
EVENT_RULES = RuleSet(
    [],
    default=InstrumentRule(
        "*",
        min_fields=5,
        patterns={0: r"^[0-9]+$", 1: r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", 2: r"^[0-9]+$"},
        floats=(3,),
        timestamp_columns=("Timestamp",),
    ),
)
# A data line of a text: at least two comma-separated pieces, a capital first.
DOCUMENT_RULES = RuleSet([], default=InstrumentRule("*", min_fields=2, patterns={0: "^[A-Z]"}))


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("instrument_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("object_key"),
        F.col("event_id").alias("pos"),
        event_line().alias("line"),
        "ts",
        "value",
        "user_id",
    )


EV = """
ev AS (
  SELECT event_type AS instrument_id, strftime(ts, '%Y-%m-%d') AS object_key, event_id AS pos,
         concat_ws(',', event_id::VARCHAR, strftime(ts, '%Y-%m-%d %H:%M:%S'), user_id::VARCHAR,
                   printf('%.2f', value), props) AS line,
         strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_text, ts, value, user_id, props, event_id
  FROM events
)"""


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event lines with a header line in front of every object."""
    lines = event_lines(spark, sf_dir).select("instrument_id", "object_key", "pos", "line")
    headers = lines.select("instrument_id", "object_key").distinct()
    return lines.unionByName(
        headers.select("instrument_id", "object_key", F.lit(-1).cast("bigint").alias("pos"), F.lit(EVENT_HEADER).alias("line"))
    )


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the event log as a browse sees them."""
    lines = event_lines(spark, sf_dir)
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return lines.select(
        "instrument_id", "object_key", "pos",
        tx.row_key(F.col("instrument_id"), stamp, F.col("line")).alias("row_key"),
        stamp.alias("timestamp"),
        F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"),
        F.col("line").alias("raw"),
        "value",
        "user_id",
    )


ROWS = EV + """,
rows_ AS (
  SELECT instrument_id, object_key, pos, sha256(instrument_id || '|' || ts_text || '|' || line)[1:32] AS row_key,
         ts_text AS "timestamp", date_trunc('second', ts) AS ts, line AS raw, value, user_id,
         row_number() OVER (PARTITION BY instrument_id ORDER BY object_key, pos) - 1 AS source_index
  FROM ev
)"""


def review_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review items derived from the event records.

    Every spike (value of 150 or more) opens a range flag of ten minutes; every
    day of an instrument has a key flag that lists its values of 100 or more;
    every value below 0.05 gets a correction.  Every fifth range is inactive.
    """
    rows = event_rows(spark, sf_dir)
    at = iso_text(F.col("ts"))
    number = F.col("pos").cast("string")
    spikes = rows.filter("value >= 150").select(
        F.concat_ws("/", "instrument_id", F.lit("flags/range"), number).alias("_s3_key"),
        F.concat(F.lit("range_"), number).alias("id"),
        F.lit("flag").alias("type"),
        "instrument_id",
        F.when(F.col("pos") % 5 == 0, "inactive").when(F.col("pos") % 5 == 1, "active").alias("status"),
        F.lit("time_range").alias("scope"),
        F.concat(at, F.lit("Z")).alias("start_time"),
        iso_text(F.col("ts") + F.expr("INTERVAL 10 MINUTES")).alias("end_time"),
        at.alias("created_at"),
    )
    keyed = rows.filter("value >= 100").groupBy("instrument_id", "object_key").agg(
        F.sort_array(F.collect_list("row_key")).alias("row_keys")
    )
    keyed = keyed.select(
        F.concat_ws("/", "instrument_id", F.lit("flags/key"), "object_key").alias("_s3_key"),
        F.concat_ws("_", F.lit("key"), "instrument_id", "object_key").alias("id"),
        F.lit("flag").alias("type"),
        "instrument_id",
        F.lit("active").alias("status"),
        F.lit("selected_rows").alias("scope"),
        "row_keys",
        F.concat("object_key", F.lit("T00:00:00")).alias("created_at"),
    )
    fixes = rows.filter("value < 0.05").select(
        F.concat_ws("/", "instrument_id", F.lit("corrections"), number).alias("_s3_key"),
        F.concat(F.lit("fix_"), number).alias("id"),
        F.lit("correction").alias("type"),
        "instrument_id",
        F.lit("active").alias("status"),
        F.lit("selected_rows").alias("scope"),
        "row_key",
        "timestamp",
        F.create_map(F.lit("Value"), F.format_string("%.2f", F.col("value"))).alias("original_values"),
        F.create_map(F.lit("Value"), F.lit("0.05")).alias("corrected_values"),
        at.alias("created_at"),
    )
    parts = [with_item_columns(part) for part in (spikes, keyed, fixes)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


ITEMS = ROWS + """,
ranges_ AS (
  SELECT instrument_id, instrument_id || '/flags/range/' || pos AS item_key, 'range_' || pos AS id, 'flag' AS type,
         CASE pos % 5 WHEN 0 THEN 'inactive' WHEN 1 THEN 'active' END AS status, ts AS t0, ts + INTERVAL 10 MINUTE AS t1
  FROM rows_ WHERE value >= 150
),
keys_ AS (
  SELECT instrument_id, instrument_id || '/flags/key/' || object_key AS item_key,
         'key_' || instrument_id || '_' || object_key AS id, 'flag' AS type, row_key
  FROM rows_ WHERE value >= 100
),
fixes_ AS (
  SELECT instrument_id, instrument_id || '/corrections/' || pos AS item_key, 'fix_' || pos AS id,
         'correction' AS type, row_key
  FROM rows_ WHERE value < 0.05
),
pairs_ AS (
  SELECT r.instrument_id, r.row_key, k.item_key, k.type FROM rows_ r
    JOIN (SELECT * FROM keys_ UNION ALL SELECT * FROM fixes_) k USING (instrument_id, row_key)
  UNION
  SELECT r.instrument_id, r.row_key, g.item_key, g.type FROM rows_ r
    JOIN ranges_ g ON r.instrument_id = g.instrument_id AND r.ts BETWEEN g.t0 AND g.t1
  WHERE coalesce(g.status, 'active') = 'active'
)"""


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select(
        F.col("source").alias("instrument_id"),
        F.col("doc_id").alias("object_key"),
        F.posexplode(tx.split_lines(F.col("text"))).alias("pos", "line"),
    )
    return lines.withColumn("pos", F.col("pos").cast("bigint"))


def classified_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_lines(document_lines(spark, sf_dir), DOCUMENT_RULES)


DL = """
dl AS (
  SELECT source AS instrument_id, doc_id AS object_key, line, (pos - 1)::BIGINT AS pos,
         trim(line) <> '' AND NOT starts_with(trim(line), '#') AND NOT starts_with(trim(line), '%')
           AND len(string_split(line, ',')) >= 2
           AND regexp_matches(trim(trim(trim(string_split(line, ',')[1]), '"')), '^[A-Z]') AS is_data
  FROM (SELECT source, doc_id, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS pos, len(parts) AS n
        FROM (SELECT source, doc_id, string_split(text, chr(10)) AS parts FROM documents))
  WHERE NOT (pos = n AND line = '')
)"""
# Keep-first data lines of the documents.
DD = DL + """,
dd AS (
  SELECT instrument_id, line, object_key, pos, copies FROM (
    SELECT instrument_id, line, object_key, pos,
           row_number() OVER (PARTITION BY instrument_id, line ORDER BY object_key, pos) AS rn,
           count(*) OVER (PARTITION BY instrument_id, line) AS copies
    FROM dl WHERE is_data) WHERE rn = 1
)"""


def conversation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("room"), (F.col("conv_id") % 7).cast("string")).alias("instrument_id"),
        F.col("conv_id").cast("string").alias("object_key"),
        F.col("turn").alias("pos"),
        F.col("text").alias("line"),
        (F.col("role") != "system").alias("is_data"),
    )


CL = """
cl AS (
  SELECT 'room' || (conv_id % 7) AS instrument_id, conv_id::VARCHAR AS object_key, turn AS pos, text AS line,
         role <> 'system' AS is_data
  FROM conversations
),
prev AS (
  SELECT *, last_value(CASE WHEN NOT is_data AND trim(line) <> '' THEN line END IGNORE NULLS) OVER (
              PARTITION BY instrument_id, object_key ORDER BY pos
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_nondata
  FROM cl
)"""


def object_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as listed objects; the event of the same number gives the time."""
    documents = table(spark, sf_dir, "documents").select(
        F.col("source").alias("instrument_id"), F.col("doc_id").alias("object_key"), F.col("n_chars").alias("size")
    )
    times = table(spark, sf_dir, "events").select(F.col("event_id").alias("object_key"), F.col("ts").alias("modified_at"))
    return documents.join(times, "object_key", "left").select("instrument_id", "object_key", "size", "modified_at")


def source_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty sources and one instrument without data, in number order."""
    numbers = table(spark, sf_dir, "documents").select(F.regexp_extract("source", "[0-9]+", 0).cast("int").alias("ordinal"))
    names = numbers.distinct()
    idle = names.agg((F.max("ordinal") + 1).alias("ordinal"))
    return names.unionByName(idle).select(F.concat(F.lit("src"), F.col("ordinal").cast("string")).alias("instrument_id"), "ordinal")


OBJ = """
obj AS (
  SELECT d.source AS instrument_id, d.doc_id AS object_key, d.n_chars AS size, e.ts AS modified_at
  FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id
),
dim AS (
  SELECT 'src' || n AS instrument_id, n AS ordinal
  FROM (SELECT DISTINCT regexp_extract(source, '[0-9]+')::INT AS n FROM documents
        UNION ALL SELECT max(regexp_extract(source, '[0-9]+')::INT) + 1 FROM documents)
)"""
STATS = DD + "," + OBJ + """,
st AS (
  SELECT instrument_id, o.n AS bronze_objects, coalesce(c.total, 0)::BIGINT AS data_rows_total,
         coalesce(c.n, 0) AS data_rows_unique, (coalesce(c.total, 0) - coalesce(c.n, 0))::BIGINT AS duplicates_removed
  FROM (SELECT instrument_id, count(*) AS n FROM obj GROUP BY 1) o
  LEFT JOIN (SELECT instrument_id, sum(copies) AS total, count(*) AS n FROM dd GROUP BY 1) c USING (instrument_id)
)"""
STOCK = DD + "," + OBJ + """,
stock AS (
  SELECT dim.instrument_id AS id, replace(dim.instrument_id, '-', ' ') AS name,
         coalesce(o.bronze_size, 0)::BIGINT AS bronze_size, coalesce(r.bronze_rows, 0)::BIGINT AS bronze_rows,
         s.silver_rows, o.last_update, dim.ordinal
  FROM dim
  LEFT JOIN (SELECT instrument_id, sum(size) AS bronze_size, max(modified_at) AS last_update FROM obj GROUP BY 1) o
    USING (instrument_id)
  LEFT JOIN (SELECT instrument_id, count(*) FILTER (is_data) AS bronze_rows FROM dl GROUP BY 1) r USING (instrument_id)
  LEFT JOIN (SELECT instrument_id, count(*) AS silver_rows FROM dd GROUP BY 1) s USING (instrument_id)
)"""
