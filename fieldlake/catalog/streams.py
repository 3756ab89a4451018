"""Streaming jobs run to completion over files derived from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlake.catalog.registry import query
from fieldlake.catalog.review import SUBMITTED, accepted_items
from fieldlake.catalog.standins import EV, EVENT_RULES, event_lines
from fieldlake.catalog.storage import once, raw_files
from fieldlake.session import scratch_path, stage
from fieldlake.sources import bronze, reviews
from fieldlake.sources.tail import tail_growing_files
from fieldlake.streaming import ingest, silver

CONFIG = "instrument_id string, ordinal int, ingestion_type string, globs array<string>, active boolean"


@query("tail_growing_files", f"WITH {EV} SELECT instrument_id, line FROM ev")
def tail_files(spark, sf):
    root = raw_files(spark, sf)

    def run(path):
        tailed = tail_growing_files(spark, f"{root}/*/*/*/*.txt", split_bytes=64 * 1024)
        query_ = (
            tailed.writeStream.format("parquet")
            .option("path", path)
            .option("checkpointLocation", scratch_path(spark, "tail-checkpoint"))
            .trigger(availableNow=True)
            .start()
        )
        query_.awaitTermination()

    path = once(spark, sf, "tailed", run)
    return spark.read.parquet(path).select(F.regexp_extract("path", "instrument_id=([^/]+)", 1).alias("instrument_id"), "line")


def landed_lake(spark, sf) -> str:
    """The raw event files landed by one ingest pass, then run again."""
    root = raw_files(spark, sf)

    def run(path):
        types = sorted(r.instrument_id for r in event_lines(spark, sf).select("instrument_id").distinct().collect())
        entries = [(t, i, "growing_file", [f"{root}/instrument_id={t}/*/*/*.txt"], None) for i, t in enumerate(types)]
        entries += [("feed", len(types), "api", [], True), ("spare", len(types) + 1, "growing_file", [], False)]
        instruments = spark.createDataFrame(entries, CONFIG)
        for name in ("first", "second"):
            done = ingest.ingest_pass(spark, instruments, path, f"{path}/checkpoints", EVENT_RULES)
            done.write.mode("overwrite").parquet(f"{path}/passes/{name}")

    return once(spark, sf, "landed", run)


@query("ingest_stream", f"WITH {EV} SELECT instrument_id, line FROM ev")
def ingest_stream(spark, sf):
    return bronze.read_bronze(spark, f"{landed_lake(spark, sf)}/bronze").select("instrument_id", "line")


@query(
    "run_status_of_passes",
    """SELECT 'first' AS pass, event_type AS instrument_id, 'ok' AS instrument_status, 1::BIGINT AS batches_written, count(DISTINCT ts::DATE) > 0 AS has_offsets
      FROM events GROUP BY 2
    UNION ALL SELECT 'second', event_type, 'ok', 0, true FROM events GROUP BY 2
    UNION ALL SELECT p, 'feed', 'error', 0, false FROM (VALUES ('first'), ('second')) t(p)""",
)
def run_status_of_passes(spark, sf):
    lake = landed_lake(spark, sf)
    passes = [spark.read.parquet(f"{lake}/passes/{p}").withColumn("pass", F.lit(p)) for p in ("first", "second")]
    offsets = F.coalesce(F.size("files") > 0, F.lit(False)).alias("has_offsets")
    return passes[0].unionByName(passes[1]).select("pass", "instrument_id", "instrument_status", "batches_written", offsets)


@query(
    "stream_status",
    f"""WITH {EV} SELECT instrument_id, 0::BIGINT AS batch_id, count(*) AS input_rows, sum(octet_length(encode(line)) + 1)::BIGINT AS input_bytes
    FROM ev GROUP BY 1""",
)
def stream_status(spark, sf):
    return ingest.stream_status(spark, landed_lake(spark, sf)).select("instrument_id", "batch_id", "input_rows", "input_bytes")


@query(
    "exactly_once_landing",
    f"WITH {EV} SELECT instrument_id, count(*) AS lines, sum(octet_length(encode(line)) + 1)::BIGINT AS bytes FROM ev GROUP BY 1",
)
def exactly_once_landing(spark, sf):
    lake = landed_lake(spark, sf)
    lines = bronze.read_bronze(spark, f"{lake}/bronze").groupBy("instrument_id").agg(F.count(F.lit(1)).alias("lines"))
    sizes = bronze.read_bronze_stats(spark, f"{lake}/bronze_stats").groupBy("instrument_id").agg(F.sum("size").alias("bytes"))
    return lines.join(sizes, "instrument_id")


@query("landing_after_checkpoint_loss", f"WITH {EV} SELECT instrument_id, line FROM ev")
def landing_after_checkpoint_loss(spark, sf):
    """Land some files, lose the checkpoints, land with new ones after files were added, and replay a batch: each line once."""
    lines = event_lines(spark, sf)
    early = F.coalesce(F.dayofmonth("ts") <= 15, F.lit(False))

    def run(path):
        found = sorted(r.instrument_id for r in lines.select("instrument_id").distinct().collect())
        for name, part in (("first", early), ("second", ~early)):
            added = lines.filter(part).select("instrument_id", "line")
            added.write.mode("append").partitionBy("instrument_id").text(f"{path}/in")
            started = []
            for instrument in found:
                pattern = f"{path}/in/instrument_id={instrument}/*.txt"
                started.append(ingest.ingest_stream(spark, instrument, [pattern], path, f"{path}/checkpoints-{name}", EVENT_RULES))
            for running in started:
                running.awaitTermination()
        landed = bronze.read_bronze(spark, f"{path}/bronze")
        run_id = ingest.checkpoint_id(spark, f"{path}/checkpoints-first/ingest/{found[0]}")
        batch = stage(landed.filter((F.col("run_id") == run_id) & (F.col("batch_id") == 0)), "replayed")
        bronze.write_bronze(batch, f"{path}/bronze", run_id, 0)

    path = once(spark, sf, "landed-again", run)
    return bronze.read_bronze(spark, f"{path}/bronze").select("instrument_id", "line")


@query("streaming_silver", f"WITH {EV} SELECT instrument_id, line FROM ev UNION SELECT instrument_id, line FROM ev")
def streaming_silver(spark, sf):
    """The landed files in one batch, the same lines again in a second one."""
    lake = landed_lake(spark, sf)

    def run(path):
        both = f"{path}/bronze"
        first = bronze.read_bronze(spark, f"{lake}/bronze")
        for batch_id in (100, 200):
            bronze.write_bronze(first.drop("run_id", "batch_id"), both, "copy", batch_id)
            silver.streaming_silver(spark, both, f"{path}/lines", f"{path}/checkpoints", EVENT_RULES).awaitTermination()

    path = once(spark, sf, "streamed-silver", run)
    return silver.read_streamed_lines(spark, f"{path}/lines").select("instrument_id", "line")


@query(
    "write_review_items",
    f"""WITH {SUBMITTED} SELECT id, type, event_type AS instrument_id, strftime(ts, '%Y') AS year, strftime(ts, '%m') AS month
    FROM checked WHERE error IS NULL""",
)
def write_review_items(spark, sf):
    path = once(spark, sf, "accepted", lambda p: reviews.write_review_items(accepted_items(spark, sf), p))
    created = F.col("created_at").cast("timestamp")
    items = reviews.read_review_items(spark, path)
    return items.select("id", "type", "instrument_id", F.date_format(created, "yyyy").alias("year"), F.date_format(created, "MM").alias("month"))


