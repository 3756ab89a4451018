"""Landing growing files in Bronze, one streaming query per instrument."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldlake.functions.rules import RuleSet, classify_lines
from fieldlake.operators import offsets, totals
from fieldlake.sources import bronze
from fieldlake.sources.files import expand_lines
from fieldlake.sources.status import STATUS_SCHEMA
from fieldlake.sources.tail import SPLIT_BYTES, tail_growing_files
from fieldlake.sources.versions import hadoop_files

BATCH_BYTES = 64 * 1024**3
"""Bytes of new lines that a batch takes: what one instrument may land before its offsets are saved again."""


def checkpoint_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gave a checkpoint folder: equal after each restart, another one in a new folder."""
    return spark.read.schema("id string").json(f"{checkpoint}/metadata").first().id


def planned_offsets(spark: SparkSession, checkpoint: str) -> dict | None:
    """The entry per file that the last batch planned in this checkpoint folder reaches; None without one."""
    files, folder = hadoop_files(spark, f"{checkpoint}/offsets/[0-9]*")
    numbers = sorted(int(s.getPath().getName()) for s in files.globStatus(folder) or [])
    if not numbers:
        return None
    rows = spark.read.text(f"{checkpoint}/offsets/{numbers[-1]}", wholetext=True).first()
    return json.loads(rows.value.strip().split("\n")[-1])["files"]


def landed_offsets(spark: SparkSession, lake: str, instrument_id: str, saved: DataFrame | None = None) -> dict[str, int]:
    """Where a stream whose checkpoint is lost goes on: what the ledger has, merged with ``saved`` offsets.

    Only the ledger is read: a row per landed byte range, no line of Bronze.
    """
    reached = bronze.file_offsets(bronze.read_ledger(spark, f"{lake}/ledger"))
    if saved is not None:
        reached = offsets.checkpoint_merge(reached, saved)
    return {r.file: r.offset for r in reached.filter(F.col("instrument_id") == instrument_id).collect()}


def _land(rules: RuleSet, lake: str, instrument_id: str, checkpoint: str):
    """Batch writer: lines first, then their statistics from the landed files, then the ledger.

    All writes replace what the same batch of the same checkpoint wrote before, so a
    batch that is run again after a failure leaves one copy, and a new checkpoint
    leaves what an old one landed.
    """
    run: list[str] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if not run:
            run.append(checkpoint_id(spark, checkpoint))
        run_id = run[0]
        bronze.write_bronze(bronze.with_object_key(batch, run_id, batch_id), f"{lake}/bronze", run_id, batch_id)
        landed = bronze.read_bronze(spark, f"{lake}/bronze").filter(
            (F.col("instrument_id") == instrument_id) & (F.col("run_id") == run_id) & (F.col("batch_id") == batch_id)
        )
        stats = bronze.bronze_stats(classify_lines(expand_lines(landed), rules), run_id, batch_id)
        bronze.write_bronze_stats(stats, f"{lake}/bronze_stats")
        bronze.write_ledger(bronze.landed_ranges(landed), f"{lake}/ledger")

    return write


def ingest_stream(
    spark: SparkSession,
    instrument_id: str,
    patterns: list[str],
    lake: str,
    checkpoints: str,
    rules: RuleSet,
    interval: str | None = None,
    split_bytes: int = SPLIT_BYTES,
    saved_offsets: DataFrame | None = None,
    max_bytes: int = BATCH_BYTES,
) -> StreamingQuery:
    """Start landing one instrument, at most about ``max_bytes`` in a batch.

    Without ``interval`` the query takes one batch and ends; with one (``"15 minutes"``)
    it keeps running.  Offsets live in the query's checkpoint; if that is lost, batches
    that did not end are removed and the stream goes on from the ledger, merged with
    ``saved_offsets`` (``instrument_id, file, offset``).
    """
    checkpoint = f"{checkpoints}/ingest/{instrument_id}"
    start = planned_offsets(spark, checkpoint)
    if start is None:
        bronze.remove_half_landed(spark, f"{lake}/bronze", bronze.read_ledger(spark, f"{lake}/ledger"), instrument_id)
        start = landed_offsets(spark, lake, instrument_id, saved_offsets)
    tailed = tail_growing_files(spark, patterns, split_bytes, start, max_bytes)
    rows = bronze.bronze_rows_from_tail(tailed, instrument_id)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return (
        rows.writeStream.queryName(f"ingest-{instrument_id}")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(_land(rules, lake, instrument_id, checkpoint))
        .trigger(**trigger)
        .start()
    )


def ingest_pass(
    spark: SparkSession,
    instruments: DataFrame,
    lake: str,
    checkpoints: str,
    rules: RuleSet,
    split_bytes: int = SPLIT_BYTES,
    max_bytes: int = BATCH_BYTES,
) -> DataFrame:
    """One incremental pass over all active instruments; returns the run status.

    A pass goes on in rounds of one batch per instrument until nothing is left, so a
    backlog takes several batches of ``max_bytes``.  Instruments run side by side and
    fail alone.  The loops are over the configuration and over batches, never over data.
    """
    active = totals.active_filter(instruments).orderBy("ordinal")
    checked = active.join(totals.instrument_run_status(active), "instrument_id").orderBy("ordinal").collect()
    results = {e.instrument_id: (totals.ERROR, 0, e.error) for e in checked if e.instrument_status != totals.OK}
    going = [e for e in checked if e.instrument_id not in results]
    batches = {e.instrument_id: 0 for e in going}
    while going:
        started, more = [], []
        for entry in going:
            name = entry.instrument_id
            try:
                query = ingest_stream(
                    spark, name, list(entry.globs), lake, checkpoints, rules, split_bytes=split_bytes, max_bytes=max_bytes
                )
                started.append((entry, query))
            except Exception as error:  # one instrument's failure must not stop the others
                results[name] = (totals.ERROR, batches[name], str(error))
        for entry, query in started:
            name = entry.instrument_id
            try:
                query.awaitTermination()
                error = None
            except Exception as failure:
                error = str(failure)
            landed = _landed_batches(query)
            batches[name] += landed
            results[name] = (totals.OK if error is None else totals.ERROR, batches[name], error)
            if error is None and landed:
                more.append(entry)
        going = more
    reached = bronze.file_offsets(bronze.read_ledger(spark, f"{lake}/ledger"))
    files = reached.groupBy("instrument_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("file", "offset")))).alias("files"))
    return status_rows(spark, [(e.instrument_id, *results[e.instrument_id]) for e in checked], files)


def _landed_batches(query: StreamingQuery) -> int:
    return sum(1 for progress in query.recentProgress if progress["numInputRows"] > 0)


def status_rows(spark: SparkSession, results: list[tuple], files: DataFrame | None = None) -> DataFrame:
    """Run status from ``(instrument, status, batches, error)`` per instrument; ``files`` has the offset of each of its files."""
    rows = spark.createDataFrame(
        results, "instrument_id string, instrument_status string, batches_written bigint, error string"
    )
    now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S")
    overall = totals.OK if all(result[1] == totals.OK for result in results) else totals.RUN_DEGRADED
    columns = [part.split()[0] for part in STATUS_SCHEMA.replace("map<string,bigint>", "map").split(", ")]
    known = rows.withColumn("files", F.lit(None).cast("map<string,bigint>")) if files is None else rows.join(files, "instrument_id", "left")
    return known.withColumns({"last_run": F.lit(now), "status": F.lit(overall)}).select(*columns)


def stream_status(spark: SparkSession, lake: str) -> DataFrame:
    """One row per batch that ever ended: ``instrument_id, run_id, batch_id, input_rows, input_bytes, files, landed_at``.

    Read from the ledger, which keeps every batch; a running query only remembers its latest.
    """
    return bronze.read_ledger(spark, f"{lake}/ledger").groupBy("instrument_id", "run_id", "batch_id").agg(
        F.sum("lines").alias("input_rows"),
        F.sum(F.col("range_end") - F.col("range_start")).alias("input_bytes"),
        F.count_distinct("source_file").alias("files"),
        F.max("ingest_ts").alias("landed_at"),
    )
