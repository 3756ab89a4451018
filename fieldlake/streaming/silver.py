"""Silver lines kept current from newly landed Bronze.

A batch appends a folder; ``compact`` merges the folders of earlier batches into
generations.  Layout below the path::

    instrument_id=/content_month=/run_id=/batch_id=/   lines of one batch
    _compacted/generations/<token>/instrument_id=/content_month=/   merged lines, never changed
    _compacted/manifests/<token>/   which generations count, and up to which batch of each run they reach
    _compacted/commits/<number>.json   the manifest that counts; the largest number is current

Readers take the current generations and the batches after them, so that a merge
in progress, or one that failed, changes nothing for them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldlake.functions.rules import RuleSet, classify_lines
from fieldlake.functions.text import line_hash
from fieldlake.functions.times import content_month
from fieldlake.operators.consolidate import GROUP, distinct_lines
from fieldlake.session import scratch_path, side_by_side_writers, stage
from fieldlake.sources import versions
from fieldlake.sources.bronze import BRONZE_SCHEMA
from fieldlake.sources.files import expand_lines
from fieldlake.streaming.ingest import checkpoint_id

LINES_SCHEMA = (
    "line string, line_hash string, object_key string, pos bigint, "
    "instrument_id string, content_month string, run_id string, batch_id bigint"
)
COLUMNS = [part.split()[0] for part in LINES_SCHEMA.split(", ")]
PARTITIONS = ["instrument_id", "content_month", "run_id", "batch_id"]
LABEL = [GROUP, "content_month"]
MANIFEST_SCHEMA = "generation string, lines bigint, run_id string, batch_id bigint"
COMPACTED = "_compacted"
LINES_A_FILE = 5_000_000


def _current(spark: SparkSession, path: str) -> tuple[int, list, dict[str, int]]:
    """Number of the current commit (0: none), its generations, and the last batch of each run in them."""
    root = f"{path}/{COMPACTED}"
    known = versions.commits(spark, root)
    if not known:
        return 0, [], {}
    # A row per generation, about log2 of the merges, and one per checkpoint there ever was.
    rows = spark.read.schema(MANIFEST_SCHEMA).parquet(versions.manifest_path(spark, root, known[-1])).collect()
    return known[-1], [r for r in rows if r.generation is not None], {r.run_id: r.batch_id for r in rows if r.run_id is not None}


def _within(reached: dict[str, int]) -> Column:
    """Is a row's batch one that the generations hold?  On partition columns only."""
    return reduce(lambda a, b: a | b, [(F.col("run_id") == r) & (F.col("batch_id") <= n) for r, n in reached.items()], F.lit(False))


def _batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LINES_SCHEMA).parquet(path)


def _generation(spark: SparkSession, path: str, token: str) -> DataFrame:
    return spark.read.schema(LINES_SCHEMA).parquet(f"{path}/{COMPACTED}/generations/{token}")


def read_streamed_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of the current generations and of the batches after them."""
    _, generations, reached = _current(spark, path)
    parts = [_batches(spark, path).filter(~_within(reached)), *(_generation(spark, path, g.generation) for g in generations)]
    return reduce(DataFrame.unionByName, parts)


def new_lines(batch: DataFrame, rules: RuleSet) -> DataFrame:
    """Distinct data lines of a batch with their look-up key.

    Lines without a date share no month; a digit of their hash divides them instead.
    """
    distinct = classify_lines(distinct_lines(expand_lines(batch)), rules).filter("is_data")
    month, digest = content_month(F.col("line")), line_hash(F.col("line"))
    label = F.when(month == "none", F.concat(F.lit("none-"), F.substring(digest, 1, 1))).otherwise(month)
    return distinct.withColumns({"line_hash": digest, "content_month": label})


def append_batch(batch: DataFrame, run_id: str, batch_id: int, rules: RuleSet, path: str) -> None:
    """Add the lines of a batch that Silver does not hold yet.

    Equal lines carry the same label, because it is read from the line, so a batch
    only has to be compared with the labels it mentions: those are joined to the
    partition columns, and Spark leaves out the other folders at run time.  What
    the same batch of the same run wrote before is left out of the comparison and
    replaced.
    """
    spark = batch.sparkSession
    work = scratch_path(spark, "streamed-batch")
    try:
        lines = stage(new_lines(batch, rules), "lines", f"{work}/lines")
        known = _known_lines(spark, path)
        fresh = lines
        if known is not None:
            known = known.filter((F.col("run_id") != run_id) | (F.col("batch_id") != batch_id))
            labels = stage(lines.select(*LABEL).distinct(), "labels", f"{work}/labels")
            fresh = lines.join(of_labels(known, labels).select(*LABEL, "line_hash"), [*LABEL, "line_hash"], "left_anti")
        named = fresh.withColumns({"run_id": F.lit(run_id), "batch_id": F.lit(batch_id).cast("bigint")}).select(*COLUMNS)
        with side_by_side_writers(spark):
            named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path)
    finally:
        files, folder = versions.hadoop_files(spark, work)
        files.delete(folder, True)


def of_labels(known: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``known`` whose label is among ``labels``; they prune its folders at run time.

    A staged table of labels lets Spark see how few they are; the filter on them,
    true for every label, is what makes Spark consider pruning by them.
    """
    return known.join(labels.where(F.col("content_month") > ""), LABEL, "left_semi")


def _known_lines(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return read_streamed_lines(spark, path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def compact(spark: SparkSession, path: str) -> int:
    """Merge finished batches into generations; returns the number of generations that count.

    The newest batch of each run stays as it is, because a restart may write it
    again.  New lines are merged with every generation that is no larger than what
    is merged so far, so a line is rewritten about log2(lines) times in all and
    about so many generations are left.  Folders that the commit before this one
    had already replaced are removed: readers that began before it must have ended,
    readers of that commit go on.  One compaction runs at a time; of two, the second to commit fails
    and leaves nothing but an unused folder.
    """
    root = f"{path}/{COMPACTED}"
    number, generations, reached = _current(spark, path)
    if not versions.names(spark, path):
        return 0
    _remove_replaced(spark, path, generations, reached)
    batches = _batches(spark, path).filter(~_within(reached))
    # From the folder names: a row per batch that is not merged yet.
    last = {r.run_id: r.last for r in batches.groupBy("run_id").agg((F.max("batch_id") - 1).alias("last")).collect()}
    merging = batches.filter(_within(last))
    count = merging.count()
    if not count:
        return len(generations)
    parts, kept, total = [merging], [], count
    for generation in sorted(generations, key=lambda g: g.lines):
        if generation.lines <= total:
            parts.append(_generation(spark, path, generation.generation))
            total += generation.lines
        else:
            kept.append((generation.generation, generation.lines, None, None))
    token = versions.new_build()
    merged = reduce(DataFrame.unionByName, parts)
    # Even ranges of (label, hash): files of a bounded size, a large label in several.
    sized = merged.repartitionByRange(total // LINES_A_FILE + 1, *LABEL, "line_hash").sortWithinPartitions(*LABEL, "line_hash")
    sized.write.partitionBy(*LABEL).parquet(f"{root}/generations/{token}")
    now = {**reached, **{run: max(n, reached.get(run, n)) for run, n in last.items()}}
    rows = [*kept, (token, total, None, None), *((None, None, run, n) for run, n in now.items())]
    spark.createDataFrame(rows, MANIFEST_SCHEMA).coalesce(1).write.parquet(f"{root}/manifests/{token}")
    if not versions._commit(spark, root, number + 1, token):
        raise RuntimeError(f"another compaction of {path} committed first")
    return len(kept) + 1


def _remove_replaced(spark: SparkSession, path: str, generations: list, reached: dict[str, int]) -> None:
    """Remove batch folders and generations that the current commit has replaced."""
    current = {g.generation for g in generations}
    for name in versions.names(spark, f"{path}/{COMPACTED}/generations") if current else []:
        if name not in current:
            files, folder = versions.hadoop_files(spark, f"{path}/{COMPACTED}/generations/{name}")
            files.delete(folder, True)
    files, pattern = versions.hadoop_files(spark, f"{path}/instrument_id=*/content_month=*/run_id=*/batch_id=*")
    for status in (files.globStatus(pattern) or []) if reached else []:
        folder = status.getPath()
        run, batch = (name.split("=", 1)[1] for name in (folder.getParent().getName(), folder.getName()))
        if int(batch) <= reached.get(run, -1):
            files.delete(folder, True)


def streaming_silver(
    spark: SparkSession, bronze_path: str, path: str, checkpoints: str, rules: RuleSet, interval: str | None = None
) -> StreamingQuery:
    """Start keeping the Silver lines current.

    Holds the same distinct data lines as a full rebuild.  Positions are those
    of the first landing; run the rebuild for key order and ``source_index``.
    No streaming state grows with the data.
    """
    landed = spark.readStream.schema(BRONZE_SCHEMA).option("maxFilesPerTrigger", 10000).parquet(bronze_path)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    checkpoint = f"{checkpoints}/silver"

    def append(batch: DataFrame, batch_id: int) -> None:
        append_batch(batch, checkpoint_id(batch.sparkSession, checkpoint), batch_id, rules, path)

    return (
        landed.writeStream.queryName("streaming-silver")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(append)
        .trigger(**trigger)
        .start()
    )


def streamed_stats(bronze_stats: DataFrame, lines: DataFrame) -> DataFrame:
    """Silver statistics from landing totals and the streamed lines."""
    landed = bronze_stats.groupBy(GROUP).agg(
        F.count(F.lit(1)).alias("bronze_objects"), F.sum("data_rows").cast("bigint").alias("data_rows_total")
    )
    unique = lines.groupBy(GROUP).agg(F.count(F.lit(1)).alias("data_rows_unique"))
    kept = F.coalesce("data_rows_unique", F.lit(0).cast("bigint"))
    return landed.join(unique, GROUP, "left").select(
        GROUP, "bronze_objects", "data_rows_total", kept.alias("data_rows_unique"),
        (F.col("data_rows_total") - kept).alias("duplicates_removed"),
    )
