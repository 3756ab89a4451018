"""Silver: records out of keep-first lines, and the full rebuild as a published version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.functions import text as tx
from fieldlake.functions.rules import RuleSet, classify_lines, record_timestamp
from fieldlake.functions.times import with_times
from fieldlake.operators import consolidate as cs
from fieldlake.operators.positions import assign_source_index
from fieldlake.session import stage
from fieldlake.sources import silver as store
from fieldlake.sources import versions

ERROR_CHARS = 2000


def header_columns(header: DataFrame) -> DataFrame:
    """``instrument_id, object_key, raw, columns`` of recovered header lines."""
    return header.select("instrument_id", "object_key", F.col("line").alias("raw"), tx.split_fields(F.col("line")).alias("columns"))


def silver_records(
    indexed: DataFrame, headers: DataFrame, rules: RuleSet, date_order: str = "dmy", naive_zone: str | None = None
) -> DataFrame:
    """Silver rows from ``instrument_id, source_index, object_key, pos, line``.

    ``headers`` has one row per instrument.  Column positions are looked up once
    per header; rows then take their fields by position.  Without a header the
    values get positional names and there is no timestamp.
    """
    no_columns = F.array().cast("array<string>")
    resolved = headers.select(
        "instrument_id", "columns", rules.timestamp_positions(F.col("instrument_id"), F.col("columns")).alias("_at")
    )
    rows = (
        indexed.join(resolved, "instrument_id", "left")
        .withColumn("fields", tx.split_fields(F.col("line")))
        .withColumn("timestamp", record_timestamp(F.col("_at"), F.col("fields")))
    )
    timed = with_times(rows, "timestamp", compare="ts", iso="timestamp_iso", date_order=date_order, naive_zone=naive_zone)
    return timed.select(
        "instrument_id", "source_index", "object_key", "pos", F.col("line").alias("raw"), "fields",
        tx.values_map(F.coalesce("columns", no_columns), F.col("fields")).alias("values"),
        "timestamp", "timestamp_iso", "ts",
        tx.row_key(F.col("instrument_id"), F.col("timestamp"), F.col("line")).alias("row_key"),
    )


def _write_build(lines: DataFrame, rules: RuleSet, path: str, build: str, objects: DataFrame | None,
                 object_statistics: DataFrame | None, partitions: int | None, date_order: str, naive_zone: str | None) -> DataFrame:
    """Write the four tables of one build; returns its statistics, read back.

    Lines are shuffled once, by (instrument, line), for data rows, preamble and
    statistics together; the outcome is staged as a table so that the four
    outputs do not repeat it.  Per-object statistics and headers are staged too:
    their true file size then tells the optimizer whether to broadcast them.
    """
    staged = stage(classify_lines(cs.distinct_lines(lines), rules), "silver-lines")
    data = staged.filter("is_data")
    classified = classify_lines(lines, rules)
    per_object = object_statistics
    if per_object is None:
        per_object = stage(cs.object_stats(classified), "silver-objects")
    header = stage(header_columns(cs.recover_header(classified, per_object, settle=True)), "silver-header")
    indexed = assign_source_index(data.drop("is_data", "copies"), partitions=partitions)
    preamble = cs.number_preamble(staged.filter(~F.col("is_data")), partitions)
    listing = objects if objects is not None else per_object.select("instrument_id", "object_key")

    store.write_rows(silver_records(indexed, header, rules, date_order, naive_zone), path, build)
    store.write_table(preamble, path, "preamble", build)
    store.write_table(header, path, "header", build)
    store.write_table(cs.silver_stats(data, listing), path, "stats", build)
    return lines.sparkSession.read.schema(store.STATS_SCHEMA).parquet(f"{path}/stats/build={build}")


def build_silver(
    lines: DataFrame,
    rules: RuleSet,
    path: str,
    objects: DataFrame | None = None,
    object_statistics: DataFrame | None = None,
    partitions: int | None = None,
    date_order: str = "dmy",
    naive_zone: str | None = None,
) -> DataFrame:
    """Rebuild Silver of every instrument that has lines and publish it; returns a result or an error per instrument.

    The tables of a build go to new folders, and one commit at the end makes them
    count (``sources.versions``); until then, and if anything fails before, readers
    have the version before.  If a build fails, its lines are read and classified again
    in halves of its instruments, without writing anything, until those that fail stand
    alone; they keep their last good build and get an error, the others are built
    together.  If reading is not what fails, the build itself is halved.  With f failing
    instruments of n that takes about 2 f log2(n) scans of shrinking parts, or builds.

    ``object_statistics`` from landing saves the scan that computes them.  Instruments
    without lines stay as they are.
    """
    spark = lines.sparkSession
    done: list[tuple[str, DataFrame]] = []
    failed: list[tuple[str, str, str]] = []

    def of(df: DataFrame | None, names: list[str] | None) -> DataFrame | None:
        return df if df is None or names is None else df.filter(F.col("instrument_id").isin(names))

    def attempt(names: list[str] | None) -> None:
        build = versions.new_build()
        try:
            parts = (of(objects, names), of(object_statistics, names))
            done.append((build, _write_build(of(lines, names), rules, path, build, *parts, partitions, date_order, naive_zone)))
        except Exception as error:  # whatever it is, it must not stop other instruments
            if names is None:
                names = sorted(r.instrument_id for r in lines.select("instrument_id").distinct().collect() if r.instrument_id is not None)
                if not names:
                    raise
            if len(names) == 1:
                failed.append((names[0], build, str(error)[:ERROR_CHARS]))
                return
            torn = unreadable(names)
            failed.extend((name, build, message) for name, message in torn.items())
            rest = [name for name in names if name not in torn]
            for part in [rest] if torn else [rest[: len(rest) // 2], rest[len(rest) // 2 :]]:
                if part:
                    attempt(part)

    def unreadable(names: list[str]) -> dict[str, str]:
        """Instruments whose lines cannot be read and classified, with their errors."""
        try:
            classify_lines(of(lines, names), rules).write.format("noop").mode("overwrite").save()
        except Exception as error:
            if len(names) == 1:
                return {names[0]: str(error)[:ERROR_CHARS]}
            middle = len(names) // 2
            return unreadable(names[:middle]) | unreadable(names[middle:])
        return {}

    attempt(None)
    entries = spark.createDataFrame(failed, "instrument_id string, attempt string, error string")
    for build, stats in done:
        good = stats.withColumns({"build": F.lit(build), "attempt": F.lit(build), "error": F.lit(None).cast("string")})
        entries = entries.unionByName(good, allowMissingColumns=True)
    if not done:
        entries = entries.select("*", *[F.lit(None).cast("string").alias(c) for c in versions.ENTRY if c not in entries.columns])
    entries = stage(entries.select(*[F.col(c).cast(t) for c, t in (p.split() for p in versions.ENTRY_SCHEMA.split(", "))]), "silver-entries")
    versions.publish(spark, path, entries)
    return build_results(entries)


def build_results(stats: DataFrame, instruments: DataFrame | None = None) -> DataFrame:
    """Result row per instrument; one without objects, or with an error, has zeros and ``written = false``."""
    stats = stats if "error" in stats.columns else stats.withColumn("error", F.lit(None).cast("string"))
    rows = stats if instruments is None else instruments.select("instrument_id").join(stats, "instrument_id", "left")
    zero = F.lit(0).cast("bigint")
    return rows.select(
        "instrument_id",
        F.coalesce("bronze_objects", zero).alias("objects"),
        F.coalesce("data_rows_total", zero).alias("rows"),
        F.coalesce("data_rows_unique", zero).alias("unique"),
        F.coalesce("duplicates_removed", zero).alias("duplicates"),
        (F.coalesce("bronze_objects", zero) > 0).alias("written"),
        "error",
    )
