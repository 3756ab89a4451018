"""File discovery and reads of raw objects, by byte range."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlake.functions.text import RARE_BREAKS, split_lines
from fieldlake.sources.tail import SPLIT_BYTES, FileRange, list_matches, read_range, unfinished_line

ERROR_CHARS = 500

_REMOTE = re.compile(r"(?!file:)[A-Za-z][A-Za-z0-9+.-]*://")
_LOCAL = re.compile(r"^file:(//(?=/))?")
_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def _read_files(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """Binary-file rows for several patterns; a pattern without a match adds none."""
    found = []
    for pattern in patterns:
        try:
            found.append(spark.read.format("binaryFile").load(pattern))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    if not found:
        return spark.createDataFrame([], _FILES)
    return reduce(DataFrame.unionByName, found)


def _absolute(pattern: str) -> str:
    """A pattern that means the same on every machine that sees the folder."""
    return pattern if ":" in pattern.split("/")[0] else os.path.abspath(pattern)


def _list_patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for pattern in batch.column("pattern").to_pylist():
            found = list_matches(pattern)
            # A local file has one name, however its pattern was written.
            paths = [p if _REMOTE.match(p) else "file:" + _LOCAL.sub("", p) for p in found]
            sizes, times = zip(*found.values(), strict=True) if found else ((), ())
            columns = [pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array([t // 1000 for t in times], pa.int64())]
            yield pa.record_batch(columns, names=["path", "size", "modified_us"])


def discover_files(spark: SparkSession, patterns: str | list[str]) -> DataFrame:
    """Distinct files that match any pattern, sorted: ``path, size, modified_at``.

    The listing is the one that ``growing_text`` reads by, so both see the same
    files: not recursive, folders that match are no files, anything below a
    quarantine folder is left out, a name that starts with ``_`` counts and one
    that starts with ``.`` only where the pattern says so.  A task lists a pattern;
    no content is read.  Patterns without a match, and no patterns, give no rows.
    """
    patterns = [patterns] if isinstance(patterns, str) else list(patterns)
    rows = spark.createDataFrame([(_absolute(p),) for p in patterns], "pattern string")
    listed = rows.repartition(max(1, len(patterns))).mapInArrow(_list_patterns, "path string, size bigint, modified_us bigint")
    modified = F.timestamp_micros("modified_us").cast("timestamp_ntz").alias("modified_at")
    return listed.select("path", "size", modified).distinct().orderBy("path")


def _is_object(path: Column) -> Column:
    return ~F.endswith(path, F.lit(".keep")) & ~F.endswith(path, F.lit("/"))


def _with_keys(files: DataFrame, root: str) -> DataFrame:
    """Add the object key (path below ``root``) and its instrument (first folder)."""
    tail = root.split("://")[-1].split(":", 1)[-1].strip("/") + "/"
    key = F.substring("path", F.instr("path", tail) + len(tail), F.length("path"))
    folder = F.substring_index("object_key", "/", 1)
    return files.withColumn("object_key", key).withColumn("instrument_id", F.regexp_replace(folder, "^instrument_id=", ""))


def _bronze_pattern(root: str) -> str:
    return f"{root.rstrip('/')}/*/bronze/*/*/*"


def scan_bronze_objects(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """Listing ``instrument_id, object_key, size, modified_at``; no content is read."""
    files = _read_files(spark, [pattern or _bronze_pattern(root)]).filter(_is_object(F.col("path")))
    return _with_keys(files, root).select(
        "instrument_id",
        "object_key",
        F.col("length").alias("size"),
        F.col("modificationTime").cast("timestamp_ntz").alias("modified_at"),
    )


def scan_bronze_lines(
    spark: SparkSession, root: str, pattern: str | None = None, range_bytes: int = SPLIT_BYTES, on_error: str = "raise"
) -> DataFrame:
    """Lines ``instrument_id, object_key, pos, line`` of raw text objects, blank lines included.

    Objects of every size go through one reader, in ranges of ``range_bytes``; a
    range has the lines that begin in it.  ``pos`` is the byte offset of the line
    in its object (lines cut at one of the rarer separators count on from it), so
    neither rows nor positions depend on ``range_bytes``.

    A range that cannot be read fails the job, or with ``on_error="column"`` gives
    a row with null ``pos`` and ``line`` and the message in one more column
    ``error``, null in all other rows; other ranges of that object still give
    their lines.
    """
    if on_error not in ("raise", "column"):
        raise ValueError(f"on_error is raise or column, not {on_error}")
    files = _read_files(spark, [pattern or _bronze_pattern(root)]).filter(_is_object(F.col("path"))).select("path", "length")
    step = F.lit(range_bytes).cast("bigint")
    begins = F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0)), step)
    ranges = files.withColumn("begin", F.explode(begins)).withColumn("end", F.least(F.col("begin") + step, F.col("length")))
    # Rows are ranges of about equal size here: one task for each, or for several short ones.
    size, count = files.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1))).first()
    tasks = max(size // range_bytes + 1, min(count, spark.sparkContext.defaultParallelism))
    read = ranges.repartition(int(tasks), "path", "begin").mapInArrow(_range_reader(on_error == "column"), "path string, pos bigint, line string, error string")
    # The reader took one break off each line; a line that still ends with CR had CR CR LF.
    text = F.concat("line", F.when(F.endswith("line", F.lit("\r")), F.lit("\r\n")).otherwise(F.lit("\n")))
    pieces = _with_keys(read, root).select("instrument_id", "object_key", "pos", "error", F.posexplode_outer(split_lines(text)).alias("_n", "line"))
    pieces = pieces.withColumn("pos", F.col("pos") + F.col("_n"))
    return pieces.select("instrument_id", "object_key", "pos", "line", *(["error"] if on_error == "column" else []))


def _range_reader(errors_as_rows: bool):
    def table(path: str, pos, line, error: str | None = None) -> pa.RecordBatch:
        n = len(pos)
        return pa.record_batch([pa.array([path] * n, pa.string()), pos, line, pa.array([error] * n, pa.string())], names=["path", "pos", "line", "error"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                part = FileRange(row["path"], 0, row["length"], row["begin"], row["end"])
                try:
                    for lines in read_range(part):
                        yield table(part.path, lines.column("pos"), lines.column("line"))
                    if part.end == part.range_end and (rest := unfinished_line(part)) is not None:
                        start, text = rest
                        bare = text[:-1] if text.endswith(tuple(RARE_BREAKS)) else text
                        yield table(part.path, pa.array([start], pa.int64()), pa.array([bare], pa.string()))
                except Exception as error:  # whatever a file system raises for one object
                    if not errors_as_rows:
                        raise
                    yield table(part.path, pa.array([None], pa.int64()), pa.array([None], pa.string()), f"{type(error).__name__}: {error}"[:ERROR_CHARS])

    return run


def expand_lines(landed: DataFrame) -> DataFrame:
    """Cut landed ``\\n`` lines at the other line separators.

    The few bytes between pieces keep their order: a piece is placed at the byte
    offset of its line plus its number, which stays below the next line's offset.
    """
    pieces = landed.select("*", F.posexplode(split_lines(F.col("line"))).alias("_n", "_piece"))
    return pieces.withColumn("pos", F.col("pos") + F.col("_n")).withColumn("line", F.col("_piece")).drop("_n", "_piece")
