"""Header recovery, preamble, keep-first duplicates and their statistics.

All take *lines*: ``instrument_id, object_key, pos, line`` and, where the split
into data and other lines matters, ``is_data``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlake.functions.text import is_blank
from fieldlake.operators.positions import assign_source_index
from fieldlake.session import stage

GROUP = "instrument_id"
OBJECT = [GROUP, "object_key"]
# Most header objects that are looked up by a literal key filter.
MAX_KEY_FILTER = 2000


def _count_if(condition: Column) -> Column:
    return F.count_if(condition).cast("bigint")


def object_stats(lines: DataFrame, *more: Column) -> DataFrame:
    """One row per object: line counts and the positions a header search needs.

    A hash aggregate over fixed-width values; landing keeps the same columns up
    to date per batch, so totals and headers need not read the lines again.
    ``more`` adds aggregates.
    """
    other = ~F.col("is_data") & ~is_blank(F.col("line"))
    return lines.groupBy(*OBJECT).agg(
        _count_if(F.col("is_data")).alias("data_rows"),
        _count_if(other).alias("other_rows"),
        F.min(F.when(F.col("is_data"), F.col("pos"))).alias("first_data_pos"),
        F.max(F.when(F.col("is_data"), F.col("pos"))).alias("last_data_pos"),
        F.min(F.when(other, F.col("pos"))).alias("first_other_pos"),
        *more,
    )


def count_data_rows(lines: DataFrame) -> DataFrame:
    """Data rows per object, objects without any included.

    Lines may have a column ``error`` (``scan_bronze_lines(on_error="column")``): an
    object with an error in any of its ranges counts 0.
    """
    counted = _count_if(F.col("is_data"))
    if "error" in lines.columns:
        counted = F.when(F.count("error") > 0, F.lit(0).cast("bigint")).otherwise(counted)
    return lines.groupBy(*OBJECT).agg(counted.alias("data_rows"))


def bronze_rows(lines: DataFrame) -> DataFrame:
    """Data rows per instrument; objects with an error count 0, as in ``count_data_rows``."""
    if "error" in lines.columns:
        return count_data_rows(lines).groupBy(GROUP).agg(F.sum("data_rows").alias("bronze_rows"))
    return lines.groupBy(GROUP).agg(_count_if(F.col("is_data")).alias("bronze_rows"))


def recover_header(lines: DataFrame, stats: DataFrame | None = None, settle: bool = False) -> DataFrame:
    """Header line of each instrument: ``instrument_id, object_key, line``.

    In (object, position) order, the first data row that has a non-data line
    somewhere before it in its own object decides; the nearest such line is the
    header.  An object has one exactly when its first non-data line comes before
    its last data row, so the object is found on per-object positions and only
    that one object of each instrument is looked at again.
    """
    per_object = stats if stats is not None else object_stats(lines)
    chosen = (
        per_object.filter(F.col("first_other_pos") < F.col("last_data_pos"))
        .groupBy(GROUP)
        .agg(F.min(F.struct("object_key", "first_other_pos")).alias("_first"))
        .select(GROUP, F.col("_first.object_key"), F.col("_first.first_other_pos"))
    )
    if settle:
        chosen = stage(chosen, "header-objects")
        keys = chosen.select("object_key").limit(MAX_KEY_FILTER + 1).collect()
        if len(keys) <= MAX_KEY_FILTER:
            lines = lines.filter(F.col("object_key").isin(*{r.object_key for r in keys}))
    in_chosen = lines.join(chosen, OBJECT).filter(F.col("pos") >= F.col("first_other_pos"))
    first_data = in_chosen.filter("is_data").groupBy(*OBJECT).agg(F.min("pos").alias("_data_pos"))
    return (
        in_chosen.filter(~F.col("is_data") & ~is_blank(F.col("line")))
        .join(first_data, OBJECT)
        .filter(F.col("pos") < F.col("_data_pos"))
        .groupBy(*OBJECT)
        .agg(F.max_by("line", "pos").alias("line"))
    )


def distinct_lines(lines: DataFrame, *extra: str) -> DataFrame:
    """Distinct non-blank lines per instrument with first position and count.

    The aggregate combines before the shuffle, so a line that fills a third of
    the data still travels as one row per task.  The shuffle key holds the line
    itself and is even when one instrument dominates.
    """
    return (
        lines.filter(~is_blank(F.col("line")))
        .groupBy(GROUP, "line", *extra)
        .agg(F.min(F.struct("object_key", "pos")).alias("_first"), F.count(F.lit(1)).alias("copies"))
        .select(GROUP, "line", *extra, "_first.object_key", "_first.pos", "copies")
    )


def dedup_keep_first(lines: DataFrame) -> DataFrame:
    """Data lines without exact duplicates; the first occurrence stays."""
    return distinct_lines(lines.filter("is_data")).select(GROUP, "object_key", "pos", "line", "copies")


def first_occurrence(lines: DataFrame) -> DataFrame:
    """Mark every data row that is the first of its equal lines.

    A row is the first when it sits at the position the aggregate found.  The
    join is on that position, not on the line, so copies do not pile up.
    """
    firsts = dedup_keep_first(lines).select(*OBJECT, "pos", F.lit(True).alias("is_first"))
    data = lines.filter("is_data")
    return data.join(firsts, [*OBJECT, "pos"], "left").withColumn(
        "is_first", F.coalesce("is_first", F.lit(False))
    )


def collect_preamble(lines: DataFrame, partitions: int | None = None) -> DataFrame:
    """Distinct non-data lines per instrument in first-seen order: ``seq, line``."""
    return number_preamble(distinct_lines(lines.filter(~F.col("is_data"))), partitions)


def number_preamble(distinct: DataFrame, partitions: int | None = None) -> DataFrame:
    """``seq`` for distinct non-data lines, by their first position."""
    return assign_source_index(distinct, name="seq", partitions=partitions).select(GROUP, "seq", "line")


def silver_stats(distinct: DataFrame, objects: DataFrame) -> DataFrame:
    """Totals per instrument from keep-first rows and an object listing."""
    counted = distinct.groupBy(GROUP).agg(
        F.sum("copies").cast("bigint").alias("data_rows_total"), F.count(F.lit(1)).alias("data_rows_unique")
    )
    listed = objects.groupBy(GROUP).agg(F.count(F.lit(1)).alias("bronze_objects"))
    total, unique = (F.coalesce(c, F.lit(0).cast("bigint")) for c in ("data_rows_total", "data_rows_unique"))
    return listed.join(counted, GROUP, "left").select(
        GROUP,
        "bronze_objects",
        total.alias("data_rows_total"),
        unique.alias("data_rows_unique"),
        (total - unique).alias("duplicates_removed"),
    )


def ordered_listing(objects: DataFrame) -> DataFrame:
    """Objects in key order (a range-partitioned sort)."""
    return objects.orderBy(GROUP, "object_key")


def union_bronze(*parts: DataFrame) -> DataFrame:
    """All objects of several Bronze tables as one."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged
