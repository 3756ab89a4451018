"""Ordered operators that never put one instrument, or one object, in one task.

Rows are ordered by ``(object_key, pos)`` inside an instrument.  Ranks come from a
range partitioning of all rows: partitions are equally full whatever the instruments
and objects are, and only one number per partition is added up outside of them.
Looking back inside an object is resolved on *blocks* of at most ``block_rows``
consecutive positions: windows run inside a block, and what passes from block to block
is computed on a table with one row per block.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldlake.functions.text import is_blank
from fieldlake.session import stage

BLOCK_ROWS = 1_000_000


def _with_block(df: DataFrame, pos: str, block_rows: int) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(pos) / block_rows).cast("bigint"))


# ``monotonically_increasing_id`` holds the partition above 33 bits of row number.
_ROW_BITS = 33


def assign_source_index(
    df: DataFrame,
    *,
    group: str = "instrument_id",
    object_key: str = "object_key",
    pos: str = "pos",
    name: str = "source_index",
    partitions: int | None = None,
) -> DataFrame:
    """Add the 0-based rank of each row in its group's ``(object_key, pos)`` order.

    All rows are range partitioned and sorted by (group, object, position) and staged
    with their partition and their place in it.  The number of rows before a partition
    is a running sum over one count per partition, on the driver; the rank is the place
    in all rows less that of the group's first row.  No window, no task by group, and the
    staged files are in order.  Without ``partitions`` the session's number counts.
    """
    spark = df.sparkSession
    order = [group, object_key, pos]
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    placed = stage(ranged.sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "ordered-rows")
    part = F.shiftright("_id", _ROW_BITS)
    # A sorted partition begins few groups, so this has about as many rows as there are partitions and groups.
    runs = stage(
        placed.groupBy(part.alias("_part"), group).agg(F.count(F.lit(1)).alias("_rows"), F.min("_id").alias("_first")),
        "ordered-runs",
    )
    counts = sorted((r["_part"], r.n) for r in runs.groupBy("_part").agg(F.sum("_rows").alias("n")).collect())
    before = [total - n for total, (_, n) in zip(accumulate(n for _, n in counts), counts, strict=True)]
    begins = spark.createDataFrame([(p, b) for (p, _), b in zip(counts, before, strict=True)], "_part bigint, _before bigint")
    place = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    # One row per partition: the session's number of partitions bounds it.
    starts = (
        runs.withColumnRenamed("_first", "_id").join(F.broadcast(begins), "_part").groupBy(group).agg(F.min(place).alias("_start"))
    )
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(begins), "_part")
        .join(stage(starts, "ordered-starts").withColumnRenamed(group, "_group"), F.col(group).eqNullSafe(F.col("_group")))
        .withColumn(name, (place - F.col("_start")).cast("bigint"))
        .drop("_id", "_part", "_before", "_start", "_group")
    )


def previous_nondata_line(
    lines: DataFrame,
    *,
    group: str = "instrument_id",
    object_key: str = "object_key",
    pos: str = "pos",
    block_rows: int = BLOCK_ROWS,
    name: str = "previous_nondata",
) -> DataFrame:
    """Add the nearest earlier non-data, non-blank line of the same object.

    Needs ``line`` and ``is_data``.  Inside a block a window looks back; for rows
    ahead of the first such line of their block the value comes from the last
    earlier block that has one.
    """
    blocks = _with_block(lines, pos, block_rows)
    key = [group, object_key, "_block"]
    mark = F.when(~F.col("is_data") & ~is_blank(F.col("line")), F.col("line"))
    tail = blocks.groupBy(*key).agg(F.max_by(mark, F.when(mark.isNotNull(), F.col(pos))).alias("_tail"))
    earlier = Window.partitionBy(group, object_key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = tail.select(*key, F.last("_tail", ignorenulls=True).over(earlier).alias("_carry"))
    inside = Window.partitionBy(*key).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return (
        blocks.withColumn("_near", F.last(mark, ignorenulls=True).over(inside))
        .join(carried, key)
        .withColumn(name, F.coalesce("_near", "_carry"))
        .drop("_near", "_carry", "_block")
    )
