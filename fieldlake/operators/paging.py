"""Order, pages and cursors over indexed Silver rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlake.functions.times import in_range

# Page size default and bounds.
DEFAULT_LIMIT = 100
MAX_LIMIT = 500

# A search for a page counts rows in so many blocks of the index at once, down to blocks of so many numbers.
FAN_OUT = 4096
FINE_BLOCK = 20_000


def clamp_limit(limit: int | None) -> int:
    return min(max(int(limit or DEFAULT_LIMIT), 1), MAX_LIMIT)


def page_size(limit: int | None) -> int:
    """The operators take any size from 1; only a browse request has an upper bound."""
    return max(int(limit or DEFAULT_LIMIT), 1)


def clamp_cursor(cursor: int | None) -> int:
    return max(int(cursor or 0), 0)


def _as_ntz(value) -> Column | None:
    if value is None or isinstance(value, Column):
        return value
    return F.lit(str(value)).cast("timestamp_ntz")


def time_range_filter(rows: DataFrame, start=None, end=None, ts: str = "ts") -> DataFrame:
    """Rows with ``start <= ts <= end``; each bound is optional, both inclusive.

    Plain comparisons with literals, so the bounds reach the Parquet scan.  With
    any bound set, rows without a time drop out.
    """
    start, end = _as_ntz(start), _as_ntz(end)
    kept = rows
    if start is not None:
        kept = kept.filter(F.col(ts) >= start)
    if end is not None:
        kept = kept.filter(F.col(ts) <= end)
    return kept


def _direction(order: str, index: str) -> Column:
    return F.col(index).desc() if order == "desc" else F.col(index).asc()


def in_order(rows: DataFrame, order: str = "asc", index: str = "source_index") -> DataFrame:
    """Storage order, reversed for ``desc``; any other word means ascending."""
    return rows.orderBy(_direction(order, index))


def index_bounds(
    rows: DataFrame, cursor: int, limit: int, order: str, index: str, fan_out: int, fine: int
) -> tuple[int, int, int] | None:
    """Lowest and highest index of a stretch that holds the page, and how many of its rows come before the page.

    Rows are counted in ``fan_out`` blocks of the index; the blocks that the page meets
    are the next stretch, until it is ``fine`` or does not shrink.  The driver holds one
    count per block, and only the first round reads more than one block of the one before.
    """
    ends = rows.agg(F.min(index).alias("low"), F.max(index).alias("high")).first()
    if ends.low is None:
        return None
    low, high, before = ends.low, ends.high, cursor
    while high - low >= fine:
        width = -(-(high - low + 1) // fan_out)
        block = F.floor((F.col(index) - low) / width).cast("bigint")
        counted = rows.filter(F.col(index).between(low, high)).groupBy(block.alias("block")).count().collect()
        met, ahead = [], 0
        for r in sorted(counted, key=lambda r: r.block, reverse=order == "desc"):
            if ahead + r["count"] > before and ahead < before + limit:
                met.append((r.block, ahead))
            ahead += r["count"]
        if not met:
            return None
        before -= met[0][1]
        first, last = sorted((met[0][0], met[-1][0]))
        low, high, was = low + first * width, min(high, low + (last + 1) * width - 1), high - low
        if high - low >= was or width == 1:
            break
    return low, high, before


def page(
    rows: DataFrame,
    cursor: int = 0,
    limit: int | None = None,
    order: str = "asc",
    index: str = "source_index",
    fan_out: int = FAN_OUT,
    fine: int = FINE_BLOCK,
) -> DataFrame:
    """Rows ``cursor`` to ``cursor + limit`` of the ordered rows of one instrument.

    One plan for every cursor: the search above reads the index and the filtered
    columns only, and its bounds are literals that leave out all other row groups of
    the wide rows.
    """
    cursor, limit = clamp_cursor(cursor), page_size(limit)
    found = index_bounds(rows, cursor, limit, order, index, fan_out, fine)
    if found is None:
        return rows.limit(0)
    low, high, before = found
    return in_order(rows.filter(F.col(index).between(low, high)), order, index).offset(before).limit(limit)


def page_dense(rows: DataFrame, cursor: int = 0, limit: int | None = None, order: str = "asc", index: str = "source_index") -> DataFrame:
    """The same page of rows that hold every index from 0: the cursor itself is the bound."""
    cursor, limit = clamp_cursor(cursor), page_size(limit)
    low = cursor
    if order == "desc":
        last = rows.agg(F.max(index).alias("last")).first().last
        if last is None or last < cursor:
            return rows.limit(0)
        low = last - cursor - limit + 1
    return in_order(rows.filter(F.col(index).between(low, low + limit - 1)), order, index)


def page_after(rows: DataFrame, last_index: int | None, limit: int | None = None, order: str = "asc", index: str = "source_index") -> DataFrame:
    """Next page after a known index: a pushed-down bound instead of an offset."""
    if last_index is not None:
        rows = rows.filter(F.col(index) < last_index if order == "desc" else F.col(index) > last_index)
    return in_order(rows, order, index).limit(page_size(limit))


def latest_rows(rows: DataFrame, limit: int | None = None, index: str = "source_index") -> DataFrame:
    return page(rows, 0, limit, "desc", index)


def next_cursor(page_rows: DataFrame, cursor: int = 0, limit: int | None = None) -> DataFrame:
    """One row with the cursor of the next page, null when this one is not full."""
    cursor, limit = clamp_cursor(cursor), page_size(limit)
    full = F.count(F.lit(1)) == limit
    return page_rows.agg(F.when(full, F.lit(cursor + limit).cast("bigint")).alias("next_cursor"))


__all__ = [
    "clamp_cursor", "clamp_limit", "in_order", "in_range", "latest_rows", "next_cursor", "page", "page_after", "page_dense",
    "page_size", "time_range_filter",
]
