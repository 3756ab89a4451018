"""Display projections over inventory rows and record values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Byte units, 1024 apart.
BYTE_UNITS = ("B", "KB", "MB", "GB", "TB")


def display_name(instrument: Column) -> Column:
    return F.replace(instrument, F.lit("-"), F.lit(" "))


def format_bytes(size: Column) -> Column:
    """1024-based size text with at most one decimal; ``0 B`` for null or zero.

    Tenths are rounded half up in integers.  Sizes past the last unit stay in it.
    """
    size = size.cast("bigint")
    chain = F.when(F.coalesce(size, F.lit(0)) <= 0, F.lit("0 B"))
    for power, unit in reversed(list(enumerate(BYTE_UNITS))):
        one = F.lit(1024**power).cast("bigint")
        tenths = F.call_function("div", size * 20 + one, one * 2)
        digit = F.pmod(tenths, F.lit(10))
        text = F.concat(
            F.call_function("div", tenths, F.lit(10).cast("bigint")).cast("string"),
            F.when(digit > 0, F.concat(F.lit("."), digit.cast("string"))).otherwise(F.lit("")),
            F.lit(f" {unit}"),
        )
        chain = chain.when(size >= one, text)
    return chain


def duplicates_shown(bronze_rows: Column, silver_rows: Column) -> Column:
    """Rows dropped on the way to Silver; null when unknown or none."""
    return F.when(bronze_rows > silver_rows, bronze_rows - silver_rows)


def is_reporting(last_update: Column) -> Column:
    return last_update.isNotNull()


def first_n_columns(columns: Column, n: int) -> Column:
    return F.slice(columns, 1, n)


def sample_values(columns: Column, values: Column, n: int) -> Column:
    """Values of the first ``n`` header columns."""
    shown = first_n_columns(columns, n)
    return F.map_filter(values, lambda name, _: F.array_contains(shown, name))


def changed_values(corrected: Column, original: Column) -> Column:
    """Entries of ``corrected`` that differ from ``original``."""
    return F.map_filter(corrected, lambda name, value: ~value.eqNullSafe(F.try_element_at(original, name)))
