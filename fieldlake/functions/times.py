"""Timestamp text: parsing, comparison, formatting and partition columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlake.functions.text import strip

# Accepted timestamp shapes.  ISO-8601 comes first, then dashed
# and slashed year-first text, then day-first, then month-first text.
_ZONE = r"(Z|[+-][0-9]{2}(?::[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?|[0-9]{2}(?:[0-9]{2}(?:\.[0-9]+)?)?)?)?"
_CLOCK = (
    r"(?:([0-9]{2})(?::([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]+))?)?)?"
    r"|([0-9]{2})([0-9]{2})(?:([0-9]{2})(?:[.,]([0-9]+))?)?)"
)
ISO = r"(?s)^(?!0000)([0-9]{4})(?:-([0-9]{2})-([0-9]{2})|([0-9]{2})([0-9]{2}))(?:." + _CLOCK + _ZONE + r")?$"
YEAR_FIRST_DASH = (
    r"^(?!0000)[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}(?:[Tt]|\s+)[0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}(?:\.[0-9]{1,6})?$"
)
YEAR_FIRST_SLASH = (
    r"^(?!0000)([0-9]{4})/([0-9]{1,2})/([0-9]{1,2})\s+([0-9]{1,2}:[0-9]{1,2}:[0-9]{1,2}(?:\.[0-9]{1,6})?)$"
)
DAY_OR_MONTH_FIRST = (
    r"^([0-9]{1,2})/([0-9]{1,2})/(?!0000)([0-9]{4})\s+([0-9]{1,2}:[0-9]{1,2}(?::[0-9]{1,2}(?:\.[0-9]{1,6})?)?)$"
)
# The commonest shape; it needs no parts, and no zone.
PLAIN = r"^(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}:[0-9]{2}\z"
_HAS_FRACTION = r"\.[0-9]+$"
_HAS_SECONDS = r":[0-9]{1,2}:[0-9]{1,2}(?:\.[0-9]{1,6})?$"

DISPLAY_ZONE = "America/Los_Angeles"
NO_DATA = "NO DATA"


def _ntz(text: Column) -> Column:
    return text.try_cast("timestamp_ntz")


def _cleaned(value: Column) -> Column:
    body = F.btrim(strip(value), F.lit('"'))
    # A final Z is the same as an explicit zero offset.
    return F.regexp_replace(body, r"(?s)Z$", "+00:00")


def _iso_parts(text: Column) -> Column:
    """``[date, hour, minute, second, fraction, zone]`` of ISO text, else null."""
    marked = F.regexp_replace(text, ISO, "$1-$2$4-$3$5|$6$10|$7$11|$8$12|$9$13|$14")
    return F.when(text.rlike(ISO), F.split(marked, r"\|"))


def _iso_wall_clock(parts: Column, zone: Column) -> Column:
    def two(i: int) -> Column:
        return F.coalesce(F.nullif(F.get(parts, F.lit(i)), F.lit("")), F.lit("00"))

    fraction = F.substring(F.coalesce(F.nullif(F.get(parts, F.lit(4)), F.lit("")), F.lit("0")), 1, 6)
    clock = F.concat(two(1), F.lit(":"), two(2), F.lit(":"), two(3), F.lit("."), fraction)
    parsed = _ntz(F.concat(F.get(parts, F.lit(0)), F.lit(" "), clock))
    return F.when(_zone_is_valid(zone), parsed)


def _iso_zone(parts: Column) -> Column:
    """Zone suffix of ISO text, empty when there is none."""
    return F.coalesce(F.get(parts, F.lit(5)), F.lit(""))


def _zone_piece(zone: Column, group: int) -> Column:
    digits = r"^[+-]([0-9]{2}):?([0-9]{2})?:?([0-9]{2})?"
    return F.coalesce(F.nullif(F.regexp_extract(zone, digits, group), F.lit("")), F.lit("0")).cast("int")


def _zone_is_valid(zone: Column) -> Column:
    return (zone == "") | (F.abs(_zone_seconds(zone)) < 86400)


def _zone_seconds(zone: Column) -> Column:
    total = _zone_piece(zone, 1) * 3600 + _zone_piece(zone, 2) * 60 + _zone_piece(zone, 3)
    return F.when(F.startswith(zone, F.lit("-")), -total).otherwise(total)


def _wall_clock(text: Column, parts: Column, zone: Column, date_order: str) -> Column:
    if date_order not in ("dmy", "mdy"):
        raise ValueError(f"date_order must be 'dmy' or 'mdy', not {date_order!r}")
    spaced = F.regexp_replace(text, r"[Tt]|\s+", " ")
    has_seconds = text.rlike(_HAS_SECONDS)
    day_first = F.when(has_seconds, _ntz(F.regexp_replace(text, DAY_OR_MONTH_FIRST, "$3-$2-$1 $4")))
    month_text = F.regexp_replace(text, DAY_OR_MONTH_FIRST, "$3-$1-$2 $4")
    padded = F.when(has_seconds, month_text).otherwise(F.concat(month_text, F.lit(":00")))
    month_first = F.when(~text.rlike(_HAS_FRACTION), _ntz(padded))
    either = (day_first, month_first) if date_order == "dmy" else (month_first, day_first)
    iso = F.when(parts.isNotNull(), _iso_wall_clock(parts, zone))
    slashed = F.contains(text, F.lit("/"))
    return (
        F.when(slashed & text.rlike(DAY_OR_MONTH_FIRST), F.coalesce(*either))
        .when(slashed & text.rlike(YEAR_FIRST_SLASH), _ntz(F.regexp_replace(text, YEAR_FIRST_SLASH, "$1-$2-$3 $4")))
        .otherwise(F.coalesce(iso, F.when(text.rlike(YEAR_FIRST_DASH), _ntz(spaced))))
    )


def _to_utc(wall: Column, zone: Column, naive_zone: str | None) -> Column:
    naive = wall
    if naive_zone:
        naive = F.to_utc_timestamp(wall.cast("timestamp"), naive_zone).cast("timestamp_ntz")
    return F.when(zone == "", naive).otherwise(wall - F.make_dt_interval(secs=_zone_seconds(zone)))


def _iso_with_zone(wall: Column, zone: Column) -> Column:
    offset = F.abs(_zone_seconds(zone))
    hours, minutes, seconds = F.floor(offset / 3600), F.floor(offset % 3600 / 60), offset % 60
    suffix = F.concat(
        F.when(_zone_seconds(zone) < 0, F.lit("-")).otherwise(F.lit("+")),
        F.format_string("%02d:%02d", hours, minutes),
        F.when(seconds > 0, F.format_string(":%02d", seconds)).otherwise(F.lit("")),
    )
    return F.when(zone == "", iso_text(wall)).otherwise(F.concat(iso_text(wall), suffix))


def _readings(value: Column) -> tuple[Column, Column, Column]:
    text = _cleaned(value)
    parts = _iso_parts(text)
    return text, parts, _iso_zone(parts)


def parse_datetime(value: Column, date_order: str = "dmy") -> Column:
    """Wall-clock ``TIMESTAMP_NTZ`` of a timestamp text, null when unreadable.

    ISO-8601 is tried first (any zone suffix is left out of the result), then
    year-first text, then ``d/m/Y`` and ``m/d/Y``.  Ambiguous dates such as
    3/4/2026 are day-first; ``date_order="mdy"`` turns that round.
    """
    text, parts, zone = _readings(value)
    return _wall_clock(text, parts, zone, date_order)


def datetime_for_compare(value: Column, date_order: str = "dmy", naive_zone: str | None = None) -> Column:
    """Naive UTC time used by every range test.

    Zoned text is shifted to UTC.  Zone-less text is taken as it stands unless
    ``naive_zone`` names the zone its clock runs in.
    """
    text, parts, zone = _readings(value)
    return _to_utc(_wall_clock(text, parts, zone, date_order), zone, naive_zone)


def iso_format(value: Column, date_order: str = "dmy") -> Column:
    """ISO text of a timestamp text, with its zone suffix when it had one."""
    text, parts, zone = _readings(value)
    return _iso_with_zone(_wall_clock(text, parts, zone, date_order), zone)


def with_times(
    df: DataFrame,
    source: str,
    *,
    wall: str | None = None,
    compare: str | None = None,
    iso: str | None = None,
    date_order: str = "dmy",
    naive_zone: str | None = None,
) -> DataFrame:
    """Add the wanted readings of the text column ``source``, parsing it once.

    The intermediate columns keep the expression small, which matters when the
    three readings are used together on every row of a table.
    """
    plain, text, parts, zone = F.col("_plain"), F.col("_text"), F.col("_parts"), F.col("_zone")
    staged = (
        df.withColumn("_plain", F.col(source).rlike(PLAIN))
        .withColumn("_text", F.when(plain, F.col(source)).otherwise(_cleaned(F.col(source))))
        .withColumn("_parts", F.when(plain, F.lit(None)).otherwise(_iso_parts(text)))
        .withColumn("_zone", _iso_zone(parts))
        .withColumn("_wall", F.when(plain, _ntz(text)).otherwise(_wall_clock(text, parts, zone, date_order)))
    )
    added = {}
    if wall:
        added[wall] = F.col("_wall")
    if compare:
        added[compare] = _to_utc(F.col("_wall"), zone, naive_zone)
    if iso:
        written = F.concat(F.left(text, F.lit(10)), F.lit("T"), F.right(text, F.lit(8)))
        general = _iso_with_zone(F.col("_wall"), zone)
        added[iso] = F.when(plain, F.when(F.col("_wall").isNotNull(), written)).otherwise(general)
    return staged.withColumns(added).drop("_plain", "_text", "_parts", "_zone", "_wall")


def iso_text(ts: Column) -> Column:
    """``yyyy-MM-ddTHH:mm:ss``, with six fraction digits when there are any."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(ts, "SSSSSS")
    return F.when(fraction == "000000", whole).otherwise(F.concat(whole, F.lit("."), fraction))


def in_range(ts: Column, start: Column | None, end: Column | None) -> Column:
    """Inclusive test with optional bounds; a missing time never passes."""
    test = ts.isNotNull()
    if start is not None:
        test = test & (start.isNull() | (ts >= start))
    if end is not None:
        test = test & (end.isNull() | (ts <= end))
    return F.coalesce(test, F.lit(False))


def partition_columns(ts: Column) -> tuple[Column, Column]:
    """Zero-padded ``year`` and ``month`` text of an instant."""
    return F.date_format(ts, "yyyy").alias("year"), F.date_format(ts, "MM").alias("month")


def format_local_time(ts: Column, zone: str = DISPLAY_ZONE) -> Column:
    """Display text of a UTC instant in a local zone, e.g. ``Mar 2, 06:00:05 PM``."""
    local = F.from_utc_timestamp(ts.cast("timestamp"), zone)
    return F.coalesce(F.date_format(local, "MMM d, hh:mm:ss a"), F.lit(NO_DATA))


def content_month(line: Column) -> Column:
    """Month label taken from the first date written in a line, '' without one.

    It depends on the line alone, so equal lines always share a label.  It only
    groups rows in storage; it is not a parsed time.
    """
    year_first = r"((?:19|20)[0-9]{2})[-/]([0-9]{1,2})[-/][0-9]{1,2}"
    year_last = r"[0-9]{1,2}/([0-9]{1,2})/((?:19|20)[0-9]{2})"

    def label(year: Column, month: Column) -> Column:
        return F.concat(year, F.lit("-"), F.lpad(month, 2, "0"))

    return (
        F.when(line.rlike(year_first), label(F.regexp_extract(line, year_first, 1), F.regexp_extract(line, year_first, 2)))
        .when(line.rlike(year_last), label(F.regexp_extract(line, year_last, 2), F.regexp_extract(line, year_last, 1)))
        .otherwise(F.lit("none"))
    )
