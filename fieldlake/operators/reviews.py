"""Review items: validation, matching by row key or time range, attachment.

*Rows* carry ``instrument_id, row_key, ts``; *items* follow
``sources.reviews.ITEM_SCHEMA``.  Match results are pairs of a row key and an item
key; only keys and bounds take part in a match, and the items themselves join the
pairs that are left.  Arrays of keys per row are made without a row per pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlake.functions.display import changed_values
from fieldlake.functions.rules import RuleSet
from fieldlake.functions.times import with_times
from fieldlake.session import stage

ROW = ["instrument_id", "row_key"]
ITEM_KEY = "_s3_key"

# Item defaults and the messages of rejected items.
ACTIVE = "active"
SELECTED_ROWS = "selected_rows"
TIME_RANGE = "time_range"
BAD_INSTRUMENT = "Invalid or missing instrument_id"
RANGE_NEEDS_BOUNDS = "Time range flags require start_time and end_time"
FLAG_NEEDS_ROWS = "Selected row flags require row_key or row_keys"
CORRECTION_NEEDS_VALUES = "Corrections require row_key and corrected_values"

# Time cells hold 8^level seconds: 1 s, 8 s, 64 s, 9 min, 1.1 h, 9.1 h, 3 days ... 17,000 years.
_TOP = 13
# Open ranges, and the longest closed ones, are covered down to cells of 1.1 and 9.1 hours.
_OPEN_LEVEL, _COARSEST = 4, 5
_FIRST_SECOND, _LAST_SECOND = -62135596800, 253402300799  # years 1 to 9999
# Ranges of a cell that travel as one list, about; a cell with more has several lists.
LIST_RANGES = 1024


def active_items(items: DataFrame) -> DataFrame:
    """Items in force; an item without a status is active."""
    return items.filter(F.coalesce("status", F.lit(ACTIVE)) == ACTIVE)


def _item(items: DataFrame) -> Column:
    return F.struct(*[F.col(c) for c in items.columns])


def named_keys(items: DataFrame, of: str = ITEM_KEY) -> DataFrame:
    """``instrument_id, _s3_key, row_key`` of every row that an active item names; ``of`` gives another column than its key."""
    listed = F.coalesce("row_keys", F.array().cast("array<string>"))
    keys = F.array_distinct(F.array_compact(F.concat(listed, F.array(F.nullif(F.col("row_key"), F.lit(""))))))
    return active_items(items).select("instrument_id", of, F.explode(keys).alias("row_key"))


def match_by_row_key(rows: DataFrame, items: DataFrame) -> DataFrame:
    """Pairs ``instrument_id, row_key, _s3_key`` of rows and the items that name them."""
    return rows.select(*ROW).join(named_keys(items), ROW).select(*ROW, ITEM_KEY)


def _seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def range_cells(ranges: DataFrame) -> DataFrame:
    """``instrument_id, _s3_key, _from, _to, _level, _cell``: each range as disjoint cells.

    The finest cells of a range are an eighth of it or less, so a cover reaches past the
    range by at most a quarter of its length; full groups of eight become one cell of
    the next level, so a range has at most 14 cells on a level.  With L and H the first
    and last finest cell, the cells that level k can fill are ceil(L / 8^k) to
    floor((H + 1) / 8^k) - 1, and those of them that level k + 1 fills are left to it.  Bounds in the wrong order
    have no cells, or one that no row passes.
    """
    closed = F.col("_from").isNotNull() & F.col("_to").isNotNull()
    length = F.greatest(F.lit(1), _seconds(F.col("_to")) - _seconds(F.col("_from")) + 1)
    fitting = F.greatest(F.lit(0), F.least(F.lit(_COARSEST), F.floor(F.log2(length) / 3) - 1))
    covered = (
        ranges.withColumn("_finest", F.when(closed, fitting).otherwise(_OPEN_LEVEL).cast("int"))
        .withColumns(
            {
                "_low": F.floor(F.coalesce(_seconds(F.col("_from")), F.lit(_FIRST_SECOND)) / F.expr("shiftleft(1L, 3 * _finest)")),
                "_high": F.floor(F.coalesce(_seconds(F.col("_to")), F.lit(_LAST_SECOND)) / F.expr("shiftleft(1L, 3 * _finest)")),
                "_level": F.explode(F.sequence("_finest", F.lit(_TOP))),
            }
        )
    )
    ups = "shiftleft(1L, 3 * (_level - _finest))"
    covered = covered.withColumns(
        {
            "_first": F.expr(f"ceil(_low / {ups})"),
            "_last": F.expr(f"floor((_high + 1) / {ups}) - 1"),
            "_first_up": F.expr(f"ceil(_low / (8 * {ups}))"),
            "_last_up": F.expr(f"floor((_high + 1) / (8 * {ups})) - 1"),
        }
    )
    none = F.array().cast("array<bigint>")

    def span(first: Column, last: Column) -> Column:
        return F.when(first <= last, F.sequence(first.cast("bigint"), last.cast("bigint"))).otherwise(none)

    first, last, first_up, last_up = (F.col(c) for c in ("_first", "_last", "_first_up", "_last_up"))
    edges = F.concat(span(first, first_up * 8 - 1), span((last_up + 1) * 8, last))
    cells = F.when((first_up <= last_up) & (F.col("_level") < _TOP), edges).otherwise(span(first, last))
    return covered.select(*ranges.columns, "_level", F.explode(cells).alias("_cell"))


def range_items(items: DataFrame) -> DataFrame:
    """Active range items with parsed bounds ``_from`` and ``_to`` (null = open)."""
    start = F.coalesce(F.nullif(F.col("start_time"), F.lit("")), F.col("start"))
    end = F.coalesce(F.nullif(F.col("end_time"), F.lit("")), F.col("end"))
    ranges = active_items(items).filter(F.col("scope") == TIME_RANGE)
    timed = with_times(ranges.withColumn("_start", start), "_start", compare="_from")
    return with_times(timed.withColumn("_end", end), "_end", compare="_to").drop("_start", "_end")


def _inside() -> Column:
    return (F.col("_from").isNull() | (F.col("_ts") >= F.col("_from"))) & (F.col("_to").isNull() | (F.col("_ts") <= F.col("_to")))


def _rows_in_cells(rows: DataFrame, cells: DataFrame, ts: str) -> DataFrame:
    """``instrument_id, row_key, _ts, _level, _cell``: each row on the levels that cells of its instrument have.

    Levels are a row per instrument and are broadcast: rows are not dealt by instrument for them.
    """
    levels = cells.groupBy("instrument_id").agg(F.collect_set("_level").alias("_levels"))
    return (
        rows.select(*ROW, F.col(ts).alias("_ts"))
        .filter("_ts is not null")
        .join(F.broadcast(levels), "instrument_id")
        .withColumn("_second", _seconds(F.col("_ts")))
        .withColumn("_level", F.explode("_levels"))
        .withColumn("_cell", F.expr("floor(_second / shiftleft(1L, 3 * _level))"))
        .select(*ROW, "_ts", "_level", "_cell")
    )


def meet_by_time(rows: DataFrame, items: DataFrame, ts: str, how: str, exact: bool = True) -> DataFrame:
    """Rows and range items that share a cell; with ``exact`` only those whose bounds hold.

    A row looks for its cell on the levels that ranges of its instrument have, so rows
    of an instrument without ranges drop out at once.  The join has plain keys: a cell
    with very many rows is split at run time by the sizes that Spark measures
    (``spark.sql.adaptive.skewJoin``).  A pair can meet in one cell only.
    """
    cells = range_cells(range_items(items).select("instrument_id", ITEM_KEY, "_from", "_to"))
    timed = _rows_in_cells(rows, cells, ts).alias("row")
    shared = [F.col(f"row.{c}") == F.col(f"range.{c}") for c in ("instrument_id", "_level", "_cell")]
    on = shared[0] & shared[1] & shared[2] & (_inside() if exact else F.lit(True))
    kept = [F.col("row.instrument_id"), F.col("row.row_key")]
    return timed.join(cells.alias("range"), on, how).select(*kept, *([] if how == "left_semi" else [F.col(ITEM_KEY)]))


def match_by_time_range(rows: DataFrame, items: DataFrame, ts: str = "ts") -> DataFrame:
    """Pairs ``instrument_id, row_key, _s3_key`` of rows and active range items with ``start <= time <= end``."""
    return meet_by_time(rows, items, ts, "inner")


def match_reviews(rows: DataFrame, items: DataFrame, ts: str = "ts") -> DataFrame:
    """Pairs of rows and items that apply either way, each pair once."""
    both = match_by_row_key(rows, items).unionByName(match_by_time_range(rows, items, ts))
    return both.dropDuplicates([*ROW, ITEM_KEY])


def _sorted_items(matched: Column, kind: str) -> Column:
    chosen = F.filter(matched, lambda m: m["item"]["type"] == kind)
    ordered = F.array_sort(
        chosen,
        lambda a, b: F.when(a[ITEM_KEY] < b[ITEM_KEY], F.lit(-1)).when(a[ITEM_KEY] > b[ITEM_KEY], F.lit(1)).otherwise(F.lit(0)),
    )
    return F.transform(ordered, lambda m: m["item"])


def _keys_by_time(rows: DataFrame, items: DataFrame, ts: str) -> DataFrame:
    """``instrument_id, row_key, type, _keys``: keys of the ranges that a row lies in, an array per level or less.

    The ranges of a cell are one list, or several of about ``LIST_RANGES``, and a row
    keeps those whose bounds hold: rows meet lists, and no pair is a row of its own.
    Ranges are counted for all instruments of a cell at once, so that the join deals
    the lists out anew and Spark can split a cell with very many rows, as in ``meet_by_time``.
    """
    cells = range_cells(range_items(items).select("instrument_id", ITEM_KEY, "type", "_from", "_to"))
    crowd = F.count(F.lit(1)).over(Window.partitionBy("_level", "_cell"))
    lists = (
        cells.withColumn("_list", F.pmod(F.xxhash64(ITEM_KEY), F.ceil(crowd / LIST_RANGES)))
        .groupBy("instrument_id", "_level", "_cell", "type", "_list")
        .agg(F.collect_list(F.struct("_from", "_to", ITEM_KEY)).alias("_ranges"))
    )

    def holds(r: Column) -> Column:
        t = F.col("_ts")
        return (r["_from"].isNull() | (t >= r["_from"])) & (r["_to"].isNull() | (t <= r["_to"]))

    met = _rows_in_cells(rows, cells, ts).join(lists, ["instrument_id", "_level", "_cell"])
    keys = F.transform(F.filter("_ranges", holds), lambda r: r[ITEM_KEY])
    return met.select(*ROW, "type", keys.alias("_keys")).filter(F.size("_keys") > 0)


def review_keys(rows: DataFrame, items: DataFrame, ts: str = "ts") -> DataFrame:
    """``instrument_id, row_key, flag_keys, correction_keys`` of rows that some active item applies to: sorted distinct keys."""
    kinds = active_items(items).select("instrument_id", ITEM_KEY, "type").distinct()
    named = named_keys(items).join(rows.select(*ROW), ROW, "left_semi").join(kinds, ["instrument_id", ITEM_KEY])
    by_key = named.select(*ROW, "type", F.array(ITEM_KEY).alias("_keys"))

    def of(kind: str) -> Column:
        return F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("type") == kind, F.col("_keys"))))))

    both = _keys_by_time(rows, items, ts).unionByName(by_key).filter(F.col("type").isin("flag", "correction"))
    return both.groupBy(*ROW).agg(of("flag").alias("flag_keys"), of("correction").alias("correction_keys"))


def _whole_items(keys: DataFrame, items: DataFrame) -> DataFrame:
    """``instrument_id, row_key, flags, corrections``: the items behind the keys, in key order."""
    item = active_items(items).select("instrument_id", ITEM_KEY, "type", _item(items).alias("item"))
    item = item.dropDuplicates(["instrument_id", ITEM_KEY, "type"])

    def of(column: str, kind: str) -> Column:
        return F.transform(column, lambda k: F.struct(k.alias(ITEM_KEY), F.lit(kind).alias("type")))

    pairs = keys.select(*ROW, F.inline(F.concat(of("flag_keys", "flag"), of("correction_keys", "correction"))))
    matched = pairs.join(item, ["instrument_id", ITEM_KEY, "type"]).groupBy(*ROW).agg(
        F.collect_list(F.struct(ITEM_KEY, "item")).alias("_matched")
    )
    kinds = {"flags": _sorted_items(F.col("_matched"), "flag"), "corrections": _sorted_items(F.col("_matched"), "correction")}
    return matched.withColumns(kinds).drop("_matched")


def range_edges(items: DataFrame) -> DataFrame:
    """``instrument_id, type, _level, _cell, _whole, _until, _since, _low, _high``: what ranges cover of a cell, whoever they are.

    A range that begins before a cell covers it up to its end, one that ends behind it from
    its start on: of all of them the latest end and the earliest start tell what is covered,
    and one row per cell and type is enough.  Only a range with both bounds inside a cell (a part of a second,
    see ``range_cells``) has its own row, once for all ranges with these bounds; bounds in
    the wrong order are such a row at most.
    """
    cells = range_cells(range_items(items).select("instrument_id", "type", "_from", "_to"))
    size = F.expr("shiftleft(1L, 3 * _level) * 1000000L")  # microseconds

    def micros(t: str) -> Column:
        return F.unix_micros(F.col(t).cast("timestamp"))

    before = F.col("_from").isNull() | (micros("_from") <= F.col("_cell") * size)
    behind = F.col("_to").isNull() | (micros("_to") >= (F.col("_cell") + 1) * size - 1)
    cells = cells.withColumns({"_before": before, "_behind": behind})
    inside = ~F.col("_before") & ~F.col("_behind")
    bounds = {"_low": F.when(inside, F.col("_from")), "_high": F.when(inside, F.col("_to"))}
    return cells.withColumns(bounds).groupBy("instrument_id", "type", "_level", "_cell", "_low", "_high").agg(
        F.bool_or(F.col("_before") & F.col("_behind")).alias("_whole"),
        F.max(F.when(F.col("_before") & ~F.col("_behind"), F.col("_to"))).alias("_until"),
        F.min(F.when(~F.col("_before") & F.col("_behind"), F.col("_from"))).alias("_since"),
    )


def review_kinds(rows: DataFrame, items: DataFrame, ts: str = "ts") -> DataFrame:
    """``instrument_id, row_key, _flagged, _corrected`` (1 or null) of rows that some active item applies to.

    Rows meet what ranges cover, not ranges, so nothing here grows with pairs of them.  What
    they cover is staged: Spark knows its true size and sends it to the rows while it is small.
    """
    kinds = items.filter(F.col("type").isin("flag", "correction"))
    edges = stage(range_edges(kinds), "reviews-edges")
    held = F.col("_whole") | (F.col("_ts") <= F.col("_until")) | (F.col("_ts") >= F.col("_since")) | F.col("_ts").between(F.col("_low"), F.col("_high"))
    timed = _rows_in_cells(rows, edges, ts).join(edges, ["instrument_id", "_level", "_cell"]).filter(held)
    both = timed.select(*ROW, "type").unionByName(named_keys(kinds, "type"))
    return both.groupBy(*ROW).agg(
        F.max(F.when(F.col("type") == "flag", 1)).alias("_flagged"), F.max(F.when(F.col("type") == "correction", 1)).alias("_corrected")
    )


def attach_reviews(rows: DataFrame, items: DataFrame, ts: str = "ts", arrays: bool = True) -> DataFrame:
    """Every row with arrays ``flag_keys``, ``correction_keys``, ``flags``, ``corrections`` (all in listing order) and ``status``.

    ``flags`` and ``corrections`` hold whole items, so an item is in them once for every
    row that it applies to.  They are a left join of their own on unique keys: Spark
    leaves it out where only keys or status are read.  Without ``arrays`` a row gets its
    ``status`` alone, for which no keys travel either.
    """
    if not arrays:
        attached = rows.join(review_kinds(rows, items, ts), ROW, "left")
        return attached.withColumn("status", record_status(F.col("_flagged"), F.col("_corrected"))).drop("_flagged", "_corrected")
    keys = review_keys(rows, items, ts)
    whole = _whole_items(keys, items)
    attached = rows.join(keys, ROW, "left").join(whole, ROW, "left")
    filled = {c: F.coalesce(c, F.array().cast(attached.schema[c].dataType)) for c in ("flag_keys", "correction_keys", "flags", "corrections")}
    return attached.withColumns(filled).withColumn("status", record_status(F.size("flag_keys"), F.size("correction_keys")))


def record_status(flag_count: Column, correction_count: Column) -> Column:
    return F.when(correction_count > 0, "corrected").when(flag_count > 0, "flagged").otherwise("normal")


def reviewed_keys(rows: DataFrame, items: DataFrame, ts: str = "ts") -> DataFrame:
    """Keys of rows that some active item applies to; a row stops at its first range on a level, no pairs are built."""
    return named_keys(items).select(*ROW).unionByName(meet_by_time(rows, items, ts, "left_semi"))


def flagged_rows(rows: DataFrame, items: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows some active item applies to."""
    return rows.join(reviewed_keys(rows, items, ts), ROW, "left_semi")


def unflagged_rows(rows: DataFrame, items: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows no active item applies to."""
    return rows.join(reviewed_keys(rows, items, ts), ROW, "left_anti")


def _missing(c: str) -> Column:
    return F.coalesce(F.col(c) == "", F.lit(True))


def validate_review_items(items: DataFrame, rules: RuleSet) -> DataFrame:
    """Fill the defaults and add ``error`` (null for an accepted item)."""
    filled = items.withColumns(
        {
            "status": F.coalesce("status", F.lit(ACTIVE)),
            "scope": F.coalesce("scope", F.lit(SELECTED_ROWS)),
            "reason": F.coalesce("reason", F.lit("")),
            "notes": F.coalesce("notes", F.lit("")),
        }
    )
    is_range = F.col("scope") == TIME_RANGE
    is_flag, is_correction = F.col("type") == "flag", F.col("type") == "correction"
    no_list = F.coalesce(F.size("row_keys") <= 0, F.lit(True))
    no_values = F.coalesce(F.size("corrected_values") <= 0, F.lit(True))
    error = (
        F.when(~rules.valid_instrument(F.col("instrument_id")), BAD_INSTRUMENT)
        .when(is_flag & is_range & (_missing("start_time") | _missing("end_time")), RANGE_NEEDS_BOUNDS)
        .when(is_flag & ~is_range & _missing("row_key") & no_list, FLAG_NEEDS_ROWS)
        .when(is_correction & (_missing("row_key") | no_values), CORRECTION_NEEDS_VALUES)
    )
    return filled.withColumn("error", error)


def review_id(kind: Column, created_at: Column, suffix: Column | None = None) -> Column:
    """``{type}_{compact UTC time}_{10 hex digits}``.

    The digits are random unless ``suffix`` gives text to derive them from.
    """
    digits = F.replace(F.uuid(), F.lit("-"), F.lit("")) if suffix is None else F.sha2(suffix, 256)
    return F.concat_ws("_", kind, F.date_format(created_at, "yyyyMMdd'T'HHmmss"), F.substring(digits, 1, 10))


def flag_selected(rows: DataFrame, reason: str = "", per_item: int = 500) -> DataFrame:
    """Flags over a selection of rows: one item per ``per_item`` rows of an instrument.

    A selection comes from pages, so items are cut at the largest page size and
    no group of keys grows with the table.
    """
    part = F.floor(F.col("source_index") / per_item).cast("bigint")
    return rows.groupBy("instrument_id", part.alias("part")).agg(F.sort_array(F.collect_set("row_key")).alias("row_keys")).select(
        "instrument_id", "part", F.lit("flag").alias("type"), F.lit(SELECTED_ROWS).alias("scope"), F.lit(reason).alias("reason"), "row_keys"
    )


def flag_range(ranges: DataFrame, reason: str = "") -> DataFrame:
    """Range flags from ``instrument_id, start_time, end_time``; both bounds are needed."""
    return ranges.filter(~_missing("start_time") & ~_missing("end_time")).select(
        "instrument_id", F.lit("flag").alias("type"), F.lit(TIME_RANGE).alias("scope"), F.lit(reason).alias("reason"),
        "start_time", "end_time",
    )


def correct_rows(rows: DataFrame, edited: str = "edited_values", reason: str = "") -> DataFrame:
    """Corrections from rows with an edited copy of their values; unchanged rows drop out."""
    changed = rows.withColumn("corrected_values", changed_values(F.col(edited), F.col("values")))
    return changed.filter(F.size("corrected_values") > 0).select(
        "instrument_id", F.lit("correction").alias("type"), F.lit(reason).alias("reason"), "row_key", "timestamp",
        F.col("values").alias("original_values"), "corrected_values",
    )


def list_reviews(items: DataFrame, instrument_id: str, kind: str) -> DataFrame:
    """Items of one type for an instrument, in key order, inactive ones included."""
    return items.filter((F.col("instrument_id") == instrument_id) & (F.col("type") == kind)).orderBy(ITEM_KEY)


def review_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("instrument_id").agg(F.count(F.lit(1)).alias("review_count"))
