"""Instrument rules as data, compiled to Columns.

A rule says what a data line of one instrument looks like and where its
timestamp is written.  Adding an instrument means adding a rule.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlake.functions import text as tx


@dataclass(frozen=True)
class InstrumentRule:
    """Shape of a data line and the columns its time comes from."""

    instrument_id: str
    min_fields: int
    patterns: Mapping[int, str] = field(default_factory=dict)
    floats: tuple[int, ...] = ()
    # One column that holds the whole timestamp, tried first.
    timestamp_columns: tuple[str, ...] = ()
    # Date and time columns joined by a space, used when the first is missing.
    date_columns: tuple[str, ...] = ()
    time_columns: tuple[str, ...] = ()

    def matches(self, fields: Column) -> Column:
        """Boolean Column: do these uncleaned fields have this shape?"""

        def at(i: int) -> Column:
            return tx.clean_field(F.get(fields, F.lit(i)))

        tests = [F.size(fields) >= self.min_fields]
        tests += [at(i).rlike(pattern) for i, pattern in sorted(self.patterns.items())]
        tests += [tx.is_float(at(i)) for i in self.floats]
        if not (self.patterns or self.floats):
            tests.append(F.exists(fields, lambda f: tx.clean_field(f) != ""))
        return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))


# The five instruments, in their reporting order.
INSTRUMENT_RULES = (
    InstrumentRule(
        "BC-MA200",
        min_fields=11,
        patterns={0: r"^(?i:MA)", 1: r"^[0-9]+$"},
        timestamp_columns=("Date / time local",),
        date_columns=("Date local (yyyy/MM/dd)",),
        time_columns=("Time local (hh:mm:ss)",),
    ),
    InstrumentRule(
        "CO2-LICOR",
        min_fields=3,
        patterns={0: r"^\d{4}-\d{1,2}-\d{1,2}$", 1: r"^\d{1,2}:\d{1,2}:\d{1,2}$"},
        date_columns=("System_Date_(Y-M-D)",),
        time_columns=("System_Time_(h:m:s)",),
    ),
    InstrumentRule(
        "NEPH-PM25",
        min_fields=3,
        patterns={0: r"^\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}$"},
        floats=(1,),
        timestamp_columns=("Date_Time",),
    ),
    InstrumentRule(
        "NO2-CAPS",
        min_fields=10,
        patterns={0: r"^\d{6}$"},
        floats=(3,),
        timestamp_columns=("Timestamp",),
    ),
    InstrumentRule(
        "SMPS",
        min_fields=41,
        patterns={0: r"^[0-9]+$", 1: r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$"},
        timestamp_columns=("DateTime Sample Start",),
    ),
)


class RuleSet:
    """Rules for a set of instruments, with an optional rule for all others."""

    def __init__(self, rules: Iterable[InstrumentRule] = INSTRUMENT_RULES, default: InstrumentRule | None = None):
        self.rules = tuple(rules)
        self.default = default

    @property
    def instrument_ids(self) -> list[str]:
        return [rule.instrument_id for rule in self.rules]

    def valid_instrument(self, instrument: Column) -> Column:
        return F.coalesce(instrument.isin(*self.instrument_ids), F.lit(False))

    def _per_instrument(self, instrument: Column, build, otherwise: Column) -> Column:
        result = build(self.default) if self.default else otherwise
        if not self.rules:
            return result
        chain = F
        for rule in self.rules:
            chain = chain.when(instrument == rule.instrument_id, build(rule))
        return chain.otherwise(result)

    def has_shape(self, instrument: Column, fields: Column) -> Column:
        """True when the uncleaned fields fit the rule of their instrument."""
        return self._per_instrument(instrument, lambda rule: rule.matches(fields), F.lit(False))

    def timestamp_positions(self, instrument: Column, columns: Column) -> Column:
        """Where the time of a record sits in a header: ``STRUCT<whole, date, time>``.

        Resolved once per header, so that rows only need positional access.
        """

        def positions(rule: InstrumentRule | None) -> Column:
            def find(names: tuple[str, ...]) -> Column:
                return tx.column_position(columns, *names) if names else F.lit(None).cast("int")

            return F.struct(
                find(rule.timestamp_columns if rule else ()).alias("whole"),
                find(rule.date_columns if rule else ()).alias("date"),
                find(rule.time_columns if rule else ()).alias("time"),
                F.lit(bool(rule and rule.date_columns)).alias("parted"),
            )

        return self._per_instrument(instrument, positions, positions(None))


def record_timestamp(positions: Column, fields: Column) -> Column:
    """Timestamp text of a record, given its header's ``timestamp_positions``.

    With date and time columns, an empty value counts as missing and both parts
    are needed; a single timestamp column is passed on as written.
    """
    whole = F.get(fields, positions["whole"])
    date, time = F.get(fields, positions["date"]), F.get(fields, positions["time"])
    joined = F.when((date != "") & (time != ""), F.concat_ws(" ", date, time))
    return F.when(positions["parted"], F.coalesce(F.nullif(whole, F.lit("")), joined)).otherwise(whole)


def classify_lines(lines: DataFrame, rules: RuleSet, instrument: str = "instrument_id", line: str = "line") -> DataFrame:
    """Add ``is_data``: true for data lines; comments and blanks never are.

    The stripped line and its fields are columns of their own, so that they are
    computed once per row for all the tests of a rule.
    """
    body, fields = F.col("_body"), F.col("_fields")
    return (
        lines.withColumn("_body", tx.strip_bom(F.col(line)))
        .withColumn("_fields", tx.raw_fields(body))
        .withColumn(
            "is_data",
            ~((body == "") | F.substring(body, 1, 1).isin(*tx.COMMENT_MARKS))
            & rules.has_shape(F.col(instrument), fields),
        )
        .drop("_body", "_fields")
    )
