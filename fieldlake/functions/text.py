"""Line, field and key functions as built-in Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a text strip removes, and the line separators.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029]"
RARE_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
BYTE_ORDER_MARK = "\ufeff"
COMMENT_MARKS = ("%", "#")
MAX_CSV_FIELD_CHARS = 131072
FLOAT_PATTERN = (
    r"^[+-]?((\d+(_\d+)*)(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"
    r"|^[+-]?(?i:nan|inf|infinity)$"
)
DIGITS_PATTERN = r"^[0-9]+$"
STEM_KEEP = r"[^A-Za-z0-9._-]+"

# One CSV field after its leading comma: a quoted part with doubled quotes and
# whatever follows the closing quote, or plain text up to the next comma.  All
# loops are possessive: they neither go back nor recurse, so that a line takes
# time in proportion to its length and no stack, however many quotes it has.
_CSV_FIELD = r',("[^"]*+(?:""[^"]*+)*+(?:"[^,]*+|$)|[^,]*+)'
_QUOTED = r'^"([^"]*+(?:""[^"]*+)*+)(?:"([^,]*+))?$'


def _edges_hold(c: Column, front: str, back: str) -> Column:
    """Does ``c`` start or end with one of these characters (or is it empty)?

    A look at the two outer characters; trimming itself walks the whole text.
    """
    return F.contains(F.lit(front), F.substring(c, 1, 1)) | F.contains(F.lit(back), F.substring(c, -1, 1))


def _trim(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def strip(c: Column) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    return F.when(_edges_hold(c, WHITESPACE, WHITESPACE), _trim(c)).otherwise(c)


def strip_bom(c: Column) -> Column:
    """Strip whitespace, then any byte order marks in front."""
    touched = _edges_hold(c, WHITESPACE + BYTE_ORDER_MARK, WHITESPACE)
    return F.when(touched, F.ltrim(_trim(c), F.lit(BYTE_ORDER_MARK))).otherwise(c)


def clean_field(c: Column) -> Column:
    """Bare value of one field: no outer whitespace, order mark or quotes."""
    touched = _edges_hold(c, WHITESPACE + BYTE_ORDER_MARK + '"', WHITESPACE + '"')
    bare = _trim(F.btrim(F.ltrim(_trim(c), F.lit(BYTE_ORDER_MARK)), F.lit('"')))
    return F.when(touched, bare).otherwise(c)


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def is_blank_or_comment(c: Column) -> Column:
    """True for empty lines and lines that start with a comment mark."""
    body = strip_bom(c)
    return (body == "") | F.substring(body, 1, 1).isin(*COMMENT_MARKS)


def is_digits(c: Column) -> Column:
    """One or more ASCII digits and nothing else."""
    return c.rlike(DIGITS_PATTERN)


def is_float(c: Column) -> Column:
    """True when the text is a number literal (underscores, nan and inf included)."""
    return F.coalesce(c.rlike(FLOAT_PATTERN), F.lit(False))


def _contains_any(c: Column, marks: str) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(mark)) for mark in marks])


def split_lines(c: Column) -> Column:
    """Text to lines; a final line break does not open another line.

    Plain ``\\n`` text, nearly all of it, is cut at that one character; the
    pattern for the rarer separators only runs where a byte search finds one.
    """
    last = F.right(c, F.lit(1))
    shorter = F.length(c) - F.when(F.endswith(c, F.lit("\r\n")), F.lit(2)).otherwise(F.lit(1))
    body = F.when(last.isin("\n", *RARE_BREAKS), F.substring(c, F.lit(1), shorter)).otherwise(c)
    cut = F.when(_contains_any(c, RARE_BREAKS), F.split(body, LINE_BREAK)).otherwise(F.split(body, "\n"))
    return F.when(c == "", F.array().cast("array<string>")).otherwise(cut)


def decode_bytes(c: Column) -> Column:
    """Binary to text with the replacement character for invalid UTF-8."""
    return F.make_valid_utf8(c.cast("string"))


def _unquote(field: Column) -> Column:
    body = F.regexp_replace(F.regexp_extract(field, _QUOTED, 1), '""', '"')
    return F.when(
        F.startswith(field, F.lit('"')), F.concat(body, F.regexp_extract(field, _QUOTED, 2))
    ).otherwise(field)


def raw_fields(line: Column, max_field_chars: int | None = MAX_CSV_FIELD_CHARS) -> Column:
    """Fields of a line before cleaning: TAB text, plain CSV or quoted CSV.

    A CSV line with a field of more than ``max_field_chars`` has no fields, as in
    a reader with that limit; with None no field is too long.
    """
    quoted_fields = F.transform(
        F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_CSV_FIELD), F.lit(1)), _unquote
    )
    # A quote only matters where a field starts with it.
    quoted = F.startswith(line, F.lit('"')) | F.contains(line, F.lit(',"'))
    csv = (
        F.when(line == "", F.array().cast("array<string>"))
        .when(~quoted, F.split(line, ","))
        .otherwise(quoted_fields)
    )
    if max_field_chars is not None:
        too_long = (F.octet_length(line) > max_field_chars) & F.exists(csv, lambda f: F.length(f) > max_field_chars)
        csv = F.when(too_long, F.array().cast("array<string>")).otherwise(csv)
    return F.when(F.contains(line, F.lit("\t")), F.split(line, "\t")).otherwise(csv)


def split_fields(line: Column, max_field_chars: int | None = MAX_CSV_FIELD_CHARS) -> Column:
    """Cleaned fields of one line as ``ARRAY<STRING>``."""
    return F.transform(raw_fields(line, max_field_chars), clean_field)


def values_map(columns: Column, fields: Column) -> Column:
    """Header names and fields as a map.

    Fields past the header are named ``column_N``, a short row leaves the last
    names out, and a repeated name keeps its last value.
    """
    entries = F.transform(
        fields,
        lambda value, i: F.struct(
            F.coalesce(F.get(columns, i), F.concat(F.lit("column_"), (i + 1).cast("string"))).alias("key"),
            value.alias("value"),
        ),
    )
    return F.map_from_entries(entries)


def column_position(columns: Column, *names: str) -> Column:
    """0-based position of the first of ``names`` found, ignoring case.

    A name that occurs more than once resolves to its last position; null when
    none is present.
    """
    lowered = F.reverse(F.transform(columns, lambda c: F.lower(strip(c))))
    found = [
        F.when(F.array_contains(lowered, name.lower()), F.size(columns) - F.array_position(lowered, name.lower()))
        for name in names
    ]
    return F.coalesce(*found).cast("int")


def row_key(instrument: Column, timestamp_text: Column, raw: Column) -> Column:
    """Stable 32-character key of a record."""
    text = F.concat_ws("|", instrument, F.coalesce(timestamp_text, F.lit("")), raw)
    return F.substring(F.sha2(text, 256), 1, 32)


def line_hash(line: Column) -> Column:
    """Digest of a whole line, the key of duplicate look-ups."""
    return F.sha2(line, 256)


def sanitize_stem(file_name: Column) -> Column:
    """File name without extension and with unusual characters folded to ``_``."""
    stem = F.regexp_replace(file_name, r"^(\.*[^.].*)\.[^.]*$", "$1")
    return F.regexp_replace(stem, STEM_KEEP, "_")


def nonblank_line_count(text: Column) -> Column:
    """Number of lines in ``text`` that hold more than whitespace."""
    return F.size(F.filter(split_lines(text), lambda line: strip(line) != "")).cast("bigint")
