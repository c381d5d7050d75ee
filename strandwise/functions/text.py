"""Small parsers: dates, numbers, lines, paths and one-line XML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_date(text: Column) -> Column:
    """The date in the first ten characters (YYYY-MM-DD), whatever follows; null if there is none."""
    return F.to_date(F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")))


def format_date(date: Column) -> Column:
    """A date without leading zeros, as 2010-3-24."""
    return F.date_format(date, "y-M-d")


def split_line(line: Column, delimiter: str) -> Column:
    """The fields of a line up to its first CR or LF; an empty line has none."""
    head = F.regexp_extract(line, "^[^\r\n]*", 0)
    return F.when(head == "", F.array().cast("array<string>")).otherwise(F.split(head, rf"\Q{delimiter}\E"))


def parse_uint(text: Column) -> Column:
    """A decimal number or a hexadecimal one with 0x, of 64 bits at most, as decimal(20,0); null for anything else."""
    most = F.lit("18446744073709551615").cast("decimal(20,0)")
    digits = F.regexp_replace(F.substring(text, 3, 1 << 20), "^0+(?=.)", "")
    hexadecimal = F.when(text.rlike("^0[xX][0-9a-fA-F]+$") & (F.length(digits) <= 16), F.conv(digits, 16, 10).cast("decimal(20,0)"))
    decimal = F.when(text.rlike("^0*[0-9]{1,20}$"), text.try_cast("decimal(38,0)"))
    return F.coalesce(hexadecimal, F.when(decimal <= most, decimal.cast("decimal(20,0)")))


def has_extension(path: Column, *extensions: str) -> Column:
    """Whether a path ends with one of the extensions, whatever the case."""
    found = F.lit(False)
    for e in extensions:
        found = found | F.lower(path).endswith(e.lower())
    return found


def find_ignoring_case(text: Column, part: Column) -> Column:
    """Place of ``part`` in ``text`` from 0 on, -1 if it isn't there."""
    return F.position(F.lower(part), F.lower(text)) - 1


def directory(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/", 1)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def xml_text(line: Column, tag: str) -> Column:
    """What stands between <tag> and its last end on a line; null if the line has no such element."""
    return F.nullif(F.regexp_extract(line, f"(?s)<{tag}>(.*)</{tag}>", 1), F.lit(""))


def xml_attribute(line: Column, name: str) -> Column:
    """The quoted value of the first attribute of that name; null if there is none or it is empty."""
    return F.nullif(F.regexp_extract(line, f'{name}="([^"]*)"', 1), F.lit(""))


def percent_found(found: Column, total: Column) -> Column:
    """Per cent of windows found, in single precision; 0 for a query without windows."""
    norm = F.when(total > 0, F.lit(1.0).cast("float") / total.cast("float")).otherwise(F.lit(0.0)).cast("float")
    return (F.lit(100.0).cast("float") * found.cast("float") * norm).cast("float")
