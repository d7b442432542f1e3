"""String helpers shared by the extractors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a Unicode-aware strip removes.
WHITESPACE = "".join(
    map(
        chr,
        (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000),
    )
)


def strip(text: Column) -> Column:
    """Remove Unicode whitespace at both ends (``trim`` alone removes only spaces)."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def html_escape(text: Column) -> Column:
    for value, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(value), F.lit(entity))
    return text


def first_number(text: Column) -> Column:
    """First run of digits as int, else 0. ``1,234 replies`` gives 1; what an int cannot hold is its largest value."""
    digits = F.regexp_extract(text, r"([0-9]+)", 1)
    return F.when(digits == "", F.lit(0)).otherwise(F.coalesce(digits.try_cast("int"), F.lit(2**31 - 1)))


def json_quote(text: Column) -> Column:
    """JSON string literal of a value; null gives ``null``."""
    plain = ~text.rlike(r"[\x00-\x1f\"\\]")
    quoted = F.to_json(F.array(text), {"ignoreNullFields": "false"})
    return F.when(plain, F.concat(F.lit('"'), text, F.lit('"'))).otherwise(
        F.substring(quoted, F.lit(2), F.length(quoted) - 2)
    )
