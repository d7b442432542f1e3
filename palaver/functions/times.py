"""Message times: from the id, else from the display label.

All results are timestamps in the session zone, which :mod:`palaver.session` pins to UTC.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from palaver.schema import UNKNOWN_MONTH

_MONTH = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
_NUMBER = r"([0-9]{1,2})(?:st|nd|rd|th)?"
_YEAR = r",? +([0-9]{4})\b"
_MONTH_DAY = rf"(?i)\b{_MONTH},? +{_NUMBER}\b(?!:)"
_DAY_MONTH = rf"(?i)\b{_NUMBER} +{_MONTH}"
_ISO = r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}"
_SLASH = r"\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\b"
_RELATIVE = r"(?i)\b(today|yesterday)\b"
_BARE_CLOCK = r"(?i)^\W*(?:at +)?[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?(?: ?[ap]m)?\W*$"
_CLOCK = r"(?i)(?<![0-9:])[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?(?: ?[ap]m\b)?"


def id_datetime(timestamp: Column) -> Column:
    """16 digits are epoch microseconds, 10 digits epoch seconds, anything else is undated."""
    number = timestamp.try_cast("bigint")
    return F.when(timestamp.rlike(r"^[0-9]{16}\z"), F.timestamp_micros(number)).when(
        timestamp.rlike(r"^[0-9]{10}\z"), F.timestamp_seconds(number)
    )


def label_datetime(label: Column, captured_at: Column | None = None) -> Column:
    """Time named by a display label, skipping unknown words such as "at".

    A missing clock means midnight. A missing date or year is taken from
    ``captured_at`` ("Yesterday" counting one day back); without it such labels
    have no time, since the moment of the query must not decide the result. Of labels
    without a date only "Today", "Yesterday" and a bare clock name a day, not weekdays.
    """

    def reordered(pattern: str, order: str, *tail: Column) -> Column:
        """``15 Jan 2025`` out of the label, parsed as a date."""
        text = F.concat(F.regexp_replace(label, f"^.*?{pattern}.*$", order), *tail)
        return F.try_to_timestamp(text, F.lit("d MMM yyyy")).cast("date").cast("string")

    # One branch applies per label, so a label costs few matches.
    day = (
        F.when(label.rlike(_MONTH_DAY + _YEAR), reordered(_MONTH_DAY + _YEAR, "$2 $1 $3"))
        .when(label.rlike(_ISO), F.regexp_extract(label, _ISO, 0))
        .when(label.rlike(_SLASH), F.try_to_timestamp(F.regexp_extract(label, _SLASH, 0), F.lit("M/d/yyyy")).cast("date").cast("string"))
        .when(label.rlike(_DAY_MONTH + _YEAR), reordered(_DAY_MONTH + _YEAR, "$1 $2 $3"))
    )
    if captured_at is not None:
        captured = captured_at.cast("timestamp")
        year = F.year(captured).cast("string")
        back = F.when(label.rlike(r"(?i)\byesterday\b"), 1).otherwise(0)
        day = (
            day.when(label.rlike(_MONTH_DAY), reordered(_MONTH_DAY, "$2 $1 ", year))
            .when(label.rlike(_DAY_MONTH), reordered(_DAY_MONTH, "$1 $2 ", year))
            .when(label.rlike(_RELATIVE) | label.rlike(_BARE_CLOCK), F.date_sub(captured, back).cast("string"))
        )
    # Day and clock stand in the result once each: repeated, they make code too long to be compiled.
    return F.when(label.rlike("[0-9]"), F.concat(day, F.lit(" "), _clock(label)).try_cast("timestamp"))


def _clock(label: Column) -> Column:
    """The clock of a label by 24 hours, midnight without one, null for one that 12 hours do not have."""
    clock = F.regexp_extract(label, _CLOCK, 0)
    twelve = F.try_to_timestamp(F.upper(clock), F.lit("h:mm[:ss][ ]a"))
    return F.when(clock == "", F.lit("00:00")).when(F.lower(clock).endswith("m"), F.date_format(twelve, "HH:mm:ss")).otherwise(clock)


def message_datetime(timestamp: Column, label: Column, captured_at: Column | None = None) -> Column:
    from_id = id_datetime(timestamp)
    return F.when(from_id.isNotNull(), from_id).otherwise(label_datetime(label, captured_at))


def month_key(moment: Column) -> Column:
    """``YYYY-MM``, or ``unknown`` for undated content."""
    return F.coalesce(F.date_format(moment, "yyyy-MM"), F.lit(UNKNOWN_MONTH))


def year_of(month: Column) -> Column:
    return F.split(month, "-")[0]


def parse_bound(text: str | None) -> datetime | None:
    """Strict ``YYYY-MM-DD[ HH:MM[:SS[.ffffff]]]``; raises ``ValueError`` otherwise."""
    if not text:
        return None
    moment = datetime.fromisoformat(text)
    if moment.tzinfo is not None:
        raise ValueError(f"date bounds carry no zone: {text!r}")
    return moment


def literal(moment: datetime) -> Column:
    """Timestamp literal read in the session zone, not in the driver's local one."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp")
