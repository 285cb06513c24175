"""Date and time Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_DAY = 86_400_000_000

# Text date formats tried in this order (first match wins;
# month/day before day/month, as the form import does).
DATE_FORMATS = ("yyyy-M-d", "M/d/yyyy", "d/M/yyyy")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_ts(x) -> Column:
    """Any date/timestamp/timestamp_ntz Column as a session-zone (UTC) timestamp."""
    return _c(x).cast("timestamp")


def ntz_micros(x) -> Column:
    """Wall-clock microseconds since 1970-01-01 of a date / timestamp_ntz value,
    independent of the session time zone (no zone conversion, so no DST
    shifts: elapsed days are whole for midnight values in every zone)."""
    return F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")),
                            _c(x).cast("timestamp_ntz"))


def ts_literal(text: str) -> Column:
    """A timestamp literal comparable with the timestamp_ntz columns of the input."""
    return F.to_timestamp_ntz(F.lit(text))


def parse_date(x) -> Column:
    """Text -> date: keep the part before the first blank, try the fixed
    formats in order, null when none matches (also for '' and null)."""
    head = F.split(F.trim(_c(x).cast("string")), " ", 2).getItem(0)
    tries = [F.try_to_timestamp(head, F.lit(fmt)) for fmt in DATE_FORMATS]
    return F.when(head != "", F.to_date(F.coalesce(*tries)))


def days_between(start, end) -> Column:
    """Whole days from ``start`` to ``end``: floor of elapsed time / 24h, may be
    negative, null when either side is null."""
    return F.floor((ntz_micros(end) - ntz_micros(start)) / F.lit(MICROS_PER_DAY))


def whole_days(start, end) -> Column:
    """``days_between`` of two dates (no time of day): their day numbers are
    subtracted, without a timestamp for each side."""
    return F.datediff(_c(end), _c(start)).cast("bigint")


def tenure_months(days, default: int = 0) -> Column:
    """days / 30 truncated toward zero; null -> default."""
    return F.coalesce((_c(days) / F.lit(30.0)).cast("int"), F.lit(default))


def month_or(x, default: int = 1) -> Column:
    return F.coalesce(F.month(_c(x)), F.lit(default))


def quarter_or(x, default: int = 1) -> Column:
    return F.coalesce(F.quarter(_c(x)), F.lit(default))


def weekday_or(x, default: int = 0) -> Column:
    """Day of week with Monday = 0 (``weekday``, not ``dayofweek``)."""
    return F.coalesce(F.weekday(_c(x)), F.lit(default))


def version_stamp(ts) -> Column:
    """Model version stamp yyyyMMdd_HHmmss of an explicit instant."""
    return F.date_format(_c(ts), "yyyyMMdd_HHmmss")
