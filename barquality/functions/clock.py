"""Time zones, dates and parsing of timestamps.

Session time is UTC, so a timestamp and its UTC wall clock read alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DATE = r"^\s*\d{4}-\d{2}-\d{2}\s*$"
_INSTANT = r"^\s*\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?\s*$"
_INTEGER = r"^\s*[+-]?\d+\s*$"
_NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$|^\s*[+-]?(inf|Infinity|NaN|nan)\s*$"


def to_naive(column: Column) -> Column:
    """A wall clock from a timestamp, a date or ISO text; null where it does not parse."""
    text = column.cast("string")
    return F.when(text.rlike(_INSTANT) | text.rlike(_DATE), F.trim(text).try_cast("timestamp_ntz"))


def to_day(column: Column) -> Column:
    text = column.cast("string")
    return F.coalesce(F.when(text.rlike(_DATE), F.trim(text).try_cast("date")), to_naive(column).cast("date"))


def to_double(column: Column) -> Column:
    text = F.trim(column.cast("string"))
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def to_long(column: Column) -> Column:
    text = F.trim(column.cast("string"))
    return F.when(text.rlike(_INTEGER), text.try_cast("bigint"))


def epoch_millis(column: Column) -> Column:
    return F.timestamp_millis(to_long(column))


def stamped_utc(naive: Column) -> Column:
    """A wall clock that is UTC already, as an instant."""
    return naive.cast("timestamp")


def localised(naive: Column, zone: str) -> Column:
    """The instant of a wall clock in ``zone``; null where it never was or was twice."""
    utc = F.convert_timezone(F.lit(zone), F.lit("UTC"), naive)

    def back(at: Column) -> Column:
        return F.convert_timezone(F.lit("UTC"), F.lit(zone), at)

    hour = F.expr("interval 1 hour")
    exists = back(utc) == naive
    twice = (back(utc + hour) == naive) | (back(utc - hour) == naive)
    return F.when(exists & ~twice, utc.cast("timestamp"))


def wall(ts: Column, zone: str) -> Column:
    """The wall clock of an instant in ``zone``."""
    return F.from_utc_timestamp(ts, zone)


def local_date(ts: Column, zone: str) -> Column:
    return F.to_date(wall(ts, zone))


def iso_weekday(day: Column) -> Column:
    """1 for Monday to 7 for Sunday."""
    return F.weekday(day) + 1


def wall_seconds(ts: Column, zone: str) -> Column:
    """Seconds since 1970 of the wall clock, as charts use them."""
    return F.unix_seconds(wall(ts, zone))


def exchange_datetime(ts: Column, zone: str) -> Column:
    """Day/month/year and time of day in exchange time."""
    return F.date_format(wall(ts, zone), "dd/MM/yyyy, HH:mm:ss")


def exchange_clock(ts: Column, zone: str) -> Column:
    return F.date_format(wall(ts, zone), "HH:mm")
