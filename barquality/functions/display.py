"""Formatting of figures; a null shows as a dash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "—"


def price(value: Column) -> Column:
    """Up to four decimals, at least two."""
    full = F.format_number(value, 4)
    return F.coalesce(F.regexp_replace(full, r"(\.\d{2}\d*?)0+$", "$1"), F.lit(DASH))


def count(value: Column) -> Column:
    return F.coalesce(F.format_number(value, 0), F.lit(DASH))


def signed_percent(value: Column) -> Column:
    # format_string would write a null as text
    return F.when(value.isNotNull(), F.format_string("%+.2f%%", value)).otherwise(DASH)


def candle(open_: Column, close: Column) -> Column:
    """Down only when the close is below the open."""
    return F.when(close < open_, "down").otherwise("up")
