"""Single-row checks: one pass over the bars, one row per bar and broken check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import MINUTE, OHLC


def predicates(frequency: str = MINUTE) -> dict[str, Column]:
    """The condition of every single-row code."""
    c = {n: F.col(n) for n in (*OHLC, "volume")}
    infinite = [F.isnan(c[n]) | (F.abs(c[n]) == float("inf")) for n in OHLC]
    checks = {
        "high_lt_low": c["high"] < c["low"],
        "open_out_of_range": (c["open"] > c["high"]) | (c["open"] < c["low"]),
        "close_out_of_range": (c["close"] > c["high"]) | (c["close"] < c["low"]),
        "non_positive_price": F.least(*[c[n] for n in OHLC]) <= 0,
        "non_finite_price": infinite[0] | infinite[1] | infinite[2] | infinite[3],
        "negative_volume": c["volume"] < 0,
    }
    if frequency == MINUTE:
        checks["missing_volume"] = c["volume"].isNull()
    return checks


#: What a finding of each code says about its bars.
TEXT = {
    "high_lt_low": "high < low",
    "open_out_of_range": "open outside [low, high]",
    "close_out_of_range": "close outside [low, high]",
    "non_positive_price": "price <= 0",
    "non_finite_price": "non-finite price (inf/nan)",
    "negative_volume": "negative volume",
    "missing_volume": "minute bar with no volume",
}
#: Fixed value: what it says besides of daily bars.
DAILY_TEXT = {"close_out_of_range": " (settlement prints legitimately do this)"}


def invalid_values(bars: DataFrame, frequency: str = MINUTE) -> DataFrame:
    """contract, ts, code and the prices of every bar and check it breaks."""
    broken = F.array_compact(F.array(*[F.when(p, F.lit(code)) for code, p in predicates(frequency).items()]))
    return bars.select("contract", "ts", *OHLC, "volume", broken.alias("codes")).where(F.size("codes") > 0).select("contract", "ts", *OHLC, "volume", F.explode("codes").alias("code"))
