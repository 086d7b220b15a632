"""The canonical bar, the audit tables and the settings."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import types as T

MINUTE, DAILY = "minute", "daily"
FREQUENCIES = (MINUTE, DAILY)
OHLC = ("open", "high", "low", "close")
KEY = ("contract", "frequency", "ts")

BARS = T.StructType(
    [
        T.StructField("contract", T.StringType()),
        T.StructField("root", T.StringType()),
        T.StructField("exchange", T.StringType()),
        T.StructField("frequency", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("trading_date", T.DateType()),
        *[T.StructField(c, T.DoubleType()) for c in OHLC],
        T.StructField("volume", T.LongType()),
        T.StructField("open_interest", T.LongType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("row_hash", T.StringType()),
        T.StructField("ingested_at", T.TimestampType()),
    ]
)
BAR_COLUMNS = tuple(BARS.fieldNames())
REJECTED = T.StructType([T.StructField(n, t) for n, t in (("run_id", T.StringType()), ("source_file", T.StringType()), ("row_number", T.LongType()), ("reason", T.StringType()))])
SUPERSEDED = T.StructType(
    [T.StructField("run_id", T.StringType()), T.StructField("reason", T.StringType()), T.StructField("winning_row_hash", T.StringType()), *BARS.fields, T.StructField("superseded_at", T.TimestampType())]
)
RUNS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("frequency", T.StringType()),
        T.StructField("rows_read", T.LongType()),
        T.StructField("rows_new", T.LongType()),
        T.StructField("rows_rejected", T.LongType()),
        T.StructField("rows_deduplicated", T.LongType()),
        T.StructField("rows_superseded", T.LongType()),
        T.StructField("contracts", T.ArrayType(T.StringType())),
        T.StructField("ingested_at", T.TimestampType()),
    ]
)

#: Rank of a severity; reports put the highest first.
SEVERITIES = {"info": 0, "warning": 1, "error": 2}

#: Category and severity (minute, daily) of every finding code.
CODES: dict[str, tuple[str, str, str]] = {
    "exact_duplicate": ("duplicate", "error", "error"),
    "conflicting_duplicate": ("conflict", "error", "error"),
    "repeated_timestamp": ("duplicate", "warning", "warning"),
    "resolved_instant_conflict": ("conflict", "warning", "warning"),
    "intra_session_gap": ("gap", "warning", "warning"),
    "extended_gap": ("gap", "warning", "warning"),
    "session_break": ("gap", "info", "info"),
    "missing_sessions": ("gap", "warning", "warning"),
    "price_return_outlier": ("outlier", "warning", "warning"),
    "volume_spike": ("outlier", "info", "info"),
    "high_lt_low": ("invalid_value", "error", "error"),
    "open_out_of_range": ("invalid_value", "error", "warning"),
    "close_out_of_range": ("invalid_value", "error", "info"),
    "non_positive_price": ("invalid_value", "error", "error"),
    "non_finite_price": ("invalid_value", "error", "error"),
    "negative_volume": ("invalid_value", "error", "error"),
    "missing_volume": ("invalid_value", "warning", "warning"),
}


def severity_of(code: str, frequency: str) -> str:
    return CODES[code][1 if frequency == MINUTE else 2]


@dataclass(frozen=True)
class Settings:
    """What the user may tune; ``from_environment`` takes values from variables named ``BARQUALITY_`` and the setting."""

    vwap_window_minutes: int = 15
    source_tz: str = "America/Chicago"
    daily_bar_tz: str = "America/Chicago"
    outlier_mad_threshold: float = 8.0
    volume_spike_threshold: float = 20.0
    gap_min_multiple: float = 1.5
    detail_cap: int = 500
    #: Findings of an evidence pack that come to the driver at a time.
    pack_limit: int = 500

    @classmethod
    def from_environment(cls, environment: Mapping[str, str] = os.environ) -> Settings:
        named = {f.name: environment.get(f"BARQUALITY_{f.name.upper()}") for f in fields(cls)}
        return cls(**{name: type(getattr(cls, name))(value) for name, value in named.items() if value is not None})
