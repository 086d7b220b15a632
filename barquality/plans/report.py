"""Quality reports: findings, their order, capped samples and pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import local_date
from ..operators import gaps, occurrences
from ..operators.values import DAILY_TEXT, TEXT
from ..schema import DAILY, MINUTE, SEVERITIES, Settings
from . import paging


#: What a finding of each code says; names in braces are columns of ``_figures``.
MESSAGES = {
    "exact_duplicate": "{copies} byte-identical rows for {contract}",
    "conflicting_duplicate": "{count} timestamps with conflicting OHLCV values for {contract}",
    "repeated_timestamp": "{count} timestamps repeated with identical values for {contract}",
    "resolved_instant_conflict": "{count} timestamps had conflicting OHLCV values for {contract}; the latest row was kept and the rest are in superseded_bars",
    "intra_session_gap": "{count} intra-session gaps (~{missing} missing {expected}s bars) for {contract}",
    "extended_gap": "{count} multi-day gaps for {contract} (holiday or data outage)",
    "session_break": "{count} expected session breaks (overnight/weekend) for {contract}",
    "missing_sessions": "{count} business days with no bar for {contract} between {lo} and {hi} (some are exchange holidays)",
    "price_return_outlier": "{count} bar(s) with an extreme close-to-close return for {contract}",
    "volume_spike": "{count} bar(s) with volume >{factor}x the local median for {contract}",
} | {code: "{count} bar(s): " + text for code, text in TEXT.items()}
#: Examples that a finding shows.
EXAMPLES = 5


def _message(figures: dict[str, Column], frequency: str) -> Column:
    out = F.lit(None).cast("string")
    for code, text in MESSAGES.items():
        text += DAILY_TEXT.get(code, "") if frequency == DAILY else ""
        # names and texts take turns
        pieces = [F.lit(x) if i % 2 == 0 else figures[x].cast("string") for i, x in enumerate(re.split(r"[{}]", text)) if x]
        out = F.when(F.col("code") == code, F.concat(*pieces)).otherwise(out)
    return out


def _instant(ts: Column) -> Column:
    """An instant as text, with its zone, and with microseconds only where it has some."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.when(F.unix_micros(ts) % 1_000_000 != 0, F.date_format(ts, ".SSSSSS")).otherwise(""), F.lit("+00:00"))


def findings(occ: DataFrame, frequency: str = MINUTE, settings: Settings = Settings()) -> DataFrame:
    """One row per contract, code and group: category, severity, count, span, message, context.

    ``context`` is a struct of the figures that codes state about themselves,
    null where a code does not (``context_json`` leaves those out).  Instants of
    resolved conflicts count once however often they were restated.  All of it
    comes from one aggregation of bounded state: examples are dates of a calendar.
    """
    m, code = F.col("metrics"), F.col("code")
    grouped = occ.groupBy("contract", "code", "group").agg(
        F.sum("weight").alias("_weight"),
        F.countDistinct(F.when(code == "resolved_instant_conflict", F.col("ts"))).alias("_instants"),
        F.count("*").alias("detail_total"),
        F.min("ts").alias("_start"),
        F.max(F.coalesce("end_ts", "ts")).alias("_end"),
        F.timestamp_micros(F.min(m["prev_us"]).cast("bigint")).alias("_lo"),
        F.timestamp_micros(F.max(m["resume_us"]).cast("bigint")).alias("_hi"),
        F.max(m["expected_s"]).cast("bigint").alias("_expected"),
        F.max(m["gap_s"]).cast("bigint").alias("_largest"),
        F.floor(F.sum(m["gap_s"] / m["expected_s"] - 1)).cast("bigint").alias("_missing"),
        F.sum(m["weekend"]).cast("bigint").alias("_weekend"),
        F.max(F.abs(m["log_return"])).alias("_return"),
        F.sort_array(F.collect_set(F.col("notes")["reason"])).alias("_reasons"),
        F.slice(F.sort_array(F.collect_set("label")), 1, EXAMPLES).alias("_labels"),
    )
    count = F.when(code == "resolved_instant_conflict", F.col("_instants")).otherwise(F.col("_weight"))
    shown = grouped.withColumns({"count": count, "category": occurrences.category(), "severity": occurrences.severity(frequency)})
    c = F.col
    figures = {
        "count": c("count"), "contract": c("contract"), "copies": c("_weight") + 1, "missing": c("_missing"), "expected": c("_expected"), "lo": F.to_date("_lo"), "hi": F.to_date("_hi"), "factor": F.lit(float(settings.volume_spike_threshold)),
    }
    stated = {
        "expected_interval_s": (c("_expected"), "intra_session_gap"), "largest_gap_s": (c("_largest"), "intra_session_gap"), "estimated_missing_bars": (c("_missing"), "intra_session_gap"),
        "largest_gap_days": (F.round(c("_largest") / 86400, 1), "extended_gap"), "weekend": (c("_weekend"), "session_break"), "overnight": (c("count") - c("_weekend"), "session_break"),
        "mad_threshold": (F.lit(float(settings.outlier_mad_threshold)), "price_return_outlier"), "max_abs_return": (F.round("_return", 5), "price_return_outlier"),
        "discarded_rows": (c("detail_total"), "resolved_instant_conflict"), "example_ts": (_instant(c("_start")), "conflicting_duplicate", "resolved_instant_conflict", *TEXT),
        "reasons": (c("_reasons"), "resolved_instant_conflict"), "examples": (c("_labels"), "missing_sessions"),
    }
    context = F.struct(*[F.when(code.isin(*codes), figure).alias(name) for name, (figure, *codes) in stated.items()])
    spans, hidden = code.isin("intra_session_gap", "extended_gap", "missing_sessions"), code == "session_break"
    return shown.withColumn("context", context).select(
        "contract", "code", "group", "category", "severity", "count", "detail_total", _message(figures, frequency).alias("message"),
        F.when(spans, c("_lo")).when(~hidden, c("_start")).alias("start_ts"), F.when(spans, c("_hi")).when(~hidden, c("_end")).alias("end_ts"), "context", F.to_json("context").alias("context_json"),
    )


def rank(severity: str = "severity") -> Column:
    return F.create_map(*[F.lit(x) for kv in SEVERITIES.items() for x in kv])[F.col(severity)]


def ordered(found: DataFrame) -> DataFrame:
    """Report order: severity, category, contract, code."""
    return found.orderBy(rank().desc(), "category", "contract", "code", F.coalesce("group", F.lit("")))


def severity_tally(found: DataFrame) -> DataFrame:
    return found.groupBy("severity").agg(F.sum("count").alias("count"), F.count("*").alias("issues"))


def errors(found: DataFrame) -> DataFrame:
    return found.where("severity = 'error'")


def samples(occ: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` occurrences of each finding in time, with the true total."""
    by = Window.partitionBy("contract", "code", "group")
    numbered = occ.withColumn("_n", F.row_number().over(by.orderBy("ts", F.coalesce("label", F.lit("")))))
    first = numbered.where(F.col("_n") <= cap)
    totals = occ.groupBy("contract", "code", "group").agg(F.count("*").alias("detail_total"))
    met = first.join(totals, [first["contract"].eqNullSafe(totals["contract"]), first["code"] == totals["code"], first["group"].eqNullSafe(totals["group"])])
    return met.select(*[first[c] for c in occ.columns], "detail_total", (F.col("detail_total") > cap).alias("truncated"))


def issue_details(occ: DataFrame, code: str, limit: int = 100, offset: int = 0) -> tuple[int, DataFrame]:
    """(total, page) of one code's occurrences; an unknown code has an empty page."""
    _checked(limit, 1000, offset)
    return paging.page(occ.where(F.col("code") == code), [F.coalesce("group", F.lit(""))], limit, offset)


def missing_timestamps(bars: DataFrame, frequency: str = MINUTE, limit: int = 2000, offset: int = 0, settings: Settings = Settings()) -> tuple[int, DataFrame]:
    """(total, page) of absent instants; of minutes only those of the page are made."""
    _checked(limit, 20_000, offset)
    if frequency == DAILY:
        total, found = paging.page(gaps.missing_daily(bars), [], limit, offset)
    else:
        total, found = paging.slice_page(gaps.missing_slices(bars, settings), gaps.expanded, limit, offset)
        found = found.withColumn("label", F.lit(None).cast("string"))
    return total, found.select("contract", "ts", "label", "classification")


def by_exchange_date(missing: DataFrame, zone: str = "America/Chicago") -> DataFrame:
    """Absent instants per exchange-local date."""
    day = F.coalesce(F.col("label").try_cast("date"), local_date(F.col("ts"), zone))
    return missing.groupBy("contract", day.alias("day")).agg(F.count("*").alias("n"))


def detail_columns(occ: DataFrame) -> DataFrame:
    """code, position, name: the figures that the details of each code have, in the order in which they are first seen.

    A name stands where the smallest (time, place in its row) has it: a minimum
    per name, not an order of rows.
    """
    names = F.array_distinct(F.concat(F.coalesce(F.map_keys("metrics"), F.array()), F.coalesce(F.map_keys("notes"), F.array())))
    keys = occ.select("code", "ts", F.posexplode(names).alias("place", "name"))
    first = keys.groupBy("code", "name").agg(F.min(F.struct("ts", "place")).alias("seen"))
    return first.select("code", F.row_number().over(Window.partitionBy("code").orderBy("seen", "name")).alias("position"), "name")


def _checked(limit: int, most: int, offset: int) -> None:
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be from 1 to {most}")
    if offset < 0:
        raise ValueError("offset must not be negative")
