"""All findings of all rules in one shape: one row per occurrence."""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import CODES, DAILY, MINUTE, OHLC, Settings
from . import duplicates, gaps, outliers, values

GAP_CODES = ("intra_session_gap", "extended_gap", "session_break")
#: Columns: group names the issue inside a contract and code (only exact duplicates have several),
#: weight is what the row adds to the issue's count, metrics are its figures.
COLUMNS = ("contract", "code", "group", "ts", "end_ts", "label", "weight", *OHLC, "volume", "metrics", "notes")


def _shaped(rows: DataFrame, code: Column, *, group: Column | None = None, end: Column | None = None, label: Column | None = None, weight: Column | None = None, metrics: dict[str, Column] | None = None, notes: dict[str, Column] | None = None) -> DataFrame:
    def figures(of: dict[str, Column] | None, kind: str) -> Column:
        pairs = [x for k, v in (of or {}).items() for x in (F.lit(k), v.cast(kind))]
        return F.create_map(*pairs) if pairs else F.lit(None).cast(f"map<string,{kind}>")

    def kept(name: str, kind: str) -> Column:
        return (F.col(name) if name in rows.columns else F.lit(None)).cast(kind).alias(name)

    return rows.select(
        "contract",
        code.alias("code"),
        (group if group is not None else F.lit(None)).cast("string").alias("group"),
        F.col("ts").cast("timestamp").alias("ts"),
        (end if end is not None else F.lit(None)).cast("timestamp").alias("end_ts"),
        (label if label is not None else F.lit(None)).cast("string").alias("label"),
        (weight if weight is not None else F.lit(1)).cast("bigint").alias("weight"),
        *[kept(n, "double") for n in OHLC],
        kept("volume", "bigint"),
        figures(metrics, "double").alias("metrics"),
        figures(notes, "string").alias("notes"),
    )


def of_bars(
    bars: DataFrame, frequency: str = MINUTE, settings: Settings = Settings(), superseded: DataFrame | None = None, ordinal: str | None = None, codes: Collection[str] | None = None
) -> DataFrame:
    """The occurrences of every rule over all contracts of one frequency; with ``codes``, only rules that find these are run."""
    if ordinal is None:
        # stored bars have no order of arrival; any fixed one will do
        bars, ordinal = bars.withColumn("_order", F.xxhash64("row_hash", "source_file")), "_order"
    c = F.col

    def duplicate():
        return _shaped(duplicates.exact_duplicates(bars, ordinal), F.lit("exact_duplicate"), group=c("row_hash"), end=c("end_ts"), weight=c("copies") - 1, metrics={"copies": c("copies")}, notes={"row_hash": c("row_hash")})

    def repeated():
        return _shaped(duplicates.repeated_instants(bars, ordinal), F.when(c("variants") > 1, "conflicting_duplicate").otherwise("repeated_timestamp"), metrics={"rows": c("rows"), "variants": c("variants")})

    def jumps():
        return _shaped(outliers.price_return_outliers(bars, settings), F.lit("price_return_outlier"), metrics={"log_return": c("log_return"), "mad_score": c("mad_score")})

    def spikes():
        return _shaped(outliers.volume_spikes(bars, settings), F.lit("volume_spike"), metrics={"local_median": c("local_median"), "x_median": c("x_median")})

    def restated():
        return _shaped(superseded, F.lit("resolved_instant_conflict"), notes={"reason": c("reason")})

    def spaced():
        step = F.make_dt_interval(secs=c("expected_s"))
        found = gaps.classified(bars, settings).withColumns({"_from": c("prev_ts") + step, "_to": c("ts") - step, "_resume": c("ts")}).drop("ts").withColumnRenamed("_from", "ts")
        seconds = {"missing_bars": c("missing_bars"), "gap_minutes": c("gap_minutes"), "gap_s": c("gap_s"), "expected_s": c("expected_s")}
        return _shaped(found, c("code"), end=c("_to"), metrics=seconds | {"resume_us": F.unix_micros("_resume"), "prev_us": F.unix_micros("prev_ts"), "weekend": c("weekend").cast("int")})

    rules = {
        ("exact_duplicate",): duplicate,
        ("conflicting_duplicate", "repeated_timestamp"): repeated,
        ("price_return_outlier",): jumps,
        ("volume_spike",): spikes,
        tuple(values.TEXT): lambda: _shaped(values.invalid_values(bars, frequency), c("code")),
    }
    if superseded is not None:
        rules["resolved_instant_conflict",] = restated
    if frequency == MINUTE:
        rules[GAP_CODES] = spaced
    if frequency == DAILY:
        rules["missing_sessions",] = lambda: _shaped(gaps.missing_daily(bars), F.lit("missing_sessions"), label=c("label"), metrics={"prev_us": F.unix_micros(c("lo").cast("timestamp")), "resume_us": F.unix_micros(c("hi").cast("timestamp"))})
    wanted = set(CODES) if codes is None else set(codes)
    parts = [rule() for found, rule in rules.items() if wanted.intersection(found)]
    every = reduce(DataFrame.unionByName, parts) if parts else _shaped(bars.where("false"), F.lit(None).cast("string"))
    return every if codes is None else every.where(c("code").isin(*wanted))


def severity(frequency: str) -> Column:
    pairs = [F.lit(x) for code, v in CODES.items() for x in (code, v[1 if frequency == MINUTE else 2])]
    return F.create_map(*pairs)[F.col("code")]


def category() -> Column:
    return F.create_map(*[F.lit(x) for code, v in CODES.items() for x in (code, v[0])])[F.col("code")]
