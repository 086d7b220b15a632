"""Spacing between bars: the gap classifier, missing sessions and missing instants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import iso_weekday, local_date
from ..schema import Settings
from .sequence import since_active, with_previous

MIN_SPACINGS = 10
MIN_SESSIONS = 5
OVERNIGHT_HOURS = 36


def spacings(bars: DataFrame) -> DataFrame:
    """contract, prev_ts, ts, gap_s (whole seconds) between distinct instants since the active start."""
    instants = since_active(bars.select("contract", "ts", "volume")).select("contract", "ts").distinct()
    pairs = with_previous(instants, {"prev_ts": "ts"}).where("prev_ts is not null")
    return pairs.select("contract", "prev_ts", "ts", F.expr("timestampdiff(SECOND, prev_ts, ts)").alias("gap_s"))


def modal_interval(spaced: DataFrame) -> DataFrame:
    """contract, expected_s, n: the most frequent spacing (the smallest on ties) where there are enough."""
    counts = spaced.where("gap_s > 0").groupBy("contract", "gap_s").agg(F.count("*").alias("n"))
    best = counts.groupBy("contract").agg(F.max(F.struct("n", (-F.col("gap_s")).alias("neg"))).alias("m"), F.sum("n").alias("n"))
    return best.where(F.col("n") >= MIN_SPACINGS).select("contract", (-F.col("m.neg")).alias("expected_s"), "n")


def classified(bars: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Every gap: contract, prev_ts, ts, gap_s, expected_s, missing_bars, gap_minutes, code, weekend.

    One pass decides between an expected session break (weekend or overnight),
    an intra-session gap and an extended gap.
    """
    spaced = spacings(bars)
    zone = settings.daily_bar_tz
    gaps = spaced.join(modal_interval(spaced).drop("n"), "contract").where(F.col("gap_s") > F.col("expected_s") * settings.gap_min_multiple)
    before, after = local_date(F.col("prev_ts"), zone), local_date(F.col("ts"), zone)
    gaps = gaps.withColumn("gap_days", F.datediff(after, before))
    weekend = (F.col("gap_days") >= 1) & ((iso_weekday(before) >= 5) | (iso_weekday(after) == 1))
    long = F.col("gap_s") > OVERNIGHT_HOURS * 3600
    code = F.when(F.col("weekend"), "session_break").when(long, "extended_gap").when(F.col("gap_days") >= 1, "session_break").otherwise("intra_session_gap")
    return gaps.withColumn("weekend", weekend).select(
        "contract",
        "prev_ts",
        "ts",
        "gap_s",
        "expected_s",
        (F.floor(F.col("gap_s") / F.col("expected_s")) - 1).alias("missing_bars"),
        F.round(F.col("gap_s") / 60, 1).alias("gap_minutes"),
        code.alias("code"),
        "weekend",
    )


def _absent(bars: DataFrame) -> DataFrame:
    """contract, missing_date, lo, hi: weekdays without a bar between the first and the last session."""
    days = since_active(bars.select("contract", "ts", "volume", "trading_date")).select("contract", "trading_date").distinct()
    spans = days.groupBy("contract").agg(F.min("trading_date").alias("lo"), F.max("trading_date").alias("hi"), F.count("*").alias("n")).where(F.col("n") >= MIN_SESSIONS)
    every = spans.select("contract", "lo", "hi", F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("missing_date"))
    wanted = every.where(iso_weekday(F.col("missing_date")) <= 5)
    return wanted.join(days.withColumnRenamed("trading_date", "missing_date"), ["contract", "missing_date"], "left_anti")


def missing_sessions(bars: DataFrame) -> DataFrame:
    """contract, missing_date: weekdays without a bar between the first and the last session."""
    return _absent(bars).select("contract", "missing_date")


def missing_slices(bars: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """contract, classification, day, first, last, step, n: the absent instants of each gap and exchange date.

    The numbers follow from the ends of a gap and of a day; no instant is made
    here, so counts and totals cost a row per gap and day.
    """
    found = classified(bars, settings).where(F.col("code").isin("intra_session_gap", "extended_gap"))
    kind = F.when(F.col("code") == "intra_session_gap", "intra_session").otherwise("extended")
    step = F.col("expected_s") * 1_000_000
    # a gap below twice the interval skips no instant
    spans = found.select("contract", kind.alias("classification"), (F.unix_micros("prev_ts") + step).alias("lo"), (F.unix_micros("ts") - step).alias("hi"), step.alias("step")).where("lo <= hi")
    zone = settings.daily_bar_tz
    days = F.sequence(local_date(F.timestamp_micros("lo"), zone), local_date(F.timestamp_micros("hi"), zone), F.expr("interval 1 day"))
    cut = spans.withColumn("day", F.explode(days))

    def midnight(day) -> Column:
        return F.unix_micros(F.to_utc_timestamp(day.cast("timestamp"), zone))

    lo, size = F.col("lo"), F.col("step")
    skipped = F.greatest(F.ceil((midnight(F.col("day")) - lo) / size), F.lit(0))
    last = F.floor((F.least(F.col("hi"), midnight(F.date_add("day", 1)) - 1) - lo) / size)
    placed = cut.withColumns({"_skipped": skipped, "_last": last}).where("_last >= _skipped")
    return placed.select("contract", "classification", "day", F.timestamp_micros(lo + F.col("_skipped") * size).alias("first"), F.timestamp_micros(lo + F.col("_last") * size).alias("last"), "step", (F.col("_last") - F.col("_skipped") + 1).alias("n"))


def expanded(slices: DataFrame) -> DataFrame:
    """contract, ts, classification of each instant in the slices; an array holds a day at most."""
    step = F.make_dt_interval(secs=F.col("step") / 1_000_000)
    return slices.select("contract", F.explode(F.sequence("first", "last", step)).alias("ts"), "classification")


def missing_instants(bars: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """contract, ts, classification: the instants that intra-session and extended gaps skip."""
    return expanded(missing_slices(bars, settings))


def missing_by_date(bars: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """contract, day, n: absent instants per exchange date, counted without making them."""
    return missing_slices(bars, settings).groupBy("contract", "day").agg(F.sum("n").alias("n"))


def missing_daily(bars: DataFrame) -> DataFrame:
    """contract, ts (UTC midnight), label (ISO date), classification of each missing session, and the sessions it lies between (lo, hi)."""
    return _absent(bars).select(
        "contract", F.col("missing_date").cast("timestamp").alias("ts"), F.date_format("missing_date", "yyyy-MM-dd").alias("label"), F.lit("missing_session").alias("classification"), "lo", "hi"
    )
