"""The count cube: occurrences counted once per finding, day, hour, length and nearness to a gap.

Every figure of the evidence is a sum, a minimum or a maximum over cells of the
cube, so the rules run once, whatever is asked afterwards.  A cell is made by
partial aggregation; a finding has at most as many cells as its calendar has
hours times its different gap lengths, and never more than it has occurrences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import local_date, wall
from ..schema import MINUTE, Settings
from .occurrences import GAP_CODES

AFTER_GAP_MINUTES = 5
FINDING = ("contract", "code", "group")
#: The figure that says how extreme an occurrence is.
MAGNITUDE = {"price_return_outlier": "mad_score", "volume_spike": "x_median"}
_SPAN = AFTER_GAP_MINUTES * 60_000_000


def magnitude(code: Column, metrics: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, key in MAGNITUDE.items():
        out = F.when(code == name, metrics[key]).otherwise(out)
    return out


def dated(occurrences: DataFrame, frequency: str = MINUTE, settings: Settings = Settings()) -> DataFrame:
    """Occurrences with the day and hour they belong to: exchange time for minutes, the session date for days."""
    if frequency == MINUTE:
        return occurrences.withColumn("day", local_date(F.col("ts"), settings.daily_bar_tz)).withColumn("hour", F.hour(wall(F.col("ts"), settings.daily_bar_tz)))
    return occurrences.withColumn("day", F.to_date("ts")).withColumn("hour", F.lit(None).cast("int"))


def near_gaps(rows: DataFrame) -> DataFrame:
    """Adds ``near``: whether a gap of the contract ended at most five minutes before ``ts``.

    Each row goes to the window of its time, and the end of a gap also to the
    window after its own, so one pass over a window (the latest end so far)
    answers for all its rows; nothing is joined and no contract is one group.
    """
    us, end = F.unix_micros("ts"), F.col("resume_us").cast("bigint")
    own = F.struct(F.lit(False).alias("ends"), us.alias("us"), F.floor(us / _SPAN).alias("slot"))
    ends = [F.struct(F.lit(True).alias("ends"), end.alias("us"), (F.floor(end / _SPAN) + i).alias("slot")) for i in (0, 1)]
    spread = rows.withColumn("_p", F.explode(F.when(end.isNotNull(), F.array(own, *ends)).otherwise(F.array(own))))
    upto = Window.partitionBy("contract", F.col("_p.slot")).orderBy(F.col("_p.us")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.max(F.when(F.col("_p.ends"), F.col("_p.us"))).over(upto)
    met = spread.withColumn("near", F.coalesce(F.col("_p.us") - last <= _SPAN, F.lit(False)))
    return met.where(~F.col("_p.ends")).withColumn("slot", F.col("_p.slot")).drop("_p")


def cells(occurrences: DataFrame, frequency: str = MINUTE, settings: Settings = Settings()) -> DataFrame:
    """FINDING, day, hour, minutes, near: rows, weight, instants, first, last, start, end, magnitude, expected_s.

    ``rows`` counts occurrences, ``weight`` what they add to the finding's
    count, ``instants`` distinct instants.  ``start`` and ``end`` are the bars on
    both sides of a gap.
    """
    metrics = F.col("metrics")
    narrow = occurrences.where("ts is not null").select(
        "contract", "code", F.coalesce("group", F.lit("")).alias("group"), "ts", "end_ts", "weight",
        metrics["gap_minutes"].alias("minutes"), metrics["expected_s"].cast("bigint").alias("expected_s"), metrics["resume_us"].alias("resume_us"), metrics["prev_us"].alias("prev_us"),
        magnitude(F.col("code"), metrics).alias("magnitude"),
    )
    placed = near_gaps(narrow) if frequency == MINUTE else narrow.withColumns({"near": F.lit(False), "slot": F.lit(0)})
    place = [*FINDING, "minutes", "near"]
    # the rows of an instant lie together already, so its aggregate needs no shuffle of its own
    by_instant = placed.groupBy("contract", "slot", *[c for c in place if c != "contract"], "ts").agg(
        F.count("*").alias("rows"), F.sum("weight").alias("weight"), F.max(F.coalesce("end_ts", "ts")).alias("last"), F.min("prev_us").alias("start"), F.max("resume_us").alias("end"),
        F.max("magnitude").alias("magnitude"), F.max("expected_s").alias("expected_s"),
    )
    by_cell = dated(by_instant, frequency, settings).groupBy(*FINDING, "day", "hour", "minutes", "near")
    return by_cell.agg(
        F.sum("rows").alias("rows"), F.sum("weight").alias("weight"), F.count("*").alias("instants"), F.min("ts").alias("first"), F.max("ts").alias("latest"), F.max("last").alias("last"),
        F.timestamp_micros(F.min("start").cast("bigint")).alias("start"), F.timestamp_micros(F.max("end").cast("bigint")).alias("end"), F.max("magnitude").alias("magnitude"), F.max("expected_s").alias("expected_s"),
    )


def _is_gap() -> Column:
    return F.col("code").isin(*GAP_CODES)


def contracts_with_gaps(cube: DataFrame) -> DataFrame:
    return cube.where(_is_gap()).select("contract").distinct()


def seen(cube: DataFrame) -> DataFrame:
    """Per finding its count, rows, span, days, extreme and expected interval.

    A restated instant counts once however often it was restated; gaps span
    from the bar before the first to the bar after the last and missing sessions
    the sessions that were searched, but session breaks state no span.
    """
    spans = F.col("code").isin("intra_session_gap", "extended_gap", "missing_sessions")
    grouped = cube.groupBy(*FINDING).agg(
        F.sum("weight").alias("_weight"), F.sum("instants").alias("_instants"), F.sum("rows").alias("analysed"),
        F.min("first").alias("_first"), F.max("latest").alias("_latest"), F.max("last").alias("_last"), F.min("start").alias("_start"), F.max("end").alias("_end"),
        F.countDistinct("day").alias("days_affected"), F.bround(F.max("magnitude"), 1).alias("max_magnitude"), F.max("expected_s").alias("expected_interval_s"),
    )
    return grouped.select(
        *FINDING, F.when(F.col("code") == "resolved_instant_conflict", F.col("_instants")).otherwise(F.col("_weight")).alias("occurrences"), "analysed",
        F.when(spans, F.col("_start")).otherwise(F.col("_first")).alias("first_seen"), F.when(spans, F.col("_end")).when(_is_gap(), F.col("_latest")).otherwise(F.col("_last")).alias("last_seen"),
        "days_affected", "max_magnitude", "expected_interval_s",
    )
