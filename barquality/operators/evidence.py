"""Occurrences reduced to distribution statistics, one row per finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import MINUTE, Settings
from ..shared import written
from . import cube as cubes
from .cube import AFTER_GAP_MINUTES, FINDING
from .occurrences import GAP_CODES

TOP_HOURS = 3
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def _n(rows: DataFrame) -> Column:
    """How many occurrences rows stand for: one each, or what the cells of a cube have counted."""
    return (F.sum("rows") if "rows" in rows.columns else F.count("*")).alias("n")


def top_hours(rows: DataFrame, by: list[str]) -> DataFrame:
    """The busiest hours per finding with their share, the earlier hour first on ties."""
    counts = rows.groupBy(*by, "hour").agg(_n(rows))
    best = Window.partitionBy(*by).orderBy(F.col("n").desc(), "hour")
    total = F.sum("n").over(Window.partitionBy(*by))
    ranked = counts.withColumn("rank", F.row_number().over(best)).withColumn("share", F.bround(F.col("n") / total, 3))
    return ranked.where(F.col("rank") <= TOP_HOURS).select(*by, "rank", "hour", "n", "share")


def weekday_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by, F.weekday("day").alias("_d")).agg(_n(rows)).select(*by, F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.col("_d") + 1).alias("weekday"), "n")


def durations(rows: DataFrame, by: list[str]) -> DataFrame:
    """Median and 90th percentile (nearest rank) of gap lengths in minutes, from the count of each length."""
    length = F.col("minutes") if "minutes" in rows.columns else F.col("metrics")["gap_minutes"]
    counts = rows.withColumn("m", length).where("m is not null").groupBy(*by, "m").agg(_n(rows))
    upto = F.sum("n").over(Window.partitionBy(*by).orderBy("m"))
    total = F.sum("n").over(Window.partitionBy(*by))

    def at(place: Column) -> Column:
        """The length at a place counted from 0."""
        return F.min(F.when(F.col("upto") > place, F.col("m")))

    t = F.col("total")
    placed = counts.withColumn("upto", upto).withColumn("total", total)
    median = (at(F.floor((t - 1) / 2)) + at(F.ceil((t - 1) / 2))) / 2
    return placed.groupBy(*by).agg(F.bround(median, 1).alias("median_duration_min"), F.bround(at(F.floor((t - 1) * 0.9 + 0.5)), 1).alias("p90_duration_min"))


def periods(rows: DataFrame, by: list[str]) -> DataFrame:
    """Occurrences per week, month or quarter, depending on the span; empty periods are left out."""
    days = rows.groupBy(*by, "day").agg(_n(rows))
    whole = Window.partitionBy(*by)
    span = F.datediff(F.max("day").over(whole), F.min("day").over(whole))
    size = F.when(F.col("span") <= 182, "week").when(F.col("span") <= 1098, "month").otherwise("quarter")
    start = F.when(F.col("period") == "week", F.date_trunc("week", "day")).when(F.col("period") == "month", F.date_trunc("month", "day")).otherwise(F.date_trunc("quarter", "day"))
    return days.withColumn("span", span).withColumn("period", size).groupBy(*by, "period", start.cast("date").alias("start")).agg(F.sum("n").alias("n"))


def share_after_gap(occurrences: DataFrame, resumes: DataFrame, by: list[str]) -> DataFrame:
    """The share of occurrences at most five minutes after a gap of their contract ended.

    Times fall into windows of that length, so the range condition becomes an
    equi-join on a window and the one before it.
    """
    size = AFTER_GAP_MINUTES * 60_000_000
    at = F.unix_micros("ts")
    ends = resumes.select(F.col("contract"), F.unix_micros("resume").alias("r")).distinct()
    ends = ends.withColumn("_w", F.explode(F.array(F.floor(F.col("r") / size), F.floor(F.col("r") / size) + 1)))
    timed = occurrences.withColumn("_us", at).withColumn("_w", F.floor(at / size))
    near = timed.join(ends, ["contract", "_w"]).where((F.col("_us") >= F.col("r")) & (F.col("_us") - F.col("r") <= size)).select("contract", "_us").distinct().withColumn("_near", F.lit(1))
    met = timed.join(near, ["contract", "_us"], "left")
    return met.groupBy(*by).agg(F.bround(F.count("_near") / F.count("*"), 3).alias("share_after_gap"))


dated = cubes.dated


def resumes(occurrences: DataFrame) -> DataFrame:
    """contract, resume: the bars that end gaps."""
    return occurrences.where(F.col("code").isin(*GAP_CODES)).select("contract", F.timestamp_micros(F.col("metrics")["resume_us"].cast("bigint")).alias("resume"))


def scope_of(bars: DataFrame) -> DataFrame:
    return bars.agg(F.count("*").alias("bars_checked"), F.countDistinct("trading_date").alias("trading_days"))


def figures(cube: DataFrame, scope: DataFrame, frequency: str = MINUTE, page: DataFrame | None = None) -> DataFrame:
    """All figures of each finding (contract, code, group) from a written cube.

    ``scope`` is one row, bars_checked and trading_days; ``page`` names the
    findings that are wanted, a bounded number of them.
    """
    by = list(FINDING)
    gapped = cubes.contracts_with_gaps(cube)
    if page is not None:
        cube = cube.join(F.broadcast(page), by, "left_semi")
    found = cubes.seen(cube).withColumn("bars_checked", scope.select("bars_checked").scalar()).withColumn("trading_days", scope.select("trading_days").scalar())
    share = F.when((F.col("days_affected") <= F.col("trading_days")) & (F.col("code") != "missing_sessions"), F.bround(F.col("days_affected") / F.col("trading_days"), 3))
    found = found.withColumn("days_affected_share", share).withColumn("per_1k_bars", F.when(F.col("bars_checked") > 0, F.bround(F.col("occurrences") * 1000 / F.col("bars_checked"), 2)).otherwise(0.0))
    days = weekday_counts(cube, by).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("weekday", "n"))).alias("weekday_counts"))
    trend = periods(cube, by).groupBy(*by).agg(F.first("period").alias("period"), F.array_sort(F.collect_list(F.struct("start", "n"))).alias("period_counts"))
    found = found.join(days, by, "left").join(trend, by, "left").join(durations(cube, by), by, "left")
    if frequency == MINUTE:
        hours = top_hours(cube, by).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", "hour", "n", "share"))).alias("top_hours"))
        near = cube.where(~F.col("code").isin(*GAP_CODES)).groupBy(*by).agg(F.bround(F.sum(F.when(F.col("near"), F.col("rows")).otherwise(0)) / F.sum("rows"), 3).alias("share_after_gap"))
        after = near.join(gapped, "contract", "left_semi")
        found = found.join(hours, by, "left").join(after, by, "left")
    return found


def evidence(occurrences: DataFrame, bars: DataFrame, frequency: str = MINUTE, settings: Settings = Settings()) -> DataFrame:
    """One row per finding with its counts, days, hours, lengths, trend and extremes.

    The rules run once, for the cube, which is written to the shared folder.
    """
    cube = written(cubes.cells(occurrences, frequency, settings), "evidence-cube")
    return figures(cube, scope_of(bars), frequency)
