"""Daily bars, rolling VWAP, catalogue, chart and header figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import wall_seconds
from ..schema import OHLC


def _first_by(value: str, order: Column) -> Column:
    return F.min_by(value, F.when(F.col(value).isNotNull(), order))


def _last_by(value: str, order: Column) -> Column:
    return F.max_by(value, F.when(F.col(value).isNotNull(), order))


def daily_ohlcv(bars: DataFrame) -> DataFrame:
    """One row per contract and trading date.

    First non-null open and last non-null close in time, extremes without NaN,
    volume with nulls as 0, the last open interest and the number of bars.
    One aggregation, combined before the shuffle.
    """
    high = F.max(F.when(~F.isnan("high"), F.col("high")))
    low = F.min(F.when(~F.isnan("low"), F.col("low")))
    return bars.groupBy("contract", "trading_date").agg(
        _first_by("open", F.col("ts")).alias("open"),
        high.alias("high"),
        low.alias("low"),
        _last_by("close", F.col("ts")).alias("close"),
        F.coalesce(F.sum("volume"), F.lit(0)).alias("volume"),
        _last_by("open_interest", F.col("ts")).alias("open_interest"),
        F.count("*").alias("bar_count"),
    )


def daily_passthrough(bars: DataFrame) -> DataFrame:
    """Vendor daily bars in the shape of ``daily_ohlcv``."""
    return bars.select("contract", "trading_date", *OHLC, F.coalesce("volume", F.lit(0)).alias("volume"), "open_interest", F.lit(1).cast("bigint").alias("bar_count"))


def rolling_vwap(bars: DataFrame, window_minutes: int = 15) -> DataFrame:
    """VWAP of the typical price over ``(ts - window, ts]`` per contract; one row per bar.

    Null unless the volume in the window is positive.  The window is split by
    day with the tail of the day before, so one long contract is many tasks.
    """
    if not 1 <= window_minutes <= 1440:
        raise ValueError("window_minutes must be from 1 to 1440")
    micros = F.unix_micros("ts")
    day = F.floor(micros / 86_400_000_000)
    size = window_minutes * 60_000_000
    base = bars.select("contract", "ts", *OHLC[1:], "volume").withColumn("_at", micros).withColumn("_day", day)
    # a bar also counts for the next day when a window there can reach it
    reaches = F.floor((F.col("_at") + size - 1) / 86_400_000_000) > F.col("_day")
    copies = base.withColumn("_for", F.explode(F.when(reaches, F.array(F.col("_day"), F.col("_day") + 1)).otherwise(F.array(F.col("_day")))))
    frame = Window.partitionBy("contract", "_for").orderBy("_at").rangeBetween(-(size - 1), 0)
    volume = F.coalesce(F.col("volume"), F.lit(0))
    value = (F.col("high") + F.col("low") + F.col("close")) / 3 * volume
    total = F.sum(volume).over(frame)
    vwap = F.when(total > 0, F.sum(value).over(frame) / total)
    return copies.withColumn("vwap", vwap).withColumn("window_volume", total).where("_for = _day").select("contract", "ts", "close", "volume", "vwap", "window_volume")


def latest(points: DataFrame, limit: int) -> DataFrame:
    """The last ``limit`` points by contract and time, with the total and whether some were cut."""
    total = points.agg(F.count("*"))
    top = points.orderBy(F.col("contract").desc(), F.col("ts").desc()).limit(limit)
    return top.withColumn("total_points", total.scalar()).withColumn("truncated", F.col("total_points") > limit)


def catalogue(bars: DataFrame) -> DataFrame:
    """Contracts and frequencies with their dates and numbers of bars."""
    return bars.groupBy("contract", "frequency").agg(
        F.min("root").alias("root"), F.min("exchange").alias("exchange"), F.min("trading_date").alias("first_date"), F.max("trading_date").alias("last_date"), F.count("*").alias("bar_count")
    )


def scan(bars: DataFrame, frequency: str, contract: str | None = None, start=None, end=None) -> DataFrame:
    """Bars of a frequency, a contract (empty: all) and inclusive trading dates."""
    out = bars.where(F.col("frequency") == frequency)
    if contract:
        out = out.where(F.col("contract") == contract)
    if start is not None:
        out = out.where(F.col("trading_date") >= F.lit(start).cast("date"))
    if end is not None:
        out = out.where(F.col("trading_date") <= F.lit(end).cast("date"))
    return out


def default_range(catalog: DataFrame) -> DataFrame:
    """The dates a chart opens with: the last 30 days of minutes or 365 of days."""
    back = F.when(F.col("frequency") == "minute", 30).otherwise(365)
    return catalog.select("contract", "frequency", F.greatest(F.date_sub("last_date", back), F.col("first_date")).alias("start"), F.col("last_date").alias("end"))


def range_change(daily: DataFrame) -> DataFrame:
    """Per contract: change in percent from the first to the last close, last close, total volume."""
    day = F.col("trading_date")
    first, last = _first_by("close", day), _last_by("close", day)
    change = F.when((F.count("close") >= 2) & (first != 0), (last - first) / first * 100)
    return daily.groupBy("contract").agg(change.alias("change_pct"), F.max_by("close", "trading_date").alias("last_close"), F.coalesce(F.sum("volume"), F.lit(0)).alias("total_volume"))


def chart_points(points: DataFrame, zone: str = "America/Chicago") -> DataFrame:
    """Points with wall-clock seconds; a point not after all earlier ones is left out.

    The second pass of the hour that a clock repeats goes.
    """
    timed = points.withColumn("wall_s", wall_seconds(F.col("ts"), zone)).withColumn("_day", F.to_date("ts"))
    # the latest of all earlier days, from a row per day, and of the rows before in the day itself
    daily = timed.groupBy("contract", "_day").agg(F.max("wall_s").alias("_most"))
    days = Window.partitionBy("contract").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carried = daily.select("contract", "_day", F.max("_most").over(days).alias("_carried"))
    inside = Window.partitionBy("contract", "_day").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    met = timed.withColumn("_inside", F.max("wall_s").over(inside)).join(carried, ["contract", "_day"])
    before = F.greatest("_carried", "_inside")
    return met.where(before.isNull() | (F.col("wall_s") > before)).select(*points.columns, "wall_s")


def contracts(bars: DataFrame) -> DataFrame:
    return bars.select("contract").distinct()
