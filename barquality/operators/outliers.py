"""Robust outliers of close-to-close returns, and volume spikes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import OHLC, Settings
from ..shared import written
from .selection import medians
from .sequence import trailing, with_previous

#: Scales a median absolute deviation to a standard deviation.
MAD_SCALE = 1.4826
MIN_RETURN_BARS, MIN_VOLUME_BARS = 30, 50
MEDIAN_ROWS, MEDIAN_LEAST = 50, 20


def returns(bars: DataFrame) -> DataFrame:
    """Bars with a positive close and ``log_return`` to the one before, of contracts with enough of them."""
    priced = bars.where("close > 0").select("contract", "ts", *OHLC, "volume", "row_hash").withColumn("ln_close", F.ln("close"))
    enough = priced.groupBy("contract").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_RETURN_BARS).select("contract")
    paired = with_previous(priced.join(enough, "contract"), {"ln_before": "ln_close"}, tie="row_hash")
    return paired.withColumn("log_return", F.col("ln_close") - F.col("ln_before")).drop("ln_close", "ln_before", "row_hash")


def price_return_outliers(bars: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Bars whose return lies too many scaled deviations from the median; silent where the deviation is 0.

    Returns are written once; both medians are selected from them without
    gathering a contract.
    """
    scored = written(returns(bars), "returns")
    middle = medians(scored, ["contract"], "log_return").withColumnRenamed("median", "med")
    off = written(scored.join(middle, "contract").withColumn("off", F.abs(F.col("log_return") - F.col("med"))), "deviations")
    spread = medians(off, ["contract"], "off").withColumnRenamed("median", "mad").where("mad > 0")
    score = F.col("off") / (MAD_SCALE * F.col("mad"))
    hits = off.join(spread, "contract").withColumn("score", score).where(F.col("score") > settings.outlier_mad_threshold)
    return hits.select("contract", "ts", F.round("log_return", 6).alias("log_return"), F.round("score", 1).alias("mad_score"), *OHLC, "volume")


def volume_spikes(bars: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Bars whose volume is far above the median of the last 50 rows (at least 20, itself included)."""
    rows = bars.select("contract", "ts", *OHLC, "volume", "row_hash").withColumn("v", F.coalesce("volume", F.lit(0)))
    enough = rows.groupBy("contract").agg(F.count("*").alias("n"), F.sum("v").alias("total")).where((F.col("n") >= MIN_VOLUME_BARS) & (F.col("total") != 0))
    local = {"local_median": lambda frame: F.when(F.count("*").over(frame) >= MEDIAN_LEAST, F.percentile("v", F.lit(0.5)).over(frame))}
    hits = trailing(rows.join(enough.select("contract"), "contract"), MEDIAN_ROWS, local, tie="row_hash")
    hits = hits.where((F.col("local_median") > 0) & (F.col("v") > settings.volume_spike_threshold * F.col("local_median")))
    return hits.select("contract", "ts", "local_median", F.round(F.col("v") / F.col("local_median"), 1).alias("x_median"), *OHLC, "volume")
