"""Files as they arrive, and bars built from ticks in event time."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.store import BarStore
from ..schema import Settings


def ingest_stream(spark: SparkSession, folder: str, schema: str, store: BarStore, checkpoint: str, frequency: str | None = None, settings: Settings = Settings()) -> StreamingQuery:
    """Normalise and store every new CSV file; a batch that is retried changes nothing, as its run has the id of its epoch."""
    files = spark.readStream.schema(schema).option("header", True).csv(folder)

    name = f"stream-{hashlib.sha1(checkpoint.encode()).hexdigest()[:12]}"

    def stored(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            store.ingest(batch, f"stream-{epoch}", frequency, settings, f"{name}-{epoch}")

    return files.writeStream.foreachBatch(stored).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tick_bars(ticks: DataFrame, contract: str, ts: str, price: str, size: str, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """OHLCV bars of a stream (or table) of ticks per contract and window; ticks later than the watermark are left out."""
    grouped = ticks.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), F.col(contract).alias("contract"))
    bars = grouped.agg(F.min_by(price, ts).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, ts).alias("close"), F.sum(size).alias("volume"))
    return bars.select("contract", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
