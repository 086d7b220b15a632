"""Bars over the driver's tables, so that every operator has data with an oracle."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import local_date
from ..operators.normalize import row_hash
from ..schema import BAR_COLUMNS, DAILY, MINUTE
from ..shared import folder
from .writers import write_csv


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _finished(bars: DataFrame, frequency: str, source: str) -> DataFrame:
    bars = bars.withColumns({"root": F.substring("contract", 1, 2), "exchange": F.lit("TEST"), "frequency": F.lit(frequency), "source_file": F.lit(source), "ingested_at": F.lit("2024-01-01").cast("timestamp")})
    if "open_interest" not in bars.columns:
        bars = bars.withColumn("open_interest", F.lit(None).cast("bigint"))
    return bars.withColumn("row_hash", row_hash()).select(*BAR_COLUMNS)


def _event_bars(events: DataFrame, unit: str) -> DataFrame:
    times = events.groupBy(F.col("event_type").alias("contract"), F.date_trunc(unit, "ts").cast("timestamp").alias("ts"))
    bars = times.agg(F.min_by("value", "event_id").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "event_id").alias("close"), F.sum("user_id").alias("volume"))
    return _finished(bars.withColumn("trading_date", local_date(F.col("ts"), "America/Chicago")), MINUTE, "events")


def intraday_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of events per type."""
    return _event_bars(_table(spark, sf_dir, "events"), "hour")


def gapped_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``intraday_bars``, but what one type has on three days arrived three days earlier, which leaves an extended gap."""
    late = (F.col("event_type") == "click") & (F.col("ts") >= F.lit("2024-01-09").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-12").cast("timestamp_ntz"))
    return _event_bars(_table(spark, sf_dir, "events").withColumn("ts", F.when(late, F.col("ts") - F.expr("interval 3 days")).otherwise(F.col("ts"))), "hour")


def minute_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of events per type and minute; most minutes have none."""
    return _event_bars(_table(spark, sf_dir, "events"), "minute")


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of order prices per priority."""
    orders = _table(spark, sf_dir, "orders")
    days = orders.groupBy(F.col("o_orderpriority").alias("contract"), F.to_date("o_orderdate").alias("trading_date"))
    price = "o_totalprice"
    bars = days.agg(F.min_by(price, "o_orderkey").alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, "o_orderkey").alias("close"), F.count("*").alias("volume"))
    return _finished(bars.withColumn("ts", F.col("trading_date").cast("timestamp")), DAILY, "orders")


def intraday_bars_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``intraday_bars`` with prices and volumes broken by the hour since 1970."""
    bars = intraday_bars(spark, sf_dir)
    hour = F.floor(F.unix_seconds("ts") / 3600)

    def every(k: int, value, name: str):
        return F.when(hour % k == 0, value).otherwise(F.col(name))

    broken = bars.select("*", F.col("high").alias("_h"), F.col("low").alias("_l"))
    broken = broken.withColumn("high", F.when(hour % 11 == 0, F.col("_l") - 1).otherwise(F.col("_h")))
    broken = broken.withColumn("open", F.when(hour % 13 == 0, F.col("_h") + 5).when(hour % 19 == 0, F.lit(0.0)).otherwise(F.col("open")))
    broken = broken.withColumn("close", F.when(hour % 17 == 0, F.col("_l") - 5).when(hour % 23 == 0, F.lit(float("inf"))).otherwise(F.col("close")))
    broken = broken.withColumn("volume", F.when(hour % 29 == 0, -F.col("volume")).when(hour % 31 == 0, F.lit(None)).otherwise(F.col("volume")))
    return broken.drop("_h", "_l").withColumn("row_hash", row_hash()).select(*BAR_COLUMNS)


def line_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of order lines per part and ship date, with repeated and conflicting instants; every fiftieth order is doubled."""
    lines = _table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice")
    bars = lines.select(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("contract"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        price.alias("open"), price.alias("high"), price.alias("low"), price.alias("close"),
        F.col("l_quantity").cast("bigint").alias("volume"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("row_number"),
    )
    doubled = bars.unionByName(bars.where(F.expr("row_number div 100") % 50 == 0).withColumn("row_number", F.col("row_number") + 1_000_000_000_000))
    return doubled.withColumn("frequency", F.lit(MINUTE)).withColumn("row_hash", row_hash())


def vendor_files(spark: SparkSession, sf_dir: str) -> str:
    """The folder of four CSV files of orders in the order of their keys, written to the shared folder."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("string").alias("price"), (F.col("o_orderkey") % 4).alias("file"))
    at = f"{folder(spark)}/vendor-{uuid.uuid4().hex}"
    write_csv(orders.repartition(4, "file").sortWithinPartitions("file", "o_orderkey"), at, by=["file"])
    return at


def vendor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a vendor's text file, with rows broken by their key."""
    key = F.col("o_orderkey")
    orders = _table(spark, sf_dir, "orders")
    price = F.col("o_totalprice").cast("string")
    wall = F.date_format(F.col("o_orderdate"), "yyyy-MM-dd'T'02:30:00")
    return orders.select(
        F.when(key % 53 == 0, F.lit(" ")).otherwise(F.concat(F.upper(F.substring(F.col("o_orderpriority"), 3, 2)), F.lit("H"), F.substring(F.col("o_orderpriority"), 1, 1))).alias("Ticker"),
        F.when(key % 59 == 0, F.lit("n/a at desk")).otherwise(wall).alias("timestamp_chicago_wall"),
        F.when(key % 61 == 0, F.lit("1.2.3")).when(key % 71 == 0, F.lit(None)).otherwise(price).alias("px_open"),
        F.when(key % 71 == 0, F.lit(None)).otherwise(price).alias("PX_HIGH"),
        F.when(key % 71 == 0, F.lit(None)).otherwise(price).alias("px_low"),
        F.when(key % 71 == 0, F.lit(None)).when(key % 67 == 0, F.lit(None)).otherwise(price).alias("settle"),
        F.lit("10").alias("qty"),
        F.lit("orders").alias("__source_file"),
        key.cast("bigint").alias("__row_number"),
    )


def audited_bars(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(bars, superseded): hourly bars in which every rule for minutes finds something.

    Prices and volumes are broken by the hour since 1970; some rows come twice,
    some again with another open, and some are in the audit trail.
    """
    hour = F.floor(F.unix_seconds("ts") / 3600)
    base = gapped_bars(spark, sf_dir).withColumn("_hour", hour).withColumn("_high", F.col("high"))
    h = F.col("_hour")
    once = base.withColumns(
        {
            "high": F.when(h % 11 == 0, F.col("low") - 1).when(h % 23 == 0, F.lit(float("inf"))).otherwise(F.col("high")),
            "open": F.when(h % 13 == 0, F.col("_high") + 5).when(h % 19 == 0, F.lit(0.0)).otherwise(F.col("open")),
            "close": F.when(h % 17 == 0, F.col("low") - 5).otherwise(F.col("close")),
            "volume": F.when(h % 29 == 0, -F.col("volume")).when(h % 31 == 0, F.lit(None)).otherwise(F.col("volume")),
        }
    )
    # the copies come out of one pass over the rows
    copies = F.array_compact(F.array(F.lit(0), F.when(h % 37 == 0, F.lit(1)), F.when(h % 41 == 0, F.lit(2))))
    bars = once.withColumn("_copy", F.explode(copies)).withColumn("open", F.when(F.col("_copy") == 2, F.col("open") + 0.5).otherwise(F.col("open")))
    times = F.when(h % 86 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    superseded = once.where(h % 43 == 0).withColumn("_copy", F.explode(times)).withColumn("reason", F.when(F.col("_copy") == 0, "superseded_in_file").otherwise("superseded_by_run"))
    return tuple(x.withColumn("row_hash", row_hash()) for x in (bars.select(*BAR_COLUMNS), superseded.select(*BAR_COLUMNS, "reason")))
