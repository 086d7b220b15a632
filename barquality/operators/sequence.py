"""The row before, without sorting a whole contract in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_previous(rows: DataFrame, values: dict[str, str], tie: str | None = None) -> DataFrame:
    """Adds, for each ``new: old`` in values, the old column of the row before in time.

    Rows are ordered by ``ts`` (then ``tie``) per contract.  Inside a day it is
    a lag; the first row of a day gets the last of the day before that has
    rows, from a table with one row per contract and day.
    """
    key = F.struct("ts", tie) if tie else F.struct("ts")
    held = F.struct(*[F.col(old).alias(new) for new, old in values.items()])
    dated = rows.withColumn("_day", F.to_date("ts")).withColumn("_held", held)
    inside = Window.partitionBy("contract", "_day").orderBy("ts", *([tie] if tie else []))
    last = dated.groupBy("contract", "_day").agg(F.max_by("_held", key).alias("_last"))
    carried = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy("contract").orderBy("_day"))).drop("_last")
    met = dated.withColumn("_lag", F.lag("_held").over(inside)).join(carried, ["contract", "_day"])
    # a struct of nulls is a row before whose values are null, so test the struct itself
    met = met.withColumn("_before", F.when(F.col("_lag").isNotNull(), F.col("_lag")).otherwise(F.col("_carry")))
    return met.select(*rows.columns, *[F.col(f"_before.{new}").alias(new) for new in values])


def placed(rows: DataFrame, tie: str) -> DataFrame:
    """Adds ``place``: how many rows of the contract come before in time (then ``tie``).

    Rows are numbered inside their day, and days go on from each other by the
    running sum of their counts.
    """
    dated = rows.withColumn("_day", F.to_date("ts"))
    counts = dated.groupBy("contract", "_day").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("contract").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("contract", "_day", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("contract", "_day").orderBy("ts", tie)) - 1
    return dated.withColumn("_inside", inside).join(before, ["contract", "_day"]).withColumn("place", F.col("_before") + F.col("_inside")).select(*rows.columns, "place")


#: Rows of a contract that are windowed together.
BLOCK = 4096


def trailing(rows: DataFrame, size: int, figures: dict, tie: str, block: int = BLOCK) -> DataFrame:
    """Adds figures over the last ``size`` rows of the contract, the row itself included.

    ``figures`` are functions of a window.  Rows are windowed in blocks of
    consecutive places; the last ``size - 1`` rows of a block are copied to the
    next one, so a frame never leaves its block and a contract is never one task.
    """
    if not 1 <= size <= block:
        raise ValueError("a frame must fit into a block")
    home = F.floor(F.col("place") / block)
    both = F.when(F.col("place") % block > block - size, F.array(home, home + 1)).otherwise(F.array(home))
    spread = placed(rows, tie).withColumn("_block", F.explode(both))
    frame = Window.partitionBy("contract", "_block").orderBy("place").rowsBetween(1 - size, 0)
    met = spread.withColumns({name: f(frame) for name, f in figures.items()})
    return met.where(F.col("_block") == home).select(*rows.columns, *figures)


def active_start(bars: DataFrame) -> DataFrame:
    """contract, active_start: the first bar with volume, or the first bar where none has."""
    traded = F.min(F.when(F.col("volume") > 0, F.col("ts")))
    return bars.groupBy("contract").agg(F.coalesce(traded, F.min("ts")).alias("active_start"))


def since_active(bars: DataFrame) -> DataFrame:
    return bars.join(active_start(bars), "contract").where("ts >= active_start").drop("active_start")
