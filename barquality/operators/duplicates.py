"""Duplicates and conflicts, in bars that were not deduplicated and in the audit trail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import OHLC


def exact_duplicates(bars: DataFrame, ordinal: str = "row_number") -> DataFrame:
    """One row per repeated row hash: copies, first and last instant, prices of the first row."""
    first = F.min_by(F.struct(*OHLC, "volume"), ordinal)
    groups = bars.groupBy("contract", "row_hash").agg(F.count("*").alias("copies"), F.min("ts").alias("ts"), F.max("ts").alias("last_ts"), first.alias("f")).where("copies > 1")
    return groups.select("contract", "row_hash", "copies", "ts", F.when(F.col("last_ts") != F.col("ts"), F.col("last_ts")).alias("end_ts"), "f.*")


def repeated_instants(bars: DataFrame, ordinal: str = "row_number") -> DataFrame:
    """Instants with several rows: rows, variants (distinct prices and volume), prices of the first row."""
    values = F.struct(*OHLC, "volume")
    groups = bars.groupBy("contract", "ts").agg(F.count("*").alias("rows"), F.countDistinct(values).alias("variants"), F.min_by(values, ordinal).alias("f")).where("rows > 1")
    return groups.select("contract", "ts", "rows", "variants", "f.*")


def conflicting_duplicates(bars: DataFrame, ordinal: str = "row_number") -> DataFrame:
    return repeated_instants(bars, ordinal).where("variants > 1")


def repeated_timestamps(bars: DataFrame, ordinal: str = "row_number") -> DataFrame:
    return repeated_instants(bars, ordinal).where("variants = 1").drop("variants")


def resolved_conflicts(superseded: DataFrame) -> DataFrame:
    """Per contract of the audit trail: distinct instants, discarded rows, sorted reasons."""
    return superseded.groupBy("contract").agg(
        F.countDistinct("ts").alias("instants"), F.count("*").alias("discarded_rows"), F.sort_array(F.collect_set("reason")).alias("reasons"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts")
    )


def last_write_wins(bars: DataFrame, ordinal: str = "row_number", within: tuple[str, ...] = (), winning: tuple[str, ...] = ("row_hash",)) -> tuple[DataFrame, DataFrame]:
    """(winners, losers): the last distinct row of each instant, and the others with their winner's columns ``winning``, named ``winning_`` and the column.

    Rows with an equal hash are one row (the first); with ``within``, rows
    that differ in these columns have nothing to do with each other.  Of distinct rows with an
    equal ordinal one wins, by its hash.  Both come from grouped
    extremes, so an instant with very many rows is never sorted in one task.
    """
    own = ("contract", *within)
    key = (*own, "ts")
    rest = [c for c in bars.columns if c not in (*own, "row_hash")]
    unique = bars.groupBy(*own, "row_hash").agg(F.min_by(F.struct(*rest), ordinal).alias("_row")).select(*own, "row_hash", "_row.*").select(*bars.columns)
    # a short stand-in, so that no shuffle after the first needs the hash
    unique = unique.withColumn("_tie", F.xxhash64("row_hash"))
    last = F.max(F.struct(ordinal, "_tie", *[F.col(c).alias(f"winning_{c}") for c in winning]))
    contested = unique.groupBy(*key).agg(last.alias("_last"), F.count("*").alias("_variants")).where("_variants > 1")
    won = contested.select(*[F.col(k).alias(f"_{k}") for k in key], "_last")
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key]
    wins = F.col(ordinal).eqNullSafe(F.col("_last")[ordinal]) & (F.col("_tie") == F.col("_last")["_tie"])
    winners = unique.join(won, same, "left").where(F.col("_last").isNull() | wins).select(*bars.columns)
    losers = unique.join(won, same).where(~wins).select(*bars.columns, *[f"_last.winning_{c}" for c in winning])
    return winners, losers
