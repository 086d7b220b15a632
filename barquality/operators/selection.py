"""Exact medians per group by distributed selection: no group is ever gathered or sorted whole.

Values fall into buckets by a monotone function of their sign and logarithm,
then into equal slices of the bucket that holds the wanted rank, and only the
different values of one slice are counted one by one.  Each step is a count per
key with partial aggregation, joined back to the rows by the few keys that hold
a rank, so a group with most of all rows costs every task its own share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets per doubling of a value, and slices of a bucket.
PER_DOUBLING, SLICES = 64, 4096
#: Above the logarithm of the smallest double, so that every value but zero has a bucket of its sign.
_RAISE = 1100
_INFINITE, _NAN = 200_000, 300_000


def bucket(x: Column) -> Column:
    """A whole number that never falls as ``x`` rises; NaN counts as the greatest value."""
    sign = F.signum(x).cast("int")
    size = F.floor((F.log2(F.abs(x)) + _RAISE) * PER_DOUBLING).cast("int")
    return F.when(F.isnan(x), _NAN).when(x == 0, 0).when(F.abs(x) == float("inf"), sign * _INFINITE).otherwise(sign * size)


def _holding(counts: DataFrame, by: list[str], key: str, total: Column | None = None) -> DataFrame:
    """The keys that hold one of the two middle ranks: with ``_below`` rows before them and ``_total`` in the group."""
    order = Window.partitionBy(*by).orderBy(key)
    whole = F.sum("n").over(Window.partitionBy(*by)) if total is None else total
    start = F.lit(0) if total is None else F.col("_below")
    met = counts.withColumn("_total", whole).withColumn("_upto", start + F.sum("n").over(order)).withColumn("_before", F.col("_upto") - F.col("n"))
    low, high = F.floor((F.col("_total") - 1) / 2), F.ceil((F.col("_total") - 1) / 2)
    return met.where(((F.col("_before") <= low) & (low < F.col("_upto"))) | ((F.col("_before") <= high) & (high < F.col("_upto"))))


def medians(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, median: the exact median of the values that are not null, the mean of the two middle ones where there are two.

    ``rows`` is read three times; give it as a written table.
    """
    x = F.col("_x")
    rows = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_x")).withColumn("_bucket", bucket(x))
    extent = (F.count("*").alias("n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    buckets = _holding(rows.groupBy(*by, "_bucket").agg(*extent), by, "_bucket").select(*by, "_bucket", "_lo", "_hi", F.col("_before").alias("_below"), "_total")
    share = (x - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    sliced = F.when(F.col("_lo") < F.col("_hi"), F.floor(share * SLICES)).otherwise(0).cast("int")
    inside = rows.join(buckets, [*by, "_bucket"]).withColumn("_slice", sliced)
    of_slice = inside.groupBy(*by, "_bucket", "_lo", "_hi", "_below", "_total", "_slice").agg(F.count("*").alias("n"))
    slices = _holding(of_slice, [*by, "_bucket"], "_slice", F.col("_total")).select(*by, "_bucket", "_lo", "_hi", "_slice", F.col("_before").alias("_below"), "_total")
    last = rows.join(slices, [*by, "_bucket"]).where(sliced == F.col("_slice"))
    values = last.groupBy(*by, "_bucket", "_slice", "_below", "_total", "_x").agg(F.count("*").alias("n"))
    found = _holding(values, [*by, "_bucket", "_slice"], "_x", F.col("_total"))
    low, high = F.floor((F.col("_total") - 1) / 2), F.ceil((F.col("_total") - 1) / 2)

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("_before") <= place) & (place < F.col("_upto")), x))

    met = found.groupBy(*by).agg(at(low).alias("_a"), at(high).alias("_b"))
    # half of the smallest doubles is not exact
    return met.select(*by, F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("_a") * 0.5 + F.col("_b") * 0.5).alias("median"))
