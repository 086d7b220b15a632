"""Mixing sources to target weights: capped water-filling.

Every source has a weight and a size (words of its documents).  Sources share
all words by weight; a source is clamped at ``epochs`` times its size, and what
it cannot give is shared again by weight until no source is above its clamp.
A target of ``e`` epochs then takes every document ``floor(e)`` times and a
seeded sample of documents once more: documents in the order of a seeded hash
while they fit, then the one document of the rest that fills the gap best.

All sizes are grouped with partial aggregation; the table of sources stays
distributed and only scalars come to the driver.  The sampling never sorts a
source in one task: hash prefixes split each source into slices, sums over
slices find the one that holds the cut, and only that slice is sorted.

Null or empty texts have size 0 and are taken 0 times.  A null source is a
source of its own, ordered last.  Ties of the hash (repeated ids) are ordered by a
digest of the text (``repeat``: of the whole row); rows that are equal throughout
are as good as each other.  An empty table gives an empty result; other columns
are ignored (``mix``) or passed through (``repeat``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, boxed, persist_table

#: Hex digits of the hash that name a slice of a source: 4096 slices.
SLICE_DIGITS = 3


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """``source, source_size, rank`` (0-based, by code point, null last), sorted in parallel."""
    spread = sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id())
    spread = persist_table(spread, "sources")
    counts = spread.groupBy("_part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy("_part")) - F.col("n")).select("_part", "before")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last()))
    return spread.join(before, "_part").select("source", "source_size", (F.col("before") + inside - 1).alias("rank"))


def water_fill(weighted: DataFrame, epochs: int) -> DataFrame:
    """Adds ``target`` to ``source, source_size, weight``: a fixed point of clamped shares."""
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    level = None
    while True:
        clamped = F.lit(False) if level is None else F.col("source_size") * epochs <= F.lit(level) * F.col("weight")
        fixed, weight = weighted.agg(
            F.coalesce(F.sum(F.when(clamped, F.col("source_size") * epochs)), F.lit(0)),
            F.coalesce(F.sum(F.when(~clamped, F.col("weight"))), F.lit(0)),
        ).first()
        after = (total - fixed) / weight if weight else None
        if after is None or (level is not None and after <= level):
            break
        level = after
    share = F.lit(float(level or 0.0)) * F.col("weight")
    cap = (F.col("source_size") * epochs).cast("double")
    return weighted.withColumn("target", F.when(cap <= share, cap).otherwise(share) if level is not None else cap)


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3, seed: int = 17) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row of ``docs(doc_id, source, text)``.

    Weights go to the sources in order, repeating.  ``taken`` is a multiple of
    ``size`` and at most ``epochs`` times it.
    """
    found = _mixed(docs, F.xxhash64("text"), F.lit(0).cast("bigint"), weights, epochs, seed)
    return found.select("doc_id", "source", "size", "source_size", "target", "taken")


def _mixed(docs: DataFrame, tie: Column, tie2: Column, weights: tuple[int, ...], epochs: int, seed: int) -> DataFrame:
    """``mix`` with the columns ``tie`` and ``tie2`` of each row, which order rows of one id."""
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        order.alias("h"),
        tie.alias("tie"),
        tie2.alias("tie2"),
        F.monotonically_increasing_id().alias("row"),
    )
    # written once, so the row numbers stay what they are
    sized = persist_table(sized, "sizes")
    sources = ranked_sources(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    targets = persist_table(water_fill(persist_table(sources.withColumn("weight", weight), "weighted"), epochs), "targets")
    plan = targets.select(
        F.col("source").alias("_s"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint").alias("whole"),
    ).withColumn("part", F.col("target") - F.col("whole") * F.col("source_size"))

    slices = sized.groupBy("source", F.substring("h", 1, SLICE_DIGITS).alias("slice")).agg(F.sum("size").alias("n"))
    running = F.sum("n").over(Window.partitionBy("source").orderBy("slice"))
    slices = slices.withColumn("before", running - F.col("n")).select(F.col("source").alias("_t"), F.col("slice"), "before", "n")

    placed = (
        sized.withColumn("slice", F.substring("h", 1, SLICE_DIGITS))
        .join(plan, F.col("source").eqNullSafe(F.col("_s")))
        .join(slices.withColumnRenamed("slice", "_slice"), F.col("source").eqNullSafe(F.col("_t")) & (F.col("slice") == F.col("_slice")))
    )
    cut = (F.col("before") < F.col("part")) & (F.col("part") < F.col("before") + F.col("n"))
    sure = placed.where(~cut).withColumn("end", F.when(F.col("before") + F.col("n") <= F.col("part"), F.col("before") + F.col("n")))
    at = Window.partitionBy("source", "slice").orderBy("h", "tie", "tie2", "row").rowsBetween(Window.unboundedPreceding, 0)
    at_cut = placed.where(cut).withColumn("end", F.col("before") + F.sum("size").over(at))
    at_cut = at_cut.withColumn("end", F.when(F.col("end") <= F.col("part"), F.col("end")))
    columns = ["row", "doc_id", "source", "size", "source_size", "target", "whole", "part", "h", "tie", "tie2", "end"]
    drawn = persist_table(sure.select(*columns).unionByName(at_cut.select(*columns)), "drawn")

    left = drawn.groupBy("source").agg((F.first("part") - F.coalesce(F.max("end"), F.lit(0))).alias("gap")).withColumnRenamed("source", "_s")
    rest = drawn.where("end is null and size > 0").join(left, F.col("source").eqNullSafe(F.col("_s"))).where("abs(size - gap) < gap")
    fill = rest.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "h", "tie", "tie2", "row")).alias("best")).select(F.col("best.row").alias("row"), F.lit(1).alias("fills"))
    once = F.when(F.col("end").isNotNull() | F.col("fills").isNotNull(), 1).otherwise(0)
    taken = (F.col("whole") + once) * F.col("size")
    return drawn.join(fill, "row", "left").select("doc_id", "source", "size", "source_size", "target", taken.cast("bigint").alias("taken"), "tie", "tie2")


def repeat(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3, seed: int = 17) -> DataFrame:
    """``docs`` as the mix has them: each row as often as it is taken, none for the rest.

    Rows without words are left out, as they are taken 0 times.  Rows that are
    equal throughout share what is taken of them; other rows of one id each have
    their own count.
    """
    plain = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in t else F.col(f"`{c}`") for c, t in docs.dtypes]
    # hashes pass over nulls, so these are told apart by flags
    flags = [F.col(f"`{c}`").isNull() for c in docs.columns]
    tie, tie2 = (F.xxhash64(F.lit(n), *plain, *flags) for n in (1, 2))
    found = _mixed(docs, tie, tie2, weights, epochs, seed)
    times = found.groupBy("tie", "tie2").agg(F.count("*").alias("n"), F.sum(F.when(F.col("size") > 0, F.expr("taken div size")).otherwise(0)).alias("times")).where("times > 0")
    times = persist_table(times, "times")
    rows = boxed(docs, tie=tie, tie2=tie2)
    even = rows.join(times.where("times >= n"), ["tie", "tie2"]).select("doc", F.explode(F.sequence(F.lit(1).cast("bigint"), F.expr("times div n"))))
    # what equal rows cannot share evenly comes from one of them
    odd = times.where("times % n > 0")
    odd = rows.join(odd, ["tie", "tie2"]).groupBy("tie", "tie2").agg(F.first("doc").alias("doc"), F.first(F.expr("times % n")).alias("more")).select("doc", F.explode(F.sequence(F.lit(1).cast("bigint"), "more")))
    return even.select("doc.*").unionByName(odd.select("doc.*"))
