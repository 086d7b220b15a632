"""Deep pages with true totals: count per contract and day, then read only the days that hold the page.

Counting is one aggregation with small results; running sums over contracts,
over the days of a contract and inside a day give the rank at which each cell
begins, so a page at any offset sorts no more than the cells it lies in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written


def ranked(cells: DataFrame, levels: list[list[str]], n: str = "n") -> DataFrame:
    """Adds ``before``: the sum of ``n`` over all cells that come earlier, by the first level, then inside it by the next.

    Only sums of a level are ordered together, never all cells.
    """
    out, before, prefix = cells, F.lit(0).cast("bigint"), []
    for depth, level in enumerate(levels):
        keys = [*prefix, *level]
        sums = cells.groupBy(*keys).agg(F.sum(n).alias("_n"))
        upto = (Window.partitionBy(*prefix) if prefix else Window.partitionBy()).orderBy(*level).rowsBetween(Window.unboundedPreceding, -1)
        name = f"_before{depth}"
        own = sums.select(*[F.col(k).alias(f"_{depth}{k}") for k in keys], F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias(name))
        same = [F.col(k).eqNullSafe(F.col(f"_{depth}{k}")) for k in keys]
        out = out.join(own, same).drop(*[f"_{depth}{k}" for k in keys])
        before, prefix = before + F.col(name), keys
    return out.withColumn("before", before).select(*cells.columns, "before")


def _holding(cells: DataFrame, limit: int, offset: int) -> DataFrame:
    return cells.where((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset))


def _start(cells: DataFrame) -> tuple[int, int]:
    """All rows, and the rank at which the first of the cells begins; one row to the driver."""
    found = cells.agg(F.sum("n").alias("n"), F.min("before").alias("before")).first()
    return found["n"] or 0, found["before"] or 0


def page(rows: DataFrame, order: list[str | Column], limit: int, offset: int) -> tuple[int, DataFrame]:
    """(total, page) of rows in the order of contract, time and then ``order``.

    ``rows`` are counted once, and once more read for the days that hold the page.
    """
    dated = rows.withColumn("_day", F.to_date("ts"))
    counted = written(dated.groupBy("contract", "_day").agg(F.count("*").alias("n")), "page-counts")
    cells = written(ranked(counted, [["contract"], ["_day"]]), "page-cells")
    held = _holding(cells, limit, offset)
    (total, _), (_, start) = _start(cells), _start(held)
    days = held.select(F.col("contract").alias("_c"), F.col("_day").alias("_d"))
    inside = dated.join(days, F.col("contract").eqNullSafe(F.col("_c")) & F.col("_day").eqNullSafe(F.col("_d"))).select(*rows.columns)
    return total, inside.orderBy("contract", "ts", *order).offset(max(offset - start, 0)).limit(limit)


def slice_page(slices: DataFrame, expand, limit: int, offset: int) -> tuple[int, DataFrame]:
    """(total, page) of what slices (contract, day, first, n) would expand to, without expanding any but those of the page."""
    cells = written(ranked(written(slices, "slices"), [["contract"], ["day"], ["first"]]), "page-slices")
    held = _holding(cells, limit, offset)
    (total, _), (_, start) = _start(cells), _start(held)
    return total, expand(held).orderBy("contract", "ts").offset(max(offset - start, 0)).limit(limit)
