"""Numbers rows in a global order without bringing them into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clusterloom.plans.runtime import cut

#: Bits of monotonically_increasing_id that count rows within a partition.
_WITHIN = 33


def numbered_by(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with a column ``name``: 1, 2, 3, ... in ``order``.

    Rows are dealt by range and sorted range by range; a row's number is its place in its range and the
    number of rows in the ranges before. Only one count a range meets in a task.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_n", F.monotonically_increasing_id())
    placed = cut(placed.withColumns({"_range": F.shiftright("_n", _WITHIN), "_n": F.col("_n").bitwiseAND((1 << _WITHIN) - 1)}))
    counts = placed.groupBy("_range").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), "_range").withColumn(name, F.col("_before") + F.col("_n") + 1).drop("_range", "_n", "_before")
