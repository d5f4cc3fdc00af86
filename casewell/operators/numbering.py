"""Consecutive numbers in a given order without sorting in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from casewell.settings import ensure_checkpoint_dir

_TASK_ROWS = (1 << 33) - 1      # the bits of a monotonic id that count rows inside a task


def dense_number(df: DataFrame, order: str, name: str = "number") -> DataFrame:
    """Adds 1, 2, 3 ... along the unique column ``order``.

    Rows are dealt to ranges of the order and sorted inside them; a row's number is its place in the range plus the
    rows of the ranges before.  The ranges are kept in the checkpoint folder, as dealing again may cut elsewhere.
    """
    ensure_checkpoint_dir(df.sparkSession)
    mark = F.monotonically_increasing_id()
    placed = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_mark", mark).checkpoint()
    placed = placed.withColumns({"_range": F.call_function("shiftright", F.col("_mark"), F.lit(33)),
                                 "_inside": F.col("_mark").bitwiseAND(F.lit(_TASK_ROWS))})
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    shifts = placed.groupBy("_range").count().select(                       # a row per shuffle partition
        "_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift"))
    return (placed.join(F.broadcast(shifts), "_range").withColumn(name, F.col("_inside") + F.col("_shift") + 1)
            .drop("_mark", "_range", "_inside", "_shift"))
