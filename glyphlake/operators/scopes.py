"""Nested scopes from begin and end marks, by windows instead of a stack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def owners(rows: DataFrame, step: Column, group: str = "doc_id", order: str = "seq") -> DataFrame:
    """Rows with ``depth`` and ``owner``, the order of the innermost begin mark they stand in.

    ``step`` is 1 at a begin, -1 at an end and 0 elsewhere. A begin stands in its
    own scope, an end in the one it closes; ends without an open scope own none.
    The depth is the running sum minus its lowest value so far, if that is below
    zero: ends on an empty stack then count for nothing. All windows share one
    partitioning.
    """
    w = Window.partitionBy(group).orderBy(order)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumn("_step", step).withColumn("_sum", F.sum("_step").over(so_far))
    deep = summed.withColumn("_deep", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(so_far)))
    level = F.when(F.col("_step") < 0, F.coalesce(F.lag("_deep").over(w), F.lit(0))).otherwise(F.col("_deep"))
    levelled = deep.withColumn("depth", level.cast("int"))
    at_level = Window.partitionBy(group, "depth").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    owner = F.when(F.col("depth") > 0, F.last(F.when(F.col("_step") > 0, F.col(order)), ignorenulls=True).over(at_level))
    return levelled.withColumn("owner", owner).drop("_step", "_sum", "_deep")
