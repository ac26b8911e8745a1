"""Positions of rows inside their groups, whatever the size of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marshgrid.llm.common import saved


def placed(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Add ``idx``, the row's 0-based position in its group under ``order``, and ``n``, the group's size.

    Rows are ranged on group and order, sorted and written; a position is the range's
    offset in the group plus the place in the range, so a group of any size spreads over
    tasks.  ``group`` must not be null; ``order`` should end in a column that differs
    between rows, or a run of equal rows stays in one range.  Nulls come first.
    """
    ranged = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    table = saved(ranged.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ranges")
    # One row for each group in each range.
    runs = table.groupBy(group, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(group)
    offsets = runs.select(group, "_range", "_first", F.sum("_rows").over(whole).alias("n"),
                          (F.sum("_rows").over(whole.orderBy("_range")) - F.col("_rows")).alias("_before"))
    return (table.join(offsets, [group, "_range"]).withColumn("idx", F.col("_before") + F.col("_at") - F.col("_first"))
            .select(*df.columns, "idx", "n"))
