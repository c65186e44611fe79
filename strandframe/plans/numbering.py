"""Row numbers over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpointed


def numbered(df: DataFrame, order: list, name: str = "nth") -> DataFrame:
    """df with 1, 2, ... in a total order: ranges are numbered apart, then offset by the rows before them.

    The ranges are checkpointed with their numbers, since their borders come from a sample."""
    ranged = checkpointed(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))  # a row per range
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn(name, inside).join(F.broadcast(before), "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")
