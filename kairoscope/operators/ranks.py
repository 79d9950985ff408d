"""Numbers in a global order without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kairoscope.storage import stored


def numbered(rows: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """Rows with their place (from 1) in an order that has no ties.

    Rows are dealt by ranges of the order and stored, so that both passes see the same ranges; a range's rows are numbered
    in parallel and shifted by how many rows lie in the ranges before it: one number for each partition.
    """
    held = stored(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    before = F.sum("count").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("count")
    shift = held.groupBy("range").count().select("range", before.alias("shift"))
    own = F.row_number().over(Window.partitionBy("range").orderBy(*order))
    return held.withColumn(name, own).join(F.broadcast(shift), "range").withColumn(name, F.col(name) + F.col("shift")).drop("range", "shift")
