"""Global row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.sources import scratch


def numbered(df: DataFrame, order: list[str | Column], name: str = "row_no") -> tuple[DataFrame, int]:
    """df with gapless global row numbers (from 0) in the given order, and the number of rows.

    A range shuffle sorts the rows, which are then saved; Spark's own id holds
    partition and place; the count of each partition (as many as there are
    partitions) goes to the driver for the offsets. Rows equal in all of
    `order` are told apart by their place in the input, so a hot value spreads
    over partitions. An empty table gives no rows.
    """
    spark = df.sparkSession
    ranged = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    placed = scratch.saved(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    rows, n = [], 0
    for p, count in sorted(placed.groupBy(part.alias("p")).count().collect()):
        rows.append((p, n))
        n += count
    offsets = spark.createDataFrame(rows or [(0, 0)], "_part long, _offset long")
    out = placed.withColumn("_part", part).withColumn("_place", place).join(F.broadcast(offsets), "_part")
    return out.withColumn(name, F.col("_offset") + F.col("_place")).drop("_at", "_part", "_place", "_offset"), n
