"""Running numbers by prefix sums: no group, however large, is numbered in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.session import cut_lineage


def numbered(df: DataFrame, group: str, order: str, name: str = "index") -> DataFrame:
    """``df`` with the place of each row in its group, from 1, by the unique column ``order``; groups are not null.

    Rows are dealt to ranges of (group, order), stored, and counted inside each range; a range's first place is the sum of
    the counts of its group's earlier ranges.  Only these counts, one row per group and range, meet by group."""
    pieces = cut_lineage(df.repartitionByRange(group, order).withColumn("_piece", F.spark_partition_id()))
    counts = pieces.groupBy(group, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(group, "_piece", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(group, "_piece").orderBy(order))
    return pieces.join(first, [group, "_piece"]).withColumn(name, (F.col("_before") + place).cast("int")).drop("_piece", "_before")
