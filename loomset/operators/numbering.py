"""Running numbers inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomset.session import written


def numbered(rows: DataFrame, group: str, order: str, into: str, begin: int) -> DataFrame:
    """``rows`` with their number inside ``group`` by ``order``, from ``begin`` on; a null group is a group.

    Rows are sorted and counted in ranges over the cluster, and the counts of
    earlier ranges are added.  A group of a third of all rows is numbered by all
    the tasks that hold a part of it.
    """
    ranged = rows.repartitionByRange(group, order).sortWithinPartitions(group, order)
    placed = written(ranged.withColumn("range", F.spark_partition_id()))
    sizes = placed.groupBy(group, "range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col(group).alias("group of"), F.col("range").alias("range of"), before.alias("before"))
    within = placed.withColumn("within", F.row_number().over(Window.partitionBy("range", group).orderBy(order)))
    joined = within.join(offsets, F.col(group).eqNullSafe(F.col("group of")) & (F.col("range") == F.col("range of")))
    return joined.withColumn(into, F.col("before") + F.col("within") - 1 + begin).drop("group of", "range of", "before", "within", "range")
