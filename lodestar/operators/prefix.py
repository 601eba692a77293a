"""Running sums and ranks that never put one whole group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable


def prefix_sum(
    df: DataFrame, value: str, order: list[str], group: list[str] | None = None, out: str = "offset", partitions: int | None = None
) -> DataFrame:
    """Add ``out`` = sum of ``value`` over the rows before this one, per group.

    Rows are range-partitioned by (group, order) and written to the checkpoint
    folder together with their range number. Each (range, group) piece is then
    summed on its own, and the totals of earlier ranges are added. A group that
    holds a third of all rows is thus spread over a third of the ranges.
    ``order`` must be a total order within a group.
    """
    group = group or []
    partitions = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = durable(
        df.repartitionByRange(partitions, *group, *order).withColumn("_range", F.spark_partition_id())
    )
    local = Window.partitionBy("_range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("_local", F.coalesce(F.sum(value).over(local), F.lit(0)))
    totals = ranged.groupBy("_range", *group).agg(F.sum(value).alias("_total"))
    # At most one row per (range, group): as many rows as ranges for a single group.
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("_range", *group, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_base"))
    return (
        summed.join(bases, ["_range", *group])
        .withColumn(out, (F.col("_local") + F.col("_base")).cast("bigint"))
        .drop("_local", "_base", "_range")
    )
