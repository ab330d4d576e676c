"""Running sums inside groups that may be as large as the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkforest.plans.context import cut


def grouped_prefix(df: DataFrame, group: list[str], order: list[str], value: str, out: str, small: bool = False) -> DataFrame:
    """df with ``out``: the sum of ``value`` over the rows before in the group; ``order`` must be unique within it.

    A small table takes one window. Otherwise the rows are range-partitioned by group and order, so that a hot group spreads
    over many partitions: the window runs inside a partition, and the sums of the partitions before are joined on.
    """
    if small:
        before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.coalesce(F.sum(value).over(before), F.lit(0)))
    ranged = cut(df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per group and partition; a group has at most as many as there are partitions.
    parts = ranged.groupBy("_part", *group).agg(F.sum(value).alias("_sum")).withColumn("_base", F.coalesce(F.sum("_sum").over(across), F.lit(0)))
    summed = ranged.withColumn("_run", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return summed.join(parts.drop("_sum"), ["_part", *group]).select(*df.columns, (F.col("_run") + F.col("_base")).alias(out))


def ranked(df: DataFrame, group: list[str], order: list[str], out: str, small: bool = False) -> DataFrame:
    """df with ``out``: 0, 1, 2 ... within the group."""
    return grouped_prefix(df.withColumn("_one", F.lit(1).cast("bigint")), group, order, "_one", out, small).drop("_one")
