"""Running sums and row numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataq.session import checkpointed


def running(rows: DataFrame, by: list[str], order: list[str], **sums: Column) -> DataFrame:
    """``rows`` with a running sum for each of ``sums``, over the rows of a group in order, itself included.

    A window over a group would hold all of its rows in one task. Here rows are
    range-sorted by group and order, summed within each range, and each range of a group
    starts from the total of the ranges before it, of which there are as many as partitions
    at most.
    """
    parted = checkpointed(rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    totals = parted.groupBy("_part", *by).agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    keys = ["_part", *by]
    before = totals.select(*(F.col(c).alias(f"_key{i}") for i, c in enumerate(keys)), *(F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}") for n in sums))
    # A group that is null has its range, too.
    joined = parted.join(before, [F.col(c).eqNullSafe(F.col(f"_key{i}")) for i, c in enumerate(keys)], "left")
    inside = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumns({n: F.col(f"_{n}") + F.sum(c).over(inside) for n, c in sums.items()}).select(*rows.columns, *sums)
