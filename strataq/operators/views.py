"""Views over runs of changes: newest wins, compaction, replay, erasure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def newest_wins(runs: DataFrame, order: str = "run_no", ascending: bool = True) -> DataFrame:
    """The surviving ``(key, oid)``: the newest change of a key counts, and a delete hides all older ones.

    ``run_no`` 0 is the newest run. The winner is an aggregate, so a key with very many
    changes is reduced before the shuffle.
    """
    pick = F.min_by if ascending else F.max_by
    winner = runs.groupBy("key").agg(pick(F.struct("op", "oid"), F.col(order)).alias("w"))
    return winner.filter("w.op = 'put'").select("key", F.col("w.oid").alias("oid"))


def replay(base: DataFrame, tail: DataFrame) -> DataFrame:
    """A checkpoint ``(key, oid)`` with the log after it ``(key, op, oid, seq)`` applied."""
    old = base.select("key", F.lit("put").alias("op"), "oid", F.lit(-1).cast("long").alias("seq"))
    return newest_wins(old.unionByName(tail.select("key", "op", "oid", F.col("seq").cast("long").alias("seq"))), "seq", ascending=False)


def compact(runs: DataFrame, partitions: int, order: str = "run_no") -> DataFrame:
    """One run without tombstones, range-partitioned and sorted by key for writing."""
    return newest_wins(runs, order).repartitionByRange(partitions, "key").sortWithinPartitions("key")


def range_erase(rows: DataFrame, low, high, column: str = "key") -> DataFrame:
    """Rows outside the half-open range."""
    return rows.filter((F.col(column) < low) | (F.col(column) >= high))


def first_kept(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the first in order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).filter("_n = 1").drop("_n")


def at_version(entries: DataFrame, version: str) -> DataFrame:
    """An immutable view of one version."""
    return entries.filter(F.col("version") == version).drop("version")
