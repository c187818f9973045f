"""Lookups, ordered scans and pages over keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataq.operators.running import running

MOST = 1025


def lookup(rows: DataFrame, key, column: str = "key") -> DataFrame:
    """The row of one key; the comparison reaches the scan."""
    return rows.filter(F.col(column) == key)


def prefix_scan(rows: DataFrame, prefix: str, column: str = "key") -> DataFrame:
    """Rows whose key starts with ``prefix``, in byte order; the prefix reaches the scan."""
    return rows.filter(F.col(column).startswith(prefix)).orderBy(column)


def keyset_page(rows: DataFrame, prefix: str = "", after: str | None = None, limit: int = 64, column: str = "key") -> DataFrame:
    """Up to ``limit`` rows under ``prefix`` after an exclusive cursor, in key order."""
    if not 1 <= limit <= MOST:
        raise ValueError(f"limit must be from 1 to {MOST}")
    found = rows.filter(F.col(column).startswith(prefix)) if prefix else rows
    if after is not None:
        found = found.filter(F.col(column) > after)
    return found.orderBy(column).limit(limit)


def get_many(rows: DataFrame, wanted: DataFrame, column: str = "key") -> DataFrame:
    """For each (ordinal, key) of ``wanted`` the row of that key, or nulls; ordered as asked."""
    return wanted.join(rows, column, "left").orderBy("ordinal")


def children(entries: DataFrame, parent: str | None = None) -> DataFrame:
    """Sorted names below each parent, or below one."""
    found = entries if parent is None else entries.filter(F.col("parent_id") == parent)
    return found.select("parent_id", "name", "child_id").orderBy("parent_id", "name")


def directory_page(entries: DataFrame, parent: str, after: str | None = None, limit: int = 64, inodes: DataFrame | None = None) -> DataFrame:
    """A page of a directory in the order of names, with its inodes if given; ``eof`` says that none follow.

    The cursor is the last name shown. Pages of one version are stable whatever happens to
    the directory meanwhile, as a version is immutable; a new cursor starts without ``after``.
    """
    if not 1 <= limit <= MOST - 1:
        raise ValueError(f"limit must be from 1 to {MOST - 1}")
    names = entries.filter(F.col("parent_id") == parent).select("name", "child_id")
    if after is not None:
        names = names.filter(F.col("name") > after)
    first = names.orderBy("name").limit(limit + 1)
    page = first.withColumns({"_n": F.row_number().over(Window.orderBy("name")), "eof": F.count("*").over(Window.partitionBy(F.lit(0))) <= limit}).filter(F.col("_n") <= limit).drop("_n")
    return page if inodes is None else page.join(inodes, F.col("child_id") == F.col("inode_id")).drop("child_id")


def probe(rows: DataFrame, prefix: str, column: str = "key") -> DataFrame:
    """At most one row: the number after ``prefix`` of a key that has one and nothing else."""
    rest = F.substr(F.col(column), F.lit(len(prefix) + 1)).try_cast("long")
    return rows.filter(F.col(column).startswith(prefix)).select(rest.alias("number")).filter("number IS NOT NULL").limit(1)


def within_budget(rows: DataFrame, size: str, budget: int, partition: list[str], order: list[str]) -> DataFrame:
    """The leading rows of each partition whose sizes sum to ``budget`` at most; the first row is always kept."""
    summed = running(rows, partition, order, _sum=F.col(size), _row=F.lit(1))
    return summed.filter((F.col("_sum") <= budget) | (F.col("_row") == 1)).drop("_sum", "_row")


def worlds_first(names: DataFrame, first: str = "main") -> DataFrame:
    """Names with ``first`` ahead and the rest sorted."""
    return names.orderBy(F.col("name") != first, "name")
