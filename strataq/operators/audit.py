"""Audits: each returns the rows that violate an invariant."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataq.functions import scalars
from strataq.operators import graph


def link_counts(inodes: DataFrame, entries: DataFrame, root: str | None = None) -> DataFrame:
    """Inodes whose ``links`` is not the number of their names; a directory has two and one for each subdirectory."""
    names = entries.groupBy(F.col("child_id").alias("inode_id")).agg(F.count("*").alias("names"))
    kinds = inodes.select(F.col("inode_id").alias("child_id"), "kind")
    subdirs = entries.join(kinds, "child_id").filter("kind = 'dir'").groupBy(F.col("parent_id").alias("inode_id")).agg(F.count("*").alias("subdirs"))
    j = inodes.join(names, "inode_id", "left").join(subdirs, "inode_id", "left")
    expected = F.when(F.col("kind") == "dir", F.lit(2) + F.coalesce("subdirs", F.lit(0))).otherwise(F.coalesce("names", F.lit(0)))
    bad = j.withColumn("expected", expected.cast("long")).filter("links <> expected")
    return bad.select("inode_id", "links", "expected")


def unmatched(actual: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side."""
    extra = actual.select(key).join(expected.select(key), key, "left_anti").withColumn("problem", F.lit("unexpected"))
    missing = expected.select(key).join(actual.select(key), key, "left_anti").withColumn("problem", F.lit("missing"))
    return extra.unionByName(missing)


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often, with the signed count; empty means equal multisets. Both sides have equal columns."""
    columns = a.columns
    both = a.withColumn("_n", F.lit(1)).unionByName(b.withColumn("_n", F.lit(-1)))
    return both.groupBy(*columns).agg(F.sum("_n").alias("surplus")).filter("surplus <> 0")


def order_violations(rows: DataFrame, partition: str, order: str, key: str) -> DataFrame:
    """Rows whose key is not larger than that of the row before."""
    w = Window.partitionBy(partition).orderBy(order)
    return rows.withColumn("previous", F.lag(key).over(w)).filter(F.col("previous") >= F.col(key))


def sequence_gaps(rows: DataFrame, partition: str, seq: str = "seq") -> DataFrame:
    """Rows that do not follow their predecessor by one."""
    w = Window.partitionBy(partition).orderBy(seq)
    return rows.withColumn("previous", F.lag(seq).over(w)).filter(F.col("previous") + 1 != F.col(seq))


def chain_violations(commits: DataFrame, partition: str) -> DataFrame:
    """Commits (seq, hash, previous_hash) that do not carry the hash of the one before."""
    w = Window.partitionBy(partition).orderBy("seq")
    return commits.withColumn("expected", F.lag("hash").over(w)).filter("expected IS NOT NULL AND NOT (previous_hash <=> expected)")


def stored_counts(actual: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored counters (name, n) that differ from a fresh count of (name)."""
    fresh = actual.groupBy("name").agg(F.count("*").alias("counted"))
    return stored.join(fresh, "name", "full_outer").filter("NOT (n <=> counted)")


def xattr_limits(xattrs: DataFrame, most_names: int = 128, most_bytes: int = 8 << 20, most_value: int = (256 << 10) - 1) -> DataFrame:
    """Inodes over the limits on attribute names, total bytes, or bytes of one value."""
    size = F.octet_length("value")
    sums = xattrs.groupBy("inode_id").agg(F.count("*").alias("names"), F.sum(size + F.octet_length("name")).alias("bytes"), F.max(size).alias("largest"))
    return sums.filter((F.col("names") > most_names) | (F.col("bytes") > most_bytes) | (F.col("largest") > most_value))


def snapshot_counts(manifest: DataFrame, tree: DataFrame) -> DataFrame:
    """One row: entries missing from the tree, modified, unprotected, and extra. Both have (path, oid); the tree also ``locked``."""
    j = manifest.select("path", F.col("oid").alias("m")).join(tree.select("path", F.col("oid").alias("t"), "locked"), "path", "full_outer")
    return j.agg(F.count_if(F.col("t").isNull()).alias("missing"), F.count_if(F.col("m").isNotNull() & (F.col("m") != F.col("t"))).alias("modified"), F.count_if(F.col("m").isNotNull() & F.col("t").isNotNull() & ~F.col("locked")).alias("unprotected"), F.count_if(F.col("m").isNull()).alias("extra"))


def state_violations(inodes: DataFrame) -> DataFrame:
    """Inodes whose state does not fit their kind: directories without content of their own, FIFOs and sockets without bytes, one kind out of the known ones."""
    problem = (
        F.when(~F.col("kind").isin("dir", "file", "symlink", "fifo", "socket"), "unknown kind")
        .when(F.col("kind").isin("dir", "fifo", "socket") & (F.col("size") != 0), "size without content")
        .when((F.col("kind") == "dir") & (F.col("links") < 2), "too few links")
        .when(F.col("size") < 0, "negative size")
    )
    return inodes.select("inode_id", problem.alias("problem")).filter("problem IS NOT NULL")


def namespace_audit(inodes: DataFrame, entries: DataFrame, chunks: DataFrame, xattrs: DataFrame, root: str, chunk: int) -> DataFrame:
    """Every problem of a tree as (inode_id, problem): structure, states, reachability, directory aliases, content and attributes."""
    known = lambda df: df.join(inodes, "inode_id", "left_anti").select("inode_id").distinct()
    sized = chunks.join(inodes.select("inode_id", "size"), "inode_id")
    flagged = inodes.select("inode_id", "has_xattrs").join(xattrs.select("inode_id").distinct().withColumn("_x", F.lit(True)), "inode_id", "left")
    lost = graph.cycles(entries, root).select(F.col("child_id").alias("inode_id")).distinct()
    unnamed = inodes.filter(F.col("inode_id") != root).join(entries.select(F.col("child_id").alias("inode_id")), "inode_id", "left_anti")
    parts = [
        namespace_violations(inodes, entries, chunks),
        state_violations(inodes),
        lost.withColumn("problem", F.lit("not below the root")),
        unnamed.select("inode_id", F.lit("no name").alias("problem")),
        graph.multiply_linked(entries, inodes.filter("kind = 'dir'")).select(F.col("child_id").alias("inode_id"), F.lit("directory with names").alias("problem")),
        sized.filter((F.col("idx") * chunk >= F.col("size")) | (F.col("len") > chunk) | (F.col("len") < 1)).select("inode_id").distinct().withColumn("problem", F.lit("chunk beyond the file")),
        known(xattrs).withColumn("problem", F.lit("orphan attribute")),
        flagged.filter("has_xattrs <> (_x IS NOT NULL)").select("inode_id", F.lit("attribute flag").alias("problem")),
        xattr_limits(xattrs).select("inode_id", F.lit("attribute limits").alias("problem")),
        entries.filter(~scalars.valid_name(F.col("name"))).select(F.col("parent_id").alias("inode_id")).distinct().withColumn("problem", F.lit("invalid name")),
    ]
    return reduce(DataFrame.unionByName, parts)


def namespace_violations(inodes: DataFrame, entries: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """All structural problems of a tree as (inode_id, problem)."""
    directories = inodes.filter("kind = 'dir'")
    parts = [
        link_counts(inodes, entries).select("inode_id", F.lit("links").alias("problem")),
        entries.select(F.col("child_id").alias("inode_id")).join(inodes, "inode_id", "left_anti").distinct().withColumn("problem", F.lit("dangling entry")),
        entries.select(F.col("parent_id").alias("inode_id")).join(directories, "inode_id", "left_anti").distinct().withColumn("problem", F.lit("parent is no directory")),
        entries.groupBy("parent_id", "name").count().filter("count > 1").select(F.col("parent_id").alias("inode_id"), F.lit("duplicate name").alias("problem")),
    ]
    if chunks is not None:
        parts.append(chunks.select("inode_id").join(inodes.filter("kind = 'file'"), "inode_id", "left_anti").distinct().withColumn("problem", F.lit("orphan content")))
    return reduce(DataFrame.unionByName, parts)
