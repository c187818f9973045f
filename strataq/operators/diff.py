"""Comparing two immutable revisions of a keyed dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataq.functions import scalars

#: Attributes of an inode whose difference is a change of metadata.
INODE_ATTRIBUTES = ("inode_id", "kind", "mode", "flags", "links", "size", "modified_ns", "changed_ns", "accessed_ns", "birth_ns", "has_xattrs")
#: Kinds without content of their own.
_BARE = ("dir", "fifo", "socket")
PAGE_LIMIT = 64


def revision_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of ``(key, oid, meta)`` that differ between two revisions.

    Equal content ids prove equal content, so no payload is read. A renamed row shows as one
    removed and one added row; unchanged keys give no row. One full outer join on the key.
    """
    b = before.select("key", F.col("oid").alias("before_oid"), F.col("meta").alias("before_meta"), F.lit(True).alias("in_before"))
    a = after.select("key", F.col("oid").alias("after_oid"), F.col("meta").alias("after_meta"), F.lit(True).alias("in_after"))
    one_sided = F.col("in_before").isNull() | F.col("in_after").isNull()
    return (
        b.join(a, "key", "full_outer")
        .select(
            "key",
            change_kind("in_before", "in_after").alias("change"),
            (one_sided | ~F.col("before_meta").eqNullSafe(F.col("after_meta"))).alias("metadata_changed"),
            (one_sided | ~F.col("before_oid").eqNullSafe(F.col("after_oid"))).alias("content_changed"),
            "before_oid",
            "after_oid",
        )
        .filter("metadata_changed OR content_changed")
    )


def change_kind(before: str, after: str) -> Column:
    return F.when(F.col(before).isNull(), "added").when(F.col(after).isNull(), "removed").otherwise("modified")


def diff_if_changed(before: DataFrame, after: DataFrame, before_manifest: str, after_manifest: str) -> DataFrame:
    """Equal manifests prove equal revisions: the result is then empty and nothing is scanned."""
    out = revision_diff(before, after)
    return out.limit(0) if before_manifest == after_manifest else out


def diff_stat(changes: DataFrame) -> DataFrame:
    """Changes by kind, and how many of them touch content or metadata."""
    return changes.groupBy("change").agg(F.count("*").alias("n"), F.count_if("content_changed").alias("n_content"), F.count_if("metadata_changed").alias("n_metadata"))


def diff_page(changes: DataFrame, after=None, limit: int = PAGE_LIMIT, key: str = "key") -> DataFrame:
    """One page in key order with an exclusive cursor; ``next_after`` is null at the end."""
    if not 1 <= limit <= PAGE_LIMIT:
        raise ValueError(f"limit must be from 1 to {PAGE_LIMIT}")
    rows = changes if after is None else changes.filter(F.col(key) > after)
    # One row more than asked tells whether this is the last page; the page is bounded by the limit.
    whole = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    page = rows.orderBy(key).limit(limit + 1).withColumns({"_n": F.count("*").over(whole), "_at": F.row_number().over(Window.orderBy(key)), "_last": F.nth_value(key, limit).over(whole)})
    return page.filter(F.col("_at") <= limit).withColumn("eof", F.col("_n") <= limit).withColumn("next_after", F.when(F.col("_n") > limit, F.col("_last"))).drop("_n", "_at", "_last")


def namespace_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Differences of two trees, one row per path: inodes with ``path``, ``INODE_ATTRIBUTES``, ``xattrs`` (a hash) and ``content`` (a hash of the logical bytes, null for kinds without).

    A directory on one side only has no content change; two-sided directories, FIFOs and
    sockets change content exactly when their kind does; how bytes are laid out in chunks is
    no change, as ``content`` is a hash of logical bytes.
    """
    side = lambda df, name: df.select("path", F.struct(*INODE_ATTRIBUTES, "xattrs", "content").alias(name))
    j = side(before, "b").join(side(after, "a"), "path", "full_outer")
    one = F.col("a").isNull() | F.col("b").isNull()
    attributes = ~F.struct(*(F.col(f"b.{c}") for c in INODE_ATTRIBUTES)).eqNullSafe(F.struct(*(F.col(f"a.{c}") for c in INODE_ATTRIBUTES)))
    xattrs = ~F.col("b.xattrs").eqNullSafe(F.col("a.xattrs"))
    present_kind = F.coalesce("b.kind", "a.kind")
    bare = F.col("b.kind").isin(*_BARE) | F.col("a.kind").isin(*_BARE)
    content = F.when(one, present_kind != "dir").when(bare, F.col("b.kind") != F.col("a.kind")).when((F.col("b.kind") == "symlink") != (F.col("a.kind") == "symlink"), True).when(F.col("b.size") != F.col("a.size"), True).otherwise(~F.col("b.content").eqNullSafe(F.col("a.content")))
    return j.select(
        "path",
        F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").otherwise("modified").alias("change"),
        F.col("b.inode_id").alias("before_inode"), F.col("a.inode_id").alias("after_inode"),
        F.col("b.kind").alias("before_type"), F.col("a.kind").alias("after_type"),
        (one | xattrs).alias("xattrs_changed"), (one | attributes | xattrs).alias("metadata_changed"), content.alias("content_changed"),
    ).filter("metadata_changed OR content_changed")


def status_diff(snapshot: DataFrame, world: DataFrame) -> DataFrame:
    """A/M/D/T per ``key`` from (key, size, mtime, oid, mode): equal size and time skip the bytes; T is metadata alone."""
    s = snapshot.select("key", F.struct("size", "mtime", "oid", "mode").alias("s"))
    w = world.select("key", F.struct("size", "mtime", "oid", "mode").alias("w"))
    quick = F.col("s.size").eqNullSafe(F.col("w.size")) & F.col("s.mtime").eqNullSafe(F.col("w.mtime"))
    status = (
        F.when(F.col("s").isNull(), "A")
        .when(F.col("w").isNull(), "D")
        .when(~F.col("s.size").eqNullSafe(F.col("w.size")), "M")
        .when(~quick & ~F.col("s.oid").eqNullSafe(F.col("w.oid")), "M")
        .when(~F.col("s.mode").eqNullSafe(F.col("w.mode")), "T")
    )
    return s.join(w, "key", "full_outer").select("key", status.alias("status")).filter("status IS NOT NULL")


def status_tree(snapshot: DataFrame, world: DataFrame) -> DataFrame:
    """A/M/D/T per path from (key, kind, size, mtime, oid, mode).

    A directory on both sides shows nothing; one on one side is represented by what is in it,
    or by itself if it is empty; another kind under the same path is a change of content.
    """

    def side(rows: DataFrame, name: str) -> DataFrame:
        filled = rows.select(scalars.dirname(F.col("key")).alias("key")).distinct().withColumn("_filled", F.lit(True))
        shown = (F.col("kind") != "dir") | F.col("_filled").isNull()
        return rows.join(filled, "key", "left").select("key", F.struct("kind", "size", "mtime", "oid", "mode", shown.alias("shown")).alias(name))

    same = lambda c: F.col(f"s.{c}").eqNullSafe(F.col(f"w.{c}"))
    status = (
        F.when(F.col("s").isNull(), F.when(F.col("w.shown"), "A"))
        .when(F.col("w").isNull(), F.when(F.col("s.shown"), "D"))
        .when((F.col("s.kind") == "dir") & (F.col("w.kind") == "dir"), F.lit(None).cast("string"))
        .when(~same("kind") | ~same("size") | (~same("mtime") & ~same("oid")), "M")
        .when(~same("mode"), "T")
    )
    return side(snapshot, "s").join(side(world, "w"), "key", "full_outer").select("key", status.alias("status")).filter("status IS NOT NULL")
