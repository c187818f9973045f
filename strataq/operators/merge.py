"""Three-way merges with explicit conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CONFLICT_LIMIT = 32


def _unit(df: DataFrame, side: str, group: Column | None) -> DataFrame:
    key = F.col("key") if group is None else group
    return df.select(key.alias("key"), F.lit(side).alias("side"), F.struct(F.col("key").alias("member"), "oid", "meta").alias("row"))


def three_way(base: DataFrame, source: DataFrame, target: DataFrame, group: Column | None = None) -> DataFrame:
    """One row per unit: ``action`` keep, take or conflict, and the members of the result.

    Rows have (key, oid, meta). ``group`` maps a key to its unit, for an inode with its
    content, chunks and attributes; units are compared as sorted sets of rows. Source equal
    to base or target keeps the target; target equal to base takes the source; else conflict.
    A single shuffle on the unit gathers all three sides.
    """
    rows = _unit(base, "b", group).unionByName(_unit(source, "s", group)).unionByName(_unit(target, "t", group))
    side = lambda s: F.sort_array(F.filter(F.collect_list(F.when(F.col("side") == s, F.col("row"))), lambda x: x.isNotNull())).alias(s)
    units = rows.groupBy("key").agg(side("b"), side("s"), side("t"))
    action = F.when((F.col("s") == F.col("b")) | (F.col("s") == F.col("t")), "keep").when(F.col("t") == F.col("b"), "take").otherwise("conflict")
    return units.withColumn("action", action).withColumn("result", F.when(F.col("action") == "take", F.col("s")).when(F.col("action") == "keep", F.col("t")))


def merge_rows(base: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """The merge of single-row units: key, action, and the row that results (nulls: absent or in conflict)."""
    merged = three_way(base, source, target)
    first = F.get(F.col("result"), F.lit(0))
    return merged.select("key", "action", first["oid"].alias("oid"), first["meta"].alias("meta"), (F.size("b") > 0).alias("in_base"), (F.size("s") > 0).alias("in_source"), (F.size("t") > 0).alias("in_target"))


def summary(merged: DataFrame) -> DataFrame:
    return merged.groupBy("action").agg(F.count("*").alias("n"), F.count("oid").alias("n_rows"))


def conflicts(merged: DataFrame, limit: int = CONFLICT_LIMIT) -> DataFrame:
    """The first conflicts in key order, and whether there are more."""
    found = merged.filter("action = 'conflict'").orderBy("key").limit(limit + 1)
    # The limit comes first, so the windows see at most one row more than it.
    return found.withColumns({"conflicts_limited": F.count("*").over(Window.partitionBy(F.lit(0))) > limit, "_at": F.row_number().over(Window.orderBy("key"))}).filter(F.col("_at") <= limit).drop("_at")


def shortcut(base: str, source: str, target: str) -> str | None:
    """What manifests alone decide: ``unchanged``, ``fast-forward``, or nothing."""
    if source in (base, target):
        return "unchanged"
    return "fast-forward" if target == base else None


def token(*parts: Column) -> Column:
    """The fence of a plan; applying it requires the same token again."""
    return F.sha2(F.concat_ws("/", *(p.cast("string") for p in parts)), 256)


def directory_merge(base: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Directory inodes edited on both sides that differ in links and times only: the later times win, links are counted anew elsewhere."""
    j = base.select("inode_id", F.struct("mode", "flags").alias("b")).join(source.select("inode_id", F.struct("mode", "flags").alias("s"), F.col("modified_ns").alias("sm"), F.col("changed_ns").alias("sc")), "inode_id").join(target.select("inode_id", F.struct("mode", "flags").alias("t"), F.col("modified_ns").alias("tm"), F.col("changed_ns").alias("tc")), "inode_id")
    return j.filter("b = s AND b = t").select("inode_id", F.greatest("sm", "tm").alias("modified_ns"), F.greatest("sc", "tc").alias("changed_ns"))


def records(inodes: DataFrame, entries: DataFrame, chunks: DataFrame, xattrs: DataFrame) -> DataFrame:
    """A tree as records (key, oid, meta) by unit: an entry by itself, an inode with its content and attributes.

    ``meta`` of an inode holds what only counts for directories: links and times.
    """
    counted = [c for c in ("links", "modified_ns", "changed_ns") if c in inodes.columns]
    fixed = [c for c in inodes.columns if c not in counted and c != "inode_id"]
    inode = lambda c: F.concat(F.lit("inode/"), c)
    texts = lambda *columns: F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns))
    i = inodes.select(inode(F.col("inode_id")).alias("key"), F.lit("i").alias("part"), texts(*fixed).alias("oid"), texts(*counted).alias("meta"))
    none = F.lit("").alias("meta")
    c = chunks.select(inode(F.col("inode_id")).alias("key"), F.concat(F.lit("c"), F.lpad(F.col("idx").cast("string"), 12, "0")).alias("part"), F.col("oid"), none)
    x = xattrs.select(inode(F.col("inode_id")).alias("key"), F.concat(F.lit("x"), "name").alias("part"), F.hex("value").alias("oid"), none)
    e = entries.select(F.concat(F.lit("entry/"), "parent_id", F.lit("/"), "name").alias("key"), F.lit("e").alias("part"), F.col("child_id").alias("oid"), none)
    return i.unionByName(c).unionByName(x).unionByName(e)


def namespace_merge(base: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """The merge of three trees as ``records`` by unit: ``key``, ``action`` and ``kind``.

    Source equal to base or target keeps the target, target equal to base takes the source.
    A directory whose entries both sides have changed, and which differs in links and times
    only, is merged (the later times win; links are counted anew). All else is a conflict, of
    the kind of its key.
    """
    side = lambda df, s: df.select("key", F.lit(s).alias("side"), "part", "oid", "meta")
    rows = side(base, "b").unionByName(side(source, "s")).unionByName(side(target, "t"))
    # A unit is compared by a hash of its sorted parts; each part is hashed before the shuffle.
    part = rows.withColumn("h", F.sha2(F.concat_ws("\x1f", "part", "oid"), 256)).withColumn("m", F.concat_ws("\x1f", "part", "meta"))
    of = lambda c, s: F.sort_array(F.collect_list(F.when(F.col("side") == s, F.col(c))))
    whole = lambda s: F.concat_ws(",", *(of(c, s) for c in ("h", "m"))).alias(s)
    units = part.groupBy("key").agg(*(whole(s) for s in "bst"), *(F.concat_ws(",", of("h", s)).alias(f"{s}_fixed") for s in "bst"))
    units = units.withColumn("s_edit", F.col("s") != F.col("b")).withColumn("t_edit", F.col("t") != F.col("b"))
    edited = units.filter(F.col("key").startswith("entry/")).select(F.concat(F.lit("inode/"), F.element_at(F.split("key", "/"), 2)).alias("key"), "s_edit", "t_edit").groupBy("key").agg(F.bool_or("s_edit").alias("s_under"), F.bool_or("t_edit").alias("t_under"))
    j = units.join(edited, "key", "left")
    merges = F.col("s_under") & F.col("t_under") & (F.col("b_fixed") != "") & (F.col("s_fixed") == F.col("b_fixed")) & (F.col("t_fixed") == F.col("b_fixed"))
    action = F.when(~F.col("s_edit") | (F.col("s") == F.col("t")), "keep").when(~F.col("t_edit"), "take").when(F.coalesce(merges, F.lit(False)), "merge").otherwise("conflict")
    return j.select("key", action.alias("action"), F.split("key", "/")[0].alias("kind"))


def merged_entries(plan: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """The entries of a merge without conflicts, for the final audit."""
    key = F.concat(F.lit("entry/"), "parent_id", F.lit("/"), "name")
    act = plan.filter("kind = 'entry'").select("key", "action")
    kept = target.withColumn("key", key).join(act.filter("action = 'keep'"), "key", "left_semi")
    taken = source.withColumn("key", key).join(act.filter("action = 'take'"), "key", "left_semi")
    return kept.unionByName(taken).drop("key")
