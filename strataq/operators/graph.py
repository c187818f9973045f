"""Reachability, sweeps and trees."""

from __future__ import annotations

import functools
import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.functions import scalars
from strataq.operators.history import ancestry
from strataq.session import checkpointed

DEPTH_LIMIT = 256
FOLLOW_LIMIT = 40
EXPANSION_LIMIT = 65_536
#: Rounds after which the parts of a result are written as one.
COLLAPSE = 16


def reachable(edges: DataFrame, roots: DataFrame, most_rounds: int | None = None) -> DataFrame:
    """Distinct nodes reachable over (src, dst) from ``roots`` (node), with the depth first seen.

    Edges are written once, by their source. Each round joins the frontier only, drops what
    was seen before, and writes nothing but the new frontier, so that it ends; more than
    ``most_rounds`` are an error.
    """
    edges = checkpointed(edges.select("src", "dst").distinct().repartition("src"))
    seen = frontier = checkpointed(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    for depth in itertools.count(1) if most_rounds is None else range(1, most_rounds + 1):
        nxt = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth))
        frontier = checkpointed(nxt)
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)
        if depth % COLLAPSE == 0:  # a union of too many parts is slow to plan
            seen = checkpointed(seen)
    raise RuntimeError(f"deeper than {most_rounds}")


def sweep(objects: DataFrame, live: DataFrame, key: str = "node") -> DataFrame:
    """Objects that nothing live reaches."""
    return objects.join(live.select(key), key, "left_anti")


def retained(objects: DataFrame, live: DataFrame, key: str = "node") -> DataFrame:
    return objects.join(live.select(key), key, "left_semi")


def tree_paths(entries: DataFrame, root: str, most_depth: int = DEPTH_LIMIT) -> DataFrame:
    """(inode_id, path, depth) for every name below ``root``, from (parent_id, name, child_id); a name deeper than the limit is an error."""
    spark = entries.sparkSession
    level = spark.createDataFrame([(root, "/")], "inode_id string, path string").withColumn("depth", F.lit(0))
    out = level
    for depth in range(1, most_depth + 2):
        joined = level.join(entries, F.col("inode_id") == F.col("parent_id"))
        path = F.when(F.col("path") == "/", F.concat(F.lit("/"), "name")).otherwise(F.concat_ws("/", "path", "name"))
        level = checkpointed(joined.select(F.col("child_id").alias("inode_id"), path.alias("path")).withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise RuntimeError(f"a directory is deeper than {most_depth}, or part of a cycle")


def one_path(paths: DataFrame, most_bytes: int = 4096) -> DataFrame:
    """The smallest path of each inode among those that fit."""
    return paths.filter(F.octet_length("path") <= most_bytes).groupBy("inode_id").agg(F.min("path").alias("path"))


def subtree_sizes(paths: DataFrame, sizes: DataFrame, entry_cost: int = 1024) -> DataFrame:
    """For each directory prefix the entries at and below it, and their bytes with a fixed cost for each entry."""
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))
    rows = paths.join(sizes, "inode_id").select(F.explode(prefixes).alias("path"), (F.lit(entry_cost) + F.col("size")).alias("cost"))
    return rows.groupBy("path").agg(F.count("*").alias("entries"), F.sum("cost").alias("bytes"))


def multiply_linked(entries: DataFrame, directories: DataFrame) -> DataFrame:
    """Directories with more than one name, which a tree must not have."""
    return entries.join(directories.select(F.col("inode_id").alias("child_id")), "child_id", "left_semi").groupBy("child_id").agg(F.count("*").alias("names")).filter("names > 1")


def resolve(paths: DataFrame, entries: DataFrame, inodes: DataFrame, links: DataFrame, root: str, follow_final: bool = True) -> DataFrame:
    """``query``, ``inode_id`` and ``error`` for each (query, path), component by component.

    ``entries`` has (parent_id, name, child_id), ``inodes`` (inode_id, kind) and ``links``
    (inode_id, target). A dot stays, two dots go up (never above the root), a link's target
    takes its place and starts at the root if it is absolute; links are followed before what
    comes after them. Errors: ``EINVAL`` (not absolute), ``ENOTDIR``, ``ENOENT``, ``ELOOP``
    (over 40 links) and ``ENAMETOOLONG`` (targets of over 65,536 bytes together). Without
    ``follow_final`` a link at the end is itself the result. One round for each component.
    """
    parts = scalars.path_parts(F.col("path"))
    state = paths.select("query", F.array(F.lit(root)).alias("stack"), F.coalesce(parts, F.array().cast("array<string>")).alias("pending"), F.lit(0).alias("follows"), F.lit(0).cast("long").alias("expanded"), F.lit("dir").alias("kind"), F.when(parts.isNull(), F.lit("EINVAL")).alias("error"))
    kinds = inodes.select(F.col("inode_id").alias("_child"), F.col("kind").alias("_kind"))
    targets = links.select(F.col("inode_id").alias("_child"), F.col("target").alias("_target"))
    # Names with what they lead to are put together once; a round is then one join.
    children = entries.select(F.col("parent_id").alias("_top"), F.col("name").alias("_head"), F.col("child_id").alias("_child"))
    children = checkpointed(children.join(kinds, "_child", "left").join(targets, "_child", "left"))
    done = []
    for turn in itertools.count(1):
        state = checkpointed(state)
        done.append(state.filter("error IS NOT NULL OR size(pending) = 0"))
        todo = state.filter("error IS NULL AND size(pending) > 0")
        if todo.isEmpty():
            break
        todo = todo.withColumn("_top", F.element_at("stack", -1)).withColumn("_head", F.element_at("pending", 1)).withColumn("_rest", F.slice("pending", F.lit(2), F.size("pending")))
        j = todo.join(children, ["_top", "_head"], "left")
        dot, up = F.col("_head") == ".", F.col("_head") == ".."
        follow = (F.col("_kind") == "symlink") & (F.lit(follow_final) | (F.size("_rest") > 0)) & ~dot & ~up
        longer = F.col("expanded") + F.octet_length("_target")
        error = F.when(F.col("kind") != "dir", "ENOTDIR").when(~dot & ~up & F.col("_child").isNull(), "ENOENT").when(follow & (F.col("follows") >= FOLLOW_LIMIT), "ELOOP").when(follow & (longer > EXPANSION_LIMIT), "ENAMETOOLONG")
        target = scalars.link_parts(F.col("_target"))
        target = F.when(F.col("_target").endswith("/") & (F.size(target) > 0), F.concat(target, F.array(F.lit(".")))).otherwise(target)
        stack = (
            F.when(dot, F.col("stack"))
            .when(up, F.slice("stack", F.lit(1), F.greatest(F.size("stack") - 1, F.lit(1))))
            .when(follow, F.when(F.col("_target").startswith("/"), F.array(F.lit(root))).otherwise(F.col("stack")))
            .otherwise(F.concat("stack", F.array("_child")))
        )
        state = j.select(
            "query", stack.alias("stack"), F.when(follow, F.concat(target, F.col("_rest"))).otherwise(F.col("_rest")).alias("pending"),
            F.when(follow, F.col("follows") + 1).otherwise(F.col("follows")).alias("follows"), F.when(follow, longer).otherwise(F.col("expanded")).alias("expanded"),
            F.when(dot | up | follow, "dir").otherwise(F.col("_kind")).alias("kind"), error.alias("error"),
        )
        if turn % COLLAPSE == 0:
            done = [checkpointed(functools.reduce(DataFrame.unionByName, done))]
    out = functools.reduce(DataFrame.unionByName, done)
    return out.select("query", F.when(F.col("error").isNull(), F.element_at("stack", -1)).alias("inode_id"), "error")


def inside(entries: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (directory, place) where the place is the directory or lies below it, by jumps up the tree."""
    chain = ancestry(entries.select(F.col("child_id").alias("revision_id"), "parent_id"), pairs.select(F.col("place").alias("revision_id")).distinct())
    return pairs.join(chain.select(F.col("tip").alias("place"), F.col("revision_id").alias("directory")), ["place", "directory"], "left_semi")


def cycles(entries: DataFrame, root: str) -> DataFrame:
    """Entries that no path from the root leads to: those of a cycle, and all below it."""
    found = reachable(entries.select(F.col("parent_id").alias("src"), F.col("child_id").alias("dst")), entries.sparkSession.createDataFrame([(root,)], "node string"))
    return entries.join(found.select(F.col("node").alias("parent_id")), "parent_id", "left_anti")


def height(paths: DataFrame) -> DataFrame:
    """One row: the largest depth of any path, and how many paths have it."""
    deepest = paths.groupBy("depth").agg(F.count("*").alias("n"))
    return deepest.agg(F.max("depth").alias("height"), F.max_by("n", "depth").alias("n"))
