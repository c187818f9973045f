"""Changes to a tree of inodes, entries, chunks and attributes; each returns a new version.

A version is a ``Tree`` of DataFrames. A verb replaces the rows it touches: the old ones are
removed by an anti-join on their key and the new ones are added; all other rows are shared.
Verbs on many names at once take DataFrames, so a bulk change is one plan.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.operators import capture, graph
from strataq.session import checkpointed

INODE = "inode_id string, kind string, mode int, flags int, links long, size long, modified_ns long, changed_ns long, accessed_ns long, birth_ns long, has_xattrs boolean"
ENTRY = "parent_id string, name string, child_id string"
CHUNK = "inode_id string, idx long, oid string, len long"
XATTR = "inode_id string, name string, value binary"


@dataclass(frozen=True)
class Tree:
    inodes: DataFrame
    entries: DataFrame
    chunks: DataFrame
    xattrs: DataFrame


def _put(rows: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    return rows.join(new.select(*key), list(key), "left_anti").unionByName(new)


def _absent(tree: Tree, names: DataFrame) -> None:
    if not names.join(tree.entries, ["parent_id", "name"], "left_semi").isEmpty() or not names.groupBy("parent_id", "name").count().filter("count > 1").isEmpty():
        raise FileExistsError("a name exists or is repeated")


def relink(tree: Tree, now_ns: int, touched: DataFrame | None = None) -> Tree:
    """Count links anew: a directory has two and one for each subdirectory, others one for each name."""
    names = tree.entries.groupBy(F.col("child_id").alias("inode_id")).agg(F.count("*").alias("_n"))
    kinds = tree.inodes.select(F.col("inode_id").alias("child_id"), F.col("kind").alias("_k"))
    subs = tree.entries.join(kinds, "child_id").filter("_k = 'dir'").groupBy(F.col("parent_id").alias("inode_id")).agg(F.count("*").alias("_d"))
    j = tree.inodes.join(names, "inode_id", "left").join(subs, "inode_id", "left")
    links = F.when(F.col("kind") == "dir", F.lit(2) + F.coalesce("_d", F.lit(0))).otherwise(F.coalesce("_n", F.lit(0))).cast("long")
    rows = j.withColumn("links", links).drop("_n", "_d")
    if touched is not None:
        rows = rows.join(touched.select("inode_id").distinct().withColumn("_t", F.lit(True)), "inode_id", "left")
        for c in ("modified_ns", "changed_ns"):
            rows = rows.withColumn(c, F.when(F.col("_t"), F.lit(now_ns)).otherwise(F.col(c)))
        rows = rows.drop("_t")
    return replace(tree, inodes=rows)


def create(tree: Tree, new: DataFrame, kind: str, mode: int, now_ns: int) -> Tree:
    """Make directories, files, links, FIFOs or sockets from (parent_id, name, inode_id); a name must be new."""
    names = new.select("parent_id", "name")
    _absent(tree, names)
    parents = names.select(F.col("parent_id").alias("inode_id")).distinct()
    if not parents.join(tree.inodes.filter("kind = 'dir'"), "inode_id", "left_anti").isEmpty():
        raise NotADirectoryError("a parent is no directory")
    zero, now = F.lit(0).cast("long"), F.lit(now_ns).cast("long")
    inodes = new.select("inode_id", F.lit(kind).alias("kind"), F.lit(mode).alias("mode"), F.lit(0).alias("flags"), zero.alias("links"), zero.alias("size"), now.alias("modified_ns"), now.alias("changed_ns"), now.alias("accessed_ns"), now.alias("birth_ns"), F.lit(False).alias("has_xattrs"))
    made = replace(tree, inodes=tree.inodes.unionByName(inodes), entries=tree.entries.unionByName(new.select("parent_id", "name", F.col("inode_id").alias("child_id"))))
    return relink(made, now_ns, parents)


def write(tree: Tree, chunks: DataFrame, sizes: DataFrame, now_ns: int) -> Tree:
    """Replace the content of files: chunks (as ``CHUNK``) and sizes (inode_id, size)."""
    kept = tree.chunks.join(sizes.select("inode_id"), "inode_id", "left_anti")
    return replace(tree, chunks=kept.unionByName(chunks), inodes=_attributes(tree.inodes, sizes, now_ns, modified=True))


def overlay(tree: Tree, chunks: DataFrame, sizes: DataFrame, now_ns: int) -> Tree:
    """Write chunks over those at the same index; ``sizes`` are the sizes after it."""
    return replace(tree, chunks=_put(tree.chunks, chunks, "inode_id", "idx"), inodes=_attributes(tree.inodes, sizes, now_ns, modified=True))


def punch(tree: Tree, holes: DataFrame, now_ns: int) -> Tree:
    """Remove whole chunks (inode_id, first, last), which then read as zeros."""
    j = tree.chunks.join(holes, "inode_id", "left")
    kept = j.filter("first IS NULL OR idx < first OR idx > last").select(*tree.chunks.columns)
    return replace(tree, chunks=kept, inodes=_attributes(tree.inodes, holes.select("inode_id").distinct(), now_ns, modified=True))


def _attributes(inodes: DataFrame, new: DataFrame, now_ns: int, modified: bool = False) -> DataFrame:
    columns = [c for c in new.columns if c != "inode_id"]
    n = new.select("inode_id", F.lit(True).alias("_t"), *(F.col(c).alias(f"_{c}") for c in columns))
    j = inodes.join(n, "inode_id", "left")
    for c in columns:
        j = j.withColumn(c, F.when(F.col("_t"), F.coalesce(f"_{c}", c)).otherwise(F.col(c)))
    for c in ("modified_ns", "changed_ns") if modified else ("changed_ns",):
        if c not in columns:
            j = j.withColumn(c, F.when(F.col("_t"), F.lit(now_ns)).otherwise(F.col(c)))
    return j.select(*inodes.columns)


def set_attributes(tree: Tree, new: DataFrame, now_ns: int) -> Tree:
    """Set mode, flags or times: (inode_id, and any of the columns); nulls leave a value as it is. Sizes change with ``truncate``, which cuts the content too."""
    if "size" in new.columns:
        raise ValueError("sizes change with truncate")
    return replace(tree, inodes=_attributes(tree.inodes, new, now_ns))


def truncate(tree: Tree, sizes: DataFrame, cut: DataFrame, now_ns: int, chunk: int) -> Tree:
    """New sizes (inode_id, size): chunks beyond them go; ``cut`` has those in which a file now ends, as ``CHUNK``."""
    j = tree.chunks.join(sizes.select("inode_id", F.col("size").alias("_s")), "inode_id", "left")
    kept = j.filter(F.col("_s").isNull() | (F.col("idx") * chunk < F.col("_s"))).select(*tree.chunks.columns)
    return replace(tree, chunks=_put(kept, cut, "inode_id", "idx"), inodes=_attributes(tree.inodes, sizes, now_ns, modified=True))


def link(tree: Tree, new: DataFrame, now_ns: int) -> Tree:
    """Further names (parent_id, name, inode_id) for inodes that are no directories."""
    _absent(tree, new.select("parent_id", "name"))
    if not new.join(tree.inodes.filter("kind <> 'dir'"), "inode_id", "left_anti").isEmpty():
        raise PermissionError("a directory, or nothing, can't get another name")
    made = replace(tree, entries=tree.entries.unionByName(new.select("parent_id", "name", F.col("inode_id").alias("child_id"))))
    return relink(made, now_ns, new.select(F.col("parent_id").alias("inode_id")))


def unlink(tree: Tree, names: DataFrame, now_ns: int, open_inodes: DataFrame | None = None) -> Tree:
    """Remove names (parent_id, name). An inode without names goes with its content, unless it is open."""
    gone = tree.entries.join(names, ["parent_id", "name"], "left_semi")
    if not gone.select(F.col("child_id").alias("parent_id")).join(tree.entries.join(names, ["parent_id", "name"], "left_anti"), "parent_id", "left_semi").isEmpty():
        raise OSError("a directory is not empty")
    entries = tree.entries.join(names, ["parent_id", "name"], "left_anti")
    orphans = gone.select(F.col("child_id").alias("inode_id")).distinct().join(entries.select(F.col("child_id").alias("inode_id")), "inode_id", "left_anti")
    if open_inodes is not None:
        orphans = orphans.join(open_inodes, "inode_id", "left_anti")
    drop = lambda df: df.join(orphans, "inode_id", "left_anti")
    made = Tree(drop(tree.inodes), entries, drop(tree.chunks), drop(tree.xattrs))
    return relink(made, now_ns, names.select(F.col("parent_id").alias("inode_id")))


def _ends(tree: Tree, moves: DataFrame) -> DataFrame:
    """``moves`` with the children and kinds at both ends (null: no such name); an absent source is an error."""
    kinds = tree.inodes.select("inode_id", "kind")
    at = lambda a, b, name: tree.entries.select(F.col("parent_id").alias(a), F.col("name").alias(b), F.col("child_id").alias(name)).join(kinds.select(F.col("inode_id").alias(name), F.col("kind").alias(f"{name}_kind")), name)
    found = moves.join(at("parent_id", "name", "source"), ["parent_id", "name"], "left").join(at("to_parent", "to_name", "target"), ["to_parent", "to_name"], "left")
    found = checkpointed(found)
    if not found.filter("source IS NULL").isEmpty():
        raise FileNotFoundError("a source is absent")
    if not found.groupBy("parent_id", "name").count().filter("count > 1").isEmpty() or not found.groupBy("to_parent", "to_name").count().filter("count > 1").isEmpty():
        raise ValueError("a name is moved twice, or two names go to one place")
    return found


def _not_below_itself(tree: Tree, pairs: DataFrame) -> None:
    """``pairs``: (directory, place), where the directory must not be the place nor hold it."""
    if not graph.inside(tree.entries, pairs).isEmpty():
        raise OSError("a directory can't be moved into itself")


def rename(tree: Tree, moves: DataFrame, now_ns: int, exclusive: bool = False) -> Tree:
    """Move names: (parent_id, name, to_parent, to_name). A name in the way is replaced, or refused if ``exclusive``.

    A directory replaces an empty directory only, and other inodes replace no directory; a
    directory can't go below itself; a name that is moved onto itself, or onto another name
    of its inode, stays as it is.
    """
    ends = _ends(tree, moves)
    if exclusive and not ends.filter("target IS NOT NULL").isEmpty():
        raise FileExistsError("a target exists")
    ends = ends.filter("NOT (source <=> target) AND NOT (parent_id = to_parent AND name = to_name)")
    _not_below_itself(tree, ends.filter("source_kind = 'dir'").select(F.col("source").alias("directory"), F.col("to_parent").alias("place")))
    if not ends.filter("target IS NOT NULL AND (source_kind = 'dir') <> (target_kind = 'dir')").isEmpty():
        raise OSError("a directory and another kind can't replace each other")
    taken = ends.filter("target IS NOT NULL").select(F.col("to_parent").alias("parent_id"), F.col("to_name").alias("name"))
    moves = ends.select("parent_id", "name", "to_parent", "to_name")
    moved = ends.select(F.col("to_parent").alias("parent_id"), F.col("to_name").alias("name"), F.col("source").alias("child_id"))
    cleared = tree if taken.isEmpty() else unlink(tree, taken, now_ns)
    entries = cleared.entries.join(moves, ["parent_id", "name"], "left_anti").unionByName(moved)
    touched = moves.select(F.col("parent_id").alias("inode_id")).unionByName(moves.select(F.col("to_parent").alias("inode_id")))
    changed = _attributes(cleared.inodes, ends.select(F.col("source").alias("inode_id")).distinct(), now_ns)
    return relink(replace(cleared, inodes=changed, entries=entries), now_ns, touched)


def exchange(tree: Tree, pairs: DataFrame, now_ns: int) -> Tree:
    """Swap what two names point at: (parent_id, name, to_parent, to_name); both must exist, and neither may go below itself."""
    ends = _ends(tree, pairs)
    if not ends.filter("target IS NULL").isEmpty():
        raise FileNotFoundError("a target is absent")
    ends = ends.filter("source <> target")
    below = ends.filter("source_kind = 'dir'").select(F.col("source").alias("directory"), F.col("to_parent").alias("place"))
    _not_below_itself(tree, below.unionByName(ends.filter("target_kind = 'dir'").select(F.col("target").alias("directory"), F.col("parent_id").alias("place"))))
    moved = ends.select("parent_id", "name", F.col("target").alias("child_id")).unionByName(ends.select(F.col("to_parent").alias("parent_id"), F.col("to_name").alias("name"), F.col("source").alias("child_id")))
    entries = _put(tree.entries, moved, "parent_id", "name")
    changed = _attributes(tree.inodes, moved.select(F.col("child_id").alias("inode_id")).distinct(), now_ns)
    return relink(replace(tree, inodes=changed, entries=entries), now_ns, moved.select(F.col("parent_id").alias("inode_id")))


def save(tree: Tree, new: DataFrame, now_ns: int) -> Tree:
    """Let names (parent_id, name, inode_id) point at inodes that exist already; the old ones go with their last name."""
    old = new.select("parent_id", "name").join(tree.entries, ["parent_id", "name"], "left_semi")
    cleared = unlink(tree, old, now_ns)
    made = replace(cleared, entries=cleared.entries.unionByName(new.select("parent_id", "name", F.col("inode_id").alias("child_id"))))
    return relink(made, now_ns)


def clone(tree: Tree, copies: DataFrame, now_ns: int) -> Tree:
    """Copies (inode_id, new_id, parent_id, name) that share all chunks; mode, times and attributes are kept."""
    _absent(tree, copies.select("parent_id", "name"))
    ids = copies.select("inode_id", "new_id")
    again = lambda df: df.join(ids, "inode_id").withColumn("inode_id", F.col("new_id")).drop("new_id")
    inodes = again(tree.inodes).withColumn("changed_ns", F.lit(now_ns).cast("long"))
    made = Tree(tree.inodes.unionByName(inodes), tree.entries.unionByName(copies.select("parent_id", "name", F.col("new_id").alias("child_id"))), tree.chunks.unionByName(again(tree.chunks)), tree.xattrs.unionByName(again(tree.xattrs)))
    return relink(made, now_ns, copies.select(F.col("parent_id").alias("inode_id")))


def set_xattrs(tree: Tree, new: DataFrame, now_ns: int, policy: str = "upsert") -> Tree:
    """Attributes (inode_id, name, value): ``upsert``, ``create`` (must be new) or ``replace`` (must exist)."""
    present = new.join(tree.xattrs, ["inode_id", "name"], "left_semi")
    if policy == "create" and not present.isEmpty():
        raise FileExistsError("an attribute exists")
    if policy == "replace" and not new.join(tree.xattrs, ["inode_id", "name"], "left_anti").isEmpty():
        raise KeyError("an attribute is absent")
    return _flagged(replace(tree, xattrs=_put(tree.xattrs, new, "inode_id", "name")), new, now_ns)


def remove_xattrs(tree: Tree, names: DataFrame, now_ns: int) -> Tree:
    return _flagged(replace(tree, xattrs=tree.xattrs.join(names, ["inode_id", "name"], "left_anti")), names, now_ns)


def _flagged(tree: Tree, touched: DataFrame, now_ns: int) -> Tree:
    ids = touched.select("inode_id").distinct()
    has = ids.join(tree.xattrs.select("inode_id").distinct().withColumn("has_xattrs", F.lit(True)), "inode_id", "left").withColumn("has_xattrs", F.coalesce("has_xattrs", F.lit(False)))
    return replace(tree, inodes=_attributes(tree.inodes, has, now_ns))


def stat(tree: Tree, which: Column) -> DataFrame:
    """Inodes as JSON objects."""
    return tree.inodes.filter(which).select("inode_id", F.to_json(F.struct(*tree.inodes.columns)).alias("stat"))


def put_objects(roots: DataFrame, changes: DataFrame) -> DataFrame:
    """Raw roots (key, oid) with puts and deletes applied."""
    puts = changes.filter("op = 'put'").select("key", "oid")
    return capture.upsert(roots.join(changes.filter("op = 'delete'").select("key"), "key", "left_anti"), puts)
