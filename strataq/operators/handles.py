"""Open handles, their sessions, and the state of a service, as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def open_counts(handles: DataFrame) -> DataFrame:
    """Open handles of each (view, inode_id)."""
    return handles.groupBy("view", "inode_id").agg(F.count("*").alias("n"))


def foreign(requests: DataFrame, handles: DataFrame) -> DataFrame:
    """Requests (handle, session) on a handle that another session owns, or that nobody has."""
    owner = handles.select("handle", F.col("session").alias("owner"))
    return requests.join(owner, "handle", "left").filter("NOT (owner <=> session)")


def shared_views(mounts: DataFrame) -> DataFrame:
    """Views that more than one live session holds, which an exclusive lease rules out."""
    return mounts.groupBy("view").agg(F.count_distinct("session").alias("sessions")).filter("sessions > 1")


def kept_open(unlinked: DataFrame, handles: DataFrame) -> DataFrame:
    """Inodes without a name that stay until their last handle is closed."""
    return unlinked.join(handles.select("inode_id").distinct(), "inode_id", "left_semi")


def pool_freshness(pool: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Pool entries (id, snapshot_id, generation) as fresh, stale (another generation) or lost (no snapshot)."""
    s = snapshots.select("snapshot_id", F.col("generation").alias("_g"))
    state = F.when(F.col("_g").isNull(), "lost").when(F.col("_g") == F.col("generation"), "fresh").otherwise("stale")
    return pool.join(s, "snapshot_id", "left").withColumn("state", state).drop("_g")


def service_status(objects: DataFrame, roots: DataFrame, size: Column) -> DataFrame:
    """One row of counters: objects, their bytes and largest, and roots."""
    o = objects.agg(F.count("*").alias("objects"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"), F.max(size).cast("long").alias("largest"))
    return o.join(F.broadcast(roots.agg(F.count("*").alias("roots"))))


def xattr_names(xattrs: DataFrame) -> DataFrame:
    """Sorted attribute names of each inode."""
    return xattrs.groupBy("inode_id").agg(F.sort_array(F.collect_list("name")).alias("names"))


def xattr_value(attributes: Column, name: str) -> Column:
    """One attribute of a map, or null."""
    return F.try_element_at(attributes, F.lit(name))


def map_put(attributes: Column, name: str, value: Column) -> Column:
    """A map with one entry set."""
    return F.map_concat(map_remove(attributes, name), F.create_map(F.lit(name), value))


def map_remove(attributes: Column, name: str) -> Column:
    return F.map_filter(attributes, lambda k, _: k != name)


def write_next(handles: DataFrame, writes: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Writes (handle, data) at the positions of handles (handle, inode_id, position, append): what ``content.write_at`` takes, and the handles after it.

    A handle that appends writes at the end, whatever its position. One write of a handle at a time.
    """
    j = handles.join(writes, "handle", "left").join(sizes, "inode_id", "left")
    at = F.when(F.col("append"), F.coalesce("size", F.lit(0))).otherwise(F.col("position")).cast("long")
    placed = j.withColumn("offset", at)
    after = placed.withColumn("position", F.when(F.col("data").isNotNull(), F.col("offset") + F.octet_length("data")).otherwise(F.col("position"))).select(*handles.columns)
    return placed.filter("data IS NOT NULL").select("inode_id", "offset", "data"), after


def read_next(handles: DataFrame, sizes: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
    """The ranges (handle, inode_id, offset, count) that reads of up to ``count`` bytes take, and the handles after it."""
    j = handles.join(sizes, "inode_id", "left")
    n = F.greatest(F.least(F.lit(count), F.coalesce("size", F.lit(0)) - F.col("position")), F.lit(0)).cast("long")
    read = j.withColumn("count", n)
    return read.select("handle", "inode_id", F.col("position").alias("offset"), "count"), read.withColumn("position", F.col("position") + F.col("count")).select(*handles.columns)


def opened(handles: DataFrame, new: DataFrame) -> DataFrame:
    """Handles with new ones (handle, inode_id, owner, append) at position 0; a duplicate of a handle shares its ``owner``, the open description."""
    return handles.unionByName(new.withColumn("position", F.lit(0).cast("long")).select(*handles.columns))


def closed(handles: DataFrame, gone: DataFrame) -> DataFrame:
    return handles.join(gone.select("handle"), "handle", "left_anti")
