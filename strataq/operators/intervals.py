"""Half-open intervals: overlaps, coalescing, and leases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: The end of a lock on a whole file.
FOREVER = (1 << 63) - 1
MOST_RANGES = 128


def conflicts(locks: DataFrame, owner: str = "handle") -> DataFrame:
    """Pairs of overlapping locks of different owners on one inode, one of them exclusive: (inode_id, a, b) with a < b.

    ``locks`` has (inode_id, handle, start, end, mode) and ``owner``, the open description
    that a handle shares with its duplicates. A range belongs to the level of its length, the
    next power of two, and so to two buckets of that level at most; it is also looked for in
    the buckets of the larger levels that occur, so the overlap is an equality join for short
    ranges and for those without an end alike. A pair is reported in the bucket where the
    later one starts, and so once.
    """
    length = F.col("end") - F.col("start")
    rows = locks.filter("start < end").select("inode_id", "handle", F.col(owner).alias("_owner"), "start", "end", "mode", F.when(length == 1, 0).otherwise(F.length(F.bin(length - 1))).alias("level"))
    levels = sorted(r["level"] for r in rows.select("level").distinct().collect())  # 64 at most
    bucket = lambda x, level: F.call_function("shiftright", x, level)
    both = lambda level: F.array_distinct(F.array(bucket(F.col("start"), level), bucket(F.col("end") - 1, level)))
    large = rows.withColumn("bucket", F.explode(both(F.col("level")))).alias("a")
    upward = F.filter(F.array(*map(F.lit, levels or [0])), lambda x: x >= F.col("level"))
    small = rows.withColumn("at", F.explode(upward)).withColumn("bucket", F.explode(both(F.col("at")))).alias("b")
    return (
        large.join(small, (F.col("a.inode_id") == F.col("b.inode_id")) & (F.col("a.level") == F.col("b.at")) & (F.col("a.bucket") == F.col("b.bucket")))
        .filter("a.start < b.end AND b.start < a.end AND (a.mode = 'exclusive' OR b.mode = 'exclusive') AND NOT (a._owner <=> b._owner)")
        .filter((F.col("a.level") > F.col("b.level")) | (F.col("a.handle") < F.col("b.handle")))
        .filter(F.col("a.bucket") == bucket(F.greatest("a.start", "b.start"), F.col("a.level")))
        .select(F.col("a.inode_id").alias("inode_id"), F.least("a.handle", "b.handle").alias("a"), F.greatest("a.handle", "b.handle").alias("b"))
    )


def coalesce(ranges: DataFrame, by: list[str]) -> DataFrame:
    """Overlapping and adjacent ranges of equal ``by`` as one: (by, start, end, n)."""
    w = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.filter("start < end").withColumn("_new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    runs = marked.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*by, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("_run")


def replace_range(ranges: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """``ranges`` (by, start, end, mode) with one new range for each ``by`` laid over them."""
    n = new.select(*by, F.col("start").alias("_s"), F.col("end").alias("_e"))
    j = ranges.join(n, by, "left")
    left = j.withColumn("end", F.when(F.col("_s").isNotNull(), F.least("end", "_s")).otherwise(F.col("end"))).filter("start < end")
    right = j.filter("_e IS NOT NULL").withColumn("start", F.greatest("start", "_e")).filter("start < end")
    return left.unionByName(right).drop("_s", "_e").unionByName(new.select(*ranges.columns))


def set_locks(ranges: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """``ranges`` (by, start, end, mode) after one request for each ``by``: the new range replaces what it covers, mode ``unlock`` leaves a gap, and adjacent ranges of one mode become one; more than 128 ranges are an error."""
    laid = replace_range(ranges, new, by).filter("mode <> 'unlock'")
    w = Window.partitionBy(*by).orderBy("start")
    new_run = F.coalesce((F.lag("end").over(w) != F.col("start")) | (F.lag("mode").over(w) != F.col("mode")), F.lit(True))
    runs = laid.withColumn("_run", F.sum(new_run.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy(*by, "_run", "mode").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")
    many = F.count("*").over(Window.partitionBy(*by))
    checked = F.when(many > MOST_RANGES, F.raise_error(F.lit(f"more than {MOST_RANGES} lock ranges")).cast("long")).otherwise(F.col("start"))
    return out.withColumn("start", checked).select(*by, "start", "end", "mode")


def leases(events: DataFrame, by: str, at: str, tie: str, lease: int) -> DataFrame:
    """Sessions of each ``by``: activity extends the lease, and a gap of ``lease`` or more starts a new session."""
    w = Window.partitionBy(by).orderBy(at, tie)
    gap = F.col(at) - F.lag(at).over(w)
    marked = events.withColumn("_new", F.when(gap.isNull() | (gap >= lease), 1).otherwise(0))
    numbered = marked.withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(by, "session").agg(F.min(at).alias("started"), F.max(at).alias("last_seen"), F.count("*").alias("n")).withColumn("deadline", F.col("last_seen") + lease)
