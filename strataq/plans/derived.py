"""Versioned datasets derived from the base tables, on which the operators are run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _version(orders: DataFrame) -> DataFrame:
    """Content is the status and the price in cents; metadata is the rest. ``oid`` stands for the content."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    return orders.select(
        F.col("o_orderkey").alias("key"),
        F.concat_ws("|", F.col("o_orderstatus"), cents.cast("string")).alias("oid"),
        F.concat_ws("|", F.col("o_orderpriority"), F.col("o_custkey").cast("string")).alias("meta"),
    )


def before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _version(table(spark, sf_dir, "orders").filter("o_orderkey % 5 <> 0"))


def after(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").filter("o_orderkey % 7 <> 0")
    status = F.when(F.col("o_orderkey") % 11 == 0, F.lit("X")).otherwise(F.col("o_orderstatus"))
    priority = F.when(F.col("o_orderkey") % 13 == 0, F.lit("P")).otherwise(F.col("o_orderpriority"))
    return _version(rows.withColumns({"o_orderstatus": status, "o_orderpriority": priority}))


def target(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").filter("o_orderkey % 3 <> 0 OR o_orderkey % 5 <> 0")
    status = F.when(F.col("o_orderkey") % 17 == 0, F.lit("Y")).otherwise(F.col("o_orderstatus"))
    return _version(rows.withColumns({"o_orderstatus": status}))


def micros(column: str):
    """Microseconds since the epoch, for timestamps with or without a zone."""
    return F.unix_micros(F.col(column).cast("timestamp"))


def _status(rows: DataFrame, bump, mtime, status, priority) -> DataFrame:
    return rows.select(F.col("o_orderkey").alias("key"), (F.floor("o_totalprice").cast("long") % 97 + bump).alias("size"), (micros("o_orderdate") + mtime).alias("mtime"), status.alias("oid"), priority.alias("mode"))


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").filter("o_orderkey % 5 <> 0")
    return _status(rows, F.lit(0), F.lit(0), F.col("o_orderstatus"), F.col("o_orderpriority"))


def world(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").filter("o_orderkey % 7 <> 0")
    k = F.col("o_orderkey")
    return _status(rows, F.when(k % 19 == 0, 1).otherwise(0), F.when(k % 2 == 0, 1).otherwise(0), F.when(k % 11 == 0, F.lit("X")).otherwise(F.col("o_orderstatus")), F.when(k % 13 == 0, F.lit("P")).otherwise(F.col("o_orderpriority")))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of users' last event; an error is a tombstone. A larger ``run_no`` is newer here."""
    op = F.when(F.col("event_type") == "error", "delete").otherwise("put")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("run_no"), op.alias("op"), F.col("event_type").alias("oid"))


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's orders as a chain of revisions."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("revision_id"), F.col("o_custkey").alias("world"), F.lag("o_orderkey").over(w).alias("parent_id"), F.row_number().over(w).alias("seq"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region to nation to customer to order."""
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    n = table(spark, sf_dir, "nation").select(key("r", "n_regionkey").alias("src"), key("n", "n_nationkey").alias("dst"))
    c = table(spark, sf_dir, "customer").select(key("n", "c_nationkey").alias("src"), key("c", "c_custkey").alias("dst"))
    o = table(spark, sf_dir, "orders").select(key("c", "o_custkey").alias("src"), key("o", "o_orderkey").alias("dst"))
    return n.unionByName(c).unionByName(o)


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").filter("r_regionkey IN (0, 1)").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))


def url_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, parent, name) of every component of every page's URL, once."""
    parts = F.array_remove(F.split(F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1), "/"), "")
    rows = table(spark, sf_dir, "pages").select(parts.alias("s")).filter(F.size("s") > 0).distinct()
    each = rows.select("s", F.explode(F.sequence(F.lit(1), F.size("s"))).alias("i"))
    upto = lambda i: F.array_join(F.slice(F.col("s"), F.lit(1), i), "/")
    return each.select(upto(F.col("i")).alias("path"), upto(F.col("i") - 1).alias("parent"), F.element_at("s", F.col("i")).alias("name")).distinct()


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory tree of regions, nations and customers: (parent_id, name, child_id)."""
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    r = table(spark, sf_dir, "region").select(F.lit("root").alias("parent_id"), F.col("r_name").alias("name"), key("r", "r_regionkey").alias("child_id"))
    n = table(spark, sf_dir, "nation").select(key("r", "n_regionkey").alias("parent_id"), F.col("n_name").alias("name"), key("n", "n_nationkey").alias("child_id"))
    c = table(spark, sf_dir, "customer").select(key("n", "c_nationkey").alias("parent_id"), F.col("c_name").alias("name"), key("c", "c_custkey").alias("child_id"))
    return r.unionByName(n).unionByName(c)


def place_inodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inodes of ``places`` with stored link counts, some of them wrong."""
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    r = table(spark, sf_dir, "region").select(key("r", "r_regionkey").alias("inode_id"), F.lit("dir").alias("kind"), F.lit(7).cast("long").alias("links"))
    n = table(spark, sf_dir, "nation").select(key("n", "n_nationkey").alias("inode_id"), F.lit("dir").alias("kind"), F.lit(2).cast("long").alias("links"))
    c = table(spark, sf_dir, "customer").select(key("c", "c_custkey").alias("inode_id"), F.lit("file").alias("kind"), F.when(F.col("c_custkey") % 10 == 0, 2).otherwise(1).cast("long").alias("links"))
    return r.unionByName(n).unionByName(c)


def locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of time for each event, in microseconds; empty ranges are left out."""
    start = micros("ts")
    mode = F.when(F.col("event_id") % 4 == 0, "exclusive").otherwise("shared")
    return table(spark, sf_dir, "events").filter("event_id % 600 > 0").select(F.col("user_id").alias("inode_id"), F.col("event_id").alias("handle"), start.alias("start"), (start + (F.col("event_id") % 600) * 1_000_000).alias("end"), mode.alias("mode"))
