"""Queries over trees of inodes, entries, chunks and attributes, derived from the base tables, with the SQL that checks them.

The tree has regions below the root, nations below regions and customers, as files, below
nations; a customer's content is its name in chunks of eight bytes, and some have an
attribute. ``latest`` below the root and ``up`` below each region are symbolic links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.functions import scalars
from strataq.operators import audit, content, diff, graph, handles, intervals, merge, mutations, pages
from strataq.plans import derived
from strataq.plans.derived import table
from strataq.plans.registry import query

CHUNK, NOW = 8, 1000


def _key(letter: str, column: str):
    return F.concat(F.lit(letter), F.col(column).cast("string"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of the symbolic links."""
    up = table(spark, sf_dir, "region").select(_key("u", "r_regionkey").alias("inode_id"), F.lit("../latest").alias("target"))
    return up.unionByName(spark.createDataFrame([("s1", "/AFRICA")], "inode_id string, target string"))


def base(spark: SparkSession, sf_dir: str) -> mutations.Tree:
    region, customer = table(spark, sf_dir, "region"), table(spark, sf_dir, "customer")
    up = region.select(_key("r", "r_regionkey").alias("parent_id"), F.lit("up").alias("name"), _key("u", "r_regionkey").alias("child_id"))
    entries = derived.places(spark, sf_dir).unionByName(up).unionByName(spark.createDataFrame([("root", "latest", "s1")], mutations.ENTRY))
    size = entries.select(F.col("child_id").alias("inode_id"), "name")
    kind = F.when(F.col("inode_id").rlike("^[rn]"), "dir").when(F.col("inode_id").rlike("^c"), "file").otherwise("symlink")
    bytes_ = F.when(kind == "dir", 0).when(kind == "file", F.octet_length("name")).otherwise(F.when(F.col("inode_id") == "s1", 7).otherwise(9)).cast("long")
    number = F.substring("inode_id", F.lit(2), F.lit(20)).try_cast("long")
    time = lambda name: F.lit(0).cast("long").alias(name)
    rows = size.select("inode_id", kind.alias("kind"), F.lit(0o644).alias("mode"), F.lit(0).alias("flags"), F.lit(0).cast("long").alias("links"), bytes_.alias("size"), time("modified_ns"), time("changed_ns"), time("accessed_ns"), time("birth_ns"), ((kind == "file") & (number % 3 == 0)).alias("has_xattrs"))
    root = spark.createDataFrame([("root", "dir", 0o644, 0, 0, 0, 0, 0, 0, 0, False)], mutations.INODE)
    data = F.col("c_name").cast("binary")
    chunks = content.chunk_map(customer.select(_key("c", "c_custkey").alias("id"), data.alias("data")), "id", "data", CHUNK)
    xattrs = customer.filter("c_custkey % 3 = 0").select(_key("c", "c_custkey").alias("inode_id"), F.lit("segment").alias("name"), F.col("c_mktsegment").cast("binary").alias("value"))
    return mutations.relink(mutations.Tree(rows.unionByName(root), entries, chunks, xattrs), 0)


ENT = """ent AS (SELECT 'root' AS parent_id, r_name AS name, 'r' || r_regionkey AS child_id FROM region
  UNION ALL SELECT 'r' || n_regionkey, n_name, 'n' || n_nationkey FROM nation UNION ALL SELECT 'n' || c_nationkey, c_name, 'c' || c_custkey FROM customer
  UNION ALL SELECT 'r' || r_regionkey, 'up', 'u' || r_regionkey FROM region UNION ALL SELECT 'root', 'latest', 's1')"""
_NUMBER = "TRY_CAST(substr(inode_id, 2) AS BIGINT)"
INO = f"""ino AS (SELECT inode_id, kind, CASE kind WHEN 'dir' THEN 0 WHEN 'file' THEN strlen(name) ELSE CASE WHEN inode_id = 's1' THEN 7 ELSE 9 END END AS size, 420 AS mode, 0 AS modified_ns, 0 AS changed_ns, kind = 'file' AND {_NUMBER} % 3 = 0 AS has_xattrs
  FROM (SELECT child_id AS inode_id, name, CASE left(child_id, 1) WHEN 'r' THEN 'dir' WHEN 'n' THEN 'dir' WHEN 'c' THEN 'file' ELSE 'symlink' END AS kind FROM ent)
  UNION ALL SELECT 'root', 'dir', 0, 420, 0, 0, false)"""
WITH = f"WITH RECURSIVE {ENT}, {INO}"
#: Inodes with links counted from ``e`` and ``i``.
LINKED = """(SELECT i.inode_id, i.kind, CASE WHEN i.kind = 'dir' THEN 2 + coalesce(d.n, 0) ELSE coalesce(c.n, 0) END::BIGINT AS links, i.size::BIGINT AS size, i.mode::INTEGER AS mode, i.modified_ns::BIGINT AS modified_ns, i.changed_ns::BIGINT AS changed_ns, i.has_xattrs
  FROM i LEFT JOIN (SELECT child_id, count(*) AS n FROM e GROUP BY 1) c ON c.child_id = i.inode_id
  LEFT JOIN (SELECT parent_id, count(*) AS n FROM e JOIN i k ON k.inode_id = e.child_id AND k.kind = 'dir' GROUP BY 1) d ON d.parent_id = i.inode_id)"""
COLUMNS = ("inode_id", "kind", "links", "size", "mode", "modified_ns", "changed_ns", "has_xattrs")


def shown(tree: mutations.Tree) -> DataFrame:
    """The inodes of a tree, and a count of its entries that follows their names and places."""
    named = tree.entries.groupBy(F.col("child_id").alias("inode_id")).agg(F.sort_array(F.collect_list(F.concat_ws("/", "parent_id", "name"))).alias("names"))
    return tree.inodes.select(*COLUMNS).join(named, "inode_id", "left").withColumn("names", F.array_join("names", ","))


def changed(entries: str, inodes: str) -> str:
    """The SQL of ``shown`` for a tree with these entries and inodes, given as selects over ``ent`` and ``ino``."""
    return f"{WITH}, e AS ({entries}), i AS ({inodes}) SELECT l.*, n.names FROM {LINKED} l LEFT JOIN (SELECT child_id, string_agg(parent_id || '/' || name, ',' ORDER BY parent_id || '/' || name) AS names FROM e GROUP BY 1) n ON n.child_id = l.inode_id"


def touched(where: str, modified: str | None = None, **columns: str) -> str:
    """A select over ``ino`` in which rows of ``where`` are changed (and those of ``modified`` are modified) at ``NOW``."""
    m = modified or "false"
    cols = {"kind": "kind", "size": "size", "mode": "mode", "has_xattrs": "has_xattrs"} | columns
    return f"SELECT inode_id, {cols['kind']} AS kind, {cols['size']} AS size, {cols['mode']} AS mode, CASE WHEN {m} THEN {NOW} ELSE modified_ns END AS modified_ns, CASE WHEN ({where}) OR ({m}) THEN {NOW} ELSE changed_ns END AS changed_ns, {cols['has_xattrs']} AS has_xattrs FROM ino"


# ---------------------------------------------------------------- reading a tree


@query("tree_stat", f"{WITH}, e AS (SELECT * FROM ent), i AS (SELECT * FROM ino) SELECT inode_id, kind, links, size, has_xattrs FROM {LINKED}")
def tree_stat(spark, sf_dir):
    text = mutations.stat(base(spark, sf_dir), F.lit(True))
    got = F.from_json("stat", "kind string, links long, size long, has_xattrs boolean")
    return text.select("inode_id", got.alias("x")).select("inode_id", "x.*")


@query("tree_list", f"{WITH} SELECT * FROM ent WHERE parent_id = 'r1'")
def tree_list(spark, sf_dir):
    return pages.children(base(spark, sf_dir).entries, "r1")


@query("directory_cursor", f"{WITH}, p AS (SELECT name, child_id FROM ent WHERE parent_id = 'n3' AND name > 'Customer#00000002' ORDER BY name LIMIT 5) SELECT p.name, p.child_id AS inode_id, i.kind, i.size::BIGINT AS size, (SELECT count(*) FROM ent WHERE parent_id = 'n3' AND name > 'Customer#00000002') <= 5 AS eof FROM p JOIN ino i ON i.inode_id = p.child_id")
def directory_cursor(spark, sf_dir):
    t = base(spark, sf_dir)
    return pages.directory_page(t.entries, "n3", "Customer#00000002", 5, t.inodes.select("inode_id", "kind", "size"))


@query("read_link", f"{WITH} SELECT child_id AS inode_id, CASE WHEN child_id = 's1' THEN '/AFRICA' ELSE '../latest' END AS target FROM ent WHERE left(child_id, 1) IN ('u', 's')")
def read_link(spark, sf_dir):
    t = base(spark, sf_dir)
    return t.inodes.filter("kind = 'symlink'").select("inode_id").join(links(spark, sf_dir), "inode_id")


_RESOLVE = f"""{WITH}, q AS (SELECT n_nationkey AS query, 0 AS style, n_name, n_regionkey FROM nation)
SELECT query * 4 AS query, CASE WHEN n_regionkey = 0 THEN 'n' || query END AS inode_id, CASE WHEN n_regionkey <> 0 THEN 'ENOENT' END AS error FROM q
UNION ALL SELECT query * 4 + 1, 'n' || query, NULL FROM q
UNION ALL SELECT query * 4 + 2, 'r0', NULL FROM q
UNION ALL SELECT query * 4 + 3, NULL, CASE WHEN query % 2 = 0 THEN 'EINVAL' ELSE 'ENOTDIR' END FROM q"""


@query("resolve_paths", _RESOLVE)
def resolve_paths(spark, sf_dir):
    t = base(spark, sf_dir)
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    first = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.min("c_name").alias("c")).join(n, F.col("c_nationkey") == F.col("n_nationkey"), "right")
    path = lambda k, *parts: F.struct((F.col("n_nationkey") * 4 + k).alias("query"), F.concat(*parts).alias("path"))
    name, region, slash = F.col("n_name"), F.col("r_name"), F.lit("/")
    odd = F.when(F.col("n_nationkey") % 2 == 0, name).otherwise(F.concat(slash, region, slash, name, slash, F.coalesce("c", F.lit("up/x")), F.lit("/.")))
    asked = first.select(F.explode(F.array(
        path(0, slash, region, F.lit("/up/./"), name), path(1, F.lit("/latest/../"), region, F.lit("//"), name),
        path(2, slash, region, F.lit("/up/"), F.lit("../../AFRICA/")), path(3, odd),
    )).alias("x")).select("x.*")
    return graph.resolve(asked, t.entries, t.inodes, links(spark, sf_dir), "root")


_PATHS = "p AS (SELECT child_id AS inode_id, '/' || name AS path, 1 AS depth FROM ent WHERE parent_id = 'root' UNION ALL SELECT e.child_id, p.path || '/' || e.name, p.depth + 1 FROM p JOIN ent e ON e.parent_id = p.inode_id)"


@query("tree_height", f"{WITH}, {_PATHS} SELECT max(depth)::INTEGER AS height, count(*) FILTER (depth = 3) AS n FROM p")
def tree_height(spark, sf_dir):
    return graph.height(graph.tree_paths(base(spark, sf_dir).entries, "root"))


@query("inode_paths", f"{WITH}, {_PATHS} SELECT inode_id, path FROM p UNION ALL SELECT 'root', '/'")
def inode_paths(spark, sf_dir):
    return graph.one_path(graph.tree_paths(base(spark, sf_dir).entries, "root"))


# ---------------------------------------------------------------- changing a tree


@query("tree_mkdir", changed("SELECT * FROM ent UNION ALL SELECT 'r' || r_regionkey, 'new', 'x' || r_regionkey FROM region", touched("false", "left(inode_id, 1) = 'r' AND inode_id <> 'root'") + f" UNION ALL SELECT 'x' || r_regionkey, 'dir', 0, 493, {NOW}, {NOW}, false FROM region"))
def tree_mkdir(spark, sf_dir):
    new = table(spark, sf_dir, "region").select(_key("r", "r_regionkey").alias("parent_id"), F.lit("new").alias("name"), _key("x", "r_regionkey").alias("inode_id"))
    return shown(mutations.create(base(spark, sf_dir), new, "dir", 0o755, NOW))


@query("tree_special", changed("SELECT * FROM ent UNION ALL SELECT 'n' || n_nationkey, 'pipe', 'f' || n_nationkey FROM nation", touched("false", "left(inode_id, 1) = 'n'") + f" UNION ALL SELECT 'f' || n_nationkey, 'fifo', 0, 384, {NOW}, {NOW}, false FROM nation"))
def tree_special(spark, sf_dir):
    new = table(spark, sf_dir, "nation").select(_key("n", "n_nationkey").alias("parent_id"), F.lit("pipe").alias("name"), _key("f", "n_nationkey").alias("inode_id"))
    return shown(mutations.create(base(spark, sf_dir), new, "fifo", 0o600, NOW))


@query("tree_link", changed("SELECT * FROM ent UNION ALL SELECT 'r0', 'alias-' || c_custkey, 'c' || c_custkey FROM customer WHERE c_custkey % 5 = 0", touched("false", "inode_id = 'r0' AND EXISTS (SELECT 1 FROM customer WHERE c_custkey % 5 = 0)")))
def tree_link(spark, sf_dir):
    new = table(spark, sf_dir, "customer").filter("c_custkey % 5 = 0").select(F.lit("r0").alias("parent_id"), _key("alias-", "c_custkey").alias("name"), _key("c", "c_custkey").alias("inode_id"))
    return shown(mutations.link(base(spark, sf_dir), new, NOW))


_GONE = "SELECT 'c' || c_custkey FROM customer WHERE c_custkey % 7 = 0"


@query("tree_unlink", changed(f"SELECT * FROM ent WHERE child_id NOT IN ({_GONE})", touched("false", "inode_id IN (SELECT 'n' || c_nationkey FROM customer WHERE c_custkey % 7 = 0)") + f" WHERE inode_id NOT IN ({_GONE})"))
def tree_unlink(spark, sf_dir):
    names = table(spark, sf_dir, "customer").filter("c_custkey % 7 = 0").select(_key("n", "c_nationkey").alias("parent_id"), F.col("c_name").alias("name"))
    return shown(mutations.unlink(base(spark, sf_dir), names, NOW))


@query("kept_open", "SELECT 'c' || c_custkey AS inode_id FROM customer WHERE c_custkey % 7 = 0 AND c_custkey % 2 = 0")
def kept_open(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    unlinked = customer.filter("c_custkey % 7 = 0").select(_key("c", "c_custkey").alias("inode_id"))
    return handles.kept_open(unlinked, customer.filter("c_custkey % 2 = 0").select(_key("c", "c_custkey").alias("inode_id")))


@query("tree_rename", changed("SELECT CASE WHEN c_custkey % 11 = 0 THEN 'n' || (c_nationkey + 1) % 25 ELSE parent_id END AS parent_id, CASE WHEN c_custkey % 11 = 0 THEN 'moved-' || name ELSE name END AS name, child_id FROM ent LEFT JOIN customer ON child_id = 'c' || c_custkey", touched("inode_id IN (SELECT 'c' || c_custkey FROM customer WHERE c_custkey % 11 = 0)", "inode_id IN (SELECT 'n' || c_nationkey FROM customer WHERE c_custkey % 11 = 0) OR inode_id IN (SELECT 'n' || (c_nationkey + 1) % 25 FROM customer WHERE c_custkey % 11 = 0)")))
def tree_rename(spark, sf_dir):
    moves = table(spark, sf_dir, "customer").filter("c_custkey % 11 = 0").select(_key("n", "c_nationkey").alias("parent_id"), F.col("c_name").alias("name"), F.concat(F.lit("n"), ((F.col("c_nationkey") + 1) % 25).cast("string")).alias("to_parent"), F.concat(F.lit("moved-"), "c_name").alias("to_name"))
    return shown(mutations.rename(base(spark, sf_dir), moves, NOW))


@query("tree_exchange", changed("SELECT parent_id, name, CASE child_id WHEN 'n0' THEN 'n1' WHEN 'n1' THEN 'n0' ELSE child_id END AS child_id FROM ent", touched("inode_id IN ('n0', 'n1')", "inode_id IN (SELECT 'r' || n_regionkey FROM nation WHERE n_nationkey < 2)")))
def tree_exchange(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(_key("r", "n_regionkey").alias("p"), F.col("n_name").alias("n"), "n_nationkey")
    pair = n.filter("n_nationkey = 0").select(F.col("p").alias("parent_id"), F.col("n").alias("name")).crossJoin(F.broadcast(n.filter("n_nationkey = 1").select(F.col("p").alias("to_parent"), F.col("n").alias("to_name"))))
    return shown(mutations.exchange(base(spark, sf_dir), pair, NOW))


@query("tree_attributes", changed("SELECT * FROM ent", touched(f"kind = 'file' AND {_NUMBER} % 13 = 0", mode=f"CASE WHEN kind = 'file' AND {_NUMBER} % 13 = 0 THEN 384 ELSE mode END")))
def tree_attributes(spark, sf_dir):
    new = table(spark, sf_dir, "customer").filter("c_custkey % 13 = 0").select(_key("c", "c_custkey").alias("inode_id"), F.lit(0o600).alias("mode"))
    return shown(mutations.set_attributes(base(spark, sf_dir), new, NOW))


@query("tree_xattrs", changed("SELECT * FROM ent", touched(f"kind = 'file' AND ({_NUMBER} % 4 = 0 OR {_NUMBER} % 9 = 0)", has_xattrs=f"kind = 'file' AND ({_NUMBER} % 4 = 0 OR ({_NUMBER} % 3 = 0 AND {_NUMBER} % 9 <> 0))")))
def tree_xattrs(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    id_ = _key("c", "c_custkey").alias("inode_id")
    less = mutations.remove_xattrs(base(spark, sf_dir), customer.filter("c_custkey % 9 = 0").select(id_, F.lit("segment").alias("name")), NOW)
    return shown(mutations.set_xattrs(less, customer.filter("c_custkey % 4 = 0").select(id_, F.lit("phone").alias("name"), F.col("c_name").cast("binary").alias("value")), NOW))


@query("tree_write", changed("SELECT * FROM ent", touched("false", f"kind = 'file' AND {_NUMBER} % 10 = 0", size=f"CASE WHEN kind = 'file' AND {_NUMBER} % 10 = 0 THEN 3 ELSE size END")))
def tree_write(spark, sf_dir):
    some = table(spark, sf_dir, "customer").filter("c_custkey % 10 = 0").select(_key("c", "c_custkey").alias("inode_id"))
    chunks = some.select("inode_id", F.lit(0).cast("long").alias("idx"), content.object_id(F.lit(b"new")).alias("oid"), F.lit(3).cast("long").alias("len"))
    return shown(mutations.write(base(spark, sf_dir), chunks, some.withColumn("size", F.lit(3).cast("long")), NOW))


@query("tree_clone", changed("SELECT * FROM ent UNION ALL SELECT 'root', 'copy-' || c_custkey, 'k' || c_custkey FROM customer WHERE c_custkey % 17 = 0", touched("false", "inode_id = 'root' AND EXISTS (SELECT 1 FROM customer WHERE c_custkey % 17 = 0)") + f" UNION ALL SELECT 'k' || substr(inode_id, 2), kind, size, mode, modified_ns, {NOW}, has_xattrs FROM ino WHERE kind = 'file' AND {_NUMBER} % 17 = 0"))
def tree_clone(spark, sf_dir):
    copies = table(spark, sf_dir, "customer").filter("c_custkey % 17 = 0").select(_key("c", "c_custkey").alias("inode_id"), _key("k", "c_custkey").alias("new_id"), F.lit("root").alias("parent_id"), _key("copy-", "c_custkey").alias("name"))
    return shown(mutations.clone(base(spark, sf_dir), copies, NOW))


@query("raw_objects", "SELECT 'o' || o_orderkey AS key, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE o_orderstatus END AS oid FROM orders WHERE o_orderkey % 6 <> 1")
def raw_objects(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    roots = orders.filter("o_orderkey % 2 = 1").select(_key("o", "o_orderkey").alias("key"), F.col("o_orderstatus").alias("oid"))
    puts = orders.filter("o_orderkey % 2 = 0").select(_key("o", "o_orderkey").alias("key"), F.lit("put").alias("op"), F.when(F.col("o_orderkey") % 4 == 0, "new").otherwise(F.col("o_orderstatus")).alias("oid"))
    gone = orders.filter("o_orderkey % 6 = 1").select(_key("o", "o_orderkey").alias("key"), F.lit("delete").alias("op"), F.lit(None).cast("string").alias("oid"))
    return mutations.put_objects(roots, puts.unionByName(gone))


# ---------------------------------------------------------------- bytes


def _bytes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Chunks with their bytes, and sizes."""
    c = table(spark, sf_dir, "customer").select(_key("c", "c_custkey").alias("inode_id"), F.col("c_name").cast("binary").alias("d"))
    each = F.transform(F.sequence(F.lit(0), F.floor((F.octet_length("d") - 1) / CHUNK).cast("int")), lambda i: F.struct(i.cast("long").alias("idx"), F.substring("d", i * CHUNK + 1, F.lit(CHUNK)).alias("data")))
    return c.select("inode_id", F.inline(each)), c.select("inode_id", F.octet_length("d").cast("long").alias("size"))


def _read(chunks: DataFrame, sizes: DataFrame) -> DataFrame:
    whole = content.read_whole(sizes.join(chunks, "inode_id", "left"), CHUNK)
    return whole.select("inode_id", F.lower(F.hex("data")).alias("hex"))


def _hex(text: str) -> str:
    """DuckDB's lower-case hex of an ASCII text."""
    return f"lower(to_hex(encode({text})))"


_C = "FROM customer"


@query("read_whole", f"SELECT 'c' || c_custkey AS inode_id, {_hex('c_name')} AS hex {_C}")
def read_whole(spark, sf_dir):
    return _read(*_bytes(spark, sf_dir))


@query("write_at", f"SELECT 'c' || c_custkey AS inode_id, {_hex('substr(c_name, 1, 6)')} || '58595a5758595a5758' || {_hex('substr(c_name, 16)')} AS hex {_C}")
def write_at(spark, sf_dir):
    chunks, sizes = _bytes(spark, sf_dir)
    return _read(content.write_at(chunks, sizes.select("inode_id", F.lit(6).cast("long").alias("offset"), F.lit(b"XYZWXYZWX").alias("data")), CHUNK), sizes)


@query("append", f"SELECT 'c' || c_custkey AS inode_id, {_hex('c_name')} || '0000007461696c' AS hex {_C}")
def append(spark, sf_dir):
    chunks, sizes = _bytes(spark, sf_dir)
    after = content.write_at(chunks, sizes.select("inode_id", (F.col("size") + 3).alias("offset"), F.lit(b"tail").alias("data")), CHUNK)
    return _read(after, sizes.withColumn("size", F.col("size") + 7))


@query("truncate", f"SELECT 'c' || c_custkey AS inode_id, CASE WHEN c_custkey % 2 = 0 THEN {_hex('substr(c_name, 1, 11)')} ELSE {_hex('c_name')} || '0000' END AS hex {_C}")
def truncate(spark, sf_dir):
    chunks, sizes = _bytes(spark, sf_dir)
    new = sizes.withColumn("size", F.when(F.substring("inode_id", F.lit(2), F.lit(20)).cast("long") % 2 == 0, F.lit(11).cast("long")).otherwise(F.col("size") + 2))
    return _read(content.truncate(chunks, new, CHUNK), new)


@query("punch_hole", f"SELECT 'c' || c_custkey AS inode_id, {_hex('substr(c_name, 1, 3)')} || repeat('00', 14) || {_hex('substr(c_name, 18)')} AS hex {_C}")
def punch_hole(spark, sf_dir):
    chunks, sizes = _bytes(spark, sf_dir)
    return _read(content.punch(chunks, sizes.select("inode_id", F.lit(3).cast("long").alias("offset"), F.lit(14).cast("long").alias("length")), CHUNK), sizes)


@query("chunk_differences", f"SELECT 'c' || c_custkey AS inode_id, i::BIGINT AS idx, CASE WHEN i = 0 THEN sha256(substr(c_name, 1, 8)) END AS before_oid, CASE WHEN i = 0 THEN sha256('X' || substr(c_name, 2, 7)) ELSE sha256('more') END AS after_oid {_C}, range(0, 4, 3) t(i) WHERE c_custkey % 2 = 0")
def chunk_differences(spark, sf_dir):
    before = base(spark, sf_dir).chunks
    c = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0")
    new = c.select(_key("c", "c_custkey").alias("inode_id"), F.lit(0).cast("long").alias("idx"), content.object_id(F.concat(F.lit("X"), F.substring("c_name", 2, 7)).cast("binary")).alias("oid"), F.lit(8).cast("long").alias("len"))
    more = c.select(_key("c", "c_custkey").alias("inode_id"), F.lit(3).cast("long").alias("idx"), content.object_id(F.lit(b"more")).alias("oid"), F.lit(4).cast("long").alias("len"))
    tree = base(spark, sf_dir)
    after = mutations.overlay(tree, new.unionByName(more), c.select(_key("c", "c_custkey").alias("inode_id"), F.lit(28).cast("long").alias("size")), NOW).chunks
    return content.chunk_differences(before, after)


@query("object_fetch", "SELECT sha256(c_name) AS oid, c_custkey % 5 <> 0 AS valid, strlen(c_name)::BIGINT AS size FROM customer WHERE c_custkey % 3 = 0")
def object_fetch(spark, sf_dir):
    name = F.col("c_name").cast("binary")
    stored = table(spark, sf_dir, "customer").select(content.object_id(name).alias("oid"), F.when(F.col("c_custkey") % 5 == 0, F.lit(b"damaged")).otherwise(name).alias("payload"), F.octet_length("c_name").cast("long").alias("size"))
    wanted = table(spark, sf_dir, "customer").filter("c_custkey % 3 = 0").select(content.object_id(name).alias("oid"))
    return content.fetch(stored, wanted).select("oid", "valid").join(content.object_sizes(stored, wanted), "oid")


@query("seek_region", """
WITH q AS (SELECT o_orderkey AS query, 'c' || o_custkey AS inode_id, (o_orderkey * 5) % 90 AS pos FROM orders WHERE o_orderkey % 10 = 0),
c AS (SELECT DISTINCT 'c' || o_custkey AS inode_id, o_orderkey % 9 AS idx FROM orders),
b AS (SELECT q.query, q.inode_id, q.pos, x FROM q, range(0, 72) t(x) WHERE x >= q.pos AND q.pos < 70 AND x < 70)
SELECT q.query, q.inode_id, q.pos::BIGINT AS "offset", min(b.x) FILTER (c.idx IS NOT NULL)::BIGINT AS next_data, CASE WHEN q.pos < 70 THEN coalesce(min(b.x) FILTER (b.x IS NOT NULL AND c.idx IS NULL), 70) END::BIGINT AS next_hole
FROM q LEFT JOIN b USING (query, inode_id, pos) LEFT JOIN c ON c.inode_id = q.inode_id AND c.idx = b.x // 8 GROUP BY q.query, q.inode_id, q.pos""")
def seek_region(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    owner = _key("c", "o_custkey").alias("inode_id")
    chunks = orders.select(owner, (F.col("o_orderkey") % 9).alias("idx")).distinct()
    asked = orders.filter("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("query"), owner, ((F.col("o_orderkey") * 5) % 90).cast("long").alias("offset"))
    return content.seek_region(chunks, orders.select(owner, F.lit(70).cast("long").alias("size")).distinct(), asked, CHUNK)


@query("handle_write", f"SELECT 'h' || c_custkey AS handle, 'c' || c_custkey AS inode_id, CASE WHEN c_custkey % 3 = 0 THEN 20 WHEN c_custkey % 2 = 0 THEN 6 ELSE 4 END::BIGINT AS position, CASE WHEN c_custkey % 3 = 0 THEN {_hex('c_name')} || '4142' WHEN c_custkey % 2 = 0 THEN {_hex('substr(c_name, 1, 4)')} || '4142' || {_hex('substr(c_name, 7)')} ELSE {_hex('c_name')} END AS hex {_C} WHERE strlen(c_name) = 18")
def handle_write(spark, sf_dir):
    k, id_ = F.substring("inode_id", F.lit(2), F.lit(20)).cast("long"), F.col("inode_id")
    chunks, sizes = _bytes(spark, sf_dir)
    sizes = sizes.filter("size = 18")
    open_ = sizes.select(F.concat(F.lit("h"), F.substring(id_, F.lit(2), F.lit(20))).alias("handle"), "inode_id", F.lit(4).cast("long").alias("position"), (k % 3 == 0).alias("append"))
    data = open_.filter((k % 3 == 0) | (k % 2 == 0)).select("handle", F.lit(b"AB").alias("data"))
    writes, after = handles.write_next(open_, data, sizes)
    end = writes.select("inode_id", (F.col("offset") + 2).alias("_end"))
    grown = sizes.join(end, "inode_id", "left").select("inode_id", F.greatest("size", F.coalesce("_end", F.lit(0))).alias("size"))
    return after.select("handle", "inode_id", "position").join(_read(content.write_at(chunks, writes, CHUNK), grown), "inode_id")


@query("handle_read", "SELECT 'h' || c_custkey AS handle, 'c' || c_custkey AS inode_id, (c_custkey % 25)::BIGINT AS \"offset\", greatest(least(7, strlen(c_name) - c_custkey % 25), 0)::BIGINT AS count, (c_custkey % 25 + greatest(least(7, strlen(c_name) - c_custkey % 25), 0))::BIGINT AS position FROM customer")
def handle_read(spark, sf_dir):
    sizes = _bytes(spark, sf_dir)[1]
    k = F.substring("inode_id", F.lit(2), F.lit(20))
    open_ = sizes.select(F.concat(F.lit("h"), k).alias("handle"), "inode_id", (k.cast("long") % 25).alias("position"))
    ranges, after = handles.read_next(open_, sizes, 7)
    return ranges.join(after.select("handle", "position"), "handle")


# ---------------------------------------------------------------- comparing and merging trees


def _inode_sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Two versions of the tree as (path, attributes, xattrs, content): some files go, come, change kind, bytes, mode or attributes."""
    t = base(spark, sf_dir)
    paths = graph.tree_paths(t.entries, "root").select("inode_id", "path")
    rows = paths.join(t.inodes, "inode_id").withColumn("xattrs", F.when(F.col("has_xattrs"), F.concat(F.lit("x"), "inode_id"))).withColumn("content", F.when(F.col("kind") == "file", F.col("inode_id"))).withColumn("k", F.when(F.col("kind") == "file", F.substring("inode_id", F.lit(2), F.lit(20)).cast("long")))
    is_ = lambda m: F.coalesce(F.col("k") % m == 0, F.lit(False))
    after = (
        rows.filter(~is_(5)).withColumn("path", F.when(is_(7), F.concat("path", F.lit("-2"))).otherwise(F.col("path")))
        .withColumn("mode", F.when(is_(11), 0o600).otherwise(F.col("mode"))).withColumn("content", F.when(is_(13), F.lit("other")).otherwise(F.col("content")))
        .withColumn("kind", F.when(is_(17), "fifo").otherwise(F.col("kind"))).withColumn("xattrs", F.when(is_(19), F.lit("y")).otherwise(F.col("xattrs"))).withColumn("modified_ns", F.when(F.col("inode_id") == "n4", F.lit(7).cast("long")).otherwise(F.col("modified_ns")))
    )
    return rows, after


_SIDES = f"""{WITH}, {_PATHS}, a0 AS (SELECT inode_id, path FROM p UNION ALL SELECT 'root', '/'),
b AS (SELECT path, inode_id, kind, mode, size, 0 AS m, CASE WHEN has_xattrs THEN 'x' || inode_id END AS xattrs, CASE WHEN kind = 'file' THEN inode_id END AS content, CASE WHEN kind = 'file' THEN {_NUMBER} ELSE 1 END AS k FROM a0 JOIN ino USING (inode_id)),
a AS (SELECT path || CASE WHEN k % 7 = 0 THEN '-2' ELSE '' END AS path, inode_id, CASE WHEN k % 17 = 0 THEN 'fifo' ELSE kind END AS kind, CASE WHEN k % 11 = 0 THEN 384 ELSE mode END AS mode, size, CASE WHEN inode_id = 'n4' THEN 7 ELSE 0 END AS m, CASE WHEN k % 19 = 0 THEN 'y' ELSE xattrs END AS xattrs, CASE WHEN k % 13 = 0 THEN 'other' ELSE content END AS content FROM b WHERE k % 5 <> 0),
j AS (SELECT path, b.path IS NULL AS nb, a.path IS NULL AS na, b.inode_id AS bi, a.inode_id AS ai, b.kind AS bk, a.kind AS ak, b.xattrs IS DISTINCT FROM a.xattrs AS x,
  b.inode_id IS DISTINCT FROM a.inode_id OR b.kind IS DISTINCT FROM a.kind OR b.mode IS DISTINCT FROM a.mode OR b.m IS DISTINCT FROM a.m AS t, b.content IS DISTINCT FROM a.content AS c FROM b FULL JOIN a USING (path)),
d AS (SELECT path, CASE WHEN nb THEN 'added' WHEN na THEN 'removed' ELSE 'modified' END AS change, bi AS before_inode, ai AS after_inode, bk AS before_type, ak AS after_type, nb OR na OR x AS xattrs_changed, nb OR na OR x OR t AS metadata_changed,
  CASE WHEN nb OR na THEN coalesce(bk, ak) <> 'dir' WHEN bk IN ('dir', 'fifo', 'socket') OR ak IN ('dir', 'fifo', 'socket') THEN bk <> ak WHEN (bk = 'symlink') <> (ak = 'symlink') THEN true ELSE c END AS content_changed FROM j)"""


@query("namespace_diff", f"{_SIDES} SELECT * FROM d WHERE metadata_changed OR content_changed")
def namespace_diff(spark, sf_dir):
    return diff.namespace_diff(*_inode_sides(spark, sf_dir))


@query("namespace_diff_page", f"{_SIDES}, f AS (SELECT * FROM d WHERE (metadata_changed OR content_changed) AND path > '/ASIA'), g AS (SELECT * FROM f ORDER BY path LIMIT 10) SELECT g.*, (SELECT count(*) FROM f) <= 10 AS eof, CASE WHEN (SELECT count(*) FROM f) > 10 THEN (SELECT max(path) FROM g) END AS next_after FROM g")
def namespace_diff_page(spark, sf_dir):
    return diff.diff_page(namespace_diff(spark, sf_dir), "/ASIA", 10, key="path")


_STATUS = f"""{_SIDES}, x AS (SELECT path AS key, kind, size, content AS oid, mode FROM b WHERE path <> '/'),
y AS (SELECT path AS key, kind, size, content AS oid, mode FROM a WHERE path <> '/' AND NOT starts_with(path, '/ASIA') UNION ALL SELECT '/empty', 'dir', 0, NULL, 420),
f AS (SELECT x.key AS xk, y.key AS yk, x.kind AS xd, y.kind AS yd, x.size AS xs, y.size AS ys, x.oid AS xo, y.oid AS yo, x.mode AS xm, y.mode AS ym,
  EXISTS (SELECT 1 FROM x c WHERE starts_with(c.key, x.key || '/')) AS xf, EXISTS (SELECT 1 FROM y c WHERE starts_with(c.key, y.key || '/')) AS yf FROM x FULL JOIN y ON x.key = y.key),
s AS (SELECT coalesce(xk, yk) AS key, CASE WHEN xk IS NULL THEN CASE WHEN yd <> 'dir' OR NOT yf THEN 'A' END WHEN yk IS NULL THEN CASE WHEN xd <> 'dir' OR NOT xf THEN 'D' END
  WHEN xd = 'dir' AND yd = 'dir' THEN NULL WHEN xd <> yd OR xs <> ys OR xo IS DISTINCT FROM yo THEN 'M' WHEN xm <> ym THEN 'T' END AS status FROM f)
SELECT key, status FROM s WHERE status IS NOT NULL"""


@query("status_tree", _STATUS)
def status_tree(spark, sf_dir):
    before, after = _inode_sides(spark, sf_dir)
    side = lambda df, mtime: df.filter("path <> '/'").select(F.col("path").alias("key"), "kind", "size", F.lit(mtime).cast("long").alias("mtime"), F.col("content").alias("oid"), "mode")
    empty = spark.createDataFrame([("/empty", "dir", 0, 1, None, 0o644)], "key string, kind string, size long, mtime long, oid string, mode int")
    return diff.status_tree(side(before, 0), side(after, 1).filter("NOT startswith(key, '/ASIA')").unionByName(empty))


@query("attribute_equality", f"{_SIDES} SELECT path, NOT t AS equal FROM j WHERE NOT nb AND NOT na")
def attribute_equality(spark, sf_dir):
    before, after = _inode_sides(spark, sf_dir)
    side = lambda df, name: df.select("path", F.struct(*diff.INODE_ATTRIBUTES).alias(name))
    return side(before, "b").join(side(after, "a"), "path").select("path", F.col("b").eqNullSafe(F.col("a")).alias("equal"))


def _merge_sides(spark, sf_dir) -> tuple[mutations.Tree, mutations.Tree, mutations.Tree]:
    t = base(spark, sf_dir)
    k = F.when(F.col("inode_id").startswith("c"), F.substring("inode_id", F.lit(2), F.lit(20)).cast("long")).otherwise(F.lit(1))

    def side(gone: int, new: int, time: int, mode_of: str) -> mutations.Tree:
        inodes = t.inodes.withColumn("k", k).filter(F.col("k") % gone != 0)
        inodes = inodes.withColumn("size", F.when(F.col("k") % new == 0, F.lit(time).cast("long")).otherwise(F.col("size")))
        inodes = inodes.withColumn("modified_ns", F.when(F.col("inode_id").startswith("n"), F.lit(time).cast("long")).otherwise(F.col("modified_ns"))).withColumn("mode", F.when(F.col("inode_id") == mode_of, 0o700).otherwise(F.col("mode"))).drop("k")
        kept = lambda df, c: df.withColumn("inode_id", F.col(c)).withColumn("k", k).filter(F.col("k") % gone != 0).select(*df.columns)
        return mutations.Tree(inodes, kept(t.entries, "child_id"), kept(t.chunks, "inode_id"), kept(t.xattrs, "inode_id"))

    return t, side(5, 7, 2000, "n3"), side(6, 11, 3000, "r1")


_MERGED = f"""{WITH}, k AS (SELECT inode_id, kind, CASE WHEN kind = 'file' THEN {_NUMBER} ELSE 1 END AS k FROM ino),
u AS (SELECT 'inode/' || inode_id AS key, 'inode' AS kind, k % 5 = 0 OR k % 7 = 0 OR left(inode_id, 1) = 'n' AS s, k % 6 = 0 OR k % 11 = 0 OR left(inode_id, 1) = 'n' OR inode_id = 'r1' AS t, k % 5 = 0 AND k % 6 = 0 AS same,
    left(inode_id, 1) = 'n' AND inode_id <> 'n3' AND inode_id IN (SELECT 'n' || c_nationkey FROM customer WHERE c_custkey % 5 = 0) AND inode_id IN (SELECT 'n' || c_nationkey FROM customer WHERE c_custkey % 6 = 0) AS d FROM k
  UNION ALL SELECT 'entry/' || parent_id || '/' || name, 'entry', k % 5 = 0, k % 6 = 0, k % 5 = 0 AND k % 6 = 0, false FROM ent JOIN k ON k.inode_id = ent.child_id)
SELECT key, CASE WHEN NOT s OR same THEN 'keep' WHEN NOT t THEN 'take' WHEN d THEN 'merge' ELSE 'conflict' END AS action, kind FROM u"""


@query("namespace_merge", _MERGED)
def namespace_merge(spark, sf_dir):
    return merge.namespace_merge(*(merge.records(t.inodes, t.entries, t.chunks, t.xattrs) for t in _merge_sides(spark, sf_dir)))


@query("merge_result_audit", f"{_MERGED.replace('SELECT key, CASE', 'SELECT count(*) AS n, 0::BIGINT AS problems FROM (SELECT key, CASE')}) WHERE kind = 'entry' AND ((action = 'keep' AND key IN (SELECT 'entry/' || parent_id || '/' || name FROM ent JOIN k ON k.inode_id = ent.child_id WHERE k.k % 6 <> 0)) OR (action = 'take' AND key IN (SELECT 'entry/' || parent_id || '/' || name FROM ent JOIN k ON k.inode_id = ent.child_id WHERE k.k % 5 <> 0)))")
def merge_result_audit(spark, sf_dir):
    _, s, t = _merge_sides(spark, sf_dir)
    entries = merge.merged_entries(namespace_merge(spark, sf_dir), s.entries, t.entries)
    problems = graph.cycles(entries, "root").select(F.lit(1).alias("x")).unionByName(graph.multiply_linked(entries, t.inodes.filter("kind = 'dir'")).select(F.lit(1).alias("x")))
    return entries.agg(F.count("*").alias("n")).join(F.broadcast(problems.agg(F.count("*").alias("problems"))))


@query("directory_merge", "SELECT 'n' || n_nationkey AS inode_id, greatest(2000 + n_nationkey, 3000 - n_nationkey * 100)::BIGINT AS modified_ns, 3000::BIGINT AS changed_ns FROM nation WHERE n_nationkey % 4 <> 0")
def directory_merge(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    side = lambda mode, m, c: n.select(_key("n", "n_nationkey").alias("inode_id"), mode.alias("mode"), F.lit(0).alias("flags"), m.cast("long").alias("modified_ns"), F.lit(c).cast("long").alias("changed_ns"))
    k, plain = F.col("n_nationkey"), F.lit(0o755)
    return merge.directory_merge(side(plain, F.lit(0), 0), side(F.when(k % 4 == 0, 0o700).otherwise(plain), 2000 + k, 2000), side(plain, 3000 - k * 100, 3000))


# ---------------------------------------------------------------- audits


def _damaged(spark, sf_dir) -> mutations.Tree:
    """The tree with one damage of each kind."""
    t = base(spark, sf_dir)
    extra = spark.createDataFrame([("n9", "again", "r2"), ("lost", "x", "c9")], mutations.ENTRY)
    chunks = spark.createDataFrame([("nobody", 0, "o", 3), ("c1", 99, "o", 8)], mutations.CHUNK)
    xattrs = spark.createDataFrame([("nobody", "a", bytearray(b"v")), ("c1", "b", bytearray(b"v"))], mutations.XATTR)
    inodes = t.inodes.withColumn("size", F.when(F.col("inode_id") == "n1", F.lit(5).cast("long")).otherwise(F.col("size"))).withColumn("kind", F.when(F.col("inode_id") == "c2", "door").otherwise(F.col("kind")))
    unnamed = spark.createDataFrame([("idle", "file", 0, 0, 0, 0, 0, 0, 0, 0, False)], mutations.INODE)
    return mutations.Tree(inodes.unionByName(unnamed), t.entries.unionByName(extra), t.chunks.unionByName(chunks), t.xattrs.unionByName(xattrs))


@query("namespace_audit", "SELECT * FROM (VALUES ('n9', 'links'), ('c9', 'links'), ('lost', 'parent is no directory'), ('nobody', 'orphan content'), ('c2', 'orphan content'), ('c2', 'unknown kind'), ('n1', 'size without content'), ('c9', 'not below the root'), ('idle', 'no name'), ('r2', 'directory with names'), ('c1', 'chunk beyond the file'), ('nobody', 'orphan attribute'), ('c1', 'attribute flag')) t(inode_id, problem)")
def namespace_audit(spark, sf_dir):
    t = _damaged(spark, sf_dir)
    return audit.namespace_audit(t.inodes, t.entries, t.chunks, t.xattrs, "root", CHUNK)


@query("directory_aliases", "SELECT 'r2' AS child_id, 2::BIGINT AS names")
def directory_aliases(spark, sf_dir):
    t = _damaged(spark, sf_dir)
    return graph.multiply_linked(t.entries, t.inodes.filter("kind = 'dir'"))


@query("stored_counts", "SELECT o_orderstatus AS name, count(*) + 1 AS n, count(*) AS counted FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1")
def stored_counts(spark, sf_dir):
    actual = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("name"))
    stored = actual.groupBy("name").agg(F.count("*").alias("n")).withColumn("n", F.when(F.col("name") == "O", F.col("n")).otherwise(F.col("n") + 1))
    return audit.stored_counts(actual, stored)


@query("xattr_limits", "SELECT 'u' || o_custkey AS inode_id, count(*) AS names, sum(strlen(o_orderpriority) + strlen(CAST(o_orderkey AS VARCHAR)))::BIGINT AS bytes, max(strlen(o_orderpriority))::INTEGER AS largest FROM orders GROUP BY 1 HAVING count(*) > 12")
def xattr_limits(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(_key("u", "o_custkey").alias("inode_id"), F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderpriority").cast("binary").alias("value"))
    return audit.xattr_limits(rows, most_names=12).withColumn("largest", F.col("largest").cast("int"))


# ---------------------------------------------------------------- locks and probes


@query("whole_file_locks", """
WITH l AS (SELECT user_id AS inode_id, event_id AS handle, CASE WHEN event_id % 50 = 0 THEN 0 ELSE event_id % 1000 END AS s, CASE WHEN event_id % 50 = 0 THEN 9223372036854775807 ELSE event_id % 1000 + 1 + event_id % 7 END AS t, event_id % 3 = 0 AS x, event_id // 2 AS o FROM events WHERE event_id < 5000)
SELECT a.inode_id, a.handle AS a, b.handle AS b FROM l a JOIN l b ON a.inode_id = b.inode_id AND a.handle < b.handle AND a.s < b.t AND b.s < a.t AND (a.x OR b.x) AND a.o <> b.o""")
def whole_file_locks(spark, sf_dir):
    e, id_ = table(spark, sf_dir, "events").filter("event_id < 5000"), F.col("event_id")
    whole = id_ % 50 == 0
    rows = e.select(F.col("user_id").alias("inode_id"), id_.alias("handle"), F.when(whole, F.lit(0)).otherwise(id_ % 1000).cast("long").alias("start"), F.when(whole, F.lit(intervals.FOREVER)).otherwise(id_ % 1000 + 1 + id_ % 7).alias("end"), F.when(id_ % 3 == 0, "exclusive").otherwise("shared").alias("mode"), F.floor(id_ / 2).alias("owner"))
    return intervals.conflicts(rows, "owner")


@query("lock_replace", """
WITH o AS (SELECT DISTINCT o_custkey AS inode_id FROM orders),
r AS (SELECT inode_id, 0 AS s, 10 AS t, 'shared' AS m FROM o UNION ALL SELECT inode_id, 20, 30, 'shared' FROM o),
n AS (SELECT inode_id, CASE inode_id % 3 WHEN 0 THEN 'unlock' WHEN 1 THEN 'shared' ELSE 'exclusive' END AS m FROM o)
SELECT inode_id, s::BIGINT AS start, t::BIGINT AS "end", m AS mode FROM (
  SELECT inode_id, 0 AS s, 5 AS t, 'shared' AS m FROM n WHERE m <> 'shared' UNION ALL SELECT inode_id, 25, 30, 'shared' FROM n WHERE m <> 'shared'
  UNION ALL SELECT inode_id, 5, 25, 'exclusive' FROM n WHERE m = 'exclusive' UNION ALL SELECT inode_id, 0, 30, 'shared' FROM n WHERE m = 'shared')""")
def lock_replace(spark, sf_dir):
    owners = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("inode_id")).distinct()
    row = lambda s, t, m: F.struct(F.lit(s).cast("long").alias("start"), F.lit(t).cast("long").alias("end"), m.alias("mode"))
    ranges = owners.select("inode_id", F.inline(F.array(row(0, 10, F.lit("shared")), row(20, 30, F.lit("shared")))))
    mode = F.when(F.col("inode_id") % 3 == 0, "unlock").when(F.col("inode_id") % 3 == 1, "shared").otherwise("exclusive")
    return intervals.set_locks(ranges, owners.select("inode_id", F.inline(F.array(row(5, 25, mode)))), ["inode_id"])


@query("prefix_probe", "SELECT 42::BIGINT AS number")
def prefix_probe(spark, sf_dir):
    rows = table(spark, sf_dir, "region").select(F.when(F.col("r_regionkey") == 2, "run-42").otherwise(F.concat(F.lit("run-x"), "r_name")).alias("key"))
    return pages.probe(rows, "run-")


@query("state_violations", "SELECT 'c' || c_custkey AS inode_id, CASE WHEN c_custkey % 5 = 0 THEN 'unknown kind' WHEN c_custkey % 7 = 0 THEN 'size without content' ELSE 'too few links' END AS problem FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 7 = 0 OR c_custkey % 11 = 0")
def state_violations(spark, sf_dir):
    k = F.col("c_custkey")
    kind = F.when(k % 5 == 0, "door").when(k % 7 == 0, "fifo").when(k % 11 == 0, "dir").otherwise("file")
    size = F.when(kind == "dir", 0).otherwise(3).cast("long")
    return audit.state_violations(table(spark, sf_dir, "customer").select(_key("c", "c_custkey").alias("inode_id"), kind.alias("kind"), size.alias("size"), F.lit(1).cast("long").alias("links")))


# ---------------------------------------------------------------- scalars


@query("scalar_hex", f"SELECT c_custkey, {_hex('c_name')} AS hex, c_name AS back, CASE WHEN c_custkey % 2 = 0 THEN 'x' || c_custkey END AS odd, sha256('priority:' || c_name) AS priority FROM customer")
def scalar_hex(spark, sf_dir):
    h = scalars.hex_lower(F.col("c_name").cast("binary"))
    odd = scalars.from_hex(F.when(F.col("c_custkey") % 2 == 0, scalars.hex_lower(F.concat(F.lit("x"), F.col("c_custkey").cast("string")).cast("binary"))).otherwise(F.lit("ABC")))
    return table(spark, sf_dir, "customer").select("c_custkey", h.alias("hex"), scalars.from_hex(h).cast("string").alias("back"), odd.cast("string").alias("odd"), scalars.priority(F.col("c_name")).alias("priority"))


@query("scalar_endian", "SELECT o_orderkey, (o_orderkey % 65536)::DOUBLE AS low, printf('%02x%02x%02x%02x', o_orderkey % 256, (o_orderkey // 256) % 256, (o_orderkey // 65536) % 256, o_orderkey // 16777216) AS hex FROM orders")
def scalar_endian(spark, sf_dir):
    data = scalars.to_little_endian(F.col("o_orderkey"), 4)
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.little_endian(data, 2).cast("double").alias("low"), scalars.hex_lower(data).alias("hex"))


@query("scalar_json", """SELECT c_custkey, '"a\\u0000' || '\\"' || c_name || '\\\\' || '\\u000a"' AS quoted FROM customer""")
def scalar_json(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", scalars.json_quoted(F.concat(F.lit('a\0"'), "c_name", F.lit("\\\n"))).alias("quoted"))


@query("scalar_links", "SELECT p_partkey, array_to_string(list_filter(string_split('../' || replace(p_name, ' ', '//') || '/', '/'), lambda x: x <> ''), '|') AS parts, CASE WHEN p_partkey % 2 = 0 THEN '/' || p_name ELSE p_type || '/' || p_name END AS joined, substr(sha256(p_name), 1, 2) || '/' || substr(sha256(p_name), 3, 2) || '/' || sha256(p_name) AS sharded FROM part")
def scalar_links(spark, sf_dir):
    oid = F.sha2("p_name", 256)
    parent = F.when(F.col("p_partkey") % 2 == 0, F.lit("/")).otherwise(F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(scalars.link_parts(F.concat(F.lit("../"), F.replace(F.col("p_name"), F.lit(" "), F.lit("//")), F.lit("/"))), "|").alias("parts"), scalars.path_join(parent, F.col("p_name")).alias("joined"), scalars.sharded_path(oid).alias("sharded"))


@query("scalar_seek", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL WHEN o_orderkey - 1000 < 0 THEN NULL ELSE o_orderkey - 1000 END AS position, CASE WHEN o_orderkey % 3 = 2 THEN 'EOVERFLOW' WHEN o_orderkey - 1000 < 0 THEN 'EINVAL' END AS error, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey + 1 END AS total FROM orders")
def scalar_seek(spark, sf_dir):
    k, most = F.col("o_orderkey"), F.lit((1 << 63) - 1)
    at = scalars.seek_position(F.when(k % 3 == 2, most).otherwise(k), F.when(k % 3 == 2, k + 1).otherwise(F.lit(-1000)).cast("long"))
    return table(spark, sf_dir, "orders").select("o_orderkey", at.alias("s"), scalars.checked_add(F.when(k % 2 == 0, k).otherwise(most), F.lit(1).cast("long")).alias("total")).select("o_orderkey", "s.position", "s.error", "total")


@query("scalar_parse", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey END AS whole, CASE WHEN o_orderkey % 3 <> 0 THEN 420 END::BIGINT AS mode, strftime(to_timestamp(o_orderkey * 100000) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS minute FROM orders")
def scalar_parse(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.strict_int(F.concat(k.cast("string"), F.when(k % 2 == 0, "").otherwise(" "))).alias("whole"), scalars.octal(F.when(k % 3 != 0, "0644").otherwise("0689")).alias("mode"), scalars.minute_text(k * 100000).alias("minute"))


@query("scalar_maps", "SELECT c_custkey, c_mktsegment AS put, c_custkey % 2 = 1 AS removed, CASE WHEN c_custkey % 2 = 0 THEN 'v' END AS kept FROM customer")
def scalar_maps(spark, sf_dir):
    m = F.create_map(F.lit("a"), F.lit("v"), F.lit("b"), F.lit("w"))
    put = handles.map_put(m, "a", F.col("c_mktsegment"))
    less = F.when(F.col("c_custkey") % 2 == 0, m).otherwise(handles.map_remove(m, "a"))
    return table(spark, sf_dir, "customer").select("c_custkey", handles.xattr_value(put, "a").alias("put"), handles.xattr_value(less, "a").isNull().alias("removed"), handles.xattr_value(less, "a").alias("kept"))


@query("scalar_units", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN 'entry/x' ELSE 'inode/' || md5(c_name) END AS unit, sha256('{\"a\":\"' || c_name || '\",\"b\":' || c_custkey || '}') AS canonical, c_custkey > 100 AS utf8 FROM customer")
def scalar_units(spark, sf_dir):
    id_ = F.md5("c_name")
    k = F.col("c_custkey") % 4
    key = F.when(k == 0, F.concat(F.lit("content/"), id_)).when(k == 1, F.concat(F.lit("chunk/"), id_, F.lit("/0003"))).when(k == 2, F.concat(F.lit("inode/"), id_)).otherwise(F.lit("entry/x"))
    data = F.when(F.col("c_custkey") > 100, F.col("c_name").cast("binary")).otherwise(F.lit(b"\xc0\x80"))
    named = table(spark, sf_dir, "customer").withColumns({"b": F.col("c_custkey"), "a": F.col("c_name")})
    return named.select("c_custkey", scalars.unit_key(key).alias("unit"), scalars.canonical_hash("b", "a").alias("canonical"), scalars.valid_utf8(data).alias("utf8"))


@query("distinct_sorted", "SELECT DISTINCT o_orderpriority FROM orders ORDER BY 1")
def distinct_sorted(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderpriority").distinct().orderBy("o_orderpriority")
