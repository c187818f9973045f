"""The queries of the versioned-data operators, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataq.functions import scalars
from strataq.operators import audit, capture, content, diff, graph, handles, history, intervals, merge, pages, rollup, views
from strataq.plans import derived
from strataq.plans.derived import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_VERSION = "o_orderkey AS key, {status} || '|' || CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS oid, {priority} || '|' || CAST(o_custkey AS VARCHAR) AS meta"
BEFORE = f"(SELECT {_VERSION.format(status='o_orderstatus', priority='o_orderpriority')} FROM orders WHERE o_orderkey % 5 <> 0)"
AFTER = f"""(SELECT {_VERSION.format(status="(CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END)", priority="(CASE WHEN o_orderkey % 13 = 0 THEN 'P' ELSE o_orderpriority END)")} FROM orders WHERE o_orderkey % 7 <> 0)"""
TARGET = f"""(SELECT {_VERSION.format(status="(CASE WHEN o_orderkey % 17 = 0 THEN 'Y' ELSE o_orderstatus END)", priority='o_orderpriority')} FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 5 <> 0)"""


def query(name: str, sql: str | None):
    """Register a query under ``name`` with the SQL that must give the same rows."""

    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE_SQL[name] = sql
        return function

    return add


# ---------------------------------------------------------------- revisions

DIFF = f"""
SELECT key, CASE WHEN b.key IS NULL THEN 'added' WHEN a.key IS NULL THEN 'removed' ELSE 'modified' END AS change,
  b.key IS NULL OR a.key IS NULL OR b.meta IS DISTINCT FROM a.meta AS metadata_changed,
  b.key IS NULL OR a.key IS NULL OR b.oid IS DISTINCT FROM a.oid AS content_changed,
  b.oid AS before_oid, a.oid AS after_oid
FROM {BEFORE} b FULL JOIN {AFTER} a USING (key)
WHERE b.key IS NULL OR a.key IS NULL OR b.meta IS DISTINCT FROM a.meta OR b.oid IS DISTINCT FROM a.oid"""


@query("revision_diff", DIFF)
def revision_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.revision_diff(derived.before(spark, sf_dir), derived.after(spark, sf_dir))


@query("diff_stat", f"SELECT change, count(*) AS n, count(*) FILTER (content_changed) AS n_content, count(*) FILTER (metadata_changed) AS n_metadata FROM ({DIFF}) GROUP BY change")
def diff_stat(spark, sf_dir):
    return diff.diff_stat(revision_diff(spark, sf_dir))


@query("diff_page", f"WITH d AS ({DIFF}), p AS (SELECT * FROM d WHERE key > 100 ORDER BY key LIMIT 64) SELECT p.*, (SELECT count(*) FROM d WHERE key > 100) <= 64 AS eof, CASE WHEN (SELECT count(*) FROM d WHERE key > 100) > 64 THEN (SELECT max(key) FROM p) END AS next_after FROM p")
def diff_page(spark, sf_dir):
    return diff.diff_page(revision_diff(spark, sf_dir), after=100, limit=64)


@query("diff_mirror", f"SELECT key, CASE change WHEN 'added' THEN 'removed' WHEN 'removed' THEN 'added' ELSE change END AS change, metadata_changed, content_changed, after_oid AS before_oid, before_oid AS after_oid FROM ({DIFF})")
def diff_mirror(spark, sf_dir):
    return diff.revision_diff(derived.after(spark, sf_dir), derived.before(spark, sf_dir))


_S = "(SELECT o_orderkey AS key, CAST(floor(o_totalprice) AS BIGINT) % 97 AS size, epoch_us(o_orderdate) AS mtime, o_orderstatus AS oid, o_orderpriority AS mode FROM orders WHERE o_orderkey % 5 <> 0)"
_T = "(SELECT o_orderkey AS key, CAST(floor(o_totalprice) AS BIGINT) % 97 + CASE WHEN o_orderkey % 19 = 0 THEN 1 ELSE 0 END AS size, epoch_us(o_orderdate) + CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS mtime, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS oid, CASE WHEN o_orderkey % 13 = 0 THEN 'P' ELSE o_orderpriority END AS mode FROM orders WHERE o_orderkey % 7 <> 0)"


@query("status_diff", f"""
SELECT key, CASE WHEN s.key IS NULL THEN 'A' WHEN w.key IS NULL THEN 'D' WHEN s.size <> w.size THEN 'M'
  WHEN s.mtime <> w.mtime AND s.oid IS DISTINCT FROM w.oid THEN 'M' WHEN s.mode IS DISTINCT FROM w.mode THEN 'T' END AS status
FROM {_S} s FULL JOIN {_T} w USING (key)
WHERE s.key IS NULL OR w.key IS NULL OR s.size <> w.size OR (s.mtime <> w.mtime AND s.oid IS DISTINCT FROM w.oid) OR s.mode IS DISTINCT FROM w.mode""")
def status_diff(spark, sf_dir):
    return diff.status_diff(derived.snapshot(spark, sf_dir), derived.world(spark, sf_dir))


_M = f"""
SELECT key, b.key IS NOT NULL AS in_base, s.key IS NOT NULL AS in_source, t.key IS NOT NULL AS in_target,
  CASE WHEN (s.key IS NULL AND b.key IS NULL) OR (s.oid = b.oid AND s.meta = b.meta) OR (s.key IS NULL AND t.key IS NULL) OR (s.oid = t.oid AND s.meta = t.meta) THEN 'keep'
       WHEN (t.key IS NULL AND b.key IS NULL) OR (t.oid = b.oid AND t.meta = b.meta) THEN 'take' ELSE 'conflict' END AS action,
  s.oid AS s_oid, s.meta AS s_meta, t.oid AS t_oid, t.meta AS t_meta
FROM {BEFORE} b FULL JOIN {AFTER} s USING (key) FULL JOIN {TARGET} t USING (key)"""
MERGE = f"SELECT key, action, CASE action WHEN 'take' THEN s_oid WHEN 'keep' THEN t_oid END AS oid, CASE action WHEN 'take' THEN s_meta WHEN 'keep' THEN t_meta END AS meta, in_base, in_source, in_target FROM ({_M})"


@query("three_way_merge", MERGE)
def three_way_merge(spark, sf_dir):
    return merge.merge_rows(derived.before(spark, sf_dir), derived.after(spark, sf_dir), derived.target(spark, sf_dir))


@query("merge_summary", f"SELECT action, count(*) AS n, count(oid) AS n_rows FROM ({MERGE}) GROUP BY action")
def merge_summary(spark, sf_dir):
    return merge.summary(three_way_merge(spark, sf_dir))


@query("merge_conflicts", f"WITH c AS (SELECT * FROM ({MERGE}) WHERE action = 'conflict') SELECT c.*, (SELECT count(*) FROM c) > 32 AS conflicts_limited FROM c ORDER BY key LIMIT 32")
def merge_conflicts(spark, sf_dir):
    return merge.conflicts(three_way_merge(spark, sf_dir))


_GROUPED = "SELECT CAST(key // 8 AS BIGINT) AS g, list(CAST(key AS VARCHAR) || '#' || oid || '#' || meta ORDER BY key) AS rows FROM {} GROUP BY 1"


@query("merge_groups", f"""
SELECT action, count(*) AS n FROM (SELECT g, CASE WHEN s.rows IS NOT DISTINCT FROM b.rows OR s.rows IS NOT DISTINCT FROM t.rows THEN 'keep' WHEN t.rows IS NOT DISTINCT FROM b.rows THEN 'take' ELSE 'conflict' END AS action
FROM ({_GROUPED.format(BEFORE)}) b FULL JOIN ({_GROUPED.format(AFTER)}) s USING (g) FULL JOIN ({_GROUPED.format(TARGET)}) t USING (g)) GROUP BY action""")
def merge_groups(spark, sf_dir):
    unit = F.floor(F.col("key") / 8)
    return merge.three_way(derived.before(spark, sf_dir), derived.after(spark, sf_dir), derived.target(spark, sf_dir), unit).groupBy("action").agg(F.count("*").alias("n"))


@query("merge_tokens", f"SELECT key, sha256('repo/main/' || CAST(key AS VARCHAR) || '/' || oid) AS token FROM {BEFORE}")
def merge_tokens(spark, sf_dir):
    return derived.before(spark, sf_dir).select("key", merge.token(F.lit("repo"), F.lit("main"), F.col("key"), F.col("oid")).alias("token"))


# ---------------------------------------------------------------- views and pages


@query("newest_wins", "SELECT user_id AS key, max(event_id) AS run, arg_max(event_type, event_id) AS oid FROM events GROUP BY user_id HAVING arg_max(event_type, event_id) <> 'error'")
def newest_wins(spark, sf_dir):
    runs = derived.runs(spark, sf_dir)
    return views.newest_wins(runs.withColumn("oid", F.struct("oid", "run_no")), "run_no", ascending=False).select("key", F.col("oid.run_no").alias("run"), F.col("oid.oid").alias("oid"))


@query("checkpoint_replay", "WITH t AS (SELECT user_id AS key, event_id AS seq, event_type AS oid, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op FROM events WHERE event_id % 2 = 0), a AS (SELECT c_custkey AS key, CAST('put' AS VARCHAR) AS op, c_mktsegment AS oid, -1 AS seq FROM customer UNION ALL SELECT key, op, oid, seq FROM t) SELECT key, arg_max(oid, seq) AS oid FROM a GROUP BY key HAVING arg_max(op, seq) = 'put'")
def checkpoint_replay(spark, sf_dir):
    base = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("oid"))
    return views.replay(base, derived.runs(spark, sf_dir).filter("run_no % 2 = 0").withColumnRenamed("run_no", "seq"))


@query("range_erase", f"SELECT key, oid, meta FROM {BEFORE} WHERE key < 1000 OR key >= 5000")
def range_erase(spark, sf_dir):
    return views.range_erase(derived.before(spark, sf_dir), 1000, 5000)


@query("first_kept", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def first_kept(spark, sf_dir):
    return views.first_kept(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("point_lookup", "SELECT o_orderkey AS key, o_custkey FROM orders WHERE o_orderkey = 42")
def point_lookup(spark, sf_dir):
    return pages.lookup(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_custkey"), 42)


@query("prefix_scan", "SELECT p_name AS key, p_partkey FROM part WHERE starts_with(p_name, 'small')")
def prefix_scan(spark, sf_dir):
    return pages.prefix_scan(table(spark, sf_dir, "part").select(F.col("p_name").alias("key"), "p_partkey"), "small")


@query("keyset_page", "SELECT c_name AS key, c_custkey FROM customer WHERE starts_with(c_name, 'Customer') AND c_name > 'Customer#000000020' ORDER BY c_name, c_custkey LIMIT 64")
def keyset_page(spark, sf_dir):
    return pages.keyset_page(table(spark, sf_dir, "customer").select(F.col("c_name").alias("key"), "c_custkey"), "Customer", "Customer#000000020", 64)


@query("multi_get", "SELECT n_nationkey AS ordinal, n_nationkey * 3 AS key, c.c_name FROM nation LEFT JOIN customer c ON c.c_custkey = n_nationkey * 3")
def multi_get(spark, sf_dir):
    wanted = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ordinal"), (F.col("n_nationkey") * 3).alias("key"))
    return pages.get_many(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), "c_name"), wanted)


@query("page_budget", "SELECT source, doc_id, n FROM (SELECT source, doc_id, strlen(text) AS n, sum(strlen(text)) OVER w AS s, row_number() OVER w AS r FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)) WHERE s <= 20000 OR r = 1")
def page_budget(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length("text").cast("long").alias("n"))
    return pages.within_budget(rows, "n", 20_000, ["source"], ["doc_id"])


@query("worlds_first", "SELECT r_name AS name FROM region")
def worlds_first(spark, sf_dir):
    return pages.worlds_first(table(spark, sf_dir, "region").select(F.col("r_name").alias("name")), "EUROPE")


# ---------------------------------------------------------------- history

_HISTORY = "(SELECT o_orderkey AS revision_id, o_custkey AS world, lag(o_orderkey) OVER w AS parent_id, row_number() OVER w AS seq FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"
_CHAIN = f"WITH RECURSIVE h AS {_HISTORY}, t AS (SELECT world, arg_max(revision_id, seq) AS tip FROM h GROUP BY world), c AS (SELECT tip, tip AS revision_id, 0::BIGINT AS depth FROM t UNION ALL SELECT c.tip, h.parent_id, c.depth + 1 FROM c JOIN h ON h.revision_id = c.revision_id WHERE h.parent_id IS NOT NULL)"


@query("history_chain", f"{_CHAIN} SELECT tip, revision_id, depth FROM c")
def history_chain(spark, sf_dir):
    revisions = derived.revisions(spark, sf_dir)
    return history.ancestry(revisions, revisions.groupBy("world").agg(F.max_by("revision_id", "seq").alias("revision_id")))


@query("history_page", f"{_CHAIN}, f AS (SELECT * FROM c WHERE tip = (SELECT t.tip FROM t ORDER BY world LIMIT 1)) SELECT tip, revision_id, depth FROM f WHERE depth > 2 ORDER BY depth LIMIT 5")
def history_page(spark, sf_dir):
    revisions = derived.revisions(spark, sf_dir)
    tip = revisions.groupBy("world").agg(F.max_by("revision_id", "seq").alias("revision_id")).orderBy("world").limit(1)
    chain = history.ancestry(revisions, tip)
    cursor = chain.filter("depth = 2").first()
    return history.history_page(chain, cursor["revision_id"] if cursor else None, 5) if cursor else chain.limit(0)


@query("is_ancestor", f"{_CHAIN}, p AS (SELECT t.tip, o.o_orderkey AS candidate FROM t JOIN h ON h.revision_id = t.tip JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey) o ON o.o_custkey IN (h.world, h.world + 1)) SELECT p.tip, p.candidate, EXISTS (SELECT 1 FROM c WHERE c.tip = p.tip AND c.revision_id = p.candidate) AS is_ancestor FROM p")
def is_ancestor(spark, sf_dir):
    revisions = derived.revisions(spark, sf_dir)
    tips = revisions.groupBy("world").agg(F.max_by("revision_id", "seq").alias("revision_id"))
    first = revisions.groupBy("world").agg(F.min("revision_id").alias("candidate"))
    asked = tips.select(F.col("revision_id").alias("tip"), F.explode(F.array("world", F.col("world") + 1)).alias("world")).join(first, "world").select("tip", "candidate")
    return history.is_ancestor(history.ancestry(revisions, tips), asked)


@query("ancestry_audit", f"WITH h AS {_HISTORY} SELECT h.revision_id, h.parent_id, h.revision_id AS seq, h.parent_id AS parent_seq FROM h WHERE h.parent_id >= h.revision_id")
def ancestry_audit(spark, sf_dir):
    return history.sequence_audit(derived.revisions(spark, sf_dir).withColumn("seq", F.col("revision_id"))).select("revision_id", "parent_id", "seq", "parent_seq")


# ---------------------------------------------------------------- content


@query("content_dedup", "SELECT sha256(text) AS oid, any_value(strlen(text)) AS size, count(*) AS refs, min(doc_id) AS first_ref FROM documents GROUP BY 1")
def content_dedup(spark, sf_dir):
    return content.dedup(table(spark, sf_dir, "documents"), "text", "doc_id")


@query("new_objects", "SELECT DISTINCT sha256(text) AS oid FROM documents WHERE doc_id % 2 = 1 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0)")
def new_objects(spark, sf_dir):
    objects = table(spark, sf_dir, "documents").select("doc_id", content.object_id(F.col("text").cast("binary")).alias("oid"))
    return content.new_objects(objects.filter("doc_id % 2 = 1"), objects.filter("doc_id % 2 = 0")).select("oid")


@query("reference_counts", "SELECT c_custkey AS oid, count(o_orderkey) AS refs FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def reference_counts(spark, sf_dir):
    return content.reference_counts(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("oid")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("oid")))


@query("chunk_map", "SELECT doc_id AS inode_id, i AS idx, sha256(from_hex(h[i * 8192 + 1:(i + 1) * 8192])) AS oid, (len(h[i * 8192 + 1:(i + 1) * 8192]) // 2)::BIGINT AS len FROM (SELECT doc_id, hex(encode(text)) AS h, unnest(range(0, (strlen(text) + 4095) // 4096)) AS i FROM documents WHERE strlen(text) > 0)")
def chunk_map(spark, sf_dir):
    return content.chunk_map(table(spark, sf_dir, "documents"), "doc_id", "text", 4096)


@query("allocated_bytes", "SELECT source, sum(strlen(text))::BIGINT AS bytes, sum((strlen(text) + 511) // 512 * 512)::BIGINT AS allocated FROM documents GROUP BY source")
def allocated_bytes(spark, sf_dir):
    return content.allocated_bytes(table(spark, sf_dir, "documents"), "source", F.octet_length("text"))


@query("sparse_regions", "WITH r AS (SELECT l_partkey AS inode_id, l_linenumber AS idx FROM lineitem GROUP BY 1, 2), g AS (SELECT *, idx - row_number() OVER (PARTITION BY inode_id ORDER BY idx) AS k FROM r), s AS (SELECT inode_id, min(idx) AS first_idx, max(idx) AS last_idx FROM g GROUP BY inode_id, k) SELECT inode_id, first_idx, last_idx, coalesce(lead(first_idx) OVER (PARTITION BY inode_id ORDER BY first_idx), -1) AS next_data, last_idx + 1 AS next_hole FROM s")
def sparse_regions(spark, sf_dir):
    return content.regions(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("inode_id"), F.col("l_linenumber").alias("idx"))).withColumn("next_data", F.coalesce("next_data", F.lit(-1)))


@query("read_range", "SELECT doc_id AS inode_id, lower(hex(encode(text))[2 * 4000 + 1:2 * 4200]) AS data FROM documents WHERE strlen(text) > 0")
def read_range(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    data = F.col("text").cast("binary")
    parts = docs.filter(F.octet_length("text") > 0).select(F.col("doc_id").alias("inode_id"), F.octet_length("text").alias("size"), data.alias("_d"), F.posexplode(F.sequence(F.lit(0), F.floor((F.octet_length("text") - 1) / 4096).cast("int"))).alias("idx", "_i"))
    return content.read_range(parts.select("inode_id", "size", "idx", F.col("_d").substr(F.col("idx") * 4096 + 1, F.lit(4096)).alias("data")), 4000, 200, 4096).select("inode_id", F.lower(F.hex("data")).alias("data"))


# ---------------------------------------------------------------- graphs and trees

_EDGES = "(SELECT 'r' || r_regionkey AS src, 'n' || n_nationkey AS dst FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"
_LIVE = f"WITH RECURSIVE e AS {_EDGES}, l AS (SELECT 'r' || r_regionkey AS node, 0 AS depth FROM region WHERE r_regionkey IN (0, 1) UNION SELECT e.dst, l.depth + 1 FROM l JOIN e ON e.src = l.node)"


@query("gc_live", f"{_LIVE} SELECT node, min(depth) AS depth FROM l GROUP BY node")
def gc_live(spark, sf_dir):
    return graph.reachable(derived.edges(spark, sf_dir), derived.roots(spark, sf_dir))


@query("gc_sweep", f"{_LIVE} SELECT DISTINCT dst AS node FROM e WHERE dst NOT IN (SELECT node FROM l)")
def gc_sweep(spark, sf_dir):
    objects = derived.edges(spark, sf_dir).select(F.col("dst").alias("node")).distinct()
    return graph.sweep(objects, gc_live(spark, sf_dir))


@query("tree_listing", r"WITH p AS (SELECT DISTINCT list_filter(string_split(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/'), lambda x: x <> '') AS s FROM pages), q AS (SELECT DISTINCT array_to_string(s[1:i], '/') AS path, array_to_string(s[1:i - 1], '/') AS parent, s[i] AS name FROM (SELECT s, unnest(range(1, len(s) + 1)) AS i FROM p)) SELECT parent, count(*) AS n, min(name) AS first_name, max(name) AS last_name FROM q GROUP BY parent")
def tree_listing(spark, sf_dir):
    return derived.url_tree(spark, sf_dir).groupBy("parent").agg(F.count("*").alias("n"), F.min("name").alias("first_name"), F.max("name").alias("last_name"))


@query("tree_paths", "SELECT 'r' || r_regionkey AS inode_id, '/' || r_name AS path, 1 AS depth FROM region UNION ALL SELECT 'n' || n_nationkey, '/' || r_name || '/' || n_name, 2 FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'c' || c_custkey, '/' || r_name || '/' || n_name || '/' || c_name, 3 FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'root', '/', 0")
def tree_paths(spark, sf_dir):
    return graph.tree_paths(derived.places(spark, sf_dir), "root")


@query("subtree_sizes", "WITH f AS (SELECT r_name, n_name, c_name, CAST(floor(abs(c_acctbal)) AS BIGINT) AS s FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey), x AS (SELECT '/' AS path, s FROM f UNION ALL SELECT '/' || r_name, s FROM f UNION ALL SELECT '/' || r_name || '/' || n_name, s FROM f UNION ALL SELECT '/' || r_name || '/' || n_name || '/' || c_name, s FROM f) SELECT path, count(*) AS entries, sum(1024 + s)::BIGINT AS bytes FROM x GROUP BY path")
def subtree_sizes(spark, sf_dir):
    sizes = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("inode_id"), F.floor(F.abs("c_acctbal")).cast("long").alias("size"))
    return graph.subtree_sizes(tree_paths(spark, sf_dir), sizes)


# ---------------------------------------------------------------- capture

_CAP = f"""
SELECT key, CASE WHEN r.key IS NULL THEN 'A' WHEN c.key IS NULL THEN 'D' WHEN r.oid IS DISTINCT FROM c.oid THEN 'M' WHEN r.mode IS DISTINCT FROM c.mode THEN 'T' END AS status, c.key IS NOT NULL AND c.oid IS NULL AS incomplete
FROM {_S} r FULL JOIN {_T} c USING (key) WHERE r.key IS NULL OR c.key IS NULL OR r.oid IS DISTINCT FROM c.oid OR r.mode IS DISTINCT FROM c.mode"""


@query("capture_incremental", _CAP)
def capture_incremental(spark, sf_dir):
    kind = F.lit("file")
    return capture.capture(derived.snapshot(spark, sf_dir).withColumn("kind", kind), derived.world(spark, sf_dir).withColumn("kind", kind))


@query("capture_numbered", f"SELECT key, status, (row_number() OVER (PARTITION BY status ORDER BY key) - 1)::BIGINT AS seq FROM ({_CAP})")
def capture_numbered(spark, sf_dir):
    return capture.numbered(capture_incremental(spark, sf_dir), "status").select("key", "status", "seq")


@query("capture_reconcile", f"SELECT key FROM {_S} WHERE key NOT IN (SELECT key FROM ({_CAP}))")
def capture_reconcile(spark, sf_dir):
    return capture.reconcile(derived.snapshot(spark, sf_dir), capture_incremental(spark, sf_dir)).select("key")


@query("upsert", f"SELECT * FROM {BEFORE} WHERE key NOT IN (SELECT key FROM {AFTER}) UNION ALL SELECT * FROM {AFTER}")
def upsert(spark, sf_dir):
    return capture.upsert(derived.before(spark, sf_dir), derived.after(spark, sf_dir))


@query("insert_or_ignore", f"SELECT * FROM {BEFORE} UNION ALL SELECT * FROM {AFTER} WHERE key NOT IN (SELECT key FROM {BEFORE})")
def insert_or_ignore(spark, sf_dir):
    return capture.insert_or_ignore(derived.before(spark, sf_dir), derived.after(spark, sf_dir))


@query("add_counts", "SELECT key, sum(n)::BIGINT AS n FROM (SELECT c_custkey AS key, c_nationkey AS n FROM customer UNION ALL SELECT user_id, count(*) FROM events GROUP BY 1) GROUP BY key")
def add_counts(spark, sf_dir):
    counters = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").cast("long").alias("n"))
    return capture.add_counts(counters, table(spark, sf_dir, "events").select(F.col("user_id").alias("key")))


@query("events_after", "SELECT event_id, user_id, event_type FROM events WHERE event_id > 100")
def events_after(spark, sf_dir):
    return capture.events_after(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), 100)


# ---------------------------------------------------------------- roll-ups


@query("state_rollup", "SELECT o_orderstatus AS state, count(*) AS n, coalesce(sum(CAST(round(o_totalprice * 100) AS BIGINT)), 0)::BIGINT AS total FROM orders GROUP BY 1")
def state_rollup(spark, sf_dir):
    return rollup.by_state(table(spark, sf_dir, "orders"), "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("long"))


@query("state_pivot", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'O') AS \"O\", count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1")
def state_pivot(spark, sf_dir):
    return rollup.pivot_states(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["O", "F", "P"])


@query("pool_status", "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'O') AS ready, count(*) FILTER (o_orderstatus = 'P') AS building, count(*) FILTER (o_orderstatus NOT IN ('O', 'P')) AS stale, min(epoch_us(o_orderdate)) AS oldest, max(epoch_us(o_orderdate)) AS newest FROM orders GROUP BY 1")
def pool_status(spark, sf_dir):
    state = F.when(F.col("o_orderstatus") == "O", "ready").when(F.col("o_orderstatus") == "P", "building").otherwise("stale")
    return rollup.pool_status(table(spark, sf_dir, "orders"), "o_custkey", state, derived.micros("o_orderdate"))


@query("next_ids", "SELECT c_mktsegment, max(c_custkey) + 1 AS next_id FROM customer GROUP BY 1")
def next_ids(spark, sf_dir):
    return rollup.next_ids(table(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey")


@query("trash_union", "SELECT c_custkey AS key, c_name AS name, 'world' AS kind FROM customer WHERE c_acctbal < 0 UNION ALL SELECT s_suppkey, s_name, 'snapshot' FROM supplier WHERE s_acctbal < 0")
def trash_union(spark, sf_dir):
    c = table(spark, sf_dir, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    s = table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return rollup.tagged_union(world=c, snapshot=s)


@query("trash_classes", "SELECT event_id AS key, CASE WHEN c.c_custkey IS NULL THEN 'orphan' WHEN event_type = 'error' THEN 'deleting' WHEN epoch_us(ts) <= 1704067200000000 + 43200000000 - 86400000000 THEN 'due' ELSE 'waiting' END AS class FROM events LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0) c ON c.c_custkey = event_id")
def trash_classes(spark, sf_dir):
    trash = table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), derived.micros("ts").alias("trashed_at"), F.when(F.col("event_type") == "error", "deleting").otherwise("idle").alias("state"))
    known = table(spark, sf_dir, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("key"))
    return rollup.trash_classes(trash, known, 1704067200000000 + 43200000000, 86400000000)


@query("retention_due", "SELECT o_orderkey FROM orders WHERE epoch_us(o_orderdate) <= (SELECT max(epoch_us(o_orderdate)) FROM orders) - 31536000000000")
def retention_due(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", derived.micros("o_orderdate").alias("at"))
    now = orders.agg(F.max("at").alias("now"))
    return rollup.retention_due(orders.join(F.broadcast(now)), F.col("at"), F.col("now"), F.lit(31_536_000_000_000)).select("o_orderkey")


@query("hardlink_groups", "SELECT p_brand, p_size, array_to_string(list(p_name ORDER BY p_name), ',') AS names, count(*) AS n, count(*) < max(1 + p_partkey % 7) AS external FROM part GROUP BY 1, 2")
def hardlink_groups(spark, sf_dir):
    parts = table(spark, sf_dir, "part").withColumn("links", 1 + F.col("p_partkey") % 7)
    return rollup.hardlink_groups(parts, ["p_brand", "p_size"], "p_name", "links").select("p_brand", "p_size", F.array_join("names", ",").alias("names"), "n", "external")


@query("percentile_guarded", "SELECT l_returnflag, l_linestatus, count(l_quantity) AS n, quantile_disc(l_quantity, 0.5) AS p50, CASE WHEN count(l_quantity) >= 1000 THEN quantile_disc(l_quantity, 0.95) END AS p95 FROM lineitem GROUP BY 1, 2")
def percentile_guarded(spark, sf_dir):
    return rollup.guarded_percentiles(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")


@query("coverage", "SELECT event_type AS family, array_to_string(list(DISTINCT CAST(user_id AS VARCHAR) ORDER BY CAST(user_id AS VARCHAR)), ',') AS cases, array_to_string(list(DISTINCT CAST(event_id % 3 AS VARCHAR) ORDER BY CAST(event_id % 3 AS VARCHAR)), ',') AS layers FROM events GROUP BY 1")
def coverage(spark, sf_dir):
    cases = table(spark, sf_dir, "events").select(F.col("event_type").alias("family"), F.col("user_id").cast("string").alias("case_id"), (F.col("event_id") % 3).cast("string").alias("layer"))
    return rollup.coverage(cases).select("family", F.array_join("cases", ",").alias("cases"), F.array_join("layers", ",").alias("layers"))


# ---------------------------------------------------------------- intervals

_I = "(SELECT user_id AS inode_id, event_id AS handle, epoch_us(ts) AS s, epoch_us(ts) + (event_id % 600) * 1000000 AS e, CASE WHEN event_id % 4 = 0 THEN 'exclusive' ELSE 'shared' END AS mode FROM events WHERE event_id % 600 > 0)"


@query("lock_conflicts", f"SELECT a.inode_id, a.handle AS a, b.handle AS b FROM {_I} a JOIN {_I} b ON a.inode_id = b.inode_id AND a.handle < b.handle AND a.s < b.e AND b.s < a.e AND (a.mode = 'exclusive' OR b.mode = 'exclusive')")
def lock_conflicts(spark, sf_dir):
    return intervals.conflicts(derived.locks(spark, sf_dir))


@query("lock_coalesce", f"""WITH i AS {_I}, m AS (SELECT *, max(e) OVER (PARTITION BY inode_id, mode ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM i), g AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END) OVER (PARTITION BY inode_id, mode ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT inode_id, mode, min(s) AS start, max(e) AS "end", count(*) AS n FROM g GROUP BY inode_id, mode, k""")
def lock_coalesce(spark, sf_dir):
    return intervals.coalesce(derived.locks(spark, sf_dir), ["inode_id", "mode"])


@query("lease_sessions", "WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events), g AS (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS p FROM e), s AS (SELECT *, sum(CASE WHEN p IS NULL OR t - p >= 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM g) SELECT user_id, session, min(t) AS started, max(t) AS last_seen, count(*) AS n, max(t) + 21600000000 AS deadline FROM s GROUP BY user_id, session")
def lease_sessions(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", derived.micros("ts").alias("at"))
    return intervals.leases(events, "user_id", "at", "event_id", 21_600_000_000)


# ---------------------------------------------------------------- audits


@query("link_count_audit", "WITH n AS (SELECT 'r' || r_regionkey AS inode_id, (2 + count(n_nationkey))::BIGINT AS expected, 7::BIGINT AS links FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1 UNION ALL SELECT 'n' || n_nationkey, 2, 2 FROM nation UNION ALL SELECT 'c' || c_custkey, 1, CASE WHEN c_custkey % 10 = 0 THEN 2 ELSE 1 END FROM customer) SELECT inode_id, links, expected FROM n WHERE links <> expected")
def link_count_audit(spark, sf_dir):
    return audit.link_counts(derived.place_inodes(spark, sf_dir), derived.places(spark, sf_dir))


@query("unmatched_keys", f"SELECT key, 'unexpected' AS problem FROM {AFTER} WHERE key NOT IN (SELECT key FROM {BEFORE}) UNION ALL SELECT key, 'missing' FROM {BEFORE} WHERE key NOT IN (SELECT key FROM {AFTER})")
def unmatched_keys(spark, sf_dir):
    return audit.unmatched(derived.after(spark, sf_dir), derived.before(spark, sf_dir), "key")


@query("multiset_difference", "SELECT nation, sum(n)::BIGINT AS surplus FROM (SELECT c_nationkey AS nation, 1 AS n FROM customer UNION ALL SELECT s_nationkey, -1 FROM supplier) GROUP BY 1 HAVING sum(n) <> 0")
def multiset_difference(spark, sf_dir):
    return audit.multiset_difference(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation")))


@query("order_violations", "SELECT user_id, event_id, previous FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY value, event_id) AS previous FROM events) WHERE previous >= event_id")
def order_violations(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.struct("value", "event_id").alias("at"))
    return audit.order_violations(rows, "user_id", "at", "event_id").select("user_id", "event_id", "previous")


@query("sequence_gaps", "SELECT * FROM (SELECT l_orderkey, l_linenumber AS seq, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS previous FROM (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey % 5 <> 0)) WHERE previous + 1 <> seq")
def sequence_gaps(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").filter("l_partkey % 5 <> 0").select("l_orderkey", F.col("l_linenumber").alias("seq"))
    return audit.sequence_gaps(rows, "l_orderkey")


@query("chain_violations", "WITH c AS (SELECT o_custkey, row_number() OVER w AS seq, md5(CAST(o_orderkey AS VARCHAR)) AS hash, CASE WHEN o_orderkey % 9 = 0 THEN 'broken' ELSE lag(md5(CAST(o_orderkey AS VARCHAR))) OVER w END AS previous_hash FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) SELECT o_custkey, seq, previous_hash, expected FROM (SELECT *, lag(hash) OVER (PARTITION BY o_custkey ORDER BY seq) AS expected FROM c) WHERE expected IS NOT NULL AND previous_hash IS DISTINCT FROM expected")
def chain_violations(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    h = F.md5(F.col("o_orderkey").cast("string"))
    commits = table(spark, sf_dir, "orders").select("o_custkey", F.row_number().over(w).alias("seq"), h.alias("hash"), F.when(F.col("o_orderkey") % 9 == 0, F.lit("broken")).otherwise(F.lag(h).over(w)).alias("previous_hash"))
    return audit.chain_violations(commits, "o_custkey").select("o_custkey", "seq", "previous_hash", "expected")


@query("snapshot_verify", f"SELECT count(*) FILTER (t.key IS NULL) AS missing, count(*) FILTER (m.key IS NOT NULL AND t.key IS NOT NULL AND m.oid <> t.oid) AS modified, count(*) FILTER (m.key IS NOT NULL AND t.key IS NOT NULL AND key % 3 = 0) AS unprotected, count(*) FILTER (m.key IS NULL) AS extra FROM {BEFORE} m FULL JOIN {AFTER} t USING (key)")
def snapshot_verify(spark, sf_dir):
    tree = derived.after(spark, sf_dir).select(F.col("key").alias("path"), "oid", (F.col("key") % 3 != 0).alias("locked"))
    return audit.snapshot_counts(derived.before(spark, sf_dir).select(F.col("key").alias("path"), "oid"), tree)


# ---------------------------------------------------------------- scalars


@query("scalar_paths", r"WITH p AS (SELECT page_id, '/' || regexp_extract(url, '^[a-z]+://([^?#]*)', 1) AS path FROM pages) SELECT page_id, array_to_string(list_filter(string_split(path, '/'), lambda x: x <> ''), '|') || CASE WHEN ends_with(path, '/') THEN '|.' ELSE '' END AS parts, strlen(path) <= 4096 AS valid, CASE WHEN regexp_matches(path, '^/[^/]*$') THEN '/' ELSE regexp_replace(path, '/[^/]*$', '') END AS dir, list_contains(string_split(path, '/'), 'en') AS excluded FROM p")
def scalar_paths(spark, sf_dir):
    path = F.concat(F.lit("/"), F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1))
    p = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return p.select("page_id", F.array_join(scalars.path_parts(F.col("path")), "|").alias("parts"), scalars.valid_path(F.col("path")).alias("valid"), scalars.dirname(F.col("path")).alias("dir"), scalars.excluded(F.col("path"), ["en"]).alias("excluded"))


@query("scalar_numbers", "SELECT o_orderkey, (o_orderkey + 511) // 512 * 512 AS rounded, CASE WHEN o_orderkey < 1024 THEN lpad(CAST(o_orderkey AS VARCHAR), 4, '0') ELSE 'x' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') END AS chunk, o_orderkey & 73 <> 0 AS flagged, o_orderkey * 308 AS estimate, sha256('priority:' || CAST(o_orderkey AS VARCHAR)) AS priority FROM orders")
def scalar_numbers(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.ceil_512(k).alias("rounded"), scalars.chunk_key(k).alias("chunk"), scalars.has_flag(k, 73).alias("flagged"), scalars.estimate_bytes(k).alias("estimate"), scalars.priority(k.cast("string")).alias("priority"))


#: Each byte is followed by eight marks, one for each step of the division.
_CRC32C = """
WITH b AS (SELECT doc_id, text, hex(encode(text)) AS h FROM documents)
SELECT doc_id, CASE WHEN text IS NOT NULL THEN xor(list_reduce(list_concat([4294967295::BIGINT], flatten([[CAST('0x' || substr(h, 2 * i - 1, 2) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] FOR i IN range(1, length(h) // 2 + 1)])),
  lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) WHEN c & 1 = 1 THEN xor(c >> 1, 2197175160) ELSE c >> 1 END), 4294967295) END AS crc32c FROM b"""


@query("scalar_bytes", _CRC32C)
def scalar_bytes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scalars.crc32c(F.col("text").cast("binary")).alias("crc32c"))


@query("scalar_text", "SELECT doc_id, lower(hex(encode(text[1:4]))) AS head, strlen(text) BETWEEN 1 AND 255 AND NOT contains(text, '/') AND text NOT IN ('.', '..') AS valid_name FROM documents")
def scalar_text(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", scalars.hex_lower(F.substring(t, 1, 4).cast("binary")).alias("head"), scalars.valid_name(t).alias("valid_name"))


# ---------------------------------------------------------------- handles and status


@query("open_counts", "SELECT user_id % 5 AS view, user_id AS inode_id, count(*) AS n FROM events GROUP BY 1, 2")
def open_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("view"), F.col("user_id").alias("inode_id"))
    return handles.open_counts(rows)


@query("foreign_handles", "SELECT o_orderkey AS handle, o_custkey % 100 AS session FROM orders LEFT JOIN events ON event_id = o_orderkey WHERE (user_id % 100) IS DISTINCT FROM (o_custkey % 100)")
def foreign_handles(spark, sf_dir):
    asked = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("handle"), (F.col("o_custkey") % 100).alias("session"))
    owned = table(spark, sf_dir, "events").select(F.col("event_id").alias("handle"), (F.col("user_id") % 100).alias("session"))
    return handles.foreign(asked, owned).select("handle", "session")


@query("shared_views", "SELECT c_nationkey AS view, count(DISTINCT c_mktsegment) AS sessions FROM customer GROUP BY 1 HAVING count(DISTINCT c_mktsegment) > 1")
def shared_views(spark, sf_dir):
    return handles.shared_views(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("view"), F.col("c_mktsegment").alias("session")))


@query("pool_freshness", "SELECT o_orderkey AS id, CASE WHEN c_custkey IS NULL THEN 'lost' WHEN c_nationkey = o_orderkey % 25 THEN 'fresh' ELSE 'stale' END AS state FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 4 <> 0) c ON c_custkey = o_custkey")
def pool_freshness(spark, sf_dir):
    pool = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("snapshot_id"), (F.col("o_orderkey") % 25).alias("generation"))
    snapshots = table(spark, sf_dir, "customer").filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("snapshot_id"), F.col("c_nationkey").alias("generation"))
    return handles.pool_freshness(pool, snapshots).select("id", "state")


@query("service_status", "SELECT count(*) AS objects, sum(strlen(text))::BIGINT AS bytes, max(strlen(text))::BIGINT AS largest, (SELECT count(*) FROM customer) AS roots FROM documents")
def service_status(spark, sf_dir):
    return handles.service_status(table(spark, sf_dir, "documents"), table(spark, sf_dir, "customer"), F.octet_length("text"))


@query("xattr_names", "SELECT user_id AS inode_id, array_to_string(list(event_type ORDER BY event_type), ',') AS names FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1")
def xattr_names(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("inode_id"), F.col("event_type").alias("name")).distinct()
    return handles.xattr_names(rows).select("inode_id", F.array_join("names", ",").alias("names"))
