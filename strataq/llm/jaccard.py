"""Jaccard self-join on word shingles by a grouped prefix join.

Shingles are ordered by their document frequency, rarest first. Two sets that are similar
enough share a shingle among the first few of each, the prefix. Documents with equal sets
become one set, and sets with equal size and prefix become one group. Groups that share a
prefix shingle and whose sizes allow it are candidates; candidates are expanded to their
sets, and every pair of sets within a component of candidates is verified by exact intersection sizes, except where both
are already known to be connected. Frequencies come from a packed exchange in which each
block of documents sends a shingle once; a set of which under three quarters of the shingles
occur anywhere else is done at that point.

Defined results: a null or empty text has no shingles and no links; under ``SIZE`` words, the
whole sequence is one shingle; repeated rows are linked copies; a null ``doc_id`` takes no
part and gets a null component; an empty table gives an empty result; only ``doc_id`` and
``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataq.llm.common import checkpointed, stored
from strataq.llm.components import components
from strataq.llm.windows import BASES, ascending, by_block, cell_table, cells, exchange, mixed, numbers, received, window_hashes, word_hashes

SIZE = 5
#: A pair links when ``100 * intersection >= PERCENT * union``.
PERCENT = 75
#: Sets on one side of a verification task.
CHUNK = 512
#: Sets of small candidate components that are verified by one task.
BATCH = 2_000

SETS = "block int, s1 long, s2 long, n long, members array<long>, tokens binary, prefix array<long>, g long"


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all shingles of one document, with repeats."""
    if len(words) >= size:
        return window_hashes(words, size)
    if not len(words):
        return words
    return window_hashes(words, len(words)) ^ np.uint64(len(words))


class _Block:
    """The distinct shingle sets of a block's documents."""

    def __init__(self, table: pa.Table, size: int, n_buckets: int):
        self.n_buckets = n_buckets
        ids, each = [], []
        self.nulls = 0
        for i, text in zip(table["doc_id"].to_pylist(), table["text"], strict=True):
            ids.append(i)
            each.append(np.unique(shingles(word_hashes(text.as_py(), lower=True), size)))
        sums = [(len(x), int(mixed(x).sum(dtype=np.uint64)), int(mixed(x ^ np.uint64(BASES[1])).sum(dtype=np.uint64))) for x in each]
        found: dict[tuple, int] = {}
        self.members: list[list] = []
        self.sets: list[np.ndarray] = []
        self.keys: list[tuple] = []
        for i, x, key in zip(ids, each, sums, strict=True):
            key = key if i is not None and key[0] else (*key, len(self.sets))  # without shingles or id: alone
            if key not in found:
                found[key] = len(self.sets)
                self.sets.append(x if i is not None else x[:0])
                self.members.append([])
                self.keys.append(key)
            self.members[found[key]].append(i)

    def _all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = np.concatenate(self.sets) if self.sets else np.empty(0, np.uint64)
        of = np.repeat(np.arange(len(self.sets)), [len(x) for x in self.sets])
        return h, of, (_bucket(h, self.n_buckets) << 32) | (h & np.uint64(0xFFFFFFFF)).astype(np.int64)

    def send(self, block: int) -> Iterator[tuple[int, int, bytes]]:
        """Each distinct shingle once, as 32 bits within its bucket, and in how many sets (255 at most) it is."""
        key, count = np.unique(self._all()[2], return_counts=True)
        value, count = (key & 0xFFFFFFFF).astype(np.uint32), np.minimum(count, 255).astype(np.uint8)
        return cells(block, key >> 32, self.n_buckets, lambda s: ascending(value[s]) + count[s].tobytes(), np.arange(len(key)))

    def rows(self, block: int, answers: list[tuple[int, bytes]]) -> pa.Table:
        """A row for each set; ``tokens`` (rarest first) and ``prefix`` only where a similar set is possible."""
        parts = []
        for bucket, raw in answers:
            n = len(raw) // 6
            parts.append((numbers(raw, n).astype(np.int64) | (bucket << 32), np.frombuffer(raw, np.uint16, n, 4 * n)))
        known = np.concatenate([p[0] for p in parts]) if parts else np.empty(0, np.int64)
        often = np.concatenate([p[1] for p in parts]) if parts else np.empty(0, np.uint16)
        order = np.argsort(known)
        known, often = known[order], often[order]
        h, of, key = self._all()
        at = np.minimum(np.searchsorted(known, key), max(len(known) - 1, 0))
        shared = (known[at] == key) if len(known) else np.zeros(len(key), bool)
        h, of, df = h[shared], of[shared], often[at[shared]] if len(known) else often
        order = np.lexsort((h, df, of))
        h, of = h[order], of[order]
        edges = np.searchsorted(of, np.arange(len(self.sets) + 1))
        out: list[tuple] = []
        for i, (members, key) in enumerate(zip(self.members, self.keys, strict=True)):
            n, s1, s2 = key[:3]
            tokens = h[edges[i] : edges[i + 1]]
            need = -(-PERCENT * n // 100)
            head = tokens[: len(tokens) - need + 1] if n and len(tokens) >= need else None
            alike = n and members[0] is not None
            signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
            if head is None:
                out.append((block, signed(s1) if alike else None, signed(s2), n, members, None, None, None))
            else:
                g = int(window_hashes(np.concatenate([[np.uint64(n)], head]), len(head) + 1)[0])
                out.append((block, signed(s1), signed(s2), n, members, tokens.tobytes(), head.view(np.int64), signed(g)))
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int64()), pa.int64()]
        return pa.table([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=[x.split()[0] for x in SETS.split(", ")])


def _frequencies(table: pa.Table) -> pa.Table:
    """To each block, those of its shingles that occur in two sets or more, and in how many (65,535 at most)."""
    parts = []
    for data in table["data"]:
        raw = data.as_py()
        n = len(raw) // 5
        parts.append((numbers(raw, n), np.frombuffer(raw, np.uint8, n, 4 * n)))
    value, count = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(value, kind="stable")
    new = np.flatnonzero(np.concatenate([[True], np.diff(value[order]) != 0]))
    total = np.add.reduceat(count[order].astype(np.int64), new)
    df = np.empty(len(value), np.int64)
    df[order] = np.repeat(total, np.diff(np.concatenate([new, [len(value)]])))
    edges = np.cumsum([0, *(len(p[0]) for p in parts)])
    bucket, out = table["bucket"][0].as_py(), []
    for i, block in enumerate(table["block"].to_pylist()):
        v, d = value[edges[i] : edges[i + 1]], df[edges[i] : edges[i + 1]]
        keep = d > 1
        if keep.any():
            out.append((bucket, block, ascending(v[keep]) + np.minimum(d[keep], 65535).astype(np.uint16).tobytes()))
    return cell_table(out)


def shingle_sets(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """The distinct shingle sets of each block, with the frequencies applied (columns ``SETS``)."""
    blocks, n = by_block(docs, "doc_id", "text")

    def first(key, table):
        return cell_table(_Block(table, size, n).send(key[0].as_py()))

    def second(key, table, answers):
        return _Block(table, size, n).rows(key[0].as_py() if table.num_rows else 0, received(answers))

    answers = exchange(blocks.groupBy("block").applyInArrow, first, _frequencies, n)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(second, SETS)


def intersections(left: list[np.ndarray], right: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """Exact intersection sizes of every left with every right set, by products of 0/1 matrices."""
    both = np.concatenate([*left, *right])
    row = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    _, column = np.unique(both, return_inverse=True)
    on_left = row < len(left)
    common = (np.bincount(column[on_left], minlength=column.max(initial=-1) + 1) > 0) & (np.bincount(column[~on_left], minlength=column.max(initial=-1) + 1) > 0)
    keep = common[column]
    row, column = row[keep], (np.cumsum(common) - 1)[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(common.sum()), columns):
        part = slice(*np.searchsorted(column, [start, start + columns]))
        m = np.zeros((len(left) + len(right), columns), np.float32)
        m[row[part], column[part] - start] = 1
        out += m[: len(left)] @ m[len(left) :].T
    return out.astype(np.int64)


def _forest(ids: np.ndarray, n: np.ndarray, tokens: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links (set, representative) that connect what the verified pairs of left and right sets connect."""
    size = intersections([tokens[i] for i in left], [tokens[i] for i in right])
    link = 100 * size >= PERCENT * (n[left][:, None] + n[right][None, :] - size)
    label, far = np.arange(len(ids)), len(ids)
    while True:
        before = label.copy()
        np.minimum.at(label, left, np.where(link, label[right][None, :], far).min(1, initial=far))
        np.minimum.at(label, right, np.where(link, label[left][:, None], far).min(0, initial=far))
        if (label == before).all():
            break
    for i in np.flatnonzero(label != np.arange(len(ids))):
        yield int(ids[i]), int(ids[label[i]])


def _verify(table: pa.Table) -> pa.Table:
    """One task: the components (or pairs of chunks) of one unit; ``side`` 0 is left, 1 right, 2 both."""
    where = table["where"].to_numpy()
    ids, n, side = (table[c].to_numpy() for c in ("id", "n", "side"))
    tokens = [np.frombuffer(x.as_py(), np.uint64) for x in table["tokens"]]
    order, out = np.argsort(where, kind="stable"), []
    edges = np.flatnonzero(np.concatenate([[True], np.diff(where[order]) != 0, [True]]))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        rows = order[a:b]
        if len(rows) > 1:
            s = side[rows]
            left, right = np.flatnonzero(s != 1), np.flatnonzero(s != 0)
            if len(left) and len(right):
                out.extend(_forest(ids[rows], n[rows], [tokens[i] for i in rows], left, right))
    return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})


def _units(rows: DataFrame) -> DataFrame:
    """Verify all units; ``rows`` has unit, where, side, id, n, tokens."""
    return rows.select("unit", "where", "side", "id", "n", "tokens").groupBy("unit").applyInArrow(_verify, "a long, b long")


def _pair(*of: str):
    return F.xxhash64(*of)


#: What tells two sets apart: two sums of hashes and the number of shingles.
SET = ["s1", "s2", "n"]
#: What finds the shingles of a set: one of the blocks that hold it.
KEY = [*SET, "block"]


def named(sets: DataFrame) -> DataFrame:
    """The distinct sets (``SET``), one of the blocks that hold each, its group, and its smallest document as ``id``."""
    rows = sets.filter("s1 IS NOT NULL").groupBy(*SET).agg(F.min("block").alias("block"), F.first("g").alias("g"), F.min(F.array_min("members")).alias("id"))
    return rows.coalesce(_scans(sets))


def _scans(df: DataFrame) -> int:
    """Tasks that read a stored table, which follow its size. No more are needed for what is smaller, however many shuffle partitions there are: tasks take the driver's memory."""
    return max(1, df.rdd.getNumPartitions())


def candidate_links(sets: DataFrame, names: DataFrame) -> DataFrame:
    """Links (a, b) that hold all sets together which can be similar.

    Sets of one group hang on its smallest. Groups that share a prefix shingle can only be
    similar if the smaller one has three quarters of the larger one's shingles, so their
    sizes fall into the same class or the next one: in a class all hang on its smallest
    group, and neighbouring classes are linked. A shingle without a class between two sizes
    does not link them.
    """
    groups = sets.filter("tokens IS NOT NULL").groupBy("g").agg(F.min(F.array_min("members")).alias("id"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    # Looked up four times; their prefixes are too long to be shuffled for each.
    groups = checkpointed(groups.coalesce(_scans(sets)))
    same = names.filter("g IS NOT NULL").join(groups.select("g", F.col("id").alias("rep")), "g").filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / PERCENT)) + 1e-9)
    # The joins below ask for keys that are not null; asked for here, the least ids are exchanged once for both.
    postings = groups.select("id", size.alias("size"), F.explode("prefix").alias("t")).filter("t IS NOT NULL AND size IS NOT NULL")
    least = postings.groupBy("t", "size").agg(F.min("id").alias("m"))
    inside = postings.join(least, ["t", "size"]).filter("id <> m").select(F.col("id").alias("a"), F.col("m").alias("b"))
    # A shingle has a row for each size class, of which there are few.
    above = Window.partitionBy("t").orderBy("size")
    across = least.select("size", F.lead("size").over(above).alias("next"), F.lead("m").over(above).alias("a"), F.col("m").alias("b")).filter("next = size + 1").select("a", "b")
    return same.unionByName(inside).unionByName(across).distinct()


def links(sets: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs (a, b) of ids of sets that connect all sets connected by links; ``sets`` is what ``shingle_sets`` gives, stored, and ``names`` its ``named``."""
    candidates = checkpointed(components(candidate_links(sets, names)).withColumnRenamed("node", "id"))
    total = candidates.count()
    if not total:
        return candidates.select(F.col("id").alias("a"), F.col("component").alias("b"))
    batches = max(1, total // BATCH)
    # By no more tasks than there are batches, as ids are few beside the texts.
    sizes = candidates.groupBy("component").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("k")).coalesce(batches)
    placed = candidates.join(sizes, "component").join(names.select("id", *KEY), "id").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    # Most sets are no candidates, so the shingles of all of them are shuffled once, and those of candidates are written for what follows.
    bodies = sets.filter("tokens IS NOT NULL").select(*KEY, "tokens").join(checkpointed(placed.coalesce(batches)), KEY)
    bodies = stored(bodies.select("id", "component", "k", "chunk", "n", "tokens").coalesce(_scans(sets)), "candidate-sets")
    body = ["id", "n", "tokens"]
    small = bodies.filter("k = 1").select(*body, F.col("component").alias("where"), F.lit(2).alias("side"), F.pmod(F.xxhash64("component"), F.lit(batches)).alias("unit"))
    big = bodies.filter("k > 1")
    # Large components: everything against one chunk first, which connects nearly all of a group of copies.
    one = big.select(*body, "component", "chunk", F.when(F.col("chunk") == 0, F.sequence(F.lit(0), F.col("k") - 1)).otherwise(F.array("chunk")).alias("to"))
    one = one.select(*body, "component", "chunk", F.explode("to").alias("j"))
    one = one.select(*body, _pair("component", "j").alias("where"), F.when(F.col("chunk") > 0, 1).when(F.col("j") == 0, 2).otherwise(0).alias("side"), _pair("component", "j").alias("unit"))
    found = checkpointed(_units(small.unionByName(one)))
    if big.isEmpty():
        return found
    # Then what is left outside the largest part, against everything.
    label = components(found).withColumnRenamed("node", "id").withColumnRenamed("component", "label")
    parts = big.select("id", "component", "k", "chunk").join(label, "id", "left").withColumn("label", F.coalesce("label", "id")).coalesce(batches)
    main = parts.groupBy("component", "label").count().coalesce(batches).groupBy("component").agg(F.max_by("label", F.struct("count", "label")).alias("main")).coalesce(batches)
    parts = checkpointed(parts.join(main, "component").withColumn("rest", F.col("label") != F.col("main")).coalesce(batches))
    if parts.filter("rest").isEmpty():
        return found
    left = parts.filter("rest").groupBy("component").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("kl")).coalesce(batches)
    parts = parts.join(left, "component").withColumn("part", F.pmod(F.xxhash64("id"), F.col("kl")).cast("int"))
    a = parts.filter("rest").select("id", "component", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j"), F.col("part").alias("i"), F.lit(0).alias("side"))
    b = parts.select("id", "component", F.col("chunk").alias("j"), F.explode(F.sequence(F.lit(0), F.col("kl") - 1)).alias("i"), F.lit(1).alias("side"))
    key = _pair("component", "i", "j")
    rest = a.unionByName(b).select("id", key.alias("where"), "side", key.alias("unit"))
    return found.unionByName(_units(rest.join(big.select(*body), "id")))


def classes(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` (smallest doc_id reachable by links) for each row of ``docs``."""
    sets = stored(shingle_sets(docs, size), "shingle-sets")
    names = checkpointed(named(sets))
    label = components(links(sets, names)).select(F.col("node").alias("id"), "component")
    alone = sets.filter("s1 IS NULL").select(F.explode("members").alias("doc_id"), F.col("n").alias("n_shingles")).withColumn("component_id", F.col("doc_id"))
    # A set's id is its smallest document, and a component's the smallest id.
    found = names.join(label, "id", "left").select(*SET, F.coalesce("component", "id").alias("component_id")).coalesce(_scans(names))
    linked = sets.filter("s1 IS NOT NULL").select(*SET, "members").join(found, SET).select(F.explode("members").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(alone.select("doc_id", "n_shingles", "component_id"))


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the ``op8_jaccard_join`` query."""
    return classes(docs)


SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {SIZE} THEN [array_to_string(w, ' ')] ELSE [array_to_string(w[i:i + {SIZE - 1}], ' ') FOR i IN range(1, len(w) - {SIZE - 2})] END) AS x FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
m AS (SELECT s.doc_id, hash(x) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM m a JOIN m b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= {PERCENT} * (x.n + y.n - i)),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.c)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id
"""
