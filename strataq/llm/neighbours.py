"""Approximate nearest neighbours by stable projections and a kd-tree.

The largest inner product is turned into the smallest distance by one further coordinate, for
vectors of about one norm at a time: a band's norms differ by a factor of the square root of
two, so one very long vector does not blur the distances among all others. Vectors are
projected to ``DIMENSIONS`` coordinates with Gaussian (2-stable) weights; the squared
projected distance over the squared distance is then chi-square distributed.

A kd-tree over the projections, whose upper part is fitted on a bounded sample, deals all
vectors into parts. A query first asks its nearest part; the score of the last of its
neighbours there gives the radius beyond which, by the chi-square test, a better vector would
have shown up with probability ``CONFIDENCE``, and only the parts within that radius are asked
too. In a part, the tree goes on to leaves of ``LEAF`` vectors; projected neighbours in
growing distance are verified on the original vectors, until the test holds.

Equal vectors are one point with its ``k + 1`` smallest ids, and are asked once, which is
exact as ties go to the smaller id: a vector that a third of all rows hold is no hot key.

Defined results: vectors that are null or zero, or hold null or non-finite components, or
have another length than most, take no part; fewer candidates than ``k`` give fewer rows;
ties go to the smaller id. Rows that share an id are candidates each by themselves; a query's
own row, which is left out, is one row with its id and its vector, and equal queries are
answered once for each id. An empty table gives an empty result; only ``vec_id`` and
``embedding`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataq.llm.common import stored

K = 20
DIMENSIONS = 16
CONFIDENCE = 0.95
LEAF = 64
#: Vectors in a part, and queries that one task asks it.
PART_VECTORS = 8_192
PART_QUERIES = 4_096
#: Vectors on which the upper part of the tree is fitted, about, and its leaves at most; larger leaves are dealt into several parts.
SAMPLE = 20_000
TOP_LEAVES = 4_096
#: Projected neighbours that are verified at first; then twice as many each time.
STEP = 64
SEED = 20_240_601


def chi_square(x: np.ndarray | float, dimensions: int = DIMENSIONS) -> np.ndarray | float:
    """The cumulative distribution, for an even number of dimensions."""
    half, term, total = np.asarray(x) / 2, 1.0, 1.0
    for j in range(1, dimensions // 2):
        term = term * half / j
        total = total + term
    return 1 - np.exp(-half) * total


def quantile(confidence: float = CONFIDENCE, dimensions: int = DIMENSIONS) -> float:
    """Where the cumulative distribution reaches ``confidence``, by halving."""
    low, high = 0.0, 40.0 * dimensions
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, dimensions) < confidence else (low, middle)
    return high


def projection(dimension: int) -> np.ndarray:
    """Gaussian weights; each coordinate's are scaled to their expected length, so that one which all differences share (the further one) is not kept too long or too short for all."""
    a = np.random.default_rng(SEED).normal(size=(dimension + 1, DIMENSIONS))
    return a * np.sqrt(DIMENSIONS / (a * a).sum(1))[:, None]


def lifted(vectors: np.ndarray, radius2: np.ndarray | float) -> np.ndarray:
    """Projections of vectors with the further coordinate that gives all of a band one norm."""
    a = projection(vectors.shape[1])
    return vectors @ a[:-1] + np.sqrt(np.maximum(radius2 - (vectors * vectors).sum(1), 0))[:, None] * a[-1]


def band_of(norm2):
    """The band of a squared norm, between powers of two and a half, so that vectors of norm one share a band."""
    return F.ceil(F.log2(norm2) - 0.5).cast("int")


class KdTree:
    """Leaves of at most ``leaf`` points, split at the median of the widest coordinate, with their bounding boxes; ``order`` lists the points leaf by leaf."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        leaves: list[np.ndarray] = []
        todo = [np.arange(len(points))] if len(points) else []
        while todo:
            rows = todo.pop()
            if len(rows) <= leaf:
                leaves.append(rows)
                continue
            widest = int(np.ptp(points[rows], axis=0).argmax())
            order = np.argpartition(points[rows, widest], len(rows) // 2)
            todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
        m = points.shape[1]
        self.order = np.concatenate(leaves) if leaves else np.empty(0, np.int64)
        self.sizes = np.array([len(x) for x in leaves], np.int64)
        self.low = np.array([points[x].min(0) for x in leaves]).reshape(-1, m)
        self.high = np.array([points[x].max(0) for x in leaves]).reshape(-1, m)

    def distances(self, query: np.ndarray) -> np.ndarray:
        """Squared projected distance to each leaf's box."""
        gap = np.maximum(np.maximum(self.low - query, query - self.high), 0)
        return (gap * gap).sum(1)


class Router:
    """The upper part of the tree: a cell of the projected space for each leaf, band by band."""

    def __init__(self, bands: dict[int, tuple[int, float]], sample: dict[int, np.ndarray]):
        """``bands``: vectors and largest squared norm by band; ``sample``: projections of some of them."""
        self.radius2 = {b: r for b, (_, r) in bands.items()}
        self.splits: dict[int, list[tuple[int, float, int, int]]] = {}
        band, low, high = [], [], []
        every = sum(n for n, _ in bands.values())
        for b in sorted(bands):
            points, n = sample.get(b, np.empty((0, DIMENSIONS))), bands[b][0]
            wanted = min(-(-n // PART_VECTORS), max(1, TOP_LEAVES * n // max(every, 1)), max(1, len(points) // 4))
            nodes: list[tuple[int, float, int, int]] = [(-1, 0.0, -1, -1)]
            todo = [(0, points, np.full(DIMENSIONS, -np.inf), np.full(DIMENSIONS, np.inf), wanted)]
            while todo:
                at, rows, lo, hi, leaves = todo.pop()
                widest = int(np.ptp(rows, axis=0).argmax()) if leaves > 1 else 0
                middle = float(np.median(rows[:, widest])) if leaves > 1 else 0.0
                left = rows[:, widest] < middle if leaves > 1 else None
                if leaves <= 1 or not left.any():
                    nodes[at] = (-1, 0.0, len(band), -1)
                    band.append(b)
                    low.append(lo)
                    high.append(hi)
                    continue
                nodes[at] = (widest, middle, len(nodes), len(nodes) + 1)
                nodes += [(-1, 0.0, -1, -1)] * 2
                hi_left, lo_right = hi.copy(), lo.copy()
                hi_left[widest] = lo_right[widest] = middle
                todo.append((len(nodes) - 2, rows[left], lo, hi_left, leaves // 2))
                todo.append((len(nodes) - 1, rows[~left], lo_right, hi, leaves - leaves // 2))
            self.splits[b] = nodes
        self.band, self.low, self.high = np.array(band), np.array(low).reshape(-1, DIMENSIONS), np.array(high).reshape(-1, DIMENSIONS)
        self.r2 = np.array([self.radius2[b] for b in band])
        self.counts = np.zeros(len(band), np.int64)

    def leaf_of(self, band: int, points: np.ndarray) -> np.ndarray:
        out = np.empty(len(points), np.int64)
        todo = [(0, np.arange(len(points)))]
        while todo:
            at, rows = todo.pop()
            axis, middle, left, right = self.splits[band][at]
            if axis < 0:
                out[rows] = left
            else:
                below = points[rows, axis] < middle
                todo += [(left, rows[below]), (right, rows[~below])]
        return out

    def distances(self, query: np.ndarray) -> np.ndarray:
        gap = np.maximum(np.maximum(self.low - query, query - self.high), 0)
        return (gap * gap).sum(1)

    def home(self, query: np.ndarray, k: int) -> int:
        """The leaf that promises the largest inner product, of those that hold ``k`` vectors if any does."""
        promise = self.distances(query) / DIMENSIONS - self.r2
        if (enough := self.counts >= k).any():
            promise[~enough] = np.inf
        return int(promise.argmin())

    def parts(self) -> np.ndarray:
        return np.maximum(-(-self.counts // PART_VECTORS), 1)

    def within(self, query: np.ndarray, q2: float, kth: float) -> np.ndarray:
        """Leaves in which a product above ``kth`` is still likely enough."""
        radius2 = np.maximum(self.r2 + q2 - 2 * kth, 0)
        possible = (kth <= 0) | (kth * kth <= self.r2 * q2 * (1 + 1e-9))
        return np.flatnonzero(possible & (self.distances(query) <= quantile() * radius2))


def search(vectors: np.ndarray, queries: np.ndarray, radius2: float, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The ``k`` best found in one part for each query: query row, vector row, inner product; and how many vectors were verified.

    ``kth`` is what each query has found elsewhere (minus infinity: nothing yet).
    """
    points = lifted(vectors, radius2)
    tree, stop, verified = KdTree(points), quantile(), 0
    points, vectors = points[tree.order], vectors[tree.order]
    norm2, asked = (points * points).sum(1), queries @ projection(queries.shape[1])[:-1]
    out_q, out_v, out_s = [], [], []
    for i, (q, p) in enumerate(zip(queries, asked, strict=True)):
        q2, best = float(q @ q), float(kth[i])
        limit = stop * max(radius2 + q2 - 2 * best, 0) * (1 + 1e-9) + 1e-9
        near = tree.distances(p) <= limit
        rows = np.flatnonzero(np.repeat(near, tree.sizes)) if not near.all() else np.arange(len(points))
        apart = norm2[rows] - 2 * (points[rows] @ p) + p @ p
        inside = apart <= limit
        rows, apart = rows[inside], apart[inside]
        found, score, at, step = np.empty(0, np.int64), np.empty(0), 0, STEP
        order = np.argsort(apart) if len(rows) > STEP else np.arange(len(rows))
        rows, apart = rows[order], apart[order]
        while at < len(rows) and apart[at] <= limit:
            some = rows[at : min(at + step, int(np.searchsorted(apart, limit, "right")))]
            verified += len(some)
            # A sum for each row by itself: equal vectors get equal scores.
            found, score = np.concatenate([found, some]), np.concatenate([score, np.einsum("ij,j->i", vectors[some], q)])
            if len(score) > k:
                keep = np.argpartition(-score, k - 1)[:k]
                found, score = found[keep], score[keep]
            if len(score) == k:
                best = max(best, float(score.min()))
                limit = min(limit, stop * max(radius2 + q2 - 2 * best, 0) * (1 + 1e-9) + 1e-9)
            at += len(some)
            step *= 2
        out_q.append(np.full(len(found), i))
        out_v.append(tree.order[found])
        out_s.append(score)
    join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.empty(0, kind)
    return join(out_q, np.int64), join(out_v, np.int64), join(out_s, np.float64), verified


def _matrix(column: pa.ChunkedArray | pa.Array, dimension: int) -> np.ndarray:
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    return np.concatenate([np.empty(0), *(c.flatten().to_numpy(zero_copy_only=False) for c in chunks)]).astype(np.float64).reshape(-1, dimension)


def valid(rows: DataFrame) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).filter(F.coalesce(finite, F.lit(False)) & F.exists("embedding", lambda x: x != 0))


RESULT = "query_id long, rank int, vec_id long, score double"


def nearest(rows: DataFrame, is_query, k: int = K) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` for the rows of (vec_id, embedding) that ``is_query`` selects, against all rows."""
    norm2 = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = valid(rows.select("vec_id", "embedding")).withColumn("norm2", norm2).filter("norm2 > 0 AND norm2 < double('infinity')")
    # A row for each length and band; there are at most about 2,000 bands of doubles.
    sizes = rows.groupBy(F.size("embedding").alias("d"), band_of(F.col("norm2")).alias("band")).agg(F.count("*").alias("n"), F.max("norm2").alias("r")).collect()
    if not sizes:
        return rows.sparkSession.createDataFrame([], RESULT)
    by_length: dict[int, int] = {}
    for r in sizes:
        by_length[r["d"]] = by_length.get(r["d"], 0) + r["n"]
    d = max(by_length, key=lambda x: (by_length[x], -x))
    rows = rows.filter(F.size("embedding") == d).select("vec_id", "embedding", "norm2", F.xxhash64("embedding").alias("h1"), F.xxhash64("embedding", F.lit(1)).alias("h2"))
    # Of equal vectors, those with the smallest ids: the limit is applied before the shuffle, too.
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))).filter(F.col("place") <= k + 1)
    points = stored(first.groupBy("h1", "h2").agg(F.first("embedding").alias("embedding"), F.first("norm2").alias("norm2"), F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("band", band_of(F.col("norm2"))), "points")
    bands = {r["band"]: (r["n"], r["r"]) for r in points.groupBy("band").agg(F.count("*").alias("n"), F.max("norm2").alias("r")).collect()}
    one_in = max(1, sum(n for n, _ in bands.values()) // SAMPLE)
    chosen = points.filter(F.pmod("h2", F.lit(one_in)) == 0).select("band", "embedding").toArrow()
    band, sample = chosen["band"].to_numpy(), _matrix(chosen["embedding"], d)
    router = Router(bands, {b: lifted(sample[band == b], r) for b, (_, r) in bands.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            band, v = batch["band"].to_numpy(), _matrix(batch["embedding"], d)
            leaf = np.empty(len(band), np.int64)
            for b in np.unique(band).tolist():
                leaf[band == b] = router.leaf_of(b, lifted(v[band == b], router.radius2[b]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], [*batch.schema.names, "leaf"])

    placed = stored(points.mapInArrow(place, "h1 long, h2 long, embedding array<float>, norm2 double, ids array<long>, band int, leaf long".replace("array<float>", points.schema["embedding"].dataType.simpleString())), "placed")
    for r in placed.groupBy("leaf").count().collect():  # at most ``TOP_LEAVES`` and one for each band
        router.counts[r["leaf"]] = r["count"]

    parts = router.parts()

    def asks(bounded: bool):
        """For each query the parts to ask: of its nearest leaf, or of all others within the radius of what it has found."""

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a = projection(d)[:-1]
            for batch in batches:
                v, at, leaf, part = _matrix(batch["embedding"], d), [], [], []
                for i, (q, p, kth) in enumerate(zip(v, v @ a, batch["kth"].to_pylist(), strict=True)):
                    home = router.home(p, k + 1)
                    for x in [home] if not bounded else router.within(p, float(q @ q), -np.inf if kth is None else kth).tolist():
                        if not bounded or x != home:
                            many = int(parts[x])
                            at += [i] * many
                            leaf += [x] * many
                            part += range(many)
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([batch[c].take(take) for c in ("h1", "h2", "embedding", "kth")] + [pa.array(leaf, pa.int64()), pa.array(part, pa.int64())], ["h1", "h2", "embedding", "kth", "leaf", "part"])

        return route

    kind = rows.schema["embedding"].dataType.simpleString()
    asked = stored(rows.filter(is_query).select("vec_id", "h1", "h2", "embedding").dropDuplicates(["vec_id", "h1", "h2"]), "queries")
    vectors = asked.dropDuplicates(["h1", "h2"]).select("h1", "h2", "embedding")
    radius2 = router.r2

    def task(key, left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({"h1": pa.array([], pa.int64()), "h2": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "same": pa.array([], pa.bool_())})
        kth = right["kth"].to_numpy(zero_copy_only=False).astype(float)
        q, v, s, _ = search(_matrix(left["embedding"], d), _matrix(right["embedding"], d), float(radius2[key[0].as_py()]), np.where(np.isnan(kth), -np.inf, kth), k + 1)
        ids = left["ids"].combine_chunks().take(pa.array(v))
        many = ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        at, same = pa.array(np.repeat(q, many)), np.ones(len(v), bool)
        for c in ("h1", "h2"):
            same &= left[c].to_numpy()[v] == right[c].to_numpy()[q]
        return pa.table({"h1": right["h1"].take(at), "h2": right["h2"].take(at), "vec_id": ids.flatten(), "score": np.repeat(s, many), "same": np.repeat(same, many)})

    def answers(bounded: bool, known: DataFrame) -> DataFrame:
        todo = known.mapInArrow(asks(bounded), f"h1 long, h2 long, embedding {kind}, kth double, leaf long, part long")
        todo = stored(todo, "asks")
        # A part that very many queries ask is given to several tasks.
        shares = todo.groupBy("leaf", "part").agg(F.ceil(F.count("*") / PART_QUERIES).cast("int").alias("shares"))
        dealt = todo.join(shares, ["leaf", "part"]).withColumn("share", F.pmod("h1", F.col("shares")).cast("int"))
        many = F.element_at(F.lit(parts.tolist()), (F.col("leaf") + 1).cast("int"))
        data = placed.withColumn("part", F.pmod("h1", many).cast("long")).join(shares, ["leaf", "part"]).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        key = ["leaf", "part", "share"]
        return data.select(*key, "h1", "h2", "embedding", "ids").groupBy(*key).cogroup(dealt.select(*key, "h1", "h2", "embedding", "kth").groupBy(*key)).applyInArrow(task, "h1 long, h2 long, vec_id long, score double, same boolean")

    best = Window.partitionBy("h1", "h2").orderBy(F.desc("score"), "vec_id")
    top = lambda found: found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1)
    near = stored(top(answers(False, vectors.withColumn("kth", F.lit(None).cast("double")))), "near")
    kth = near.filter(F.col("place") == k + 1).select("h1", "h2", F.col("score").alias("kth"))
    far = answers(True, vectors.join(kth, ["h1", "h2"], "left"))
    both = top(near.drop("place").unionByName(far))
    lists = both.groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score", "same"))).alias("found"))
    # The query's own row is left out: the first with its id and its vector, or else the one too many.
    own = F.array_position(F.transform("found", lambda x: F.when(x["same"], x["vec_id"])), F.col("vec_id"))
    others = F.filter("found", lambda x, i: i != F.when(F.col("own") > 0, F.col("own") - 1).otherwise(F.lit(k)))
    listed = asked.join(lists, ["h1", "h2"]).withColumn("own", own).select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("at", "x"))
    return listed.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def digest(rows: DataFrame) -> DataFrame:
    """The columns of the ``op3_nearest_neighbours`` query: queries are the rows whose id is divisible by 20."""
    return nearest(rows, F.col("vec_id") % 20 == 0)
