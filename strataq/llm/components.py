"""Connected components by alternating stars, without collecting links anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.llm.common import checkpointed


#: Links that one task joins by itself before the rounds (16 MB).
TASK_LINKS = 1_000_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union by the smaller node, over a bounded number of links in one task: for each node, itself too, the smallest of its part."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = up
        return x

    for batch in batches:
        for u, v in zip(batch["u"].to_pylist(), batch["v"].to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = np.fromiter(parent, np.int64, len(parent))
    tops = np.fromiter(map(root, list(parent)), np.int64, len(parent))
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(tops)], ["u", "v"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component`` (its smallest reachable node) for every node with a link to another one.

    Links are dealt into parts of ``TASK_LINKS``, and each part is first joined by itself,
    which leaves one link for each of its nodes; a single part is then done. Otherwise each
    round joins every node to its smallest neighbour, first from its larger neighbours and then
    from its smaller ones, until a round changes nothing; a node with very many links is
    pre-aggregated by the minimum before the shuffle. Rounds are checkpointed in the shared
    folder.
    """
    start = checkpointed(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    parts = max(1, -(-start.count() // TASK_LINKS))
    if parts == 1:
        return checkpointed(start.coalesce(1).mapInArrow(_joined, "u long, v long")).select(F.col("u").alias("node"), F.col("v").alias("component"))
    now = checkpointed(start.repartition(parts, "v").mapInArrow(_joined, "u long, v long").filter("u <> v").distinct())
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        now = checkpointed(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
