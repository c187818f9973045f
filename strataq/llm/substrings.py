"""Removal of repeated passages with difference-cover anchors.

A passage is a window of ``width`` consecutive words. Hashes of shorter anchors are taken
only at word positions whose remainder modulo ``PERIOD`` lies in a difference cover: for any
two positions there is one shift below the period that brings both into the cover, so two
equal windows always share an aligned anchor of ``width - PERIOD + 1`` words. Anchors that
occur in one document only rule out nearly all text; the others are extended to the full
windows around them, and 96-bit hashes of those windows tell which document has each first.

Defined results: a null text has no words; texts under ``width`` words lose nothing; rows
with equal ``doc_id`` do not count as copies of each other; a null ``doc_id`` neither removes
nor loses words; an empty table gives an empty result; further columns are kept as they are.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.llm.windows import BASES, ascending, by_block, cell_table, cells, exchange, from_planes, numbers, planes, received, window_hashes, word_hashes

WIDTH = 50
PERIOD = 31
#: A perfect difference set modulo 31.
COVER = (1, 5, 11, 24, 25, 27)

ADDED = ("n_words", "n_removed", "kept_sha256", "kept_text")
_ANCHORS, _WINDOWS = 0, 1
ANCHOR_BITS = 49


def _bucket(h: np.ndarray, n: int, bits: int = 64) -> np.ndarray:
    """Buckets are ranges of hashes of so many bits, so ascending hashes are in the order of their buckets."""
    return ((h >> np.uint64(bits - 32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


class _Block:
    """The words of a block's documents, one after the other."""

    def __init__(self, table: pa.Table, width: int, n_buckets: int):
        self.width, self.n_buckets = width, n_buckets
        ids = table["doc_id"].to_pylist()
        texts = table["text"]
        each = [word_hashes(t.as_py()) if i is not None else np.empty(0, np.uint64) for i, t in zip(ids, texts, strict=True)]
        sizes = np.array([len(x) for x in each], np.int64)
        self.words = np.concatenate(each) if each else np.empty(0, np.uint64)
        self.first = np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(np.int64)
        self.sizes = sizes
        of = np.repeat(np.arange(len(ids)), sizes)
        self.doc = np.array([-1 if i is None else i for i in ids], np.int64)[of] if len(of) else np.empty(0, np.int64)
        self.start, self.end = self.first[of], (self.first + sizes)[of]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions of anchors, and their hashes: 48 bits, above a lowest bit that is left free. Windows tell apart what shares one by chance."""
        size = self.width - PERIOD + 1
        cover = np.zeros(PERIOD, bool)
        cover[list(COVER)] = True
        at = np.arange(len(self.words))
        at = at[cover[(at - self.start) % PERIOD] & (at + size <= self.end)]
        # A document under ``width`` words has no window, so its anchors can't matter.
        at = at[(self.end - self.start)[at] >= self.width]
        return at, window_hashes(self.words, size)[at] >> np.uint64(16) << np.uint64(1)

    def send_anchors(self, block: int) -> Iterator[tuple[int, int, bytes]]:
        at, h = self.anchors()
        doc = self.doc[at]
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
        last = np.concatenate([new[1:], [len(h)]])[: len(new)] - 1
        # The lowest bit says that two documents of this block have it.
        keys = h[new] | (doc[new] != doc[last]).astype(np.uint64)
        return cells(block, _bucket(keys, self.n_buckets, ANCHOR_BITS), self.n_buckets, lambda s: ascending(keys[s]), np.arange(len(keys)))

    def windows(self, shared: np.ndarray) -> np.ndarray:
        """Starts of all windows that hold an anchor of which another document has a copy."""
        at, h = self.anchors()
        if not len(shared) or not len(at):
            return np.empty(0, np.int64)
        p = at[shared[np.minimum(np.searchsorted(shared, h), len(shared) - 1)] == h]
        steps = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(steps, np.maximum(p - PERIOD + 1, self.start[p]), 1)
        np.add.at(steps, p + 1, -1)
        s = np.flatnonzero(np.cumsum(steps[:-1]) > 0)
        return s[s + self.width <= self.end[s]]

    def entries(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct windows in the order of bucket and hash, with the block's smallest document; and each window's entry."""
        a, b = (window_hashes(self.words, self.width, base)[s] for base in BASES)
        b = (b >> np.uint64(32)).astype(np.uint32)
        doc, bucket = self.doc[s], _bucket(a, self.n_buckets)
        order = np.lexsort((doc, b, a))
        a, b, doc, bucket = a[order], b[order], doc[order], bucket[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.empty(0, bool)
        entry = np.empty(len(s), np.int64)
        entry[order] = np.cumsum(new) - 1
        return a[new], b[new], doc[new], bucket[new], entry

    def send_windows(self, block: int, shared: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        a, b, doc, bucket, _ = self.entries(self.windows(shared))
        return cells(block, bucket, self.n_buckets, lambda s: ascending(a[s]) + planes(b[s]) + planes(doc[s]), np.arange(len(a)))

    def removed(self, shared: np.ndarray, answers: dict[int, bytes]) -> np.ndarray:
        """Which words a copied window covers."""
        s = self.windows(shared)
        _, _, doc, bucket, entry = self.entries(s)
        earlier = np.zeros(len(doc), bool)
        for i in np.unique(bucket):
            rows = np.flatnonzero(bucket == i)
            earlier[rows] = np.unpackbits(np.frombuffer(answers[int(i)], np.uint8), count=len(rows)).astype(bool)
        hit = s[earlier[entry] | (self.doc[s] > doc[entry])]
        steps = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(steps, hit, 1)
        np.add.at(steps, hit + self.width, -1)
        return np.cumsum(steps[:-1]) > 0


def _keys(data: bytes) -> np.ndarray:
    return numbers(data, len(data) // 8, np.uint64)


def _shared_anchors(table: pa.Table) -> pa.Table:
    """A bucket's anchors that two documents have, sent back to each block that has them."""
    parts = [_keys(x.as_py()) for x in table["data"]]
    keys = np.concatenate(parts)
    sender = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    order = np.argsort(keys, kind="stable")
    keys, sender = keys[order], sender[order]
    base = keys & ~np.uint64(1)
    run = np.cumsum(np.concatenate([[True], base[1:] != base[:-1]])) - 1
    many = (np.bincount(run) > 1) | (np.bincount(run, keys & np.uint64(1)) > 0)
    keep = many[run]
    base, sender = base[keep], sender[keep]
    order = np.argsort(sender, kind="stable")
    bucket, blocks = table["bucket"][0].as_py(), table["block"].to_pylist()
    edges = np.searchsorted(sender[order], np.arange(len(parts) + 1))
    return cell_table((bucket, blocks[i], ascending(base[order[edges[i] : edges[i + 1]]])) for i in range(len(parts)) if edges[i] < edges[i + 1])


def _earlier_windows(table: pa.Table) -> pa.Table:
    """For each block, one bit for each of its windows: another block has it in a smaller document."""
    raw = [x.as_py() for x in table["data"]]
    sizes = [len(x) // 20 for x in raw]
    a = np.concatenate([numbers(x, n, np.uint64) for x, n in zip(raw, sizes, strict=True)])
    b = np.concatenate([from_planes(x, np.uint32, n, 8 * n) for x, n in zip(raw, sizes, strict=True)])
    doc = np.concatenate([from_planes(x, np.int64, n, 12 * n) for x, n in zip(raw, sizes, strict=True)])
    order = np.lexsort((doc, b, a))
    a, b = a[order], b[order]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    least = np.repeat(doc[order][new], np.diff(np.concatenate([new, [len(a)]])))
    earlier = np.empty(len(a), bool)
    earlier[order] = doc[order] > least
    edges = np.cumsum([0, *sizes])
    bucket = table["bucket"][0].as_py()
    return cell_table((bucket, block, np.packbits(earlier[edges[i] : edges[i + 1]]).tobytes()) for i, block in enumerate(table["block"].to_pylist()))


def _of(answers: pa.Table, kind: int) -> list[tuple[int, bytes]]:
    return received(answers.filter(pc.equal(answers["kind"], kind)))


def _shared(answers: pa.Table) -> np.ndarray:
    parts = [_keys(d) for _, d in _of(answers, _ANCHORS)]
    return np.sort(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def _cut(text: str, removed: np.ndarray) -> str:
    """The text without the removed words, each with the white space after it."""
    data = text.encode()
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    keep, at = [], 0
    for i in np.flatnonzero(np.diff(np.concatenate([[False], removed, [False]]).astype(np.int8)) == 1):
        j = i + int(np.argmin(np.concatenate([removed[i:], [False]])))
        keep.append(data[at : spans[i][0]])
        at = spans[j][0] if j < len(spans) else len(data)
    keep.append(data[at:])
    return b"".join(keep).decode()


def dedup(docs: DataFrame, width: int = WIDTH, with_text: bool = True) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed``, ``kept_sha256`` (kept words joined by one space) and, ``with_text``, ``kept_text``."""
    if width < PERIOD:
        raise ValueError(f"width must be {PERIOD} or more")
    columns = [c for c in docs.columns if c not in ADDED and c != "block"] if with_text else ["doc_id", "text"]
    blocks, n = by_block(docs, *columns)

    def first(key, table):
        return cell_table(_Block(table, width, n).send_anchors(key[0].as_py()))

    def second(key, table, answers):
        if not answers.num_rows or not table.num_rows:
            return cell_table([])
        return cell_table(_Block(table, width, n).send_windows(key[0].as_py(), _shared(answers)))

    def third(key, table, answers):
        block = _Block(table, width, n) if answers.num_rows else None
        gone = block.removed(_shared(answers), dict(_of(answers, _WINDOWS))) if block else None
        totals, removed, digests, texts = [], [], [], []
        for i, text in enumerate(table["text"]):
            text = text.as_py() or ""
            words = text.encode().split()
            mask = gone[block.first[i] : block.first[i] + block.sizes[i]] if block is not None and block.sizes[i] else None
            some = mask is not None and mask.any()
            kept = [w for w, m in zip(words, mask.tolist(), strict=True) if not m] if some else words
            totals.append(len(words))
            removed.append(len(words) - len(kept))
            digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            if with_text:
                texts.append(_cut(text, mask) if some else text)
        out = table.select(columns) if with_text else table.select(["doc_id"])
        out = out.append_column("n_words", pa.array(totals, pa.int64())).append_column("n_removed", pa.array(removed, pa.int64())).append_column("kept_sha256", pa.array(digests, pa.string()))
        return out.append_column("kept_text", pa.array(texts, pa.string())) if with_text else out

    anchors = exchange(blocks.groupBy("block").applyInArrow, first, _shared_anchors, n).withColumn("kind", F.lit(_ANCHORS))
    windows = exchange(blocks.groupBy("block").cogroup(anchors.groupBy("block")).applyInArrow, second, _earlier_windows, n).withColumn("kind", F.lit(_WINDOWS))
    answers = anchors.unionByName(windows)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in (columns if with_text else ["doc_id"])]
    fields = [next(x for x in fields if x.startswith(f"`{c}` ")) for c in (columns if with_text else ["doc_id"])]
    schema = ", ".join(fields) + ", n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(third, schema)


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the ``op6_substring_dedup`` query."""
    return dedup(docs, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, rid, unnest(range(1, greatest(len(w) - {WIDTH - 2}, 1))) AS p FROM d),
h AS (SELECT s.doc_id, s.rid, p, md5(array_to_string(w[p:p + {WIDTH - 1}], ' ')) AS x FROM s JOIN d USING (rid)),
f AS (SELECT rid, p FROM h QUALIFY min(doc_id) OVER (PARTITION BY x) < doc_id),
c AS (SELECT DISTINCT rid, unnest(range(p, p + {WIDTH})) AS i FROM f),
k AS (SELECT rid, list(i) AS gone FROM c GROUP BY rid),
r AS (SELECT doc_id, w, coalesce(gone, []) AS gone FROM d LEFT JOIN k USING (rid))
SELECT doc_id, len(w)::BIGINT AS n_words, len(gone)::BIGINT AS n_removed,
  sha256(array_to_string([w[i] FOR i IN range(1, len(w) + 1) IF NOT list_contains(gone, i)], ' ')) AS kept_sha256 FROM r
"""
