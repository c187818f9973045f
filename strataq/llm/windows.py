"""Hashes of word windows, many at a time, and the exchange that compares them across all documents.

Documents are dealt into blocks by a hash of id and text. A block sends each distinct hash
once, packed by bucket of hashes; a bucket compares what all blocks have sent and answers each
block. A hash that a third of all documents hold takes one entry for each block, so no key
makes a large task.

Blocks and buckets are as many as the text has parts, so a cell for each pair of them would be
a number that grows with the square of the text. They are arranged in rows and columns
instead, about the square root of their number each: a block sends one pack for each column of
buckets, the packs of a row of blocks for a column are repacked by bucket, and answers go
back the same way. A pack then holds a root of the blocks or buckets, and ``n`` blocks take
about ``n * sqrt(n)`` packs each way.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.llm.common import BLOCK_BYTES, block_of, blocks_for

CELL = "bucket int, block int, data binary"
#: Two odd multipliers: windows are told apart by two sums modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Words whose hashes a worker keeps; beyond, it starts anew.
WORD_CACHE = 100_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Hashes()


def word_hashes(text: str | None, lower: bool = False) -> np.ndarray:
    """A 64-bit hash for each word; ``lower`` folds A to Z only."""
    data = (text or "").encode()
    words = (data.lower() if lower else data).split()  # bytes: ASCII white space and ASCII letters only
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def window_hashes(words: np.ndarray, width: int, base: int = BASES[0]) -> np.ndarray:
    """A hash for each window of ``width`` consecutive words; equal windows have equal hashes anywhere.

    Windows of 1, 2, 4, ... words are made from two halves, and those whose sizes add up to
    ``width`` are put one after the other, so nothing is kept between calls.
    """
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    part, span, out, done = words, 1, None, 0
    while True:
        power = np.uint64(pow(base, span, 1 << 64))
        if width & span:
            out = part[:n].copy() if out is None else out * power + part[done : done + n]
            done += span
        if done == width:
            return mixed(out)
        part = part[:-span] * power + part[span:]
        span *= 2


def by_block(docs: DataFrame, *columns: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """``docs`` with a ``block`` column, and the number of blocks, which follows the bytes of text."""
    size = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    n = blocks_for(size["b"], max(1, size["n"]), block_bytes)
    return docs.select(block_of(n, "doc_id", "text").alias("block"), *columns), n


def cells(block: int, bucket: np.ndarray, n_buckets: int, make: Callable[[slice], bytes], order: np.ndarray) -> Iterable[tuple[int, int, bytes]]:
    """A cell for each bucket that occurs; ``make`` packs a slice of the rows in ``order``."""
    edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    for i in np.flatnonzero(np.diff(edges)):
        yield int(i), block, make(slice(edges[i], edges[i + 1]))


def cell_table(rows: Iterable[tuple[int, int, bytes]]) -> pa.Table:
    rows = list(rows)
    columns = [[r[i] for r in rows] for i in range(3)]
    return pa.table({"bucket": pa.array(columns[0], pa.int32()), "block": pa.array(columns[1], pa.int32()), "data": pa.array(columns[2], pa.binary())})


def planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte, all lowest bytes first: what they have in common packs well."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()


def from_planes(data: bytes, kind: type, n: int, at: int = 0) -> np.ndarray:
    """``n`` numbers that ``planes`` wrote from byte ``at`` on."""
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, size * n, at).reshape(size, n).T).view(kind).ravel()


def ascending(values: np.ndarray) -> bytes:
    """Ascending numbers as their differences."""
    return planes(np.diff(values, prepend=values.dtype.type(0)).astype(values.dtype))


def numbers(data: bytes, n: int, kind: type = np.uint32) -> np.ndarray:
    """What ``ascending`` wrote at the beginning of ``data``."""
    return np.cumsum(from_planes(data, kind, n), dtype=kind)


def _pack(items: list[tuple[int, bytes]]) -> bytes:
    head = np.array([len(items), *(i for i, _ in items), *(len(d) for _, d in items)], np.int64).tobytes()
    return zstandard.compress(head + b"".join(d for _, d in items), 1)


def _unpack(data: bytes) -> list[tuple[int, bytes]]:
    raw = memoryview(zstandard.decompress(data))
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    ids, sizes = np.frombuffer(raw, np.int64, 2 * n, 8).reshape(2, n)
    ends = 8 + 16 * n + np.cumsum(sizes)
    return [(i, bytes(raw[b - k : b])) for i, k, b in zip(ids.tolist(), sizes.tolist(), ends.tolist(), strict=True)]


def _packs(items: Iterable[tuple[int, int, int, int, bytes]], names: tuple[str, str, str]) -> pa.Table:
    """From (three numbers of a pack, a number within it, bytes) a row for each pack."""
    found: dict[tuple[int, int, int], list[tuple[int, bytes]]] = {}
    for x, y, z, i, data in items:
        found.setdefault((x, y, z), []).append((i, data))
    columns = [pa.array([k[c] for k in found], pa.int32()) for c in range(3)]
    return pa.table([*columns, pa.array([_pack(v) for v in found.values()], pa.binary())], names=[*names, "data"])


_SENT = ("row", "column", "block")
_HELD = ("row", "column", "bucket")
_schema = lambda names: ", ".join(f"{n} int" for n in names) + ", data binary"


def exchange(send: Callable[[Callable, str], DataFrame], first: Callable[..., pa.Table], merge: Callable[[pa.Table], pa.Table], n: int) -> DataFrame:
    """The answers of ``n`` buckets to ``n`` blocks, with a ``block`` column; ``received`` reads them.

    ``send(function, schema)`` applies a function to each block, ``first`` returns a block's
    cells (bucket, block, data), and ``merge`` turns all cells of a bucket into its answers.
    """
    root = max(1, math.isqrt(max(n - 1, 0)) + 1)

    def packed(cells_: pa.Table) -> pa.Table:
        return _packs(((b // root, k // root, b, k, d.as_py()) for k, b, d in zip(cells_["bucket"].to_pylist(), cells_["block"].to_pylist(), cells_["data"], strict=True)), _SENT)

    def sent(key, table):
        return packed(first(key, table))

    def sent_with(key, table, answers):
        return packed(first(key, table, answers))

    def by_bucket(key, table):
        row, column = (x.as_py() for x in key)
        return _packs(((row, column, k, b, d) for b, data in zip(table["block"].to_pylist(), table["data"], strict=True) for k, d in _unpack(data.as_py())), _HELD)

    def answer(key, table):
        bucket = key[0].as_py()
        answers = merge(cell_table((bucket, b, d) for data in table["data"] for b, d in _unpack(data.as_py())))
        return _packs(((b // root, bucket // root, bucket, b, d.as_py()) for b, d in zip(answers["block"].to_pylist(), answers["data"], strict=True)), _HELD)

    def by_block(key, table):
        row, column = (x.as_py() for x in key)
        return _packs(((row, column, b, k, d) for k, data in zip(table["bucket"].to_pylist(), table["data"], strict=True) for b, d in _unpack(data.as_py())), _SENT)

    held = send(sent_with if first.__code__.co_argcount == 3 else sent, _schema(_SENT)).groupBy("row", "column").applyInArrow(by_bucket, _schema(_HELD))
    answers = held.groupBy("bucket").applyInArrow(answer, _schema(_HELD))
    return answers.groupBy("row", "column").applyInArrow(by_block, _schema(_SENT))


def received(answers: pa.Table) -> list[tuple[int, bytes]]:
    """The buckets that answered, and what."""
    return [x for data in answers["data"] for x in _unpack(data.as_py())]
