"""Best-fit packing of tokenised documents into fixed-length sequences.

The rounds are bulk-synchronous. Documents and open gaps are range-sorted by size, into ranges
of a factor of two. In a round every range is swept by itself: its documents, longest first,
take their successor gap, the smallest that holds them; those of equal length that want the
same gaps are told apart by their rank. What is left of a gap goes to the range of its new
size, and a document that found none to the next range that has gaps. Where no gap at all
would hold the longest documents, as many sequences are opened as their volume needs, and the
next round starts. It ends when no document is left.

Rows of one length are interchangeable, so a range's rows are runs of equal documents and
equal gaps: a few for each of at most ``capacity`` lengths, whatever the number of documents.
Counting, ranking and placing the documents are distributed; no length, run or row goes to the
driver, which sees the largest gap of each range and a total, twelve numbers a round.

Defined results: a null text counts as an empty one, which is the end id alone; only
documents over ``capacity`` are cut; repeated rows are packed one by one; an empty table
gives an empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataq.llm.common import checkpointed, stored

CAPACITY = 2048
END_ID = 0
TOKENIZER = "word_bpe_49k.json"
#: Encoded words, and an eighth as many parts of words, kept by a task in each of two generations.
WORD_CACHE = 250_000
#: Rows of one length that are ranked together, and that look for their place together.
RANK_ROWS = 4_000

_encoders: dict = {}


#: Words of these characters need no normalisation but lower case, and split into the parts below.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
#: Writers of few ids, by their number.
_PACK = [struct.Struct(f"<{n}I").pack for n in range(65)]
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
_PARTS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write for bytes: printable ones themselves, the others from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in printable else chr(next(rest)) for b in range(256)}


class _Parts(dict):
    """Ids of parts of words, straight from the vocabulary's merges."""

    def __init__(self, model):
        super().__init__()
        self.model, self.letters = model, _byte_letters()

    def __missing__(self, part: str) -> list[int]:
        if len(self) >= WORD_CACHE // 8:
            self.clear()
        self[part] = ids = self.encoded(part.encode().decode("latin-1").translate(self.letters))
        return ids

    def encoded(self, letters: str) -> list[int]:
        return [t.id for t in self.model.tokenize(letters)]


class _Words(dict):
    """Little-endian ids of words between ASCII white space, which the tokenizer never joins.

    When the words are too many, they become the older generation; what is met again there
    moves to the new one, so that frequent words are encoded once.
    """

    def __init__(self, tokenizer, plain: bool):
        super().__init__()
        self.tokenizer, self.plain, self.parts = tokenizer, plain, _Parts(tokenizer.model)
        self.older: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= WORD_CACHE:
            self.older = dict(self)
            self.clear()
        if word in self.older:
            self[word] = known = self.older[word]
            return known
        ids = None
        if self.plain and len(word) <= 64:
            # Contractions and special tokens are left to the whole tokenizer.
            body, tail = (word[:-1], word[-1:]) if word.endswith((b".", b",")) else (word, b"")
            if body.isalpha():  # ASCII letters
                ids = self.parts.encoded(body.lower().decode())
            elif _LETTERS.fullmatch((text := word.decode())[: len(text) - len(tail)]):
                ids = self.parts.encoded(text[: len(text) - len(tail)].lower().encode().decode("latin-1").translate(self.parts.letters))
            elif "'" not in text and "<|" not in text and _PLAIN.fullmatch(text):
                ids, tail = [i for part in _PARTS.findall(text.lower()) for i in self.parts[part]], b""
            if ids is not None and tail:
                ids = ids + self.parts[tail.decode()]
        if ids is None:
            ids = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
        packed = _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, "<u4").tobytes()
        if len(word) <= 64:
            self[word] = packed
        return packed


def _words(path: str | None) -> _Words:
    """A new store of words; the tokenizer is kept by the worker, the words only as long as a task."""
    plain = path is None  # the parts are those of this vocabulary
    if plain:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    if path not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _encoders[path] = Tokenizer.from_file(path)
    return _Words(_encoders[path], plain)


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Tokenise whole texts, end each with ``END_ID``, and cut those over ``capacity``: one row per piece.

    ``with_ids`` adds the ids themselves (little-endian unsigned 32-bit).
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    end, step = np.array([END_ID], "<u4").tobytes(), 4 * capacity

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(tokenizer_path)
        for batch in batches:
            out: list[tuple] = []
            texts = batch["text"].cast(pa.large_binary() if pa.types.is_large_string(batch["text"].type) else pa.binary())
            for doc, text in zip(batch["doc_id"].to_pylist(), texts, strict=True):
                ids = b"".join(map(words.__getitem__, (text.as_py() or b"").split())) + end
                for i, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    out.append((doc, i, at // 4, len(part) // 4, zlib.crc32(part), part)[: 5 + with_ids])
            columns = list(zip(*out, strict=True)) or [()] * (5 + with_ids)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names[: 5 + with_ids])

    return docs.select("doc_id", "text").mapInArrow(encode, schema)


ROUND = "kind string, range int, size long, first long, n long, offset long, length long, last long, each long"


def _range(size: int) -> int:
    return size.bit_length() - 1


def sweep(docs: list[tuple[int, int, int]], gaps: list[tuple[int, int, int, int]]) -> tuple[list, list, list]:
    """Best fit of runs: documents (length, first rank, number), longest first, into gaps (room, first sequence, number, offset).

    Returns placements (length, first rank, last rank + 1, documents in each sequence, first
    sequence, offset), the documents left over, and the gaps that remain.
    """
    by_room: dict[int, list[tuple[int, int, int]]] = {}
    rooms: list[int] = []

    def put(room: int, run: tuple[int, int, int]) -> None:
        if room and run[1]:
            if room not in by_room:
                by_room[room] = []
                insort(rooms, room)
            by_room[room].append(run)

    for room, *run in sorted(gaps, reverse=True):
        put(room, tuple(run))
    placed, over = [], []
    for length, rank, left in sorted(docs, key=lambda x: (-x[0], x[1])):
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                over.append((length, rank, left))
                break
            room = rooms[at]
            first, many, offset = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
            each = room // length
            full = min(many, left // each)
            if full:
                placed.append((length, rank, rank + full * each, each, first, offset))
                put(room - each * length, (first, full, offset + each * length))
            rank, left = rank + full * each, left - full * each
            if full < many and left:
                placed.append((length, rank, rank + left, left, first + full, offset))
                put(room - left * length, (first + full, 1, offset + left * length))
                rank, left, full = rank + left, 0, full + 1
            if full < many:
                put(room, (first + full, many - full, offset))
    return placed, over, [(room, *run) for room in rooms for run in by_room[room]]


def _swept(key, table):
    """One range of a round; documents left over stay in their range until they are sent on."""
    rows = table.to_pydict()
    runs = list(zip(rows["kind"], rows["size"], rows["first"], rows["n"], rows["offset"], strict=True))
    placed, over, gaps = sweep([r[1:4] for r in runs if r[0] == "doc"], [r[1:] for r in runs if r[0] == "gap"])
    out = [("placed", 0, 0, sequence, last - first, offset, length, first, each) for length, first, last, each, sequence, offset in placed]
    out += [("doc", key[0].as_py(), length, rank, n, 0, 0, 0, 0) for length, rank, n in over]
    out += [("gap", _range(room), room, first, n, offset, 0, 0, 0) for room, first, n, offset in gaps]
    kinds = [pa.string(), pa.int32(), *[pa.int64()] * 7]
    return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["kind", "range", "size", "first", "n", "offset", "length", "last", "each"])


def best_fit(counts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Placements for (length, count): ``length``, ``first`` and ``last`` rank, ``each`` in a sequence, first ``sequence``, ``offset``.

    Documents with ranks from ``first`` to below ``last`` go ``each`` at a time into
    consecutive sequences from ``sequence`` on, each set starting at ``offset``.
    """
    spark = counts.sparkSession
    top, zero = _range(capacity), F.lit(0).cast("long")
    bits = lambda size: (F.length(F.bin(size)) - 1).cast("int")
    fixed = [zero.alias("offset"), zero.alias("length"), zero.alias("last"), zero.alias("each")]
    state = counts.select(F.lit("doc").alias("kind"), bits(F.col("length")).alias("range"), F.col("length").alias("size"), zero.alias("first"), F.col("count").alias("n"), *fixed)
    placed, opened = [], 0
    while True:
        # No more tasks than ranges, however many shuffle partitions there are: each round's tasks stay in the driver's memory.
        swept = checkpointed(state.groupBy("range").applyInArrow(_swept, ROUND).coalesce(top + 1))
        placed.append(swept.filter("kind = 'placed'"))
        docs, gaps = swept.filter("kind = 'doc'"), swept.filter("kind = 'gap'")
        # The largest gap of each range, and how many documents are left.
        seen = swept.groupBy("range").agg(F.max(F.when(F.col("kind") == "gap", F.col("size"))).alias("room"), F.count_if(F.col("kind") == "doc").alias("docs")).coalesce(1).collect()
        if not sum(r["docs"] for r in seen):
            break
        largest = {r["range"]: r["room"] for r in seen if r["room"] is not None}
        own, higher = F.lit(False), F.lit(None).cast("int")
        for k in sorted(largest, reverse=True):
            own = own | ((F.col("range") == k) & (F.col("size") <= largest[k]))
            higher = F.when(F.col("range") < k, k).otherwise(higher)
        again = F.when(F.col("size") <= max(largest.values(), default=0), bits(F.col("size")))
        docs = docs.withColumn("to", F.when(own, F.col("range")).otherwise(F.coalesce(higher, again)))
        waits = F.col("to").isNull()
        longest = docs.filter(waits).agg(F.max("size").alias("size")).first()["size"]
        if longest is None:
            state = gaps.unionByName(docs.withColumn("range", F.col("to")).drop("to"))
            continue
        # The longest ones that wait, and those over half as long, get what their volume needs.
        first = waits & (F.col("size") * 2 > longest)
        need = docs.filter(first).agg(F.sum(F.col("size") * F.col("n")).alias("volume"), F.coalesce(F.sum(F.when(F.col("size") * 2 > capacity, F.col("n"))), zero).alias("large")).first()
        more = max(need["large"], -(-need["volume"] // capacity))
        new = spark.range(0, 1, 1, 1).select(F.lit("gap").alias("kind"), F.lit(top).alias("range"), F.lit(capacity).cast("long").alias("size"), F.lit(opened).cast("long").alias("first"), F.lit(more).cast("long").alias("n"), *fixed)
        opened += more
        to = F.when(first, top).otherwise(F.coalesce("to", bits(F.col("size"))))
        state = gaps.unionByName(docs.withColumn("range", to).drop("to")).unionByName(new)
    every = functools.reduce(DataFrame.unionByName, placed)
    return every.select("length", F.col("last").alias("first"), (F.col("last") + F.col("n")).alias("last"), "each", F.col("first").alias("sequence"), "offset")


def ranked(rows: DataFrame, lengths: DataFrame, *order: str) -> DataFrame:
    """``rank`` of each row among those of its length, from 0. A common length is ranked in parts."""
    salted = rows.join(F.broadcast(lengths), "length").withColumn("salt", F.pmod(F.xxhash64(*order), F.ceil(F.col("count") / RANK_ROWS).cast("long"))).drop("count")
    part = Window.partitionBy("length", "salt")
    before = salted.groupBy("length", "salt").count().withColumn("base", F.sum("count").over(Window.partitionBy("length").orderBy("salt")) - F.col("count")).drop("count")
    inside = salted.withColumn("place", F.row_number().over(part.orderBy(*order)) - 1)
    return inside.join(before, ["length", "salt"]).withColumn("rank", F.col("place") + F.col("base")).drop("salt", "place", "base")


def pack(rows: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``sequence_id`` and ``offset`` for rows with a ``length`` from 1 to ``capacity``; ``order`` tells rows of one length apart.

    ``rows`` is read twice and should be stored.
    """
    lengths = rows.groupBy("length").count()
    placed = best_fit(lengths, capacity)
    # Ranks are looked up by blocks, each of which a few placements cover.
    block = lambda rank: F.floor(rank / RANK_ROWS)
    covered = placed.withColumn("block", F.explode(F.sequence(block(F.col("first")), block(F.col("last") - 1))))
    found = ranked(rows, lengths, *order).withColumn("block", block(F.col("rank"))).join(covered, ["length", "block"]).filter("rank >= first AND rank < last")
    step = F.col("rank") - F.col("first")
    placing = [(F.col("sequence") + F.floor(step / F.col("each"))).alias("sequence_id"), (F.col("offset") + step % F.col("each") * F.col("length")).alias("offset")]
    return found.select(*rows.columns, *placing)


def digest(docs: DataFrame, capacity: int = CAPACITY, tokenizer_path: str | None = None) -> DataFrame:
    """The columns of the ``op1_best_fit_packing`` query."""
    rows = stored(pieces(docs, capacity, tokenizer_path), "pieces")
    return pack(rows, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
