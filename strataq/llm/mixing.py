"""Language-model scores by online logistic context mixing.

A text is coded as its lower-cased words, one space after each, and an end symbol; each
symbol is five binary decisions. Three predictors give a probability for every decision: the
counts after the two symbols before and the word's length, after the four symbols before, and
after a hash of the word so far. Their logits and a constant are added with weights that a
gate selects (the decision's depth, how often the word so far and the four symbols before
have been seen), and refined by an adaptive correction from a hashed slot of the two symbols
before. Weights and corrections learn after every symbol: a text is cut into lanes of
``LANE`` symbols, and one step takes the next symbol of all lanes of a group, so each lane
learns on its own while the arithmetic runs over many. A group starts from the mean of what
the lanes of the training texts before it have learned, the first one from the
middle of some lanes of training texts, which is run before. The costs of all decisions add up to the bits of the
text.

Counts are taken over all training texts. Those of up to four symbols form tables of at
most ``2 ** 20`` contexts, whose size follows from the alphabet and not from the corpus, so
they are broadcast (34 MB). Words so far have no such bound: a block of documents sends what it
has counted to buckets of hashes, and each bucket answers a block with the totals of the
decisions that the block needs. No task holds a whole table, and what is gathered grows with
the vocabulary of the corpus. A training text's own counts of words are left out of the
totals when it is scored, as if it were new; a second copy elsewhere still counts.

The query scores a block in ``Mixing.java``, which goes through the same steps symbol by symbol,
lane after lane, so that what a lane has learned stays in the processor's cache. ``Words`` and
``Mixer`` say the same with arrays; the tests hold both against each other.

Defined results: a null text counts as an empty one, which is the end alone; a document with
a null ``doc_id`` is scored but not learned from; repeated rows are learned from each time;
an empty table gives an empty result; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.llm.common import collected, removed, stored
from strataq.llm.jvm import instance
from strataq.llm.windows import CELL, by_block, cell_table, mixed

FOLDS, HELD_OUT = 7, 2
#: Symbols: letters, space, end, escape, full stop, comma, and the lead byte of accented letters.
SPACE, END, ESCAPE = 26, 27, 28
#: Symbols of a lane, lanes of a group, lanes that are run before the first group, and symbols that are made ready at once.
LANE = 1 << 12
LANES = 1 << 9
FIRST_LANES, FIRST_SYMBOLS = 1 << 7, 1 << 10
READY = 1 << 17
#: Words so far predict from this many symbols on; shorter ones are told by the four symbols before.
REACH = 4
#: Logits are kept as bytes in units of ``1 / UNIT``.
UNIT = 12
#: Added to counts for their logits.
PRIOR = 0.05
FIRST_WEIGHT, RATE, SLOT_RATE = 0.4, 0.001, 0.25
#: A lane's slots for corrections by the two symbols before.
SLOT_BITS = 10
WORD_STATES, SHORT_STATES = 4, 3
GATES = 5 * WORD_STATES * SHORT_STATES
#: Codes of contexts with the word's length begin here.
LONG = 1 << 25
#: Symbols whose words are hashed at once, about.
SOME = 1 << 19
#: Text of a block.
TEXT_BYTES = 4 << 20


def _codes() -> np.ndarray:
    code = np.full(256, ESCAPE, np.uint8)
    code[np.arange(97, 123)] = np.arange(26)
    code[32], code[ord(".")], code[ord(",")], code[0xC3] = SPACE, 29, 30, 31
    return code


_CODE = _codes()
_VALUES = mixed(np.arange(77, 109, dtype=np.uint64))
_MOVES = (np.arange(32)[:, None] >> (4 - np.arange(5))) & 1
_SIGNS = (2 * _MOVES - 1).astype(np.int8)
_NODES = ((1 << np.arange(5)) | (np.arange(32)[:, None] >> (5 - np.arange(5)))).astype(np.int32)
_CONSTANT, _TOWARDS = _SIGNS * np.int8(UNIT), _SIGNS.astype(np.float32)
#: The slots of the decisions of a symbol after two others.
_SLOTS = ((np.arange(1 << 10, dtype=np.uint32)[:, None, None] << np.uint32(5) | _NODES.astype(np.uint32)) * np.uint32(0x9E3779B1) >> np.uint32(32 - SLOT_BITS)).astype(np.int64).reshape(-1, 5)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def symbols(text: str | None) -> np.ndarray:
    """The text's words as symbols of five bits; other bytes are an escape and two half bytes."""
    words = (text or "").encode().lower().split()
    data = np.frombuffer(b" ".join(words) + b" " * bool(words), np.uint8)
    code = _CODE[data]
    other = code == ESCAPE
    at = np.arange(len(data)) + 2 * np.concatenate([[0], np.cumsum(other)])[: len(data)]
    out = np.empty(len(data) + 2 * int(other.sum()) + 1, np.uint8)
    out[at] = code
    out[at[other] + 1] = data[other] >> 4
    out[at[other] + 2] = data[other] & 15
    out[-1] = END
    return out


class Symbols:
    """The symbols of some texts, one after the other, with what the predictors look at."""

    def __init__(self, texts: list[np.ndarray]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.sym = np.concatenate(texts) if texts else np.empty(0, np.uint8)
        n = len(self.sym)
        padded = np.concatenate([np.full(4, END, np.uint8), self.sym])
        pair = padded[1:].astype(np.uint16)
        pair |= padded[:-1].astype(np.uint16) << np.uint16(5)
        #: The four symbols before, the nearest in the lowest bits.
        self.short = pair[2 : n + 2].astype(np.uint32)
        self.short |= pair[:n].astype(np.uint32) << np.uint32(10)
        begin = self.first[:-1]
        # At a text's beginning, the symbols before are those of an end.
        for k in range(4):
            at = begin[self.sizes > k] + k
            mask = np.uint32((1 << 5 * k) - 1)
            self.short[at] = self.short[at] & mask | np.uint32(sum(END << 5 * i for i in range(4))) & ~mask
        place = np.arange(n, dtype=np.int32)
        start = np.zeros(n, np.int32)
        at = np.flatnonzero(self.sym[:-1] == SPACE) + 1
        start[at] = at
        start[begin] = begin
        np.maximum.accumulate(start, out=start)
        #: Symbols of the word so far.
        self.rank = np.subtract(place, start, out=start)

    def long(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The two symbols before, and how long the word is so far (15: or longer)."""
        return np.minimum(self.rank[at], 15).astype(np.uint32) << np.uint32(10) | self.short[at] & np.uint32(1023)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Places where a word ends or has ``REACH`` symbols so far, and their codes: a hash of the word so far in 58 bits, then the symbol in five."""
        power = np.full(int(self.rank.max(initial=0)) + 1, _BASE, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        places, codes = [np.empty(0, np.int32)], [np.empty(0, np.uint64)]
        # Some texts at a time, as words do not cross texts.
        edges = np.unique(np.append(self.first[np.searchsorted(self.first, np.arange(0, len(self.sym), SOME))], len(self.sym)))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            rank, sym = self.rank[a:b], self.sym[a:b]
            total = np.zeros(b - a + 1, np.uint64)
            part = power.take(rank)
            part *= _VALUES.take(sym)
            np.cumsum(part, out=total[1:])
            at = np.flatnonzero((rank >= REACH) | (sym == SPACE))
            rank, sym = rank[at], sym[at]
            h = mixed(total[at] - total[at - rank] + power.take(rank))
            h >>= np.uint64(6)
            h <<= np.uint64(5)
            h |= sym
            places.append((at + a).astype(np.int32))
            codes.append(h)
        return np.concatenate(places), np.concatenate(codes)


def logits(counts: np.ndarray) -> np.ndarray:
    """From counts of symbols (rows, 32) to the logit of a one at each of 31 decisions, in units of ``1 / UNIT``."""
    out = np.zeros((len(counts), 32), np.int8)
    level = counts.astype(np.float32)
    for depth in (4, 3, 2, 1, 0):
        zero, one = level[:, 0::2], level[:, 1::2]
        out[:, 1 << depth : 2 << depth] = _logit(one, zero)
        level = zero + one
    return out


def _logit(one: np.ndarray, zero: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(np.log((one + np.float32(PRIOR)) / (zero + np.float32(PRIOR))) * UNIT), -127, 127).astype(np.int8)


class Tables:
    """Logits by two symbols and the word's length and by four symbols, and how often the four have been seen (0: never, 1: up to 8 times, 2: oftener).

    Contexts of four symbols that have been seen have a row each, the others share row 0.
    ``paths`` has a number for each context and symbol, the bytes of which are the five logits
    towards that symbol.
    """

    def __init__(self) -> None:
        self.two, self.four = np.zeros((1 << 14, 32), np.int8), np.zeros((1, 32), np.int8)
        self.seen, self.row = np.zeros(1 << 20, np.int8), np.zeros(1 << 20, np.int32)
        self.paths: tuple[np.ndarray, np.ndarray] | None = None

    def put(self, nearest: int, packed: bytes) -> None:
        """Take the part of all contexts with this nearest symbol."""
        raw = np.frombuffer(zstandard.decompress(packed), np.int8)
        self.two[nearest::32] = raw[: 1 << 14].reshape(-1, 32)
        seen = raw[1 << 14 : (1 << 14) + (1 << 15)]
        self.seen[nearest::32] = seen
        self.row[nearest::32][seen > 0] = len(self.four) + np.arange(np.count_nonzero(seen))
        self.four = np.concatenate([self.four, raw[(1 << 14) + (1 << 15) :].reshape(-1, 32)])

    def packed(self) -> bytearray:
        """All of it, for ``Mixing.java``."""
        return bytearray(self.two.tobytes() + self.seen.tobytes() + self.row.tobytes() + self.four.tobytes())

    def made(self) -> tuple[np.ndarray, np.ndarray]:
        if self.paths is None:
            self.paths = _paths(self.two), _paths(self.four)
        return self.paths


def _paths(table: np.ndarray) -> np.ndarray:
    out = np.zeros((len(table), 32, 8), np.int8)
    np.multiply(table[:, _NODES], _SIGNS, out=out[:, :, :5])
    return out.view(np.uint64).ravel()


def tables_part(codes: np.ndarray, counts: np.ndarray) -> bytes:
    """The tables of one nearest symbol, from counts by the codes of ``short_counts`` without that symbol."""
    long = codes >= LONG >> 5
    two, four = np.zeros(1 << 14, np.int64), np.zeros(1 << 20, np.int64)
    two[codes[long] - (LONG >> 5)] = counts[long]
    four[codes[~long]] = counts[~long]
    two, four = two.reshape(-1, 32), four.reshape(-1, 32)
    total = four.sum(1)
    seen = (total > 0).astype(np.int8) + (total > 8).astype(np.int8)
    return zstandard.compress(b"".join([logits(two).tobytes(), seen.tobytes(), logits(four[total > 0]).tobytes()]), 1)


def short_counts(texts: Symbols, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts over training texts by two kinds of codes: four symbols before and the symbol; and from ``LONG`` on, the word's length, two symbols before and the symbol."""
    here = slice(None) if learned.all() else np.repeat(learned, texts.sizes)
    sym = texts.sym[here]
    four = texts.short[here] << np.uint32(5) | sym
    four.sort()
    new = _runs(four, 0)
    two = np.bincount(texts.long(here).astype(np.int32) << 5 | sym, minlength=1)
    codes = np.flatnonzero(two)
    return np.concatenate([four[new], codes + LONG]).astype(np.uint64), np.concatenate([np.diff(np.append(new, len(four))), two[codes]])


class Mixer:
    """Weights by gate and corrections by slot; ``costs`` scores lanes and lets those of training texts teach the next ones."""

    def __init__(self, tables: Tables):
        self.tables = tables
        self.weights = np.tile(np.array([FIRST_WEIGHT] * 3 + [0], np.float32) / UNIT, (GATES, 1))
        self.slots = np.zeros(1 << SLOT_BITS, np.float32)

    def costs(self, texts: Symbols, trains: np.ndarray, word: np.ndarray, state: np.ndarray) -> np.ndarray:
        """Bits of each text; ``word`` has the word predictor's logits towards what comes, as in ``Tables.paths``, ``state`` its gate."""
        out = np.zeros(len(texts.sizes))
        many = -(-texts.sizes // LANE)
        doc = np.repeat(np.arange(len(many)), many)
        start = (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * LANE
        size = np.minimum(texts.sizes[doc] - start, LANE)
        start += texts.first[doc]
        order = np.argsort(-size, kind="stable")
        learned = order[trains[doc[order]]]
        if len(learned):
            some = learned[:: -(-len(learned) // FIRST_LANES)]
            middle = np.minimum(size[some], FIRST_SYMBOLS)
            self._group(texts, start[some] + (size[some] - middle) // 2, middle, trains[doc[some]], word, state)
        for at in range(0, len(order), LANES):
            lanes = order[at : at + LANES]
            np.add.at(out, doc[lanes], self._group(texts, start[lanes], size[lanes], trains[doc[lanes]], word, state))
        return out

    def _group(self, texts: Symbols, start: np.ndarray, size: np.ndarray, trains: np.ndarray, word: np.ndarray, state: np.ndarray) -> np.ndarray:
        lanes, out, at = len(size), np.zeros(len(size)), 0
        w = np.tile(self.weights, (lanes, 1)).view(np.complex128).ravel()  # four weights are moved as one number
        slots = np.tile(self.slots, lanes)
        while at < size[0]:
            live = int(np.searchsorted(-size, -at, "left"))
            steps = min(max(READY // live, 1), int(size[0]) - at)
            out[:live] += self._steps(texts, start[:live] + at, np.minimum(size[:live] - at, steps), word, state, w, slots)
            at += steps
        if trains.any():
            share = (size * trains / (size * trains).sum()).astype(np.float32)
            self.weights = (share @ w.view(np.float32).reshape(lanes, -1)).reshape(GATES, 4)
            self.slots = share @ slots.reshape(lanes, -1)
        return out

    def _steps(self, texts: Symbols, start: np.ndarray, size: np.ndarray, word: np.ndarray, state: np.ndarray, w: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Some steps of all lanes: the next symbol of each, then the one after it of those that have one."""
        step = np.arange(size.max())[:, None]
        here = step < size
        src = (start + step)[here]
        lane = np.broadcast_to(np.arange(len(start), dtype=np.int32), here.shape)[here]
        edges = (5 * np.concatenate([[0], np.cumsum(here.sum(1))])).tolist()
        sym, short, known = texts.sym.take(src), texts.short.take(src), state.take(src).astype(np.int32)
        two, four = self.tables.made()
        x = np.empty((len(src), 5, 4), np.int8)
        row = self.tables.row.take(short)
        for k, path in enumerate((two.take(texts.long(src) << np.uint32(5) | sym), four.take(row << np.int32(5) | sym), word.take(src))):
            x[:, :, k] = path.view(np.int8).reshape(-1, 8)[:, :5]
        x[:, :, 3] = _CONSTANT.take(sym, 0)
        gate = ((lane * GATES + (known * SHORT_STATES + self.tables.seen.take(short)) * 5)[:, None] + np.arange(5)).ravel()
        slot = _SLOTS.take((short & np.uint32(1023)) << np.uint32(5) | sym, 0)
        slot += (lane.astype(np.int64) << SLOT_BITS)[:, None]
        slot, x, towards = slot.ravel(), x.reshape(-1, 4), _TOWARDS.take(sym, 0).ravel()
        chance, one, rate, more = np.empty(len(gate), np.float32), np.float32(1), np.float32(RATE / UNIT), np.float32(SLOT_RATE)
        # Everything is said of what comes next: ``chance`` is the probability that the mixture gave it.
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            inputs, g, to, at = x[a:b].astype(np.float32), gate[a:b], towards[a:b], slot[a:b]
            weight, refined = w.take(g).view(np.float32).reshape(-1, 4), slots.take(at)
            dot = refined * to
            dot += np.vecdot(weight, inputs)
            np.exp(np.negative(dot, out=dot), out=dot)
            p = np.divide(one, dot + one, out=chance[a:b])
            wrong = one - p
            inputs *= (wrong * rate)[:, None]
            weight += inputs
            w[g] = weight.view(np.complex128).ravel()
            wrong *= more
            wrong *= to
            slots[at] = refined + wrong
        np.maximum(chance, np.float32(1e-6), out=chance)
        product = chance[::5] * chance[1::5]
        for k in (2, 3, 4):
            product *= chance[k::5]
        bits = -np.log2(product)
        return np.bincount(lane, bits, minlength=len(start))


def _trains(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS != HELD_OUT


def _planes(data: np.ndarray) -> bytes:
    """Numbers compressed byte by byte, the lowest bytes first."""
    return data.view(np.uint8).reshape(len(data), -1).T.tobytes()


def _pack(codes: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending codes and their counts."""
    return zstandard.compress(_planes(np.diff(codes, prepend=np.uint64(0))) + _planes(counts.astype(np.uint32)), 1)


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    n = len(raw) // 12
    step = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view(np.uint64).ravel()
    return np.cumsum(step, dtype=np.uint64), np.ascontiguousarray(raw[8 * n :].reshape(4, n).T).view(np.uint32).ravel()


def small(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes: exact below 128, then four steps for each doubling."""
    return np.where(counts < 128, counts, np.minimum(128 + 4 * np.log2(np.maximum(counts, 128) / 128), 255)).astype(np.uint8)


_LARGE = np.concatenate([np.arange(128), 128 * 2.0 ** (np.arange(128) / 4)]).astype(np.float32)


def _runs(codes: np.ndarray, shift: int) -> np.ndarray:
    """Where ascending codes without their lowest bits begin anew."""
    upper = codes >> codes.dtype.type(shift) if shift else codes
    return np.flatnonzero(np.concatenate([[True], upper[1:] != upper[:-1]])) if len(codes) else np.empty(0, np.int64)


def decisions(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For ascending codes and their totals: how often each of the five decisions went as in the code, and how often the other way (rows 0 to 4, 5 to 9)."""
    levels = []
    for shift in (5, 4, 3, 2, 1, 0):
        new = _runs(codes, shift)
        levels.append(np.repeat(np.add.reduceat(counts, new) if len(new) else counts, np.diff(np.append(new, len(codes)))))
    return np.array([*levels[1:], *(a - b for a, b in zip(levels[:-1], levels[1:], strict=True))])


def counted(texts: Symbols, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes of words so far, ascending, and their counts in training texts."""
    at, codes = texts.words()
    codes <<= np.uint64(1)
    codes |= np.repeat(learned, texts.sizes)[at]
    codes.sort()
    new = _runs(codes, 1)
    return codes[new] >> np.uint64(1), np.add.reduceat((codes & np.uint64(1)).astype(np.uint32), new) if len(new) else np.empty(0, np.uint32)


def parts(codes: np.ndarray, n: int) -> np.ndarray:
    """Where the codes of each bucket begin; a bucket has a range of codes."""
    return np.searchsorted((codes >> np.uint64(31)) * np.uint64(n) >> np.uint64(32), np.arange(n + 1, dtype=np.uint64))


def send(block: int, n: int, codes: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    edges = parts(codes, n)
    for i in np.flatnonzero(np.diff(edges)):
        yield int(i), block, _pack(codes[edges[i] : edges[i + 1]], counts[edges[i] : edges[i + 1]])


def _code_totals(table: pa.Table) -> pa.Table:
    """To each block, the totals of the decisions on the way to its codes and the counts of whole words; to block -1, the bucket's words and distinct words."""
    found = [_unpack(d.as_py()) for d in table["data"]]
    codes = np.concatenate([p[0] for p in found])
    counts = np.concatenate([p[1] for p in found]).astype(np.int64)
    order = np.argsort(codes)
    codes = codes[order]
    new = _runs(codes, 0)
    at = np.empty(len(codes), np.int32)
    at[order] = np.repeat(np.arange(len(new), dtype=np.int32), np.diff(np.append(new, len(codes))))
    every, total = codes[new], np.add.reduceat(counts[order], new)
    levels, ends = small(decisions(every, total)), (every & np.uint64(31)) == SPACE
    bucket, edges = table["bucket"][0].as_py(), np.cumsum([0, *(len(p[0]) for p in found)])
    out = [(bucket, -1, np.array([total[ends].sum(), (total[ends] > 0).sum()], np.int64).tobytes())]
    for i, block in enumerate(table["block"].to_pylist()):
        mine = at[edges[i] : edges[i + 1]]
        whole = total[mine[ends[mine]]]
        out.append((bucket, block, zstandard.compress(np.ascontiguousarray(levels[:, mine]).tobytes() + _planes(whole.astype(np.uint64)), 1)))
    return cell_table(out)


class Words:
    """The words so far in some texts: each place's code among the distinct ones, and what the buckets know of them."""

    def __init__(self, texts: Symbols, learned: np.ndarray, n: int, answers: dict[int, bytes]):
        self.places = len(texts.sym)
        self.at, codes = texts.words()
        self.doc = np.repeat(np.arange(len(texts.sizes), dtype=np.int32), texts.sizes)[self.at]
        self.learned, self.docs = learned, len(learned)
        self.predicts, self.ends = texts.rank[self.at] >= REACH, texts.sym[self.at] == SPACE
        order = np.argsort(codes)
        codes = codes[order]
        new = _runs(codes, 0)
        self.codes = codes[new]
        self.code = np.empty(len(order), np.int32)
        self.code[order] = np.repeat(np.arange(len(new), dtype=np.int32), np.diff(np.append(new, len(codes))))
        del order, codes
        edges, whole = parts(self.codes, n), (self.codes & np.uint64(31)) == SPACE
        self.total, self.count = np.zeros((10, len(self.codes)), np.uint8), np.zeros(len(self.codes), np.int64)
        for i in np.flatnonzero(np.diff(edges)):
            part = slice(edges[i], edges[i + 1])
            raw, size = np.frombuffer(zstandard.decompress(answers[int(i)]), np.uint8), edges[i + 1] - edges[i]
            self.total[:, part] = raw[: 10 * size].reshape(10, size)
            self.count[part][whole[part]] = np.ascontiguousarray(raw[10 * size :].reshape(8, -1).T).view(np.int64).ravel()

    def base(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: its words, those that training texts hold, and the sum of log10(count + 1)."""
        doc, count = self.doc[self.ends], self.count[self.code[self.ends]]
        return np.bincount(doc, minlength=self.docs), np.bincount(doc, count > 0, minlength=self.docs).astype(np.int64), np.bincount(doc, np.log10(count + 1.0), minlength=self.docs)

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """The word predictor's logits by place as in ``Tables.paths``, and its gate: short word, never seen, up to three times, oftener."""
        logit, state = np.zeros((self.places, 8), np.int8), np.zeros(self.places, np.uint8)
        at, code, doc = self.at[self.predicts], self.code[self.predicts], self.doc[self.predicts]
        own = self._own(code, doc)
        found = np.zeros((len(at), 8), np.int8)
        for k in range(5):
            same, other = _without(self.total[k].take(code), own[k + 1]), _without(self.total[k + 5].take(code), own[k] - own[k + 1])
            x = _LOGS.take(same)
            x -= _LOGS.take(other)
            found[:, k] = np.clip(np.rint(x, out=x), -127, 127, out=x)
            if not k:
                first = same.astype(np.int32) + other
        logit.view(np.uint64).ravel()[at] = found.view(np.uint64).ravel()
        state[at] = 1 + (first > 0).astype(np.uint8) + (first > 3)
        return logit.view(np.uint64).ravel(), state

    def _own(self, code: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
        """How often the place's own text has its context, with no, one, ... five decisions alike; 255 stands for that and more."""
        wide, far = max(1, len(self.codes)).bit_length(), max(1, len(code)).bit_length()
        key = doc.astype(np.int64) << wide | code
        if wide + far + self.docs.bit_length() < 64:  # sorting with the place in the low bits is faster than sorting places
            key <<= far
            key |= np.arange(len(key))
            key.sort()
            order = key & ((1 << far) - 1)
            key >>= far
        else:
            order = np.argsort(key)
            key = key[order]
        doc, code = key >> wide, self.codes.take(key & ((1 << wide) - 1))
        anew = np.ones(len(key), bool)
        np.not_equal(doc[1:], doc[:-1], out=anew[1:])
        # What the text has not taught is not in the totals either.
        taught = self.learned[doc]
        out = [np.empty(len(code), np.uint8) for _ in range(6)]
        for x in out:
            x[order] = taught
        some = np.arange(len(code))
        for k, shift in enumerate((5, 4, 3, 2, 1, 0)):
            upper = code >> np.uint64(shift)
            begins = anew.copy()
            begins[1:] |= upper[1:] != upper[:-1]
            new = np.flatnonzero(begins)
            size = np.diff(np.append(new, len(code)))
            size = np.repeat(np.minimum(size, 255).astype(np.uint8), size)
            out[k][order[some]] = size * taught[some]
            if not k:  # what the text has once is alone at all further decisions
                twice = size > 1
                some, code, anew = some[twice], code[twice], begins[twice]
        return out


_LOGS = (np.log(_LARGE + PRIOR) * UNIT).astype(np.float32)


def _without(total: np.ndarray, less: np.ndarray) -> np.ndarray:
    """Counts as bytes with something taken off."""
    out = total - np.minimum(total, less)
    if len(large := np.flatnonzero(total > 127)):
        out[large] = small(np.maximum(_LARGE[total[large]] - less[large], 0))
    return out


def _constants() -> tuple[bytearray, bytearray, bytearray, bytearray]:
    """Codes of bytes, numbers of symbols, and by two bytes: what ``_without`` leaves, and the logit of counts."""
    every = np.arange(256, dtype=np.uint8)
    less = np.array([_without(np.full(256, t, np.uint8), every) for t in every])
    logit = np.clip(np.rint(_LOGS[:, None] - _LOGS), -127, 127).astype(np.int8)
    return tuple(bytearray(x.tobytes()) for x in (_CODE, _VALUES, less, logit))


def _short_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch["data"]:
            codes, counts = _unpack(data.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int32)), pa.array(counts.astype(np.int64))], ["code", "n"])


def _short_tables(key, table):
    code = table["code"].to_numpy().astype(np.int64)
    packed = tables_part(code >> 10 << 5 | code & 31, table["n"].to_numpy())
    return pa.table({"nearest": pa.array([key[0].as_py()], pa.int32()), "data": pa.array([packed], pa.binary())})


def short_tables(sent: DataFrame) -> Tables:
    """Tables from what all blocks have counted; they are of one size for every corpus (34 MB), 32 parts of which are collected."""
    counts = sent.select("data").mapInArrow(_short_rows, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    parts = counts.withColumn("nearest", F.shiftright("code", 5).bitwiseAND(31)).groupBy("nearest").applyInArrow(_short_tables, "nearest int, data binary")
    out = Tables()
    for row in parts.collect():
        out.put(row["nearest"], row["data"])
    return out


def score(docs: DataFrame) -> DataFrame:
    """Scores of all texts under the model learned from the training texts.

    Returns ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``,
    ``base_score``, ``score``, ``n_bytes`` and ``bits_per_byte``.
    """
    blocks, n = by_block(docs, "doc_id", "text", block_bytes=TEXT_BYTES)
    ends = docs.filter(F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS != HELD_OUT, F.lit(False))).count()

    def prepared(table: pa.Table) -> tuple[Symbols, np.ndarray]:
        learned = np.array([_trains(i) for i in table["doc_id"].to_pylist()], bool)
        return Symbols([symbols(t.as_py()) for t in table["text"]]), learned

    def first(key, table):
        texts, learned = prepared(table)
        block = key[0].as_py()
        return cell_table([(-1, block, _pack(*short_counts(texts, learned))), *send(block, n, *counted(texts, learned))])

    # Bucket -1 has the counts by a few symbols; the others have ranges of words so far.
    sent = stored(blocks.groupBy("block").applyInArrow(first, CELL), "sent")
    collected(docs.sparkSession)
    tables = docs.sparkSession.sparkContext._jsc.broadcast(short_tables(sent.filter("bucket < 0")).packed())
    collected(docs.sparkSession)
    answers = stored(sent.filter("bucket >= 0").groupBy("bucket").applyInArrow(_code_totals, CELL), "totals")
    removed(sent)
    # One small row for each bucket, read one partition at a time.
    sums = np.zeros(2, np.int64)
    for row in answers.filter("block = -1").select("data").toLocalIterator():
        sums += np.frombuffer(row["data"], np.int64)
    collected(docs.sparkSession)
    tokens, distinct = int(sums[0]) + ends, int(sums[1]) + (ends > 0)

    mixing = instance(docs.sparkSession, "Mixing")
    mixing.setup(tables, *_constants(), n, ends, tokens, distinct)
    schema = "array<struct<doc_id: long, held_out: boolean, n_tokens: long, n_known: long, train_tokens: long, base_score: double, score: double, n_bytes: long, bits_per_byte: double>>"
    # A block's rows are dealt out once, and gathered where they are.
    texts = blocks.repartition("block").groupBy("block").agg(F.collect_list(F.struct("doc_id", F.col("text").cast("binary").alias("text"))).alias("texts"))
    found = answers.filter("block >= 0").repartition("block").groupBy("block").agg(F.collect_list(F.struct("bucket", "data")).alias("answers"))
    joined = texts.hint("merge").join(found, "block", "left").select(F.struct("texts", F.coalesce("answers", F.array()).alias("answers")).alias("block"))
    return joined.select(Column(mixing.of("block", schema)).alias("scores")).select(F.inline("scores"))


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the ``op2_lm_scoring`` query."""
    return score(docs)
