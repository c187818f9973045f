"""SentencePiece encoding with several distinct sampled segmentations, and decoding.

All segmentations of a text form a lattice whose paths have a weight, the product of their
pieces'. Adding a Gumbel variable to each path's log probability and taking the ``k``
largest draws ``k`` different paths without replacement. The paths are not listed: the
largest value of a set of paths that share a beginning is itself Gumbel distributed around
the set's log mass, so an A* search keeps beginnings in order of that value. A set is taken
from the frontier, one of its paths is drawn, which has the set's value, and the other paths
fall into the sets that leave it at one of its decisions, whose values are drawn given the
maximum that is already known; only the best that can still matter stay in the frontier. The
first ``k`` paths are the sample; the value of the next one is the threshold from which each
path's inclusion probability follows.

The texts of a batch are searched together: one round takes the best set of every text, and
all of their words go through the lattice side by side. A word's lattice is made once and
kept by the worker. Random numbers are hashes of the row's key, the round and the place.

Weights follow the rank of a piece in the vocabulary: ``(rank + 2) ** -alpha``. Partitions,
batches and repeated runs make no difference.

Defined results: a null or empty text has one segmentation, the empty one; fewer than ``k``
segmentations give fewer rows, each with inclusion 1; characters outside the vocabulary are
written as bytes; repeated rows get the same samples; an empty table gives an empty result;
only the key columns and ``text`` are read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.llm.windows import mixed

MODEL = "piece_bpe_32k.model"
SAMPLES = 4
ALPHA = 0.5
SEED = 11
#: Lattice nodes that a worker keeps; beyond, it starts anew.
NODES = 1_000_000
#: Characters of the texts that are searched together.
TOGETHER = 1 << 17
#: Characters that the table of beginnings has columns for, and of the longest words whose lattices are made together.
CLASSES, LONGEST = 256, 64
_MARK = "▁"
#: The marked text is cut before each mark that follows another character; pieces never cross these cuts.
_WORDS = re.compile(f"{_MARK}+[^{_MARK}]*")

_vocabularies: dict[tuple, "Vocabulary"] = {}


class _Grown:
    """An array that rows are added to."""

    def __init__(self, kind):
        self.data, self.size = np.empty(1 << 12, kind), 0

    def add(self, rows: list | np.ndarray) -> None:
        end = self.size + len(rows)
        if end > len(self.data):
            self.data = np.concatenate([self.data, np.empty(max(end, len(self.data)), self.data.dtype)])
        self.data[self.size : end] = rows
        self.size = end


class Vocabulary:
    """Pieces with their log weights, and the lattices of the words met so far.

    A lattice node is a place in a word; its options are the pieces that begin there, with
    their log probability at this node (``log``), their probability, the log mass of the
    node's other options (``rest``), the node they lead to (-1: the word's end) and their
    unit. A unit is a piece's id, or beyond those, the byte ids of a character.
    """

    def __init__(self, processor, alpha: float):
        self.processor, self.alpha = processor, alpha
        self.pieces: dict[str, tuple[int, float]] = {}
        self.bytes: list[tuple[int, float]] = [(0, 0.0)] * 256
        size = processor.get_piece_size()
        for i in range(size):
            piece = processor.id_to_piece(i)
            weight = -alpha * math.log(2 - min(processor.get_score(i), 0.0))
            if processor.is_byte(i):
                # Bytes have no rank: they weigh as much as the rarest piece.
                self.bytes[int(piece[3:5], 16)] = (i, -alpha * math.log(2 + size))
            elif not (processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i)):
                self.pieces[piece] = (i, weight)
        self.beginnings = {p[:i] for p in self.pieces for i in range(1, len(p) + 1)}
        self._trie()
        self.forget()

    def _trie(self) -> None:
        """The beginnings of pieces as a table: a row for each that goes on, a column for each of the most frequent characters."""
        counts = Counter(c for p in self.pieces for c in p)
        # The last class is of characters in no piece, 0 of those that have no column.
        self.classes = np.full(1 << 14, CLASSES - 1, np.uint8)
        classes = {c: i for i, (c, _) in enumerate(counts.most_common(CLASSES - 2), 1) if ord(c) < len(self.classes)}
        for c in counts:
            if ord(c) < len(self.classes):
                self.classes[ord(c)] = classes.get(c, 0)
        known = [b for b in self.beginnings if all(c in classes for c in b)]
        place = {b: i for i, b in enumerate(known, 1)} | {"": 0}
        parents = {b[:-1] for b in known}
        row = {b: i for i, b in enumerate(sorted(parents), 1)}
        self.row = np.zeros(len(known) + 1, np.int32)
        for b, i in row.items():
            self.row[place[b]] = i
        self.step = np.zeros((len(row) + 1, CLASSES), np.int32)
        self.piece, self.weight = np.full(len(known) + 1, -1, np.int64), np.zeros(len(known) + 1)
        for b in known:
            self.step[row[b[:-1]], classes[b[-1]]] = place[b]
            if b in self.pieces:
                self.piece[place[b]], self.weight[place[b]] = self.pieces[b]

    def forget(self) -> None:
        size = self.processor.get_piece_size()
        self.roots: dict[str, int] = {}
        self.characters: dict[str, tuple[int, float]] = {}
        self.first, self.many = _Grown(np.int64), _Grown(np.int64)
        self.log, self.share, self.rest = _Grown(np.float64), _Grown(np.float64), _Grown(np.float64)
        self.next, self.unit = _Grown(np.int64), _Grown(np.int64)
        self.unit_first, self.unit_many, self.ids = _Grown(np.int64), _Grown(np.int64), _Grown(np.int32)
        self.unit_first.add(list(range(size)))
        self.unit_many.add([1] * size)
        self.ids.add(list(range(size)))

    def _character(self, c: str) -> tuple[int, float]:
        """The unit and weight of a character written as bytes."""
        if c not in self.characters:
            raw = [self.bytes[b] for b in c.encode()]
            self.characters[c] = (self.unit_first.size, sum(b[1] for b in raw))
            self.unit_first.add([self.ids.size])
            self.unit_many.add([len(raw)])
            self.ids.add([b[0] for b in raw])
        return self.characters[c]

    def options(self, word: str) -> list[list[tuple[int, int, float]]]:
        """For each place the options: characters, unit, log weight."""
        out, n, beginnings, pieces = [], len(word), self.beginnings, self.pieces
        for i in range(n):
            here, j = [], i + 1
            while j <= n and (part := word[i:j]) in beginnings:
                if part in pieces:
                    here.append((j - i, *pieces[part]))
                j += 1
            if not here or here[0][0] > 1:
                here.insert(0, (1, *self._character(word[i])))
            out.append(here)
        return out

    def learn(self, new: list[str]) -> None:
        """Make the lattices of many words at once; ``root`` makes those of long words and of rare characters one by one."""
        lengths = np.array([len(w) for w in new], np.int64)
        codes = np.frombuffer("".join(new).encode("utf-32-le"), np.uint32)
        kind = self.classes.take(np.minimum(codes, len(self.classes) - 1))
        kind[codes >= len(self.classes) - 1] = 0
        start = np.cumsum(lengths) - lengths
        plain = (lengths <= LONGEST) & (np.minimum.reduceat(kind, start) > 0) if len(new) else np.empty(0, bool)
        for i in np.flatnonzero(~plain).tolist():
            self.root(new[i])
        if not plain.any():
            return
        kind = kind[np.repeat(plain, lengths)]
        words, lengths = [w for w, p in zip(new, plain.tolist(), strict=True) if p], lengths[plain]
        start = np.cumsum(lengths) - lengths
        n = int(lengths.sum())
        left = np.repeat(start + lengths, lengths) - np.arange(n)  # characters from here to the word's end
        at, node, size, found = np.arange(n), np.zeros(n, np.int32), 0, []
        while len(at):
            node = self.step[self.row.take(node), kind.take(at + size)]
            alive = node > 0
            at, node, size = at[alive], node[alive], size + 1
            piece = self.piece.take(node)
            has = piece >= 0
            found.append((at[has], np.full(has.sum(), size), piece[has], self.weight.take(node[has])))
            on = left.take(at) > size
            at, node = at[on], node[on]
        bare = np.ones(n, bool)
        bare[found[0][0]] = False
        if bare.any():  # no piece of this character alone
            text = "".join(words)
            more = [self._character(text[i]) for i in np.flatnonzero(bare).tolist()]
            found.append((np.flatnonzero(bare), np.ones(len(more), np.int64), np.array([u for u, _ in more], np.int64), np.array([w for _, w in more])))
        at, size, unit, weight = (np.concatenate(x) for x in zip(*found, strict=True))
        # From the words' ends to their beginnings: the log mass of all ways on from each place.
        order = np.lexsort((size, at, left[at]))
        at, size, unit, weight = at[order], size[order], unit[order], weight[order]
        mass, value = np.zeros(n + 1), np.empty(len(at))
        edges = np.searchsorted(left[at], np.arange(1, int(lengths.max()) + 2))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            here, to = at[a:b], at[a:b] + size[a:b]
            v = value[a:b] = weight[a:b] + np.where(size[a:b] == left[here], 0.0, mass.take(to))
            new_ = np.flatnonzero(np.concatenate([[True], here[1:] != here[:-1]])) if b > a else np.empty(0, np.int64)
            if b > a:
                top = np.maximum.reduceat(v, new_)
                many = np.diff(np.append(new_, b - a))
                mass[here[new_]] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, many)), new_))
        log = value - mass.take(at)
        order = np.lexsort((size, at))
        at, size, unit, log = at[order], size[order], unit[order], log[order]
        many = np.bincount(at, minlength=n)
        first = np.cumsum(many) - many
        log[many[at] == 1] = 0.0
        share = np.exp(log)
        small = np.where(share > 0.5, 0.0, share)
        # At most one option has over half; what the others have is added up without it.
        others = np.where(share > 0.5, np.add.reduceat(small, first)[at], np.add.reduceat(share, first)[at] - share)
        with np.errstate(divide="ignore"):
            rest = np.log(np.maximum(others, 0.0))
        base, options = self.first.size, self.log.size
        to = np.where(size < left[at], base + at + size, -1)
        for grown, rows in ((self.first, options + first), (self.many, many), (self.log, log), (self.share, share), (self.rest, rest), (self.next, to), (self.unit, unit)):
            grown.add(rows)
        self.roots.update(zip(words, (base + start).tolist(), strict=True))

    def root(self, word: str) -> int:
        """The first node of a word's lattice."""
        if word in self.roots:
            return self.roots[word]
        options, n, base, at = self.options(word), len(word), self.first.size, self.log.size
        mass, exp, log = [0.0] * (n + 1), math.exp, math.log
        first, many, logs, shares, rests, to, units = [], [], [], [], [], [], []
        for i in range(n - 1, -1, -1):
            values = [w + mass[i + size] for size, _, w in options[i]]
            if len(values) == 1:
                mass[i] = values[0]
                continue
            top = max(values)
            mass[i] = top + log(sum(exp(v - top) for v in values))
        for i, here in enumerate(options):
            first.append(at + len(logs))
            many.append(len(here))
            if len(here) == 1:
                logs.append(0.0)
                shares.append(1.0)
                rests.append(-math.inf)
            else:
                mine = [w + mass[i + size] - mass[i] for size, _, w in here]
                share = [exp(x) for x in mine]
                logs += mine
                shares += share
                for k in range(len(share)):
                    other = sum(share[:k]) + sum(share[k + 1 :])
                    rests.append(log(other) if other else -math.inf)
            for size, unit, _ in here:
                to.append(base + i + size if i + size < n else -1)
                units.append(unit)
        for grown, rows in ((self.first, first), (self.many, many), (self.log, logs), (self.share, shares), (self.rest, rests), (self.next, to), (self.unit, units)):
            grown.add(rows)
        self.roots[word] = base
        return base


def vocabulary(path: str | None, alpha: float) -> Vocabulary:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    if (path, alpha) not in _vocabularies:
        from sentencepiece import SentencePieceProcessor

        _vocabularies[path, alpha] = Vocabulary(SentencePieceProcessor(model_file=path), alpha)
    return _vocabularies[path, alpha]


def words(text: str) -> list[str]:
    return _WORDS.findall(_MARK + text.replace(" ", _MARK))


def _uniform(seed: np.ndarray, *places) -> np.ndarray:
    """Numbers between 0 and 1 that depend on the seed and the places only."""
    h = seed
    for x in places:
        h = mixed(h + np.uint64(0x9E3779B97F4A7C15) * (np.asarray(x).astype(np.uint64) + np.uint64(1)))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of several ranges, one after the other."""
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(start - before, size)


class _Paths:
    """A path for some rows: the options in order, and the log probability before each."""

    def __init__(self, size: np.ndarray, option: np.ndarray, before: np.ndarray, node: np.ndarray, word: np.ndarray):
        self.size, self.option, self.before, self.node, self.word = size, option, before, node, word
        self.start = np.cumsum(size) - size


class _Search:
    """The A* search over a batch of texts."""

    def __init__(self, v: Vocabulary, texts: list[str], k: int, seeds: np.ndarray):
        self.v, self.k, self.n = v, k, len(texts)
        if v.first.size > NODES:
            v.forget()
        found = [words(t) if t else [] for t in texts]
        v.learn([w for w in {w for x in found for w in x} if w not in v.roots])
        each = [[v.roots[w] for w in x] for x in found]
        self.words = np.array([len(x) for x in each], np.int64)
        self.first_word = np.cumsum(self.words) - self.words
        self.roots = np.array([r for x in each for r in x], np.int64)
        self.seed = mixed(seeds.astype(np.uint64))
        # The frontier: row, value, log mass before, round and decision of the path that is left, and options not to take.
        self.frontier = tuple(np.empty(0, t) for t in (np.int64, np.float64, np.int64, np.int64, np.int64))
        self.rounds: list[_Paths] = []
        self.values = np.full((k + 1, self.n), -np.inf)
        self.logs = np.zeros((k + 1, self.n))

    def run(self) -> None:
        everyone = np.arange(self.n)
        value = -np.log(-np.log(_uniform(self.seed, everyone * 0, everyone * 0)))
        none, empty = np.empty(0, np.int64), np.zeros(self.n, np.int64)
        nothing = _Paths(empty, none, np.empty(0), none, none)
        self._draw(0, everyone, value, np.zeros(self.n), empty, np.full(self.n, -1), nothing)
        for turn in range(1, self.k + 1):
            row, value, turns, at, taken = self.frontier
            order = np.lexsort((-value, row))
            row, value, turns, at, taken = (x[order] for x in (row, value, turns, at, taken))
            if not len(row):  # no text has another segmentation
                self.rounds.append(nothing)
                continue
            head = np.concatenate([[True], row[1:] != row[:-1]])
            # A set can still matter if it is among the best that are left to take.
            begin = np.flatnonzero(head)
            rank = np.arange(len(row)) - np.repeat(begin, np.diff(np.append(begin, len(row))))
            stay = ~head & (rank < self.k - turn + 1)
            self.frontier = tuple(x[stay] for x in (row, value, turns, at, taken))
            self._take(turn, *(x[head] for x in (row, value, turns, at, taken)))

    def _take(self, turn: int, row: np.ndarray, value: np.ndarray, turns: np.ndarray, at: np.ndarray, taken: np.ndarray) -> None:
        """Leave paths at a decision: draw another option there, and put what then remains back."""
        v = self.v
        before, node, word = np.zeros(len(row)), np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        for t in np.unique(turns).tolist():
            some, p = turns == t, self.rounds[t]
            where = p.start[row[some]] + at[some]
            before[some], node[some], word[some] = p.before[where], p.node[where], p.word[where]
        first, many = v.first.data[node], v.many.data[node]
        most = int(many.max())
        share = np.zeros((len(row), most))
        for j in range(most):
            free = (j < many) & (taken >> j & 1 == 0)
            share[free, j] = v.share.data[first[free] + j]
        total = share.cumsum(1)
        u = _uniform(self.seed[row], np.full(len(row), turn), at * 0 + 1) * total[:, -1]
        choice = np.minimum((total <= u[:, None]).sum(1), most - 1)
        # Rounding may point at an option that is not free: take the likeliest then.
        bad = share[np.arange(len(row)), choice] <= 0
        choice[bad] = share[bad].argmax(1)
        taken = taken | np.int64(1) << choice
        share[np.arange(len(row)), choice] = 0
        left = share.sum(1)
        rest = left > 0
        self._put(row[rest], before[rest] + np.log(left[rest]), value[rest], _uniform(self.seed[row[rest]], np.full(rest.sum(), turn), np.full(rest.sum(), 2)), turns[rest], at[rest], taken[rest])
        option = first + choice
        # The path up to there, with the new option.
        size, kept = np.zeros(self.n, np.int64), []
        size[row] = at + 1
        for t in np.unique(turns).tolist():
            some, p = turns == t, self.rounds[t]
            kept.append((np.repeat(row[some], at[some]), *(x[_ranges(p.start[row[some]], at[some])] for x in (p.option, p.before, p.node, p.word))))
        kept.append((row, option, before, node, word))
        parts = [np.concatenate(x) for x in zip(*kept, strict=True)]
        order = np.argsort(parts[0], kind="stable")
        prefix = _Paths(size, *(x[order] for x in parts[1:]))
        to = v.next.data[option]
        self._draw(turn, row, value, before + v.log.data[option], np.where(to < 0, word + 1, word), to, prefix)

    def _draw(self, turn: int, row: np.ndarray, value: np.ndarray, given: np.ndarray, word: np.ndarray, node: np.ndarray, prefix: _Paths) -> None:
        """Draw the rest of a path for each of ``row`` from ``word`` on, first at ``node`` (-1: at the word's beginning)."""
        v, left = self.v, self.words[row] - word
        index = _ranges(word, left)  # word of the row
        owner = np.repeat(np.arange(len(row)), left)
        at = self.roots[self.first_word[row[owner]] + index]
        begins = np.flatnonzero(left > 0)
        inside = begins[node[begins] >= 0]
        at[(np.cumsum(left) - left)[inside]] = node[inside]
        live, seed, step = np.arange(len(at)), self.seed[row[owner]], 0
        entries, nodes, options = [], [], []
        while len(live):
            here = at[live]
            option, last = v.first.data[here], v.first.data[here] + v.many.data[here] - 1
            todo = np.flatnonzero(option < last)
            u = _uniform(seed[live[todo]], np.full(len(todo), turn), index[live[todo]] + 3, np.full(len(todo), step))
            while len(todo):
                u -= v.share.data[option[todo]]
                on = u >= 0
                todo, u = todo[on], u[on]
                option[todo] += 1
                on = option[todo] < last[todo]
                todo, u = todo[on], u[on]
            entries.append(live)
            nodes.append(here)
            options.append(option)
            at[live] = to = v.next.data[option]
            live, step = live[to >= 0], step + 1
        entry = np.concatenate([np.empty(0, np.int64), *entries])
        order = np.argsort(entry, kind="stable")
        entry = entry[order]
        node, option = (np.concatenate([np.empty(0, np.int64), *x])[order] for x in (nodes, options))
        who, log = owner[entry], v.log.data[option]
        size = np.bincount(who, minlength=len(row))
        begin = np.cumsum(size) - size
        total = np.concatenate([[0.0], np.cumsum(log)])
        before = given[who] + total[:-1] - total[begin[who]]
        end = given + total[begin + size] - total[begin]
        # What leaves the path at one of its new decisions.
        place = np.arange(len(who)) - begin[who] + prefix.size[row[who]]
        some = np.flatnonzero(v.many.data[node] > 1)
        rest = v.rest.data[option[some]]
        some, rest = some[rest > -np.inf], rest[rest > -np.inf]
        r = row[who[some]]
        u = _uniform(self.seed[r], np.full(len(r), turn), place[some] + 3, np.full(len(r), 1 << 40))
        self._put(r, before[some] + rest, value[who[some]], u, np.full(len(r), turn), place[some], np.int64(1) << (option[some] - v.first.data[node[some]]))
        self.values[turn, row], self.logs[turn, row] = value, end
        sizes = prefix.size.copy()
        sizes[row] += size
        rows = np.concatenate([np.repeat(np.arange(self.n), prefix.size), row[who]])
        order = np.argsort(rows, kind="stable")
        joined = ((prefix.option, option), (prefix.before, before), (prefix.node, node), (prefix.word, index[entry]))
        self.rounds.append(_Paths(sizes, *(np.concatenate(x)[order] for x in joined)))

    def _put(self, row: np.ndarray, mass: np.ndarray, most: np.ndarray, u: np.ndarray, turns: np.ndarray, at: np.ndarray, taken: np.ndarray) -> None:
        """Add sets to the frontier: the largest value in each is Gumbel distributed around its mass, given that it is below ``most``."""
        value = mass - np.log(np.exp(mass - most) - np.log(u))
        if len(row) > 4 * self.n:  # only the best few of each row can matter
            order = np.lexsort((-value, row))
            first = np.searchsorted(row[order], row[order])
            order = order[np.arange(len(row)) - first < self.k]
            row, value, turns, at, taken = (x[order] for x in (row, value, turns, at, taken))
        self.frontier = tuple(np.concatenate(x) for x in zip(self.frontier, (row, value, turns, at, taken), strict=True))

    def samples(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """By row and draw: row, number of the draw from 1, ids (sizes, flat), log probability, inclusion probability."""
        found = self.values[: self.k].T > -np.inf
        row, turn = np.nonzero(found)
        size = np.array([p.size for p in self.rounds[: self.k]])[turn, row] if len(row) else np.empty(0, np.int64)
        start = np.array([p.start for p in self.rounds[: self.k]])[turn, row] if len(row) else np.empty(0, np.int64)
        shift = np.cumsum([0, *(len(p.option) for p in self.rounds[: self.k])])
        option = np.concatenate([p.option for p in self.rounds[: self.k]])[_ranges(start + shift[turn], size)] if len(row) else np.empty(0, np.int64)
        unit = self.v.unit.data[option]
        many = self.v.unit_many.data[unit]
        ids = self.v.ids.data[_ranges(self.v.unit_first.data[unit], many)]
        edges = np.concatenate([[0], np.cumsum(many)])
        ends = np.cumsum(size)
        with np.errstate(over="ignore"):
            log, threshold = self.logs[turn, row], self.values[self.k, row]
            inclusion = np.where(threshold == -np.inf, 1.0, -np.expm1(-np.exp(np.minimum(log - threshold, 700.0))))
        return row, turn + 1, edges[ends] - edges[ends - size], ids, log, inclusion


def sample_many(v: Vocabulary, texts: list[str], k: int, seeds: list[int]) -> tuple[np.ndarray, ...]:
    """Up to ``k`` distinct segmentations of each text, as ``_Search.samples`` returns them."""
    search = _Search(v, texts, k, np.array(seeds, np.uint64))
    search.run()
    return search.samples()


def sample(v: Vocabulary, text: str | None, k: int, seed: int) -> list[tuple[list[int], float, float]]:
    """Up to ``k`` distinct segmentations in the order drawn: ids, log probability, inclusion probability."""
    if not text:
        return [([], 0.0, 1.0)]
    _, _, size, ids, log, inclusion = sample_many(v, [text], k, [seed])
    parts = np.split(ids, np.cumsum(size)[:-1])
    return [(p.tolist(), x, y) for p, x, y in zip(parts, log.tolist(), inclusion.tolist(), strict=True)]


def encode(rows: DataFrame, keys: tuple[str, ...], k: int = SAMPLES, alpha: float = ALPHA, model_path: str | None = None, seed: int = SEED) -> DataFrame:
    """A row for each sampled segmentation: the keys, ``sample`` from 1, ``ids``, ``log_probability``, ``inclusion``."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model_path, alpha)
        names = [*keys, "sample", "ids", "log_probability", "inclusion"]
        for batch in batches:
            key_rows = list(zip(*(batch[c].to_pylist() for c in keys), strict=True))
            texts = [x or "" for x in batch["text"].to_pylist()]
            edges = np.flatnonzero(np.diff(np.cumsum([len(t) for t in texts]) // TOGETHER, prepend=-1)).tolist() if texts else []
            for a, b in zip(edges, [*edges[1:], len(texts)], strict=True):
                row, turn, size, ids, log, inclusion = sample_many(v, texts[a:b], k, [zlib.crc32(repr((seed, *key)).encode()) for key in key_rows[a:b]])
                take = pa.array(row + a)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch[c].take(take) for c in keys), pa.array(turn, pa.int32()), lists, pa.array(log), pa.array(inclusion)], names)

    chosen = rows.select(*keys, "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema if f.name in keys)
    return chosen.mapInArrow(apply, f"{fields}, sample int, ids array<int>, log_probability double, inclusion double")


def decode(rows: DataFrame, ids: str = "ids", model_path: str | None = None) -> DataFrame:
    """``rows`` with ``decoded``, the text of the ids."""
    columns = [c for c in rows.columns if c != "decoded"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = vocabulary(model_path, ALPHA).processor
        for batch in batches:
            texts = [None if x is None else processor.decode(x) for x in batch[ids].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*columns, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*columns).schema)
    return rows.select(*columns).mapInArrow(apply, f"{fields}, decoded string")


def digest(turns: DataFrame) -> DataFrame:
    """The columns of the ``op7_sentencepiece_sampling`` query: each sample's size and checks, and a CRC of the decoded text."""
    keyed = turns.select("conv_id", "turn", "text")
    out = decode(encode(keyed, ("conv_id", "turn")))
    return out.select("conv_id", "turn", "sample", F.size("ids").cast("long").alias("n_ids"), F.crc32(F.array_join(F.col("ids"), " ")).alias("ids_crc32"), "log_probability", "inclusion", F.crc32("decoded").alias("decoded_crc32"))
