"""Language-model scoring by online logistic context mixing.

A text is the bytes of its lower-cased words, each closed by a space, then an end sign. Each byte is coded as a few binary
choices. For each choice one predictor for each order in ORDERS looks up counts of zeros and ones under a hash of the last bytes,
across words; another does so under the word so far (its last REACH bytes), one knows the byte before, and the last one follows what came
next where another training text had the same SEED words. Their log odds are added with weights, which are gated by what the longest contexts
have seen and by how long the follower has been right, and by how much each predictor has seen. An adaptive map refines the sum
for each choice. The probability of every byte comes from this mixture; -log2 of the text's, over its bytes, is its bits per byte.

Learning covers all training texts. Counts are summed over tasks in tables of fixed size. The weights and the map are learnt
online, step by step, in each task, from predictions that leave the byte at hand out of the counts, and are averaged over
tasks by how often each was used. Scoring doesn't change them, so a score doesn't depend on which texts share a task. Bytes that
have all their contexts in common are predicted once in a block of texts.

Words' counts and runs of words that training texts share grow with the input and are never sent whole: each block of texts
lists its distinct words and runs, packed by ranges of hashes; each range is summed by a task, and each block gets its own back. So no key has
more entries than there are blocks, and every step is the same at any size.

Defined cases: a null or empty text has one token, its end; a null doc_id belongs to the training rows; without training rows
all counts are 0 and each choice is even; rows that repeat count and are scored one by one, and are not foretold from rows with their own doc_id;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import documents, drop, new_path, written
from .text import Words, blocks, column, grams_by_doc, release

ORDERS, REACH = (2, 4, 5), 7
#: Slots of the tables of ORDERS, and of the word so far, as powers of two.
SLOTS = (18, 21, 21, 21)
#: Bytes of text in a block, for each range of hashes, and for each task that counts.
BLOCK, RANGE, TALLY = 6 << 20, 32 << 20, 40 << 20
#: Words of a run that may be followed, and one run in so many that is looked up.
SEED, EVERY = 6, 16
#: Different bytes that are predicted at once.
STEP = 1 << 14
_ID = "coalesce(doc_id, 9223372036854775806)"
HELD_OUT = "coalesce(pmod(crc32(CAST(doc_id AS STRING)), 7) = 2, false)"

_SPACE, _END = 32, 10
_TABLES = len(SLOTS)
_PART = 1 << 15
_AT = np.append(0, np.cumsum([1 << s for s in SLOTS]))
_RUNS = np.array([1] * 4 + [2] * 12 + [3] * 16 + [4])  # 1 + how long the follower has been right, in four steps
_DELTA, _BINS, _GATES, _CONF = 0.4, 64, 45, 8
_KEEP = np.array([(1 << 64) - (1 << 8 * (REACH - max(k, max(ORDERS)))) for k in range(REACH + 1)], np.uint64)
_OWN = np.array([(1 << 64) - (1 << 8 * (REACH - k)) for k in range(REACH)], np.uint64)
_LOW7, _HIGH, _SPACES = np.uint64(0x007F7F7F7F7F7F7F), np.uint64(0x0080808080808080), np.uint64(0x0020202020202020)
_MUL, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

#: A slot holds its counts of zeros and ones as one of 256 states: up to EXACT choices exactly, more as one of LEVELS log odds and a size.
EXACT, LEVELS, SIZES = 13, 50, (20, 50, 200)
_FEW = (EXACT + 1) * (EXACT + 2) // 2
_LEVEL = np.linspace(-7, 7, LEVELS)


def states(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """The state of each pair of counts."""
    n = n0 + n1
    few = n * (n + 1) // 2 + n1
    odds = np.log(n1 + _DELTA) - np.log(n0 + _DELTA)
    level = np.rint((odds.clip(-7, 7) + 7) * ((LEVELS - 1) / 14)).astype(np.int64)
    size = (n >= 30).astype(np.int64) + (n >= 100)
    return np.where(n <= EXACT, few, _FEW + size * LEVELS + level).astype(np.uint8)


def _meaning() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each state its log odds, its number of choices, and the state without a zero and without a one."""
    n0, n1 = np.zeros(256), np.zeros(256)
    for n in range(EXACT + 1):
        for k in range(n + 1):
            n0[n * (n + 1) // 2 + k], n1[n * (n + 1) // 2 + k] = n - k, k
    for i, size in enumerate(SIZES):
        one = np.clip((size + 2 * _DELTA) / (1 + np.exp(-_LEVEL)) - _DELTA, 0, size)
        n0[_FEW + i * LEVELS : _FEW + (i + 1) * LEVELS], n1[_FEW + i * LEVELS : _FEW + (i + 1) * LEVELS] = size - one, one
    odds = np.log(n1 + _DELTA) - np.log(n0 + _DELTA)
    odds[_FEW : _FEW + 3 * LEVELS] = np.tile(_LEVEL, 3)
    less = []
    for a, b in ((np.maximum(n0 - 1, 0), n1), (n0, np.maximum(n1 - 1, 0))):
        few = (a + b + 0.5).astype(np.int64) <= EXACT
        x = states(np.where(few, np.rint(a), a).astype(np.float64), np.where(few, np.rint(b), b).astype(np.float64))
        x[_FEW:] = np.where(np.arange(_FEW, 256) < _FEW + 3 * LEVELS, _nearest(a[_FEW:], b[_FEW:], np.arange(_FEW, 256)), 0)
        less.append(x)
    return odds.astype(np.float32), n0 + n1, np.concatenate(less).astype(np.uint8)


def _nearest(n0: np.ndarray, n1: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The state of the same size with the log odds of these counts."""
    odds = np.log(n1 + _DELTA) - np.log(n0 + _DELTA)
    return _FEW + (state - _FEW) // LEVELS * LEVELS + np.rint((odds.clip(-7, 7) + 7) * ((LEVELS - 1) / 14))


_ODDS, _COUNT, _LESS = _meaning()
_SEEN = np.minimum(_CONF - 1, np.log2(_COUNT + 1)).astype(np.int64)
_SOME = np.minimum(2, np.log2(_COUNT + 1)).astype(np.int64)  # nothing, one or two, more
_SOMES = 3 * _SOME


class Code:
    """A prefix code of bytes for each byte before them (0 at first), by their counts: the inner nodes on the way to each byte, and the turns taken there."""

    def __init__(self, counts: np.ndarray):
        """counts: of each byte after each byte."""
        rows = [counts.sum(axis=0), *(c for c in counts if c.any())]
        self.own = np.zeros(256, np.int32)
        self.own[counts.any(axis=1)] = np.arange(1, len(rows))
        nodes, turns, lengths = [], [], []
        self.odds = np.zeros(len(rows) * 256, np.float32)
        for r, row in enumerate(rows):
            heap = [(float(c) + 0.01, i, i) for i, c in enumerate(row)]
            heapq.heapify(heap)
            parent: dict[int, tuple[int, int]] = {}
            for node in range(256, 511):
                (x, _, a), (y, _, b) = heapq.heappop(heap), heapq.heappop(heap)
                parent[a], parent[b] = (node, 0), (node, 1)
                self.odds[r * 256 + node - 256] = np.log(y + _DELTA) - np.log(x + _DELTA)
                heapq.heappush(heap, (x + y, node, node))
            for b in range(256):
                way, at = [], b
                while at in parent:
                    at, turn = parent[at]
                    way.append((r * 256 + at - 256, turn))
                lengths.append(len(way))
                nodes += [n for n, _ in reversed(way)]
                turns += [t for _, t in reversed(way)]
        self.length = np.array(lengths, np.int32)
        self.first = (np.cumsum(self.length) - self.length).astype(np.int32)
        self.node, self.turn = np.array(nodes, np.int32), np.array(turns, np.uint8)
        self._toward: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_toward": None}

    def toward(self, row: np.ndarray, node: np.ndarray) -> np.ndarray:
        """1 and -1 if the way to a byte (row: 256 times its code and the byte) takes that turn at a node, else 0."""
        if self._toward is None:
            self._toward = np.zeros((len(self.length), 256), np.int8)
            self._toward[np.repeat(np.arange(len(self.length)), self.length), self.node % 256] = 2 * self.turn.astype(np.int8) - 1
        return self._toward.ravel().take(row * 256 + (node & 255))


def contexts(body: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each byte with what its contexts look at, as a number whose highest byte it is: the last bytes before it in its text, as many as the
    largest of ORDERS, and further ones, REACH at most, as far as they are of the same word; 0 elsewhere. Part by part, each with its place."""
    wide = np.zeros(len(body) + REACH, np.uint8)
    wide[REACH:] = body
    eight = np.ndarray(len(body), "<u8", wide, strides=(1,))
    spoken = (wide != _SPACE) & (wide != _END) & (wide != 0)
    # Near the beginning of a text its own bytes only; of several texts that begin there, the last one's.
    near = (offsets[:-1, None] + np.arange(REACH)).ravel()[::-1]
    near, at = np.unique(near, return_index=True)
    own = _OWN[REACH - 1 - at[: (keep := np.searchsorted(near, len(body)))] % REACH]
    cuts = np.searchsorted(near[:keep], np.arange(0, len(body) + _PART, _PART))
    for part, (a, b) in enumerate(windows(len(body), _PART)):
        same = spoken[a + REACH - 1 : b + REACH - 1].copy()
        size = same.astype(np.uint8)
        for j in range(2, REACH + 1):
            same &= spoken[a + REACH - j : b + REACH - j]
            size += same
        key = eight[a:b] & _KEEP[size]
        some = slice(cuts[part], cuts[part + 1])
        key[near[some] - a] &= own[some]
        yield a, key


def spoken(before: np.ndarray) -> np.ndarray:
    """Of the bytes of contexts those of the same word: above the last byte that is a space or 0."""
    ends = np.zeros(len(before), np.uint64)
    for x in (before ^ _SPACES, before):
        ends |= ~(((x & _LOW7) + _LOW7) | x) & _HIGH  # of each byte of x that is 0
    for shift in (8, 16, 32):
        ends |= ends >> np.uint64(shift)
    ends >>= np.uint64(7)
    ends *= np.uint64(255)
    return before & ~ends


def hashes(key: np.ndarray) -> list[np.ndarray]:
    """Hashes of the contexts in SLOTS."""
    out = [np.empty(len(key), np.uint32) for _ in SLOTS]
    for a, b in windows(len(key), _PART):
        before = key[a:b] & np.uint64((1 << 56) - 1)
        some = [(before >> np.uint64(8 * (REACH - k))) * np.uint64(2) + np.uint64(k) for k in ORDERS]
        some.append(spoken(before) * np.uint64(2) + np.uint64(1))
        for x, to in zip(some, out, strict=True):
            x *= _MUL
            x ^= x >> np.uint64(29)
            x *= _MIX
            x >>= np.uint64(32)
            to[a:b] = x
    return out


def _mixed(key: np.ndarray) -> np.ndarray:
    """A hash, in place, that _unmixed takes back."""
    key *= _MUL
    key ^= key >> np.uint64(32)
    key *= _MIX
    return key


def _unmixed(key: np.ndarray) -> np.ndarray:
    key *= np.uint64(pow(int(_MIX), -1, 1 << 64))
    key ^= key >> np.uint64(32)
    key *= np.uint64(pow(int(_MUL), -1, 1 << 64))
    return key


def _alike(mixed: np.ndarray, at: np.ndarray, mark: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """These places of hashes in an order that brings equal ones (with equal marks) together, and where in it each that differs begins."""
    order, low = np.empty(len(at), np.uint64), np.uint64((1 << len(mixed).bit_length()) - 1)
    for a, b in windows(len(at), _PART):
        own = mixed.take(at[a:b])
        if mark is not None:
            own += mark[a:b] * _MUL
        own &= ~low
        own |= at[a:b].view(np.uint64)
        order[a:b] = own
    order.sort()
    order &= low
    order = order.view(np.int64)
    new = np.ones(len(at), bool)
    for a, b in windows(len(at), _PART):
        some = order[max(a - 1, 0) : b]
        own = mixed.take(some)
        new[max(a, 1) : b] = own[1:] != own[:-1]
        if mark is not None:
            own = mark.take(some)
            new[max(a, 1) : b] |= own[1:] != own[:-1]
    return order, np.flatnonzero(new)


class Bytes:
    """The bytes of a block's stream with their contexts. Bytes that are alike in all that predicts them are kept once, many
    times over; they come in the order of a hash."""

    def __init__(self, code: Code, body: np.ndarray, told: np.ndarray | None, offsets: np.ndarray, back: bool = True):
        """told: what is foretold (0: nothing), or None. back: values will be spread. Bytes that nothing is foretold come first."""
        n, self.code = len(body), code
        said, mark = _marks(body, told) if told is not None else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        mixed = np.empty(n, np.uint64)
        for a, key in contexts(body, offsets):
            mixed[a : a + len(key)] = _mixed(key)
        later = mixed[said]
        if back:
            order, first = _alike(mixed, np.flatnonzero(told == 0) if len(said) else np.arange(n))
            key = mixed[order[first]]
        else:
            order = np.sort(mixed[told == 0]) if len(said) else np.sort(mixed)
            first = np.flatnonzero(np.append(True, order[1:] != order[:-1])[: len(order)])
            key = order[first]
        del mixed
        self.many = np.diff(first, append=n - len(said))
        self.told = self.run = None
        if len(said):
            last, first = _alike(later, np.arange(len(later)), mark)
            one = last[first]
            marks = np.append(np.zeros(len(key), np.int32), mark[one].astype(np.int32))
            self.told, self.run = marks & 255, marks >> 8
            key, self.many = np.append(key, later[one]), np.append(self.many, np.diff(first, append=len(last)))
            if back:
                order = np.append(order, said[last])
        self._order = order if back else None
        key = _unmixed(key)
        self.hashes = hashes(key)
        self.own = code.own[(key >> np.uint64(48)) & np.uint64(255)] * np.int32(256)
        self.row = self.own + (key >> np.uint64(56)).astype(np.int32)

    def __len__(self) -> int:
        return len(self.row)

    def spread(self, values: np.ndarray) -> np.ndarray:
        """Of the different bytes' values those of all bytes, in their order."""
        out = np.empty(len(self._order))
        out[self._order] = np.repeat(values, self.many)
        return out

    def choices(self, step: int | None = None) -> Iterator[Choices]:
        for lo, hi in windows(len(self), step or STEP):
            yield Choices(self, lo, hi)

    def dealt(self, step: int | None = None) -> Iterator[Choices]:
        """For learning: windows of bytes that nothing is foretold, and between them, evenly, those of the others."""
        silent = len(self) if self.run is None else int(np.searchsorted(self.run > 0, True))
        turns: list[tuple[float, int, int]] = []
        for a, b in ((0, silent), (silent, len(self))):
            turns += [((lo + hi) / (b - a), a + lo, a + hi) for lo, hi in windows(b - a, step or STEP)]
        for _, lo, hi in sorted(turns):
            yield Choices(self, lo, hi)


class Choices:
    """The binary choices of some of Bytes, the slots of their contexts, and how many times each occurs."""

    def __init__(self, x: Bytes, lo: int, hi: int):
        code, row = x.code, x.row[lo:hi]
        n = code.length[row]
        self.before = np.cumsum(n) - n
        self._of = of = np.repeat(np.arange(len(n)), n)
        step = (code.first[row] - self.before).take(of)
        step += np.arange(len(step))
        self.node, self.turn = code.node.take(step), code.turn.take(step)
        self._odds, self._many = code.odds, x.many[lo:hi]
        salt = self.node.astype(np.uint32)
        salt *= np.uint32(0x85EBCA6B)
        self.slots = []
        for h, bits in zip(x.hashes, SLOTS, strict=True):
            slot = h[lo:hi].take(of)
            slot += salt
            slot *= np.uint32(0x9E3779B1)
            slot >>= np.uint32(32 - bits)
            self.slots.append(slot)
        self.follow = self.run = None
        if x.run is not None and (run := x.run[lo:hi]).any():
            self.follow, self.run = np.zeros(len(step), np.float32), np.zeros(len(step), np.int64)
            some = np.flatnonzero((run > 0).take(of))
            of = of.take(some)
            follow = code.toward((x.own[lo:hi] + x.told[lo:hi]).take(of), self.node.take(some))
            self.follow[some] = follow
            self.run[some] = np.where(follow != 0, run.take(of), 0)

    @cached_property
    def odds(self) -> np.ndarray:
        return self._odds.take(self.node)

    @cached_property
    def many(self) -> np.ndarray:
        return self._many.take(self._of)


def _marks(body: np.ndarray, told: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the bytes that are foretold, and of each the byte and, above it, how long the follower has been right before, in steps from 1 on."""
    said = np.flatnonzero(told)
    if not len(said):
        return said, np.zeros(0, np.uint64)
    byte, at = told[said], np.arange(len(said))
    right = byte == body[said]
    on = np.append(False, (said[1:] == said[:-1] + 1) & right[:-1])  # the byte before was foretold, and rightly
    right = at - np.maximum.accumulate(np.where(on, 0, at))
    return said, (_RUNS[np.minimum(right, len(_RUNS) - 1)].astype(np.uint64) << np.uint64(8)) | byte


def tally(x: Bytes, counts: np.ndarray) -> None:
    """Adds the zeros and ones (in pairs) of each slot to counts."""
    for c in x.choices():
        many = c.many.astype(np.int32)
        for i, s in enumerate(c.slots):
            part = counts[2 * _AT[i] : 2 * _AT[i + 1]]
            np.add.at(part, s.astype(np.int64) * 2 + c.turn, many)


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x.clip(-30, 30)))


def bins(x: np.ndarray) -> np.ndarray:
    return np.rint((x.clip(-8, 8) + 8) * np.float32((_BINS - 1) / 16)).astype(np.int64)


class Weights:
    """Of each gate: those of each table, by how much a slot has seen; of the code's own odds; of the follower."""

    def __init__(self, flat: np.ndarray):
        self.flat = flat
        k = _TABLES * _GATES * _CONF
        self.tables, self.own, self.follow = flat[:k].reshape(_TABLES, _GATES, _CONF), flat[k : k + _GATES], flat[k + _GATES :]

    def terms(self, gates: int = _GATES) -> np.ndarray:
        """What each state adds, by table and gate."""
        return (self.tables[:, :gates, _SEEN] * _ODDS).reshape(_TABLES, -1)


_SIZE = _TABLES * _GATES * _CONF + 2 * _GATES
#: Rows of the adaptive map: log odds of the code's own odds in steps, by gate.
_ROWS = _GATES * 8


class Mixer:
    """Code, states, weights and adaptive map; all of fixed size."""

    def __init__(self, code: Code, table: np.ndarray, weights: np.ndarray, refine: np.ndarray):
        self.code, self.table, self.weights, self.refine = code, table, weights, refine

    def mixed(self, c: Choices, leave_out: bool, weights: Weights, terms: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """The sum of the weighted log odds, the places of the terms, and the gates."""
        seen = [self.table[_AT[i] : _AT[i + 1]].take(s) for i, s in enumerate(c.slots)]
        if leave_out:
            turn = c.turn.astype(np.int64)
            turn <<= 8
            seen = [_LESS.take(turn + s) for s in seen]
        gate = _SOMES.take(seen[-2])
        gate += _SOME.take(seen[-1])
        if c.run is not None:
            gate += c.run * 9
        x = weights.own.take(gate)
        x *= c.odds
        if c.run is not None:
            x += weights.follow.take(gate) * c.follow
        base, places = gate << 8, []
        for s, t in zip(seen, terms, strict=True):
            at = base + s
            x += t.take(at)
            places.append(at)
        return x, places, gate

    def ready(self) -> tuple[Weights, np.ndarray]:
        w = Weights(self.weights)
        return w, w.terms()

    def log10(self, x: Bytes, step: int | None = None) -> np.ndarray:
        """log10 of the probability of each byte: half the mixture's, half the map's of that. No choice has less than one in a million."""
        ready, m, out = self.ready(), self.refine.ravel(), []
        for c in x.choices(step):
            y, _, gate = self.mixed(c, False, *ready)
            p = squash(y)
            p += m.take(_row(c, gate) + bins(y))
            p *= 0.5
            p += c.turn
            p -= 1
            p = np.abs(p, out=p).clip(1e-6)
            out.append(np.multiply.reduceat(p.astype(np.float64), c.before))
        return np.log10(np.concatenate(out)) if out else np.zeros(0)


def _row(c: Choices, gate: np.ndarray) -> np.ndarray:
    """Where the row of the adaptive map begins: one for each gate and step of the code's own odds."""
    return (gate * 8 + ((c.odds.clip(-3.99, 3.99) + 4)).astype(np.int64)) * _BINS


def _start() -> tuple[np.ndarray, np.ndarray]:
    """Weights that trust the longest context that has seen something, and the follower; a map that changes nothing."""
    flat = np.zeros(_SIZE, np.float32)
    w = Weights(flat)
    for gate in range(_GATES):
        run, order, word = gate // 9, gate // 3 % 3, gate % 3
        share = np.array([*[0.4 / (_TABLES - 2)] * (_TABLES - 2), 0.3 if order else 0.0, 0.3 if word else 0.0])
        w.tables[:, gate] = share[:, None]
        w.own[gate] = 0.1
        w.follow[gate] = (0, 1.5, 2.5, 3.5, 4.5)[run]
    return flat, squash(np.tile(np.linspace(-8, 8, _BINS), (_ROWS, 1))).astype(np.float32)


class Learner:
    """Learns the weights and the map online, one window after another."""

    def __init__(self, mixer: Mixer, rate: float = 0.03):
        self.mixer, self.rate = Mixer(mixer.code, mixer.table, mixer.weights.copy(), mixer.refine), rate
        self.square, self.used = np.full(_SIZE, 1e-4), np.zeros(_SIZE)
        self.seen, self.ones = np.zeros(_ROWS * _BINS), np.zeros(_ROWS * _BINS)

    def see(self, c: Choices) -> None:
        m = self.mixer
        w, gates = Weights(m.weights), _GATES if c.run is not None else 9  # the first ones have no follower
        x, places, gate = m.mixed(c, True, w, w.terms(gates))
        many = c.many.astype(np.float32)
        error = c.turn - squash(x)
        error *= many
        by_gate = np.bincount(gate, many, _GATES)
        g, used = Weights(np.zeros(_SIZE)), Weights(self.used)
        g.own[:] = np.bincount(gate, error * c.odds, _GATES)
        if c.run is not None:
            g.follow[:] = np.bincount(gate, error * c.follow, _GATES)
        used.own += by_gate
        used.follow += by_gate
        used.tables += by_gate[None, :, None]
        error = error.astype(np.float64)
        for i, at in enumerate(places):
            g.tables[i, :gates] = (np.bincount(at, error, gates * 256).reshape(gates, 256) * _ODDS) @ _KIND
        flat = g.flat / by_gate.sum()
        self.square += flat * flat
        m.weights = (m.weights + self.rate * flat / np.sqrt(self.square)).astype(np.float32)
        at = _row(c, gate) + bins(x)
        self.seen += np.bincount(at, many, len(self.seen))
        self.ones += np.bincount(at, many * c.turn, len(self.ones))


_KIND = (_SEEN[:, None] == np.arange(_CONF)).astype(np.float64)


def windows(size: int, step: int) -> Iterator[tuple[int, int]]:
    for lo in range(0, size, step):
        yield lo, min(lo + step, size)


def anchors(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, place (in the block) and hash of the runs of SEED words whose hash says so: one in EVERY."""
    place, g, n = grams_by_doc(h, first, SEED)
    ok = np.flatnonzero(g % np.uint64(EVERY) == 0)
    return np.repeat(np.arange(len(n)), n)[ok], place[ok], g[ok]


def stream(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The coded bytes of the words of a block, the offsets of its documents in them, and the places of its words."""
    lens, doc = w.ends - w.starts, w.doc()
    sizes = np.bincount(doc, lens + 1, len(w.counts)).astype(np.int64) + 1
    offsets = np.append(0, np.cumsum(sizes))
    at = np.cumsum(lens + 1) - lens - 1 + doc
    inside = np.ones(int(offsets[-1]), bool)
    inside[at + lens] = inside[offsets[1:] - 1] = False
    body = np.full(len(inside), _SPACE, np.uint8)
    body[offsets[1:] - 1] = _END
    body[inside] = w.data[w.mask]
    return body, offsets, at


_END_HASH = int(Words(np.array([_END], np.uint8), np.array([0, 1]), is_word=np.ones(256, bool)).hashes()[0])
_NONE = np.iinfo(np.int64).max
_ROW = {"kind": "int", "block": "long", "range": "int", "size": "binary", "held": "binary", "id": "binary", "body": "binary", "told": "binary", "h": "binary", "x": "binary", "y": "binary", "z": "binary"}
#: Kinds of rows: a block's words and runs, the block itself, what followed runs, which of that a block asks for, and its figures.
_WORDS, _RUNS_OF, _TEXTS, _SOURCES, _WANTED, _FIGURES = range(6)


def _schema(own: str) -> str:
    return f"{', '.join(f'{k} {t}' for k, t in _ROW.items())}, doc_id array<{own}>"


def _rows(ids: pa.DataType, **values) -> pa.RecordBatch:
    """One packed row; arrays go as bytes, those of numbers compressed (hashes, which are sorted, as differences)."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    row = [pa.array([_written(k, v) if isinstance(v := values.get(k), np.ndarray) else v], kinds[t]) for k, t in _ROW.items()]
    ids_ = values.get("doc_id")
    lists = pa.ListArray.from_arrays(pa.array([0, len(ids_)], pa.int32()), ids_) if ids_ is not None else pa.nulls(1, pa.list_(ids))
    return pa.RecordBatch.from_arrays([*row, lists], names=[*_ROW, "doc_id"])


def _written(name: str, x: np.ndarray) -> bytes:
    if x.dtype.itemsize != 8:
        return x.tobytes()
    x = x.ravel()
    return _planed(np.diff(x, prepend=x.dtype.type(0)) if name == "h" else x)


def _planed(x: np.ndarray) -> bytes:
    """Numbers, compressed by planes of bytes."""
    return _squeezed(x.view(np.uint8).reshape(-1, x.dtype.itemsize).T).tobytes()


def _unplaned(blob: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


class _Row:
    """A packed row, as it comes back."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        self._batch, self._i = batch, i

    def number(self, name: str) -> int:
        return self._batch.column(self._batch.schema.names.index(name))[self._i].as_py()

    def array(self, name: str, kind: type) -> np.ndarray:
        blob = self._batch.column(self._batch.schema.names.index(name))[self._i].as_buffer()
        if np.dtype(kind).itemsize != 8:
            return np.frombuffer(blob, kind)
        x = _unplaned(blob, kind)
        return np.cumsum(x, dtype=kind) if name == "h" else x

    def ids(self) -> pa.Array:
        return self._batch.column(self._batch.schema.names.index("doc_id"))[self._i].values


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[_Row]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield _Row(batch, i)


def _grouped(rows: Iterator[_Row], name: str) -> Iterator[tuple[int, list[_Row]]]:
    """The rows of each value of a column, by which they are sorted."""
    now, held = None, []
    for row in rows:
        value = row.number(name)
        if held and value != now:
            yield now, held
            held = []
        now = value
        held.append(row)
    if held:
        yield now, held


def _squeezed(x: np.ndarray) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes()), np.uint8)


def _spread(x: np.ndarray) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x.tobytes()), np.uint8)


def _told(body: np.ndarray, told: np.ndarray) -> np.ndarray:
    """What is foretold, as it is stored: 1 where it is right."""
    return _squeezed(np.where(told == body, np.uint8(1), np.where(told == 1, np.uint8(0), told)) * (told > 0))


class Pack:
    """A block of texts: sizes, which are held out, ids, streams and what is foretold."""

    def __init__(self, row: _Row):
        self.size, self.held = row.array("size", np.int64), row.array("held", np.bool_)
        self.body = _spread(row.array("body", np.uint8))
        self.offsets = np.append(0, np.cumsum(self.size))

    def foretold(self, row: _Row) -> np.ndarray:
        told = _spread(row.array("told", np.uint8))
        return np.where(told == 1, self.body, told)


def _cuts(h: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range of hashes begins and ends in sorted hashes."""
    return np.append(np.searchsorted(h, np.array([i * 2**64 // ranges for i in range(ranges)], np.uint64)), len(h))


def _by_range(h: np.ndarray, ranges: int) -> Iterator[tuple[int, slice]]:
    cuts = _cuts(h, ranges)
    for i in np.flatnonzero(np.diff(cuts)).tolist():
        yield i, slice(int(cuts[i]), int(cuts[i + 1]))


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, sorted, and of each hash which it is. Sorted by their high bits, with places as the low ones."""
    low = np.uint64((1 << len(h).bit_length()) - 1)
    order = h & ~low
    order |= np.arange(len(h), dtype=np.uint64)
    order.sort()
    order &= low
    order = order.view(np.int64)
    x = h.take(order)
    if (x[1:] < x[:-1]).any():  # some differ in low bits only
        return np.unique(h, return_inverse=True)
    new = np.append(True, x[1:] != x[:-1])[: len(h)]
    back = np.empty(len(h), np.int64)
    back[order] = np.cumsum(new) - 1
    return x[new], back


class _Block:
    """Gathers the texts of a block."""

    def __init__(self, number: int):
        self.number, self.bytes = number, 0
        self.ids: list[pa.Array] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.words: list[tuple[np.ndarray, np.ndarray]] = []
        self.runs: list[tuple[np.ndarray, ...]] = []

    def add(self, ids: pa.Array, held: np.ndarray, key: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
        w = Words(data, offsets, lower=True)
        h, doc = w.hashes(), w.doc()
        body, ends, _ = stream(w)
        self.words.append((np.append(h, np.full(len(held), _END_HASH, np.uint64)), np.append(held[doc], held)))
        doc, _, a = anchors(h, w.first)
        self.runs.append((a, np.where(held[doc], _NONE, key[doc]), key[doc]))
        self.ids.append(ids)
        self.parts.append((np.diff(ends), held, key, body))
        self.bytes += len(data)

    def rows(self, ranges: int) -> Iterator[pa.RecordBatch]:
        kind = self.ids[0].type
        size, held, key, body = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        yield _rows(kind, kind=_TEXTS, block=self.number, range=0, size=size.astype(np.int64), held=held, id=key, body=_squeezed(body), doc_id=pa.concat_arrays(self.ids))
        h, aside = (np.concatenate(x) for x in zip(*self.words, strict=True))
        words, n = np.unique(h[~aside], return_counts=True)
        aside = np.setdiff1d(h[aside], words)
        h = np.append(words, aside)
        order = np.argsort(h)
        h, n = h[order], np.append(n, np.zeros(len(aside), np.int64))[order]
        for i, part in _by_range(h, ranges):
            yield _rows(kind, kind=_WORDS, block=self.number, range=i, h=h[part], x=n[part])
        a, least, own = (np.concatenate(x) for x in zip(*self.runs, strict=True))
        a, back = _distinct(a)
        taught = least != _NONE
        x, y = np.full(len(a), _NONE), np.full(len(a), -_NONE)
        np.minimum.at(x, back, least)
        np.maximum.at(y, back[taught], least[taught])
        order = np.lexsort((own, back))
        of, own = back[order], own[order]
        new = np.append(True, (of[1:] != of[:-1]) | (own[1:] != own[:-1]))[: len(of)]
        texts = np.bincount(of[new], minlength=len(a)).astype(np.int64)
        for i, part in _by_range(a, ranges):
            yield _rows(kind, kind=_RUNS_OF, block=self.number, range=i, h=a[part], x=x[part], y=y[part], z=texts[part])


def _kept(df: DataFrame, path: str) -> DataFrame:
    """df, written by kind and read back."""
    df.write.partitionBy("kind").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def _packed(docs: DataFrame, ranges: int, path: str) -> DataFrame:
    """The blocks of docs with their distinct words and runs, as packed rows."""
    own = docs.schema["doc_id"].dataType.simpleString()
    marked = docs.select("doc_id", F.expr(HELD_OUT).alias("held_out"), F.expr(_ID).cast("long").alias("id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(TaskContext.get().partitionId() << 32)
        for batch in batches:
            held, key = batch.column(1).to_numpy(zero_copy_only=False), batch.column(2).to_numpy()
            for lo, hi, data, offsets in blocks(column(batch, "text", pa.string())):
                if block.bytes and block.bytes + len(data) > BLOCK:
                    yield from block.rows(ranges)
                    block = _Block(block.number + 1)
                block.add(batch.column(0).slice(lo, hi - lo), held[lo:hi], key[lo:hi], data, offsets)
        if block.parts:
            yield from block.rows(ranges)
        release()

    return _kept(marked.mapInArrow(run, _schema(own)), path)


def _sorted_by(df: DataFrame, name: str) -> DataFrame:
    return df.repartition(name).sortWithinPartitions(name, "kind", "block")


def _summed(packed: DataFrame) -> DataFrame:
    """For each block and range: the counts of its words in all training texts (x), with how many words are listed nowhere before (y);
    and of its runs that a training text shares with another text (h) the least and greatest ids of training texts (x, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        for number, rows in _grouped(_each(batches), "range"):
            for what in (_WORDS, _RUNS_OF):
                own = [r for r in rows if r.number("kind") == what]
                if not own:
                    continue
                kind = own[0]._batch.schema.field("doc_id").type.value_type
                h = [r.array("h", np.uint64) for r in own]
                ends = np.append(0, np.cumsum([len(x) for x in h]))
                h, back = _distinct(np.concatenate(h))
                x = np.concatenate([r.array("x", np.int64) for r in own])
                if what == _WORDS:
                    c = np.zeros(len(h), np.int64)
                    np.add.at(c, back, x)
                    new = int((c > 0).sum())
                    for r, a, b in zip(own, ends[:-1], ends[1:], strict=True):
                        yield _rows(kind, kind=what, block=r.number("block"), range=number, x=c[back[a:b]], y=np.array([new]))
                        new = 0
                    continue
                least, most, texts = np.full(len(h), _NONE), np.full(len(h), -_NONE), np.zeros(len(h), np.int64)
                np.minimum.at(least, back, x)
                np.maximum.at(most, back, np.concatenate([r.array("y", np.int64) for r in own]))
                np.add.at(texts, back, np.concatenate([r.array("z", np.int64) for r in own]))
                shared = (texts > 1) & (least != _NONE)
                for r, a, b in zip(own, ends[:-1], ends[1:], strict=True):
                    at = back[a:b][shared[back[a:b]]]
                    if len(at):
                        yield _rows(kind, kind=what, block=r.number("block"), range=number, h=h[at], x=least[at], y=most[at])
        release()

    return _sorted_by(packed.where(f"kind IN ({_WORDS}, {_RUNS_OF})"), "range").mapInArrow(run, packed.schema)


def _after(place: np.ndarray, doc: np.ndarray, w: Words, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where in the stream the runs at these words end: at the next word, or at the document's end sign."""
    following = place + SEED
    return np.where(following < w.first[doc + 1], np.append(at, 0)[following], ends[doc + 1] - 1)


def _gathered(data: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    return data[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def _met(packed: DataFrame, ranges: int, path: str) -> DataFrame:
    """Figures of each block: x has tokens, known words, the sum of log10(c + 1) and new words of each text, y and z the shared runs (hash and
    which source; document and end); the sources of runs; and the runs that a block asks for."""
    texts, back = packed.where(f"kind = {_TEXTS}"), _summed(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _grouped(_each(batches), "block"):
            words = [r for r in rows if r.number("kind") == _WORDS]
            runs = [r for r in rows if r.number("kind") == _RUNS_OF]
            (row,) = (r for r in rows if r.number("kind") == _TEXTS)
            pack, ids, key = Pack(row), row.ids(), row.array("id", np.int64)
            words.sort(key=lambda r: r.number("range"))
            c, new = np.concatenate([r.array("x", np.int64) for r in words]), sum(int(r.array("y", np.int64)[0]) for r in words)
            shared, least, most = (np.concatenate([r.array(f, t) for r in runs]) if runs else np.zeros(0, t) for f, t in (("h", np.uint64), ("x", np.int64), ("y", np.int64)))
            order = np.argsort(shared)
            shared, least, most = shared[order], least[order], most[order]
            parts, n = [], len(pack.size)
            for a, b in _pieces(pack.offsets):
                offsets = pack.offsets[a : b + 1] - pack.offsets[a]
                parts.append((a, b, Words(pack.body[pack.offsets[a] : pack.offsets[b]], offsets)))
            hs = [w.hashes() for *_, w in parts]
            h, at = _distinct(np.append(np.concatenate(hs), np.uint64(_END_HASH)))
            assert len(h) == len(c), "a block's words are those it has listed"
            c = c[at]
            end, done = int(c[-1]), 0
            stats = np.zeros((4, n))
            found: list[tuple[np.ndarray, ...]] = []
            for (a, b, w), h in zip(parts, hs, strict=True):
                own, doc = c[done : done + len(h)], w.doc()
                done += len(h)
                stats[0, a:b] = w.counts + 1
                stats[1, a:b] = np.bincount(doc, own > 0, b - a) + (end > 0)
                stats[2, a:b] = np.bincount(doc, np.log10(own + 1.0), b - a) + np.log10(end + 1.0)
                if len(shared):
                    doc, place, run_ = anchors(h, w.first)
                    k = np.searchsorted(shared, run_)
                    hit = shared[np.minimum(k, len(shared) - 1)] == run_
                    begin = _after(place, doc, w, pack.offsets[a : b + 1] - pack.offsets[a], w.starts) + pack.offsets[a]
                    stop = pack.offsets[a + doc + 1].copy()
                    stop[:-1] = np.where(doc[1:] == doc[:-1], begin[1:], stop[:-1])
                    found.append((k[hit], (a + doc)[hit], begin[hit], stop[hit]))
            stats[3, 0] = new
            k, doc, begin, stop = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 4
            own, taught = key[doc], ~pack.held[doc]
            which = np.where(own == least[k], 1, 0)  # the greatest, for the text that is the least itself
            use = (which == 0) | (most[k] > least[k])
            yield _rows(ids.type, kind=_FIGURES, block=number, range=0, x=stats, y=(shared[k] * np.uint64(2) + which.astype(np.uint64))[use], z=np.stack([doc, begin], 1)[use].astype(np.int64))
            for side, of in ((0, least), (1, most)):
                mine = np.flatnonzero(taught & (own == of[k]) & ((side == 0) | (most[k] > least[k])))
                mine = mine[np.unique(k[mine], return_index=True)[1]]
                for i, part in _by_range(shared[k[mine]], ranges):
                    m = mine[part]
                    yield _rows(ids.type, kind=_SOURCES, block=number, range=i, h=shared[k[m]] * np.uint64(2) + np.uint64(side), x=(stop - begin)[m], body=_gathered(pack.body, begin[m], (stop - begin)[m]))
            ask = np.unique(k[use] * 2 + which[use])
            for i, part in _by_range(shared[ask >> 1], ranges):
                yield _rows(ids.type, kind=_WANTED, block=number, range=i, h=shared[ask[part] >> 1] * np.uint64(2) + (ask[part] & 1).astype(np.uint64))
        release()

    return _kept(_sorted_by(texts.unionByName(back), "block").mapInArrow(run, packed.schema), path)


def _pieces(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about that many bytes."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, b
        a = b


def _answers(met: DataFrame) -> DataFrame:
    """For each block and range the bytes (body, of sizes x) that followed the runs (h) it asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _grouped(_each(batches), "range"):
            sources, wanted = ([r for r in rows if r.number("kind") == k] for k in (_SOURCES, _WANTED))
            if not sources or not wanted:
                continue
            kind = sources[0]._batch.schema.field("doc_id").type.value_type
            h, n, data = (np.concatenate([r.array(f, t) for r in sources]) for f, t in (("h", np.uint64), ("x", np.int64), ("body", np.uint8)))
            first = np.cumsum(n) - n
            h, one = np.unique(h, return_index=True)  # rows that share a doc_id: the first block's
            for r in wanted:
                ask = r.array("h", np.uint64)
                at = np.searchsorted(h, ask)
                hit = h[np.minimum(at, len(h) - 1)] == ask
                at = one[at[hit]]
                yield _rows(kind, kind=_WORDS, block=r.number("block"), range=number, h=ask[hit], x=n[at], body=_gathered(data, first[at], n[at]))
        release()

    return _sorted_by(met.where(f"kind IN ({_SOURCES}, {_WANTED})"), "range").mapInArrow(run, met.schema)


def follow(body: np.ndarray, offsets: np.ndarray, doc: np.ndarray, begin: np.ndarray, data: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The byte that is foretold at each place of the stream, or 0: from begin on in a document the n bytes of data from first on, until one is
    wrong; of several, the last one."""
    told = np.zeros(len(body), np.uint8)
    n = np.minimum(n, offsets[doc + 1] - begin)
    start = np.cumsum(n) - n
    said, target = _gathered(data, first, n), np.repeat(begin - start, n) + np.arange(int(n.sum()))
    miss = said != body[target]
    wrong = np.cumsum(miss)
    alive = wrong - miss == np.repeat((wrong - miss)[np.minimum(start, max(0, len(wrong) - 1))] if len(wrong) else start, n)
    told[target[alive]] = said[alive]
    return told


def _foretold(packed: DataFrame, met: DataFrame) -> DataFrame:
    """The blocks with their figures and what is foretold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in _grouped(_each(batches), "block"):
            answers = [r for r in rows if r.number("kind") == _WORDS]
            (row,) = (r for r in rows if r.number("kind") == _TEXTS)
            (figures,) = (r for r in rows if r.number("kind") == _FIGURES)
            pack, told = Pack(row), None
            if answers:
                h, n, data = (np.concatenate([r.array(f, t) for r in answers]) for f, t in (("h", np.uint64), ("x", np.int64), ("body", np.uint8)))
                order = np.argsort(h)
                first = (np.cumsum(n) - n)[order]
                h, n = h[order], n[order]
                ask, (doc, begin) = figures.array("y", np.uint64), figures.array("z", np.int64).reshape(-1, 2).T
                at = np.searchsorted(h, ask)
                hit = np.flatnonzero(h[np.minimum(at, len(h) - 1)] == ask)
                told = follow(pack.body, pack.offsets, doc[hit], begin[hit], data, first[at[hit]], n[at[hit]])
            told = _told(pack.body, told) if told is not None else _squeezed(np.zeros(len(pack.body), np.uint8))
            yield _rows(row.ids().type, kind=_TEXTS, block=number, range=0, size=pack.size, held=pack.held, body=row.array("body", np.uint8), told=told, x=figures.array("x", np.float64), doc_id=row.ids())
        release()

    return written(_sorted_by(packed.where(f"kind = {_TEXTS}").unionByName(met.where(f"kind = {_FIGURES}")).unionByName(_answers(met)), "block").mapInArrow(run, met.schema), "streams")


def _streams(batches: Iterator[pa.RecordBatch], taught: bool = False) -> Iterator[tuple[_Row, np.ndarray, np.ndarray, np.ndarray]]:
    """Each block's row, bytes, foretold bytes and offsets; taught: of the training texts."""
    for row in _each(batches):
        pack = Pack(row)
        body, told, offsets = pack.body, pack.foretold(row), pack.offsets
        if taught and pack.held.any():
            keep = np.repeat(~pack.held, pack.size)
            body, told, offsets = body[keep], told[keep], np.append(0, np.cumsum(pack.size[~pack.held]))
        if len(body) or not taught:
            yield row, body, told, offsets


def _pairs(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each byte comes after each byte, or first in its text (after 0)."""
    n = np.zeros(65536, np.int64)
    for a, b in windows(len(body) - 1, _PART):
        pair = body[a:b].astype(np.int64)
        pair <<= 8
        pair += body[a + 1 : b + 1]
        n += np.bincount(pair, minlength=65536)
    first, last = body[offsets[:-1]], body[offsets[1:-1] - 1].astype(np.int64) << 8
    np.subtract.at(n, last + first[1:], 1)
    np.add.at(n, first.astype(np.int64), 1)
    return n


#: Slots whose counts go together.
_CHUNK = 1 << 14


def learn(streams: DataFrame, size: int) -> Mixer:
    """The mixer, from the training texts of packed rows with size bytes. Only tables of fixed size come to the driver."""
    spark = streams.sparkSession
    taught = streams.select("size", "held", "body", "told")
    counts = np.zeros(65536)

    def histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(65536, np.int64)
        for _, body, _, offsets in _streams(batches, True):
            n += _pairs(body, offsets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["b", "n"])

    for r in taught.mapInArrow(histogram, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():
        counts[r.b] = r.n
    code = Code(counts.reshape(256, 256))
    weights, refine = _start()
    table = np.zeros(_AT[-1], np.uint8)
    if not counts.any():
        return Mixer(code, table, weights, refine)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2 * _AT[-1], np.int32)
        for _, body, told, offsets in _streams(batches, True):
            tally(Bytes(code, body, None, offsets, back=False), sums)
        both = sums.reshape(-1, 2 * _CHUNK)
        for i in np.flatnonzero(both.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([int(i)]), pa.array([_planed(both[i])], pa.binary())], names=["chunk", "counts"])
        release()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[chunk] = total.get(chunk, 0) + _unplaned(blob.as_py(), np.int32).astype(np.int64)
        for chunk, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([states(x[::2], x[1::2]).tobytes()], pa.binary())], names=["chunk", "counts"])

    schema = "chunk long, counts binary"
    parts = taught.coalesce(max(1, -(-size // TALLY))).mapInArrow(counted, schema)
    for r in parts.repartition("chunk").mapInArrow(summed, schema).toLocalIterator():
        table[r.chunk * _CHUNK : (r.chunk + 1) * _CHUNK] = np.frombuffer(r.counts, np.uint8)
    sent = spark.sparkContext.broadcast(table)

    def online(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Learner(Mixer(code, sent.value, weights, refine))
        for _, body, told, offsets in _streams(batches, True):
            for c in Bytes(code, body, told, offsets, back=False).dealt():
                own.see(c)
        k = np.arange(_SIZE + len(own.seen))
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.append(own.mixer.weights * own.used, own.ones)), pa.array(np.append(own.used, own.seen))], names=["k", "x", "n"])
        release()

    learnt = taught.mapInArrow(online, "k long, x double, n double").groupBy("k").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    x, n = np.zeros(_SIZE + refine.size), np.zeros(_SIZE + refine.size)
    for r in learnt.collect():
        x[r.k], n[r.k] = r.x, r.n
    weights = np.where(n[:_SIZE] > 0, x[:_SIZE] / np.maximum(n[:_SIZE], 1), weights).astype(np.float32)
    refine = ((x[_SIZE:].reshape(_ROWS, _BINS) + 8 * refine) / (n[_SIZE:].reshape(_ROWS, _BINS) + 8)).astype(np.float32)
    return Mixer(code, sent.value, weights, refine)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and n_bytes of each row of docs, learnt from those that aren't held out."""
    spark = docs.sparkSession
    total_bytes = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")).cast("long"))).first()[0] or 0
    ranges = max(1, -(-int(total_bytes) // RANGE))
    paths = [new_path(spark, name) for name in ("blocks", "met")]
    packed = _packed(docs, ranges, paths[0])
    met = _met(packed, ranges, paths[1])
    for kind in (_WORDS, _RUNS_OF):
        drop(spark, f"{paths[0]}/kind={kind}")
    streams = _foretold(packed, met)
    for path in paths:
        drop(spark, path)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(3, np.int64)
        for row in _each(batches):
            held, size, stats = row.array("held", np.bool_), row.array("size", np.int64), row.array("x", np.float64).reshape(4, -1)
            out += [int(stats[0][~held].sum()), int(stats[3].sum()), int(size[~held].sum())]
        yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in out], names=["total", "new", "size"])

    r = streams.select("held", "size", "x").mapInArrow(sums, "total long, new long, size long").agg(F.sum("total").alias("total"), F.sum("new").alias("new"), F.sum("size").alias("size")).first()
    total, distinct, size = (int(x or 0) for x in (r.total, r.new, r["size"]))
    sent = spark.sparkContext.broadcast(learn(streams, size))
    own = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {own}, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for row, body, told, offsets in _streams(batches):
            x = Bytes(m.code, body, told, offsets)
            stats = row.array("x", np.float64).reshape(4, -1)
            base = stats[2] - stats[0] * np.log10(total + distinct + 1.0)
            p = np.add.reduceat(x.spread(m.log10(x)), offsets[:-1])
            made = [pa.array(stats[0].astype(np.int64)), pa.array(stats[1].astype(np.int64)), pa.array(base), pa.array(p), pa.array(np.diff(offsets))]
            yield pa.RecordBatch.from_arrays([row.ids(), pa.array(row.array("held", np.bool_)), *made], names=names)
        release()

    return streams.select("size", "held", "body", "told", "x", "doc_id").mapInArrow(run, schema).withColumn("train_tokens", F.lit(total).cast("long"))


def op8_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score(documents(spark, sf_dir))
    bits = F.expr("-score / log10(2D) / n_bytes").alias("bits_per_byte")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", bits)
