"""Token ids of many texts at once: texts are cut into chunks, a table remembers the ids of short ones, and the tokenizer's library
encodes the others, joined.

A cut is made only where one of the pattern's matches surely ends: after an ASCII letter or digit (or a letter of U+00C0 to U+00FF)
before an ASCII character of another kind; before ASCII white space after a character that is surely none; and before the last of
several white-space characters that something else follows, and after it unless it is a space. The pattern never looks back, and
ahead only at what follows white space: the part of it before the last character is one match in either case. So the ids of a text
are those of its chunks. Where bytes alone don't tell, there is no cut, and the chunk is longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken

from .byte_bpe import read_ranks
from .text import BLOCK_BYTES, IS_WORD, _MASKS, blocks, mix

#: Slots of the table (a power of two), and the bytes of the longest chunk that it remembers (so many ids at most).
SLOTS, WIDE = 1 << 20, 16
_ASCII = np.arange(256) < 128
_SPACE = ~IS_WORD
#: ASCII that is surely no white space, whatever the library takes for it; and first bytes of characters that may be.
_SOLID = IS_WORD & _ASCII
_SOLID[0x1C:0x20] = False
_MAY_BE_SPACE = ~_SOLID & _ASCII
_MAY_BE_SPACE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_LETTER, _DIGIT = (np.array([chr(b).isascii() and f(chr(b)) for b in range(256)]) for f in (str.isalpha, str.isdigit))
_LINE = _SPACE & (np.arange(256) != 32)


def _bits(*sets: np.ndarray) -> np.ndarray:
    return sum((x.astype(np.uint8) << np.uint8(i) for i, x in enumerate(sets)), np.zeros(256, np.uint8))


#: There is a cut between two bytes where the first one's bits of _BEFORE and the second one's of _AFTER meet, for the last of them before the first byte.
_BEFORE = _bits(_SOLID, _LETTER, _DIGIT, _LINE, _SPACE)
_AFTER = _bits(_SPACE, _ASCII & ~_LETTER, _ASCII & ~_DIGIT, _SOLID, _SOLID)


def cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places where a block's chunks begin, and of each byte whether it is the last of a character that is surely no white space."""
    inner = offsets[offsets < len(data)]
    before = _BEFORE[data]
    many = np.flatnonzero(data >= 128)  # bytes of longer characters, which may end there
    one, two = data[many - 1], data[many - 2]  # the bytes before; what comes round from the end stands at a text's start, where no character ends
    before[many] = (((one != 0xC2) & ((two < 0xE1) | (two > 0xE3))) * np.uint8(1)) | (((one == 0xC3) & (data[many] != 0x97) & (data[many] != 0xB7)) * np.uint8(2))
    meet = np.zeros(len(data) + 1, np.uint8)
    np.bitwise_and(before[:-1], _AFTER[data[1:]], out=meet[1:-1])
    meet[inner] = 0
    cut = (meet[:-1] & np.uint8(15)) != 0
    cut |= (meet[1:] & np.uint8(16)) != 0
    cut[inner] = True
    return np.flatnonzero(cut), (before & np.uint8(1)) != 0


def pieces(data: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """A text in parts of about limit bytes that end where chunks do, but not in white space, as its cuts depend on what follows."""
    at, width = 0, limit
    while at + width < len(data):
        starts, solid = cuts(data[at : at + width], np.zeros(1, np.int64))
        last = int((starts * solid[starts - 1])[1:].max(initial=0))
        if last:
            yield data[at : at + last]
            at, width = at + last, limit
        else:
            width *= 2
    yield data[at:]


class Encoder:
    """What a worker remembers between blocks: a chunk's bytes as two words, its length, and its ids. A chunk has one slot; one that
    is in use by a block isn't overwritten by it."""

    def __init__(self, ranks: dict[bytes, int], slots: int = SLOTS, limit: int = BLOCK_BYTES):
        self.slots, self.limit = slots, limit
        self.use = tiktoken.Encoding("chunks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.lens = np.zeros(self.use.n_vocab, np.int64)
        self.lens[list(ranks.values())] = [len(x) for x in ranks]
        self.words = np.zeros((2, self.slots), np.uint64)
        self.size, self.n = np.zeros(self.slots, np.uint8), np.zeros(self.slots, np.uint8)
        self.ids = np.zeros(self.slots * WIDE, np.uint16)  # and after them those that aren't remembered

    def encode(self, text: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for lo, hi, data, offsets in blocks(text, self.limit):
            if hi - lo == 1:
                yield np.concatenate([self.block(x, np.array([0, len(x)]))[0] for x in pieces(data, self.limit)])
            else:
                ids, bounds = self.block(data, offsets)
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    yield ids[a:b]

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a block's texts, and where each text's begin."""
        if not len(data):
            return np.zeros(0, np.uint16), np.zeros(len(offsets), np.int64)
        starts, solid = cuts(data, offsets)
        size = np.diff(starts, append=len(data))
        padded = np.zeros(len(data) + WIDE, np.uint8)
        padded[: len(data)] = data
        eight = np.ndarray(len(data) + 9, "<u8", padded, strides=(1,))
        low = eight[starts]
        np.bitwise_and(low, _MASKS[np.minimum(size, 7)], out=low, where=size < 8)
        high = eight[starts + 8 * (size > 8)]
        np.bitwise_and(high, _MASKS[np.clip(size - 8, 0, 7)], out=high, where=size < WIDE)
        slot = (mix(low ^ mix(high + size.astype(np.uint64))) >> np.uint64(64 - (self.slots - 1).bit_length())).astype(np.int64)
        short = size <= WIDE
        known = short & (self.size[slot] == size) & (self.words[0][slot] == low) & (self.words[1][slot] == high)

        n = self.n[slot].astype(np.int64)
        at = slot * WIDE
        missing = np.flatnonzero(~known)
        if len(missing):
            new = np.flatnonzero(short & ~known)
            busy = np.zeros(self.slots, bool)
            busy[slot[known]] = True
            new = new[~busy[slot[new]]]
            _, first = np.unique(slot[new], return_index=True)
            new = new[first]
            self.words[0][slot[new]], self.words[1][slot[new]], self.size[slot[new]] = low[new], high[new], size[new]
            again = missing[short[missing] & (self.size[slot[missing]] == size[missing]) & (self.words[0][slot[missing]] == low[missing]) & (self.words[1][slot[missing]] == high[missing])]
            rest = np.setdiff1d(missing, again, assume_unique=True)
            todo = np.concatenate([new, rest])
            try:
                ids, count = self._by_library(data, starts[todo], size[todo], solid)
            except BaseException:
                self.size[slot[new]] = 0  # nothing is remembered of chunks that have no ids
                raise
            begin = np.cumsum(count) - count
            of_new = int(count[: len(new)].sum())
            self.n[slot[new]] = count[: len(new)]
            self.ids[_runs(at[new], count[: len(new)])] = ids[:of_new]
            n[again] = self.n[slot[again]]
            n[rest], at[rest] = count[len(new) :], self.slots * WIDE + begin[len(new) :] - of_new
            spare = len(ids) - of_new
            if len(self.ids) < self.slots * WIDE + spare:
                self.ids = np.concatenate([self.ids[: self.slots * WIDE], np.zeros(2 * spare, np.uint16)])
            self.ids[self.slots * WIDE : self.slots * WIDE + spare] = ids[of_new:]
        first = np.append(0, np.cumsum(n))[np.searchsorted(starts, offsets)]
        return self.ids[_runs(at, n)], first

    def _by_library(self, data: np.ndarray, starts: np.ndarray, size: np.ndarray, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks, one after another, and how many each has. Those whose first and last characters are surely no white space
        (but for a space at the start) go to the library in one text, a line each: there a line's end is a match of its own."""
        spaced = (data[starts] == 32) & (size > 1)
        joined = np.flatnonzero(~_MAY_BE_SPACE[data[starts + spaced]] & solid[starts + size - 1])
        alone = np.setdiff1d(np.arange(len(starts)), joined, assume_unique=True)
        count = np.zeros(len(starts), np.int64)
        found = []
        if len(joined):
            ends = np.cumsum(size[joined] + 1)
            begins = ends - size[joined] - 1
            lines = np.full(ends[-1], 10, np.uint8)
            lines[_runs(begins, size[joined])] = data[_runs(starts[joined], size[joined])]
            ids = self.use.encode_to_numpy(lines.tobytes().decode(), disallowed_special=())
            reach = np.append(0, np.cumsum(self.lens[ids]))
            a, b = np.searchsorted(reach, begins), np.searchsorted(reach, ends - 1)
            if not (np.array_equal(reach[a], begins) and np.array_equal(reach[b], ends - 1)):
                raise AssertionError("a token spans two chunks")
            count[joined] = b - a
            found.append(ids[_runs(a, b - a)])
        for i in alone.tolist():
            ids = self.use.encode_to_numpy(data[starts[i] : starts[i] + size[i]].tobytes().decode(), disallowed_special=())
            count[i] = len(ids)
            found.append(ids)
        flat = np.concatenate(found) if found else np.zeros(0, np.uint32)
        if len(alone):  # back into the order of the chunks
            order = np.concatenate([joined, alone])
            begin = np.zeros(len(starts), np.int64)
            begin[order] = np.cumsum(count[order]) - count[order]
            flat = flat[_runs(begin, count)]
        return flat.astype(np.uint16), count


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    """One of each in a worker process."""
    return Encoder(read_ranks(public_tokenizers.path(vocabulary)))


def _runs(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (n[0] numbers), starts[1], ..."""
    ends = np.cumsum(n)
    return np.repeat(starts - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
