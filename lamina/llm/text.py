"""Whole-text kernels: Arrow batches are cut into byte blocks and handled with NumPy, many documents at a time.

Words are runs of bytes other than 0x20 and 0x09-0x0D; UTF-8 never uses those inside a character.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .store import small_batches

#: Bytes of text handled at once; a longer document is a block of its own.
BLOCK_BYTES = 1 << 20
IS_WORD = np.ones(256, bool)
IS_WORD[[9, 10, 11, 12, 13, 32]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_GRAM = np.uint64(0xD6E8FEB86659FD93)
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(8)], np.uint64)


def column(batch: pa.RecordBatch, name: str, kind: pa.DataType) -> pa.Array:
    """The first column of that name, without nulls for strings."""
    arr = batch.column(batch.schema.names.index(name))
    arr = arr if arr.type == kind else arr.cast(kind)
    return arr.fill_null("") if kind == pa.string() and arr.null_count else arr


def blocks(text: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row past the last, bytes, offsets of the rows in them). Every row comes in exactly one block, whole."""
    n = len(text)
    if not n:
        return
    offsets = np.frombuffer(text.buffers()[1], np.int32, n + 1 + text.offset)[text.offset :].astype(np.int64)
    raw = text.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(32))


class Words:
    """The words of a block. first[d]:first[d + 1] are those of document d; starts and ends are byte places."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, is_word: np.ndarray = IS_WORD):
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        mask = is_word[self.data]
        edge = mask.copy()
        edge[1:] &= ~mask[:-1]
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        edge[inner] = mask[inner]
        self.starts = np.flatnonzero(edge)
        self.mask = mask
        last = mask.copy()
        last[:-1] &= ~mask[1:]
        last[inner - 1] = mask[inner - 1]
        self.ends = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, eight bytes at a time."""
        n = len(self)
        lens = self.ends - self.starts
        wide = np.zeros(len(self.data) + 8, np.uint8)
        wide[:-8] = self.data
        eight = np.ndarray(len(self.data) + 1, "<u8", wide, strides=(1,))  # the eight bytes from each place on
        h = mix(lens.astype(np.uint64) * _BASE + np.uint64(1))
        at, left = np.arange(n), lens
        done = 0
        while len(at):
            some = left[at] - done if done else left
            part = eight[self.starts[at] + done]
            short = some < 8
            part[short] &= _MASKS[some[short]]
            h[at] = mix(h[at] * _GRAM + part * _BASE)
            done += 8
            at = np.flatnonzero(lens > done) if done == 8 else at[lens[at] > done]
            left = lens
        return h


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive items from each place on (len(h) - k + 1 of them), by doubling."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out, have, power, size, step = None, 0, h, 1, int(_GRAM)
    # power: hash of `size` items from each place; step: _GRAM ** size
    while True:
        if k & size:
            out = power if out is None else out[: len(h) - have - size + 1] * np.uint64(step) + power[have : len(h) - size + 1]
            have += size
        if have == k:
            return out if k == 1 else mix(out)
        power = power[: len(power) - size] * np.uint64(step) + power[size:]
        step = step * step % 2**64
        size *= 2


def grams_by_doc(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of k words within a document: place of its first word, hash; and how many each document has."""
    n = np.maximum(np.diff(first) - k + 1, 0)
    total = int(n.sum())
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), n
    at = np.cumsum(n) - n
    place = np.arange(total) + np.repeat(first[:-1] - at, n)
    return place, grams(h, k)[place], n


def segments(values: np.ndarray, n: np.ndarray, op: np.ufunc, empty) -> np.ndarray:
    """op over consecutive runs of n values each; empty where n is 0."""
    out = np.full(len(n), empty, values.dtype)
    full = n > 0
    if full.any():
        out[full] = op.reduceat(values, (np.cumsum(n) - n)[full])
    return out


def sequence_hashes(h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each document's sequence of words."""
    place = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
    out = []
    for salt in (0x632BE59BD9B4E019, 0x9FB21C651E98DF25):
        v = mix(h ^ mix(place.astype(np.uint64) * np.uint64(salt) + np.uint64(salt >> 3)))
        out.append(mix(segments(v, counts, np.add, np.uint64(0)) + counts.astype(np.uint64)))
    return out[0], out[1]


def per_document(docs: DataFrame, fields: list[tuple[str, str]], kernel: Callable, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """kernel(bytes, offsets) gives one array for each of fields (name, Spark type), with an entry for each row of a block.

    The result has the columns in keep, then fields; null texts count as empty. One row out for each row in, no shuffle.
    """
    own = "text" in keep
    kept = docs.select(*keep) if own else docs.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = T.StructType([kept.schema[c] for c in keep] + [T.StructField(n, T._parse_datatype_string(t)) for n, t in fields])
    arrow = [pa.field(n, to_arrow_type(T._parse_datatype_string(t))) for n, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = column(batch, "text" if own else "_text", pa.string())
            for lo, hi, data, offsets in blocks(text):
                made = [pa.array(v, f.type) for v, f in zip(kernel(data, offsets), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(lo, hi - lo) for i in range(len(keep))] + made, names=[*keep, *(f.name for f in arrow)])
        release()

    return kept.mapInArrow(run, schema)


def carried(docs: DataFrame) -> DataFrame:
    """text, and the other columns in a struct _row, so that no name can clash with an operator's own."""
    small_batches(docs.sparkSession)
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select(F.struct(*rest).alias("_row"), F.col("text").cast("string").alias("text"), F.col("doc_id"))


def restored(df: DataFrame, names: list[str], text: str = "text") -> DataFrame:
    """The columns that carried() packed, in their order, with the text of that column."""
    return df.select(*[F.col(text).alias("text") if c == "text" else F.col("_row")[c].alias(c) for c in names])


def release() -> None:
    """Gives memory that a task no longer needs back to the system: a worker process waits for further tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
