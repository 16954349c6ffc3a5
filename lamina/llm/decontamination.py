"""Benchmark decontamination by pigeonhole edit matching.

Texts are reduced to words: ASCII letters are lower-cased, ASCII characters other than letters and digits separate. An item
of n words leaks into a document if some run of the document's words has an edit distance, in words, of at most
n * ERROR_PERCENT / 100 from the item. Such a run keeps at least one of the item's budget + 1 pieces whole, so exact hits of
pieces are looked up first, and the words around each hit are verified by Myers' bit-parallel distance.

The items are a stated query set: they go to the executors in blocks of a bounded number of words, each against all documents;
the documents are never shuffled.

Defined cases: an item with fewer than LEAST_WORDS words (listed by short_items) matches exact runs only; one without words or null
matches nothing; a null or empty text has no leaks; repeated items and repeated rows are answered one by one; with an empty table of either kind the
result is empty; other columns are carried, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import documents
from .text import Words, blocks, carried, column, grams, restored

ERROR_PERCENT, LEAST_WORDS = 20, 8
#: Words of items that are sent to the executors at once (about 100 bytes each there).
BLOCK_WORDS = 200_000

_IS_WORD = np.ones(256, bool)
_IS_WORD[:128] = [chr(i).isalnum() for i in range(128)]


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    return Words(data, offsets, lower=True, is_word=_IS_WORD)


def myers(pattern: dict[int, int], m: int, text: list[int]) -> list[int]:
    """Least edit distances between the pattern and the runs of text that end at each place, the run's start being free.

    pattern: bits of the places of each symbol; m: its length. One word of text costs a few operations on m-bit integers."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, out = full, 0, m, []
    for c in text:
        eq = pattern.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        out.append(score)
    return out


class Items:
    """A block of items, with their pieces by length."""

    def __init__(self, ids: list, texts: list[str | None], percent: int = ERROR_PERCENT):
        arr = pa.array([t or "" for t in texts], pa.string())
        self.ids, self.hashes, self.masks, self.reverse, self.budget = ids, [], [], [], []
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for _, _, data, offsets in blocks(arr):
            w = words(data, offsets)
            h = w.hashes()
            self.hashes += [h[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        for i, h in enumerate(self.hashes):
            n = len(h)
            k = n * percent // 100 if n >= LEAST_WORDS else 0
            self.budget.append(k)
            self.masks.append(_places(h))
            self.reverse.append(_places(h[::-1]))
            if not n:
                continue
            cuts = [j * n // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                pieces.setdefault(b - a, []).append((int(grams(h[a:b], b - a)[0]), i, a))
        self.pieces = {}
        for size, found in pieces.items():
            found.sort()
            key = np.array([x[0] for x in found], np.uint64)
            seen = np.zeros(1 << 20, bool)
            seen[key & np.uint64((1 << 20) - 1)] = True
            self.pieces[size] = (key, np.array([x[1] for x in found]), np.array([x[2] for x in found]), seen)

    def hits(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """Document, item and place of the item's first word (in words of the document) of each exact piece."""
        out = []
        for size, (key, item, offset, seen) in self.pieces.items():
            g = grams(h, size)
            at = np.flatnonzero(seen[g & np.uint64((1 << 20) - 1)])
            lo = np.searchsorted(key, g[at])
            many = np.searchsorted(key, g[at], "right") - lo
            doc = np.searchsorted(first, at, "right") - 1
            many[at + size > first[doc + 1]] = 0
            which = np.repeat(lo, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            out.append((np.repeat(doc, many), item[which], np.repeat(at - first[doc], many) - offset[which]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3

    def found(self, w: Words) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
        """Document, item and verified runs of each leak in a block of documents."""
        h = w.hashes()
        doc, item, place = self.hits(h, w.first)
        order = np.lexsort((item, doc))
        doc, item, place = doc[order], item[order], place[order]
        cuts = np.append(np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]))), len(doc)) if len(doc) else []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            d, i = int(doc[a]), int(item[a])
            if runs := self.verified(h[w.first[d] : w.first[d + 1]], i, place[a:b]):
                yield d, i, runs

    def verified(self, h: np.ndarray, item: int, place: np.ndarray) -> list[tuple[int, int, int]]:
        """Start, end and distance of the best run of one document near each cluster of hits of an item."""
        n, k = len(self.hashes[item]), self.budget[item]
        place = np.unique(place)
        out: list[tuple[int, int, int]] = []
        for cluster in np.split(place, np.flatnonzero(np.diff(place) > 2 * k) + 1):
            lo, hi = max(0, int(cluster[0]) - k), min(len(h), int(cluster[-1]) + n + k)
            span = h[lo:hi].tolist()
            scores = myers(self.masks[item], n, span)
            best = min(scores, default=n)
            while best <= k:
                end = scores.index(best) + 1
                back = myers(self.reverse[item], n, span[:end][::-1])
                size = n if n <= len(back) and back[n - 1] == best else back.index(best) + 1
                run = (lo + end - size, lo + end, best)
                if not out or run[0] >= out[-1][1]:
                    out.append(run)
                scores[max(0, end - n) : end + n] = [n] * len(scores[max(0, end - n) : end + n])  # other copies in the same cluster
                best = min(scores)
        return out


def _places(h: np.ndarray) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, x in enumerate(h.tolist()):
        out[x] = out.get(x, 0) | 1 << i
    return out


def item_blocks(items: DataFrame, id_col: str = "item_id", limit: int = BLOCK_WORDS) -> Iterator[list]:
    """The items, a block at a time: they come to the driver partition by partition, and no block is over the limit but by one item."""
    block, size = [], 0
    for row in items.select(F.col(id_col).alias("i"), F.col("text").cast("string").alias("t")).toLocalIterator():
        block.append((row.i, row.t))
        size += 1 + len(row.t or "") // 2
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


def _scan(docs: DataFrame, block: list, percent: int) -> DataFrame:
    items = docs.sparkSession.sparkContext.broadcast(block)
    schema = "doc_id long, item_id long, start long, end long, distance long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = Items([i for i, _ in items.value], [t for _, t in items.value], percent)
        for batch in batches:
            ids, texts = column(batch, "doc_id", pa.int64()), column(batch, "text", pa.string())
            rows = []
            for lo, _, data, offsets in blocks(texts):
                w = words(data, offsets)
                for d, i, found in use.found(w):
                    base = int(w.first[d])
                    # byte places, for cutting
                    rows += [(ids[lo + d].as_py(), use.ids[i], int(w.starts[base + start] - offsets[d]), int(w.ends[base + end - 1] - offsets[d]), distance) for start, end, distance in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in zip(*rows, strict=True)], names=["doc_id", "item_id", "start", "end", "distance"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def leaks(docs: DataFrame, items: DataFrame, percent: int = ERROR_PERCENT) -> DataFrame:
    """doc_id, item_id, start and end (in bytes of the text), distance (in words) of each leak."""
    out = None
    for block in item_blocks(items):
        found = _scan(docs, block, percent)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "doc_id long, item_id long, start long, end long, distance long")


def short_items(items: DataFrame) -> DataFrame:
    """The items that are too short for edits: they are looked for as they are."""
    n = F.size(F.expr(r"regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9\\x{80}-\\x{10FFFF}]+', 0)"))
    return items.where(n < LEAST_WORDS).select("item_id")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without leaks."""
    flagged = docs
    names = docs.columns
    for block in item_blocks(spark.read.parquet(f"{sf_dir}/benchmark.parquet")):
        flagged = restored(_clean(carried(flagged), block, ERROR_PERCENT), names)
    return flagged


def _clean(packed: DataFrame, block: list, percent: int) -> DataFrame:
    """The rows of packed (text and others) in which no item of a block leaks."""
    items = packed.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = Items([i for i, _ in items.value], [t for _, t in items.value], percent)
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for lo, _, data, offsets in blocks(column(batch, "text", pa.string())):
                for d, _, _ in use.found(words(data, offsets)):
                    keep[lo + d] = False
            yield batch.filter(pa.array(keep))

    return packed.mapInArrow(run, packed.schema)
