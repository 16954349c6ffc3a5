"""Substring deduplication by seed and extend.

A window is LENGTH consecutive words of one document. Words covered by a window whose words also occur, as a window, in a
document with a smaller doc_id are removed. Windows are judged on the input.

Seeds: winnowing picks, for every window, the SEED-word gram of least hash in it as its anchor; equal windows have the same
anchor at the same place. Consecutive windows with one anchor make a region, which reaches from the anchor to both sides
as far as its windows do. Occurrences of an anchor are joined. Where whole regions agree, the match is extended over both
at once: each occurrence but those in the region's smallest document goes. Where regions of one anchor differ (one of them
was cut by an edit or by the end of a text), they are extended window by window, and only one occurrence of each differing
region takes part, as the others are gone already. Overlapping removed windows make the maximal repeats.

An anchor may be in any number of documents: what is shuffled is first reduced to least ids, and no group meets in a task
but as a join that Spark can split. Pairs of occurrences are never made.

Defined cases: a null or empty text has no words; a text shorter than a window loses nothing; a window that repeats only
within its document, or within rows of one doc_id, stays; rows that repeat are answered one by one; a null doc_id counts as
larger than any other; an empty table gives an empty result; other columns are carried, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import documents, written
from .text import Words, blocks, carried, column, grams, mix, release, restored, signed

LENGTH, SEED = 50, 10
#: Windows that a kernel handles at once, and the bits of an anchor's place among them.
_CHUNK, _PLACE = 1 << 20, 24
_B = 0x9E3779B97F4A7C15
_B_INVERSE = pow(_B, -1, 2**64)
_ID = "coalesce(doc_id, 9223372036854775807)"


def _ranges(h: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of h[lo:hi] for many ranges."""
    up, down = (np.full(len(h) + 1, b, np.uint64) for b in (_B, _B_INVERSE))
    up[0] = down[0] = 1
    up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[:-1], out=sums[1:])
    return mix((sums[hi] - sums[lo]) * down[lo] + (hi - lo).astype(np.uint64))


def regions(h: np.ndarray, first: np.ndarray, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """(document, first window, number of windows, anchor's hash, region's hash) of each region of a block."""
    span = length - seed + 1
    starts = np.zeros(len(h) + 1, np.int32)
    counts = np.diff(first)
    long = counts >= length
    np.add.at(starts, first[:-1][long], 1)
    np.add.at(starts, first[1:][long] - length + 1, -1)
    valid = np.cumsum(starts[:-1]) > 0
    g = grams(h, seed)
    out = []
    for at in range(0, max(len(g) - span + 1, 0), _CHUNK):
        part = g[at : at + _CHUNK + span - 1]
        key = (part >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(part), dtype=np.uint64)
        size = 1
        while size * 2 <= span:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        if size < span:
            key = np.minimum(key[: len(key) - (span - size)], key[span - size :])
        windows = np.flatnonzero(valid[at : at + len(key)])
        if not len(windows):
            continue
        anchor = (key[windows] & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
        new = np.ones(len(windows), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (windows[1:] != windows[:-1] + 1)
        begin = np.flatnonzero(new)
        n = np.diff(np.append(begin, len(windows)))
        lo = windows[begin]
        words = h[at : at + _CHUNK + length]
        out.append((lo + at, n, part[anchor[begin]], _ranges(words, lo, lo + n + length - 1)))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    lo, n, a, b = (np.concatenate(x) for x in zip(*out, strict=True))
    doc = np.searchsorted(first, lo, "right") - 1
    return doc, lo - first[doc], n, a, b


def _keyed(docs: DataFrame) -> DataFrame:
    """carried(), with did (orders documents) and th (tells texts of one doc_id apart)."""
    return carried(docs).withColumns({"did": F.expr(f"CAST({_ID} AS LONG)"), "th": F.expr("CAST(xxhash64(coalesce(text, '')) & 2147483647 AS INT)")})


def _occurrences(keyed: DataFrame, length: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, th = (column(batch, c, t).to_numpy() for c, t in (("did", pa.int64()), ("th", pa.int32())))
            for lo, hi, data, offsets in blocks(column(batch, "text", pa.string())):
                w = Words(data, offsets)
                doc, pos, n, a, b = regions(w.hashes(), w.first, length, seed)
                if len(doc):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (signed(a), signed(b), did[lo:hi][doc], th[lo:hi][doc], pos.astype(np.int32), n.astype(np.int32))], names=["a", "b", "did", "th", "pos", "n"])
        release()

    return keyed.select("did", "th", "text").mapInArrow(run, "a long, b long, did long, th int, pos int, n int")


def _window_hashes(docs: DataFrame, length: int) -> DataFrame:
    """wh, did, th, pos of each window named in the column spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, th = (column(batch, c, t).to_numpy() for c, t in (("did", pa.int64()), ("th", pa.int32())))
            spans = batch.column(batch.schema.names.index("spans"))
            for lo, hi, data, offsets in blocks(column(batch, "text", pa.string())):
                w = Words(data, offsets)
                doc, pos, n = _flat(spans.slice(lo, hi - lo))
                g = grams(w.hashes(), length)
                doc, at = np.repeat(doc, n), np.arange(int(n.sum())) + np.repeat(pos - (np.cumsum(n) - n), n)
                yield pa.RecordBatch.from_arrays([pa.array(signed(g[w.first[doc] + at])), pa.array(did[lo:hi][doc]), pa.array(th[lo:hi][doc]), pa.array(at.astype(np.int32))], names=["wh", "did", "th", "pos"])
        release()

    return docs.select("did", "th", "text", "spans").mapInArrow(run, "wh long, did long, th int, pos int")


def _flat(spans: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first window and number of windows of each span in a column of lists."""
    n = np.asarray(spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    flat = spans.flatten()
    pos, many = (np.asarray(x.to_numpy(zero_copy_only=False), np.int64) for x in flat.flatten()) if len(flat) else (np.zeros(0, np.int64),) * 2
    return np.repeat(np.arange(len(n)), n), pos, many


def repeats(keyed: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """did, th, spans: the windows to remove of each document that has some, as runs (pos, n)."""
    found = _occurrences(keyed, length, seed)
    # Least ids are written before they are joined: both sides of the joins are then plain exchanges, whose hot keys Spark splits.
    shared = written(found.groupBy("a").agg(F.min("did").alias("lo"), F.max("did").alias("hi")).where("lo < hi").select("a"), "shared")
    seeds = written(found.join(shared, "a"), "seeds")
    mixed = written(seeds.groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi")).select("a", F.expr("lo < hi").alias("mixed")), "mixed")
    region = written(seeds.groupBy("a", "b").agg(F.min("did").alias("least")), "least")
    both = seeds.join(region, ["a", "b"]).join(mixed, "a")
    whole = both.where("did > least").select("did", "th", "pos", "n")
    apart = both.where("did = least AND mixed").groupBy("did", "th").agg(F.collect_list(F.struct("pos", "n")).alias("spans"))
    windows = written(_window_hashes(keyed.select("did", "th", "text").join(apart, ["did", "th"]), length), "windows")
    first = windows.groupBy("wh").agg(F.min("did").alias("least"), F.max("did").alias("most")).where("least < most")
    single = windows.join(first, "wh").where("did > least").select("did", "th", "pos", F.lit(1).alias("n"))
    return whole.unionByName(single).groupBy("did", "th").agg(F.collect_list(F.struct("pos", "n")).alias("spans"))


def _without(data: np.ndarray, offsets: np.ndarray, spans: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words, removed words, and what is left joined by spaces, of each document of a block."""
    w = Words(data, offsets)
    doc, pos, n = _flat(spans)
    cover = np.zeros(len(w) + 1, np.int64)
    np.add.at(cover, w.first[doc] + pos, 1)
    np.add.at(cover, w.first[doc] + pos + n + length - 1, -1)
    kept = np.cumsum(cover[:-1]) == 0
    counts = w.counts
    left = np.zeros(len(w) + 1, np.int64)
    np.cumsum(kept, out=left[1:])
    n_left = np.diff(left[w.first])
    lens = w.ends - w.starts
    size = lens[kept] + 1  # a space before each word; a document's first is cut off below
    at = np.cumsum(size) - size + 1
    out = np.full(int(size.sum()), 32, np.uint8)
    body = data[w.mask][np.repeat(kept, lens)]
    out[np.arange(len(body)) + np.repeat(at - (np.cumsum(lens[kept]) - lens[kept]), lens[kept])] = body
    first = np.cumsum(n_left) - n_left
    cut = np.ones(len(out), bool)
    cut[(at - 1)[first[n_left > 0]]] = False
    bytes_left = np.zeros(len(counts) + 1, np.int64)
    total = np.append(0, np.cumsum(size))
    np.cumsum(total[first + n_left] - total[first] - (n_left > 0), out=bytes_left[1:])
    text = pa.StringArray.from_buffers(len(counts), pa.py_buffer(bytes_left.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(out[cut])))
    return counts, counts - n_left, text


def remove(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """_row, doc_id, text, n_words, n_removed and kept_text (the words left, joined by one space) of each row of docs."""
    keyed = _keyed(docs)
    spans = repeats(keyed, length, seed)
    joined = keyed.join(spans, ["did", "th"], "left").select("_row", "doc_id", "text", "spans")
    fields = joined.drop("spans").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column(batch.schema.names.index("spans"))
            for lo, hi, data, offsets in blocks(column(batch, "text", pa.string())):
                n, gone, text = _without(data, offsets, runs.slice(lo, hi - lo), length)
                yield pa.RecordBatch.from_arrays([batch.column(i).slice(lo, hi - lo) for i in range(3)] + [pa.array(n), pa.array(gone), text], names=["_row", "doc_id", "text", "n_words", "n_removed", "kept_text"])
        release()

    return joined.mapInArrow(run, fields.add("n_words", "long").add("n_removed", "long").add("kept_text", "string"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = remove(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, without the repeated words. One that loses nothing keeps its text as it is."""
    done = remove(docs).withColumn("kept_text", F.expr("CASE WHEN n_removed > 0 THEN kept_text ELSE text END"))
    names = docs.columns
    out = restored(done.select("_row", "kept_text"), names, "kept_text")
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {LENGTH - 2}, 1))) AS i FROM d),
x AS (SELECT doc_id, i, md5(array_to_string(w[i : i + {LENGTH - 1}], ' ')) AS h FROM g),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS least FROM x) WHERE doc_id > least),
c AS (SELECT DISTINCT doc_id, i + k AS j FROM r, range({LENGTH}) s(k)),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS j FROM d),
k AS (SELECT p.doc_id, string_agg(w[j], ' ' ORDER BY j) AS kept, count(*) AS n FROM p ANTI JOIN c USING (doc_id, j) GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
