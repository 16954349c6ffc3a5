"""Training-order materialisation: token ids in fixed-stride shards, in an order that a key determines.

Each text is encoded and cut into sequences of LENGTH ids. The numbers doc * most + place, for all ids and places that the table
can have, are a range whose size is known before any text is encoded. A keyed Feistel network with cycle-walking permutes that
range; ranges of permuted numbers are the shards. Each shard is written by one task, sorted; its sequences' ranks, after those of
the shards before, are the slots 0, 1, 2, ... without gaps. The order depends on the key and the doc_ids alone, not on how
the input is partitioned, and a task that is repeated writes the same bytes.

A record is doc_id (8 bytes), place (4), number of ids (4) and LENGTH ids of 2 bytes, padded; all little-endian. Slot s of a
shard that starts at slot b is at byte (s - b) * STRIDE, so a reader can go on anywhere.

Defined cases: a null or empty text has no sequence; a null doc_id counts as one more than the largest, and is stored so;
rows that share a doc_id follow each other, in the order of their ids; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .byte_bpe import VOCABULARY
from .encoder import encoder
from .store import documents, new_path, written
from .text import column, mix

LENGTH, KEY, ROUNDS = 512, 0x5EED_0F_7A1E5, 6
#: Bytes of text for each shard, about, and records that a task holds before it hands them on.
SHARD_BYTES, HELD = 48 << 20, 1 << 15
RECORD = np.dtype([("doc_id", "<i8"), ("place", "<u4"), ("n", "<u4"), ("ids", "<u2", (LENGTH,))])
STRIDE = RECORD.itemsize
_SENT = np.dtype([("at", "<u8"), ("record", RECORD)])
#: Larger ranges are permuted as 62-bit hashes of the numbers; equal hashes are told apart by doc_id and place.
_LARGEST = 1 << 62


def permute(x: np.ndarray, size: int, key: int = KEY) -> np.ndarray:
    """A keyed permutation of range(size), applied to x."""
    half = np.uint64(max(1, (int(size - 1).bit_length() + 1) // 2))
    low = np.uint64((1 << int(half)) - 1)
    keys = [int(mix(np.array([key * (i + 1) + i], np.uint64))[0]) for i in range(ROUNDS)]
    out = x.astype(np.uint64)
    left = np.arange(len(out))
    while len(left):  # numbers beyond the range walk on until they are back in it
        v = out[left]
        a, b = v >> half, v & low
        for k in keys:
            a, b = b, a ^ (mix(b + np.uint64(k)) & low)
        v = (a << half) | b
        out[left] = v
        left = left[v >= np.uint64(size)]
    return out


def _size(docs: DataFrame) -> tuple[int, int, int, int]:
    """Least and largest doc_id, most sequences of a text (a byte is a token at most), bytes of all texts."""
    n = F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit("")))
    r = docs.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.max(n).alias("n"), F.sum(n.cast("long")).alias("sum")).first()
    return int(r.lo or 0), int(r.hi or 0), max(1, -(-(r.n or 0) // LENGTH)), int(r["sum"] or 0)


def materialise(docs: DataFrame, folder: str, key: int = KEY, vocabulary: str = VOCABULARY, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards to folder (shard-00000.bin, ...), and gives doc_id, place, n_tokens, slot, shard and offset of each sequence."""
    spark = docs.sparkSession
    lo, hi, most, total = _size(docs)
    size = (hi - lo + 2) * most
    none = hi + 1 if hi < 2**63 - 1 else lo - 1  # no document has it
    shards = max(1, -(-total // shard_bytes))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoder(vocabulary)
        pad, pack = codec.use.n_vocab, zstandard.ZstdCompressor(level=1)
        held: list[tuple[int | None, np.ndarray]] = []

        def hand_on() -> pa.RecordBatch:
            """What is held, as records. Their numbers are permuted all at once: a text has a few only, and each call costs as much as many."""
            n = np.array([-(-len(ids) // LENGTH) for _, ids in held])
            first = np.cumsum(n) - n
            base = [(hi + 1 if d is None else d) - lo for d, _ in held]
            place = np.arange(n.sum(), dtype=np.uint64) - np.repeat(first, n).astype(np.uint64)
            rows = np.zeros(len(place), _SENT)
            rows["at"] = _numbers(base, n, place, most, size, key)
            r = rows["record"]
            r["doc_id"], r["place"], r["n"] = np.repeat([none if d is None else d for d, _ in held], n), place, LENGTH
            r["n"][first + n - 1] = [len(ids) - LENGTH * (k - 1) for (_, ids), k in zip(held, n.tolist(), strict=True)]
            flat = np.full(len(rows) * LENGTH, pad, np.uint16)
            for at, (_, ids) in zip((first * LENGTH).tolist(), held, strict=True):
                flat[at : at + len(ids)] = ids
            r["ids"] = flat.reshape(-1, LENGTH)
            held.clear()
            shard = _shard(rows["at"], size, shards)
            order = np.argsort(shard, kind="stable")
            rows, shard = rows[order], shard[order]
            first = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
            blobs = [pack.compress(rows[a:b].tobytes()) for a, b in zip(first, np.append(first[1:], len(rows)), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(shard[first].astype(np.int32)), pa.array(blobs, pa.binary())], names=["shard", "blob"])

        n_held = 0
        for batch in batches:
            ids_of = codec.encode(column(batch, "text", pa.string()))
            for d, ids in zip(column(batch, "doc_id", pa.int64()).to_pylist(), ids_of, strict=True):
                if not len(ids):
                    continue
                held.append((d, ids))
                n_held += -(-len(ids) // LENGTH)
                if n_held >= HELD:
                    yield hand_on()
                    n_held = 0
        if held:
            yield hand_on()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        parts: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for shard, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                parts.setdefault(shard, []).append(np.frombuffer(unpack.decompress(blob.as_py()), _SENT))
        for shard in sorted(parts):
            rows = np.concatenate(parts.pop(shard))
            r = rows["record"]
            order = np.lexsort((r["place"], _tie(r["ids"]), r["doc_id"], rows["at"]))
            r = r[order]
            store(folder, shard_name(shard), np.ascontiguousarray(r).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(r["doc_id"], mask=r["doc_id"] == none), pa.array(r["place"].astype(np.int64)), pa.array(r["n"].astype(np.int64)), pa.array(np.full(len(r), shard, np.int32)), pa.array(np.arange(len(r), dtype=np.int64))],
                names=["doc_id", "place", "n_tokens", "shard", "rank"],
            )

    sent = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(encode, "shard int, blob binary")
    ledger = written(sent.repartitionById(shards, F.col("shard")).mapInArrow(write, "doc_id long, place long, n_tokens long, shard int, rank long"), "ledger")
    counts = ledger.groupBy("shard").agg(F.count("*").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    base = counts.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return ledger.join(base, "shard").select("doc_id", "place", "n_tokens", (F.col("first") + F.col("rank")).alias("slot"), "shard", (F.col("rank") * STRIDE).alias("offset"))


def _numbers(base: list[int], n: np.ndarray, place: np.ndarray, most: int, size: int, key: int) -> np.ndarray:
    """The permuted numbers of sequences: base has one entry for each text, n how many sequences it has, place one for each of them."""
    if size < _LARGEST:
        return permute(np.repeat(np.array([b * most for b in base], np.uint64), n) + place, size, key)
    return permute(mix(mix(np.repeat(np.array([b % 2**64 for b in base], np.uint64), n)) + place) >> np.uint64(2), _LARGEST, key)


def _tie(ids: np.ndarray) -> np.ndarray:
    """Tells records with equal numbers apart by their ids."""
    factors = mix(np.arange(1, LENGTH + 1, dtype=np.uint64))
    return np.concatenate([(x * factors).sum(axis=1, dtype=np.uint64) for x in np.array_split(ids, -(-len(ids) // 4096))])


def _shard(at: np.ndarray, size: int, shards: int) -> np.ndarray:
    """The shard of each permuted number: ranges of equal width."""
    width = -(-min(size, _LARGEST) // shards)
    return (at // np.uint64(width)).astype(np.int64)


def shard_name(shard: int) -> str:
    return f"shard-{shard:05d}.bin"


def store(folder: str, name: str, data: bytes) -> None:
    """Writes a file under its name only when it is whole; an older copy of it is replaced."""
    fs, path = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(path)
    part = f"{path}/.{name}.{uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(data)
    fs.move(part, f"{path}/{name}")


def read(folder: str, ledger: DataFrame, start: int = 0) -> Iterator[np.void]:
    """The records from slot start on, in order. What is read of the ledger is one row a shard."""
    fs, path = pa.fs.FileSystem.from_uri(folder)
    for r in ledger.groupBy("shard").agg(F.min("slot").alias("first"), F.count("*").alias("n")).orderBy("first").collect():
        if r["first"] + r["n"] > start:
            with fs.open_input_file(f"{path}/{shard_name(r.shard)}") as f:
                f.seek(max(0, start - r["first"]) * STRIDE)
                yield from np.frombuffer(f.read(), RECORD)


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(documents(spark, sf_dir), new_path(spark, "shards"))
