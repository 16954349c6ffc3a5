"""Byte-level BPE in two tiers: a minimal perfect hash finds pre-tokens that are whole entries of the vocabulary; the others
are merged with a heap over linked bytes.

Texts are split by the tokenizer's pattern, each match is encoded by itself and no special token is known. Ids are stored as
little-endian unsigned 32-bit integers.

Defined cases: a null or empty text has no ids and decodes to no bytes; repeated rows are encoded one by one; an empty table
gives an empty result; other columns are not read. A text that isn't valid Unicode can't occur in a Spark string column.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest as _hash

from .store import documents
from .text import carried, column, release

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pre-tokens whose ids a worker remembers in each of two generations, and the longest that it remembers, in characters.
REMEMBERED, LONGEST = 150_000, 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PerfectHash:
    """A minimal perfect hash by displacement: n keys to 0..n-1. Each bucket has a seed that sends its keys to free places;
    the key stored at a place tells strangers apart."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 3)
        rows: list[list[bytes]] = [[] for _ in range(self.buckets)]
        for k in keys:
            rows[_hash(k, 0) % self.buckets].append(k)
        self.seeds = [0] * self.buckets
        self.keys: list[bytes | None] = [None] * n
        free = set(range(n))
        for b in sorted(range(self.buckets), key=lambda b: -len(rows[b])):
            row = rows[b]
            if len(row) == 1:  # any free place will do: a negative seed names it
                place = free.pop()
                self.seeds[b], self.keys[place] = -place - 1, row[0]
            elif row:
                seed = 1
                while len(places := {_hash(k, seed) % n for k in row}) < len(row) or not places <= free:
                    seed += 1
                self.seeds[b] = seed
                free -= places
                for k in row:
                    self.keys[_hash(k, seed) % n] = k

    def place(self, key: bytes) -> int:
        """The key's place, or -1 if it is none of the keys."""
        seed = self.seeds[_hash(key, 0) % self.buckets]
        at = -seed - 1 if seed < 0 else _hash(key, seed) % self.n
        return at if self.keys[at] == key else -1


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a pre-token that isn't in the vocabulary: again and again the leftmost pair of lowest rank is joined.

    A heap holds the pairs; the parts are linked by the places of their neighbours, so a merge costs O(log n)."""
    n = len(piece)
    rank = ranks.get
    end, right, left = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        j = right[i]
        if j >= n or end[j] != stop or not end[i]:
            continue  # one of its parts has been joined to something since
        end[i], end[j] = stop, 0
        k = right[i] = right[j]
        if k < n:
            left[k] = i
            if (r := rank(piece[i : end[k]])) is not None:
                heappush(heap, (r, i, end[k]))
        h = left[i]
        if h >= 0 and (r := rank(piece[h:stop])) is not None:
            heappush(heap, (r, h, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = right[i]
    return out


class Codec(dict):
    """Pre-token -> its ids as bytes. As a dict it remembers what it has looked up lately; what is missing goes to the tiers."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.hash = PerfectHash(list(self.ranks))
        self.bytes_of = {r: r.to_bytes(4, "little") for r in self.ranks.values()}
        self.ids = [self.bytes_of[self.ranks[k]] for k in self.hash.keys]
        self.bytes = {r: k for k, r in self.ranks.items()}
        self.older: dict[str, bytes] = {}
        self.split: Callable[[str], list[str]] = regex.compile(pattern).findall

    def __missing__(self, token: str) -> bytes:
        ids = self.older.get(token)
        if ids is None:
            ids = self.looked_up(token.encode())
        if len(token) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[token] = ids
        return ids

    def looked_up(self, piece: bytes) -> bytes:
        """The ids of one pre-token by the two tiers."""
        at = self.hash.place(piece)
        return self.ids[at] if at >= 0 else b"".join([self.bytes_of[r] for r in merged(piece, self.ranks)])

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, memoryview(ids).cast("I").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One of each in a worker process. The vocabulary file is part of the installed tokenizers, on every executor."""
    return Codec(path, pattern)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Iterator[str]]]:
    for batch in batches:
        text = column(batch, "text", pa.string())
        yield batch, (text[i].as_py() for i in range(len(text)))


def _mapped(docs: DataFrame, fields: str, row: Callable[[Codec, str], tuple], vocabulary: str, pattern: str) -> DataFrame:
    """The columns of docs and what row makes of each text, as fields."""
    schema = f"{docs.schema.simpleString()[7:-1]}, {fields}"
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(public_tokenizers.path(vocabulary), pattern)
        for batch, texts in _texts(batches):
            made = list(zip(*(row(use, t) for t in texts), strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, _ARROW[f.split()[1]]) for v, f in zip(made, fields.split(", "), strict=True))], names=[*batch.schema.names, *names])
        release()

    return docs.mapInArrow(run, schema)


_ARROW = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """docs (with a column text) and ids: the ids of each text, 4 bytes each."""
    return _mapped(docs, "ids binary", lambda c, t: (c.encode(t),), vocabulary, pattern)


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """encoded (with a column ids) and decoded: the bytes that the ids stand for. Null ids decode to none."""
    schema = f"{encoded.schema.simpleString()[7:-1]}, decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(public_tokenizers.path(vocabulary), pattern)
        for batch in batches:
            ids = batch.column(batch.schema.names.index("ids"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([use.decode(x.as_py() or b"") for x in ids], pa.binary())], names=[*batch.schema.names, "decoded"])
        release()

    return encoded.mapInArrow(run, schema)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode(documents(spark, sf_dir).select("doc_id", F.col("text").cast("string").alias("text"))).select("doc_id", "ids")
    return decode(encoded).select("doc_id", F.expr("CAST(length(ids) / 4 AS BIGINT)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' columns, the ids of each text and their number."""
    packed = encode(carried(docs).select("_row", "text"))
    taken = {c.lower() for c in docs.columns}
    n, ids = (next(x for x in (c, f"bpe_{c}", f"bpe__{c}") if x not in taken) for c in ("n_tokens", "ids"))
    ids_of = F.expr("CAST(length(ids) / 4 AS BIGINT)")
    return packed.select(*[F.col("text") if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns], ids_of.alias(n), F.col("ids").alias(ids))
