from __future__ import annotations

import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from lamina.llm import byte_bpe as B, encoder as E, store, token_shards as T
from lamina.llm.text import mix

CODEC = B.codec(public_tokenizers.path(B.VOCABULARY), public_tokenizers.PATTERN)
REFERENCE = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=CODEC.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(" aet'slr\n\x85é½²٣界🙂") | st.characters(exclude_categories=["Cs"]), max_size=80))
def test_ids_are_those_of_the_library(text):
    ids = CODEC.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == REFERENCE.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


ODD = ["'s", "'re", "don't", " ", "  ", "\n", "\r\n", "\t", "\0", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", "\u1680", "\u180e", "\u2003", "\u2028", "\u3000", "\ufeff", "\u200b", "a", " the", "word", "é", "ß", "×", "÷", "ª", "µ", "½", "²", "٣", "Ж", "界", "🙂", "e\u0301", "1", "23", ",", "...", "«", "—", "longer than what is remembered".replace(" ", "")]
#: Any two bytes of these join, so ids differ wherever texts are cut at other places than the pattern's.
_USED = sorted({b for x in ODD for b in x.encode()})
SHARP = {bytes([b]): b for b in range(256)} | {bytes([a, b]): 256 + i * len(_USED) + k for i, a in enumerate(_USED) for k, b in enumerate(_USED)}
#: Tables and blocks of the usual size, and so small ones that chunks share slots and texts are cut.
ENCODERS = [(E.Encoder(ranks), E.Encoder(ranks, slots=8, limit=16)) for ranks in (CODEC.ranks, SHARP)]


@pytest.mark.parametrize("pair", ENCODERS)
@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ODD) | st.characters(exclude_categories=["Cs"]), max_size=30).map("".join), max_size=6))
def test_ids_of_many_texts_are_those_of_the_library(pair, texts):
    want = [pair[0].use.encode_ordinary(t) for t in texts]
    for codec in pair:
        assert [x.tolist() for x in codec.encode(pa.array(texts, pa.string()))] == want
        assert [x.tolist() for x in codec.encode(pa.array(["x", *texts], pa.string()).slice(1))] == want


def test_a_failure_of_the_library_leaves_nothing_behind(monkeypatch):
    codec = E.Encoder(CODEC.ranks)
    with monkeypatch.context() as m:
        m.setattr(tiktoken.Encoding, "encode_to_numpy", lambda *a, **b: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            list(codec.encode(pa.array(["some words"])))
    assert [x.tolist() for x in codec.encode(pa.array(["some words"]))] == [REFERENCE.encode_ordinary("some words")]


def test_the_library_gets_only_what_is_not_remembered(monkeypatch):
    codec, given = E.Encoder(CODEC.ranks), []
    monkeypatch.setattr(tiktoken.Encoding, "encode_to_numpy", lambda use, text, *, f=tiktoken.Encoding.encode_to_numpy, **more: given.append(text) or f(use, text, **more))
    texts = [" ".join(f"word{i % 50}, aiêux" for i in range(20_000)), "\n".join(["    word one. "] * 500)] * 2
    assert [x.tolist() for x in codec.encode(pa.array(texts))] == [REFERENCE.encode_ordinary(t) for t in texts]
    assert sum(map(len, given)) < 2000
    assert all(len(x) <= E.BLOCK_BYTES for x in E.pieces(np.frombuffer(texts[0].encode() * 8, np.uint8), E.BLOCK_BYTES))


def test_the_hash_is_minimal_perfect_and_knows_strangers():
    assert sorted(CODEC.hash.place(k) for k in CODEC.ranks) == list(range(len(CODEC.ranks)))
    assert CODEC.hash.place(b"no such token, surely") == -1


def test_long_runs_and_a_full_memory(monkeypatch):
    monkeypatch.setattr(B, "REMEMBERED", 3)
    for text in ("a" * 30_000, "ab" * 9_000, " ".join(f"w{i}" for i in range(50)) * 2):
        assert np.frombuffer(CODEC.encode(text), "<u4").tolist() == REFERENCE.encode_ordinary(text)


def test_stage_keeps_columns_and_round_trips(spark, docs, empty):
    out = B.stage(spark, docs, "")
    assert out.columns == [*docs.columns, "n_tokens", "ids"] and B.stage(spark, empty, "").count() == 0
    for r in B.decode(out.select("text", "n_tokens", "ids")).collect():
        assert bytes(r.decoded).decode() == (r.text or "") and r.n_tokens == len(r.ids) // 4


@pytest.mark.parametrize("size", [1, 2, 3, 17, 1000, 4097])
def test_the_permutation_is_one(size):
    a, b = (T.permute(np.arange(size), size, key).tolist() for key in (1, 2))
    assert sorted(a) == sorted(b) == list(range(size)) and (size < 10 or a != b)


@pytest.mark.parametrize("shard_bytes", [3_000, 1 << 30])
def test_shards_hold_every_sequence_at_its_slot(spark, docs, shard_bytes):
    folder = store.new_path(spark, "test-shards")
    ledger = T.materialise(docs, folder, shard_bytes=shard_bytes)
    rows = sorted(ledger.collect(), key=lambda r: r.slot)
    assert [r.slot for r in rows] == list(range(len(rows)))
    records = list(T.read(folder, ledger))
    none = max(r.doc_id or 0 for r in rows) + 1
    assert [(None if r["doc_id"] == none else int(r["doc_id"]), int(r["place"]), int(r["n"])) for r in records] == [(r.doc_id, r.place, r.n_tokens) for r in rows]
    assert [x.tobytes() for x in T.read(folder, ledger, 5)] == [x.tobytes() for x in records[5:]]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.place, records[r.slot]["ids"][: r.n_tokens].tolist()) for r in rows)
    want = []
    for d in docs.collect():
        ids = REFERENCE.encode_ordinary(d.text or "")
        want += [(-1 if d.doc_id is None else d.doc_id, k, ids[k * T.LENGTH : (k + 1) * T.LENGTH]) for k in range(-(-len(ids) // T.LENGTH))]
    assert got == sorted(want)
    again = T.materialise(docs.repartition(7), store.new_path(spark, "test-shards"), shard_bytes=shard_bytes)
    assert sorted(map(str, again.collect())) == sorted(map(str, rows))  # however the input is partitioned


def test_no_shards_of_nothing(spark, empty):
    assert T.materialise(empty, store.new_path(spark, "test-shards")).count() == 0


def test_huge_ids_are_hashed(spark):
    df = spark.createDataFrame([(-(2**62), "a b"), (2**62, "c d"), (5, "e")], "doc_id long, text string")
    assert sorted(r.slot for r in T.materialise(df, store.new_path(spark, "test-shards")).collect()) == [0, 1, 2]


def test_pretokens_cover_the_text():
    text = "It's  all\n\n here, 123!"
    assert "".join(CODEC.split(text)) == text and re.match("It", text)


@pytest.mark.parametrize("ids", [[7, None, 3, -4], [2**62, None, 3, -(2**62)]])
def test_numbers_are_permuted_by_block(spark, monkeypatch, ids):
    """One call of the permutation for all texts of a block, and the number that each sequence gets by itself."""
    texts = ["one two " * 900, "", None, "a", "é" * 2000]
    rows = [(d, t) for d in ids for t in texts]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    steps, mapped = [], type(df).mapInArrow
    monkeypatch.setattr(type(df), "mapInArrow", lambda df, f, *a: steps.append(f) or mapped(df, f, *a))
    T.materialise(df, store.new_path(spark, "test-shards"), shard_bytes=1 << 30)
    calls, permute = [], T.permute
    monkeypatch.setattr(T, "permute", lambda x, *a: calls.append(len(x)) or permute(x, *a))
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array([t for _, t in rows])], names=["doc_id", "text"])
    (out,) = steps[0](iter([batch]))
    got = np.frombuffer(zstandard.ZstdDecompressor().decompress(out.column(1)[0].as_py()), T._SENT)
    assert calls == [len(got)]
    lo, hi = min(d for d in ids if d is not None), max(d for d in ids if d is not None)
    most = -(-max(len((t or "").encode()) for t in texts) // T.LENGTH)
    size = (hi - lo + 2) * most
    for r in got:
        base = int(r["record"]["doc_id"]) - lo  # a null id is stored as hi + 1
        place = np.array([r["record"]["place"]], np.uint64)
        if size < T._LARGEST:
            assert r["at"] == permute(np.uint64(base * most) + place, size)[0]
        else:
            assert r["at"] == permute(mix(mix(np.array([base], np.uint64)) + place) >> np.uint64(2), T._LARGEST)[0]
    lengths = [len(REFERENCE.encode_ordinary(t or "")) for _, t in rows]
    want = sorted((k, min(T.LENGTH, n - k * T.LENGTH)) for n in lengths for k in range(-(-n // T.LENGTH)))
    assert sorted((int(r["record"]["place"]), int(r["record"]["n"])) for r in got) == want


def test_null_and_negative_ids_are_told_apart(spark):
    df = spark.createDataFrame([(-1, "a b"), (None, "c d"), (-2, "e")], "doc_id long, text string")
    rows = T.materialise(df, store.new_path(spark, "test-shards")).collect()
    assert sorted((str(r.doc_id), r.slot < 3) for r in rows) == [("-1", True), ("-2", True), ("None", True)]


def test_queries_on_whole_tables(spark, table_dir, docs):
    """op3 lists every sequence once; op9's hashes are of the library's ids and of the text."""
    import hashlib

    folder = table_dir(documents=docs)
    want = []
    for d in docs.collect():
        text = d.text or ""
        ids = np.array(REFERENCE.encode_ordinary(text), "<u4").tobytes()
        want.append((str(d.doc_id), len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in B.op9_byte_bpe(spark, folder).collect()) == sorted(want)
    rows = T.op3_token_shards(spark, folder).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    places = sorted((i, k) for i, n, *_ in want for k in range(-(-n // T.LENGTH)))
    assert sorted((str(r.doc_id), r.place) for r in rows) == places


def test_a_text_over_a_block_is_encoded_whole(spark):
    text = "word and more. " * 90_000  # over BLOCK_BYTES
    r = B.stage(spark, spark.createDataFrame([(1, text)], "doc_id long, text string"), "").first()
    assert r.n_tokens == len(REFERENCE.encode_ordinary(text))
