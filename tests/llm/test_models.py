from __future__ import annotations

import collections
import math
import re
import zlib

import numpy as np
import pytest

from lamina.llm import context_mixing as C, kneser_ney as K, toxicity as X

WORD = "[^\x20\x09-\x0d]+"


@pytest.fixture(scope="module")
def labelled(spark):

    texts = _texts()
    rows = [(i, t + (" vile" if i % 5 == 0 else ""), ["en", "fr"][i % 2]) for i, t in enumerate(texts)]
    rows += [(1000 + i, "".join("#*$%&"[k % 5] + "qzx"[k % 3] for k in range(80)), "en") for i in range(10)]
    docs = spark.createDataFrame([*rows, (2000, None, None), (2001, "", "xx"), (None, "vile words", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 1000), int(i % 5 == 0 and i < 1000)) for i, _, _ in rows] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels


def _texts():
    import random

    r = random.Random(6)
    words = ["".join(r.choice(["ka", "to", "ri", "su", "mo", "la"]) for _ in range(r.randint(1, 3))) for _ in range(150)]
    return [" ".join(r.choice(words) for _ in range(r.randint(20, 60))) for _ in range(300)]


def test_toxicity_finds_held_out_rows(labelled, empty):
    docs, labels = labelled
    model = X.train(docs, labels.where("doc_id % 3 <> 0"))
    rows = X.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    held = [(r.doc_id % 5 == 0, r.score >= X.THRESHOLD) for r in rows if r.doc_id is not None and r.doc_id < 1000 and r.doc_id % 3 == 0]
    assert sum(a == b for a, b in held) >= 0.98 * len(held)
    blank = [r.score for r in rows if r.doc_id in (2000, 2001)]
    assert blank[0] == blank[1] < X.THRESHOLD
    assert X.score(empty, model).count() == 0


def test_toxicity_without_labels_is_the_prior(labelled):
    docs, labels = labelled
    for some in (labels.where("false"), labels.where("toxic = 0")):
        scores = {r.score for r in X.score(docs, X.train(docs, some)).collect()}
        assert len(scores) == 1 and scores.pop() <= 0.5


def test_toxicity_learns_from_labelled_documents_only(spark, labelled):
    """Labels without documents don't count for the bound or the prior, and rows that repeat teach once."""
    docs, labels = labelled
    few = labels.where("doc_id < 200").union(spark.createDataFrame([(i, 0, 1) for i in range(5000, 9000)], labels.schema))
    one, two = (X.train(d, l, 210) for d, l in ((docs, labels.where("doc_id < 200")), (docs.union(docs.where("doc_id < 50")), few)))
    assert len(one.grams) and (one.grams == two.grams).all() and one.weights == pytest.approx(two.weights) and one.intercept == pytest.approx(two.intercept)


def test_toxicity_query_by_brute_force(spark, labelled, table_dir):
    """Each score from the features of the whole text, by sets; a third of the ids is held out, and the verdict is the score's."""
    docs, labels = labelled
    folder = table_dir(documents=docs.union(docs.where("doc_id < 9")), labels=labels)
    rows = X.op2_toxicity(spark, folder).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 4 == 2
    taught = spark.createDataFrame([r for r in labels.collect() if not held(r.doc_id)], labels.schema)
    m = X.train(docs, taught)
    weight = dict(zip(m.grams.tolist(), m.weights.tolist(), strict=True))

    def score(text):
        s = bytes(32 if b in (9, 10, 11, 12, 13, 32) else b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
        grams = set()
        for n in X.ORDERS:
            for i in range(len(s) - n + 1):
                h = sum(int(X._TABLES[k][s[i + k]]) for k in range(n)) & 0xFFFFFFFF
                grams.add(((h ^ h >> 15) * (0x9E3779B1 + 2 * n) & 0xFFFFFFFF) >> (32 - X.BITS))
        return 1 / (1 + math.exp(-(sum(weight.get(g, 0.0) for g in grams) + m.intercept)))

    want = sorted((str(r.doc_id), held(r.doc_id), round(score(r.text), 6)) for r in docs.union(docs.where("doc_id < 9")).collect())
    assert sorted((str(r.doc_id), r.held_out, round(r.score, 6)) for r in rows) == want
    assert all(r.predicted == (r.score >= 0.3) for r in rows) and {r.predicted for r in rows} == {0, 1}


def test_features_are_those_of_each_text():
    import pyarrow as pa

    from lamina.llm.text import blocks

    def sets(texts):
        out = []
        for lo, hi, data, offsets in blocks(pa.array(texts)):
            doc, gram = X.features(data, offsets)
            out += [set(gram[doc == d].tolist()) for d in range(hi - lo)]
        return out

    texts = ["abcdef", "", "ab", "ABC", "abc", "xyz abc"]
    assert sets(texts) == [s for t in texts for s in sets([t])]
    assert sets(["ABC"]) == sets(["abc"]) and len(sets(["abcdef"])[0]) == 4 + 3 + 2


def kneser_ney(texts, order):
    """The model by the book, with dictionaries; -1 is the start sign."""
    counts = [collections.Counter() for _ in range(order + 1)]
    for t in texts:
        b = (-1,) * (order - 1) + tuple(t.encode())
        counts[order].update(b[i : i + order] for i in range(len(t.encode())))
    for k in range(order - 1, 0, -1):
        counts[k].update(g[1:] for g in counts[k + 1])
        for g in counts[k]:
            if g[0] == -1:
                counts[k][g] = sum(c for h, c in counts[k + 1].items() if h[1:] == g)
    discount = [None]
    for k in range(1, order + 1):
        n = collections.Counter(counts[k].values())
        d = [0.5, 1.0, 1.5]
        if n[1] and n[2]:
            y = n[1] / (n[1] + 2 * n[2])
            d = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
        discount.append([min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)])
    groups = [collections.defaultdict(list) for _ in range(order + 1)]
    for k in range(1, order + 1):
        for g, c in counts[k].items():
            groups[k][g[:-1]].append(c)

    def p(g):
        k = len(g)
        if not k:
            return 1 / 256
        own = groups[k].get(g[:-1])
        if own is None:
            return p(g[1:])
        cut = lambda c: discount[k][min(c, 3) - 1]
        c = counts[k].get(g, 0)
        return ((c - cut(c) if c else 0) + sum(map(cut, own)) * p(g[1:])) / sum(own)

    return p


def test_kneser_ney_by_the_book(spark, labelled):
    docs, _ = labelled
    own = docs.where("doc_id < 100").select("text").union(spark.createDataFrame([("\0\0kato",), ("ri\0",)], "text string"))
    taught = [r.text for r in own.collect()]
    model = K.train(own)
    p = kneser_ney(taught, K.ORDER)
    probe = docs.where("doc_id > 290 OR doc_id IS NULL")
    for most in (K.MODEL_ROWS, 0):  # the table sent whole, and joined
        for r in K.perplexity(probe.select("doc_id", "text"), model, ("doc_id", "text"), most).collect():
            b = (-1,) * (K.ORDER - 1) + tuple((r.text or "").encode())
            want = sum(math.log(p(b[i : i + K.ORDER])) for i in range(len(b) - K.ORDER + 1))
            assert r.n_bytes == len((r.text or "").encode()) and r.ln_p == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_quality_keeps_clean_text_and_drops_junk(labelled, empty):
    docs, labels = labelled
    rows = {r.doc_id: r for r in K.judged(docs, labels).collect()}
    assert sum(rows[i].kept for i in range(300)) >= 290 and not any(rows[1000 + i].kept for i in range(10))
    assert rows[2000].perplexity is None and not rows[2000].kept and not rows[2001].kept
    untrusted = K.judged(docs, labels.where("false")).collect()
    assert all(r.kept == bool(r.n_bytes) for r in untrusted)
    assert K.judged(empty, labels).count() == 0


def test_quality_query(labelled, table_dir, spark):
    """On whole tables with a repeated row; the limit is a quantile of the trusted documents set aside."""
    docs, labels = labelled
    rows = K.op4_quality_classifier(spark, table_dir(documents=docs.union(docs.where("doc_id = 7")), labels=labels)).collect()
    assert len(rows) == docs.count() + 1 and len([r for r in rows if r.doc_id == 7]) == 2
    assert all(r.kept == (r.perplexity is not None and r.perplexity <= r.threshold) for r in rows)
    aside = sorted(r.perplexity for r in rows if r.doc_id is not None and r.doc_id < 300 and r.lang == "en" and zlib.crc32(str(r.doc_id).encode()) % K.ASIDE == 0)
    assert {r.threshold for r in rows if r.lang == "en"} == {aside[math.ceil(K.QUANTILE * len(aside)) - 1]}


def base_by_brute_force(docs):
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    rows = [(r.doc_id, [*re.findall(WORD, (r.text or "").translate(lower)), None]) for r in docs.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter(w for i, t in rows if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    return sorted(((i, held(i), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for i, t in rows), key=str)


def test_language_model_counts_and_improves_on_them(docs, labelled, empty):
    for some in (docs, labelled[0]):
        rows = C.score(some).collect()
        assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows), key=str) == base_by_brute_force(some)
        assert all(r.score < 0 for r in rows)
    assert C.score(empty).count() == 0
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > 1.02 * sum(r.base_score for r in held)  # words at random, no copies: nothing here but single words helps


def test_language_model_query(table_dir, docs, spark):
    """The query's columns, on rows with nulls, repeated rows and extra columns; a score doesn't depend on how rows are dealt."""
    one = C.op8_context_mixing(spark, table_dir(documents=docs)).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in one), key=str) == base_by_brute_force(docs)
    assert all(r.bits_per_byte == pytest.approx(-r.score / math.log10(2) / len(stream_of(t)), rel=1e-9) for r, t in by_id(one, docs))


def by_id(rows, docs):
    texts = {r.doc_id: r.text for r in docs.collect()}
    return [(r, texts[r.doc_id]) for r in rows]


def stream_of(text):
    lower = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    return b"".join(w.encode() + b" " for w in re.findall(WORD, (text or "").translate(lower))) + b"\n"


def test_language_model_without_training_rows(spark):
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    rows = C.score(spark.createDataFrame([(i, "some text") for i in ids], "doc_id long, text string")).collect()
    assert [(r.n_known, r.train_tokens, r.base_score) for r in rows] == [(0, 0, 0.0)] * 3 and all(r.score < 0 for r in rows)


def way(code, before, byte):
    """Nodes and turns on the way to a byte after another."""
    row = int(code.own[before]) * 256 + byte
    first = int(code.first[row])
    return [(int(code.node[first + d]), int(code.turn[first + d])) for d in range(code.length[row])]


def plain_slots(code, body, i):
    """Node, turn and slots of each choice of byte i of one document's stream."""
    before = bytes([0] * C.REACH + list(body[:i]))[-C.REACH :]
    word = before[max(before.rfind(b" "), before.rfind(b"\0")) + 1 :]
    seen = [(int.from_bytes(before[-k:], "little") * 2 + k) for k in C.ORDERS] + [int.from_bytes(bytes(C.REACH - len(word)) + word, "little") * 2 + 1]
    hashes = []
    for v in seen:
        v = v * int(C._MUL) % 2**64
        hashes.append((v ^ v >> 29) * int(C._MIX) % 2**64 >> 32)
    for node, turn in way(code, before[-1], body[i]):
        yield node, turn, [((h + node * 0x85EBCA6B & 0xFFFFFFFF) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - bits) for h, bits in zip(hashes, C.SLOTS, strict=True)]


def plain_log10(m, body, told):
    """log10 of the probability of each byte, choice by choice."""
    out, right = [], 0
    w = C.Weights(m.weights)
    for i in range(len(body)):
        run = (1 if right < 4 else 2 if right < 16 else 3 if right < 32 else 4) if told[i] else 0
        total = 0.0
        for node, turn, slots in plain_slots(m.code, body, i):
            follow = next((2 * t - 1 for n, t in way(m.code, body[i - 1] if i else 0, told[i]) if n == node), 0) if told[i] else 0
            r = run if follow else 0
            seen = [int(m.table[C._AT[k] + s]) for k, s in enumerate(slots)]
            gate = (r * 3 + min(2, int(math.log2(C._COUNT[seen[-2]] + 1)))) * 3 + min(2, int(math.log2(C._COUNT[seen[-1]] + 1)))
            own = float(m.code.odds[node])
            x = w.own[gate] * own + w.follow[gate] * follow
            for k, s in enumerate(seen):
                x += w.tables[k, gate, min(C._CONF - 1, int(math.log2(C._COUNT[s] + 1)))] * C._ODDS[s]
            at = round((min(max(x, -8), 8) + 8) * (C._BINS - 1) / 16)
            p = 0.5 / (1 + math.exp(-x)) + 0.5 * float(m.refine.reshape(-1, C._BINS)[gate * 8 + int(min(max(own, -3.99), 3.99) + 4), at])
            total += math.log10(max(p if turn else 1 - p, 1e-6))
        out.append(total)
        right = right + 1 if told[i] and told[i] == body[i] else 0
    return out


def test_states_keep_small_counts_and_nearly_keep_large_ones():
    n0, n1 = (x.ravel() for x in np.meshgrid(np.arange(C.EXACT + 1), np.arange(C.EXACT + 1)))
    few = n0 + n1 <= C.EXACT
    s = C.states(n0[few], n1[few])
    assert len(set(s.tolist())) == few.sum() and np.allclose(C._ODDS[s], np.log((n1[few] + C._DELTA) / (n0[few] + C._DELTA)), atol=1e-6)
    for turn, (a, b) in enumerate(((n0 - 1, n1), (n0, n1 - 1))):
        some = few & (a >= 0) & (b >= 0)
        assert (C._LESS[256 * turn + C.states(n0[some], n1[some]).astype(int)] == C.states(a[some], b[some])).all()
    big = np.array([20, 500, 10**9]), np.array([3, 900, 5])
    assert np.allclose(C._ODDS[C.states(*big)], np.log(big[1] / big[0]).clip(-7, 7), atol=0.25)
    assert C._ODDS[C._LESS[256 + C.states(np.array([19]), np.array([1])).astype(int)]][0] < -3


def toy(spark, texts, told=None):
    """Streams of texts, and the mixer that is learnt from them."""
    import pyarrow as pa

    streams = [stream_of(t) for t in texts]
    body, offsets = packed(streams)
    said = np.frombuffer(b"".join(told), np.uint8) if told else np.zeros(len(body), np.uint8)
    row = C._rows(pa.int64(), kind=C._TEXTS, block=0, range=0, size=np.diff(offsets), held=np.zeros(len(texts), bool), body=C._squeezed(body), told=C._told(body, said), doc_id=pa.array(range(len(texts))))
    return streams, C.learn(spark.createDataFrame(pa.Table.from_batches([row])), 1)


def packed(parts):
    return np.frombuffer(b"".join(parts), np.uint8), np.append(0, np.cumsum([len(x) for x in parts]))


def test_every_byte_comes_from_the_mixer(spark, monkeypatch):
    """Counts and probabilities against loops over choices; a long word, several documents in a block, windows that cut words."""
    texts = [*_texts()[:30], "x" * 90 + " y", "é ñ", "", "a", _texts()[0]]
    told = [bytes(b if 20 < i < 90 else b ^ 1 if i == 90 else 0 for i, b in enumerate(stream_of(t))) for t in texts]
    streams, m = toy(spark, texts, told)
    counts = collections.Counter((k, s, turn) for b in streams for i in range(len(b)) for _, turn, slots in plain_slots(m.code, b, i) for k, s in enumerate(slots))
    places = sorted({(k, s) for k, s, _ in counts})
    want = C.states(*(np.array([counts[k, s, turn] for k, s in places]) for turn in (0, 1)))
    assert (m.table[[C._AT[k] + s for k, s in places]] == want).all() and np.count_nonzero(m.table) == len(places)
    (body, offsets), (follow, _) = packed(streams), packed(told)
    want = np.concatenate([plain_log10(m, s, t) for s, t in zip(streams, told, strict=True)])
    for step, part in ((1 << 14, 1 << 15), (37, 64)):
        monkeypatch.setattr(C, "_PART", part)
        x = C.Bytes(m.code, body, follow, offsets)
        got = x.spread(m.log10(x, step))
        assert got == pytest.approx(want, rel=2e-2, abs=2e-2) and got.sum() == pytest.approx(want.sum(), rel=1e-4)
        assert x.many.sum() == len(body)


def test_contexts_are_those_of_each_byte(monkeypatch):
    """Across parts and short texts, beside bytes of 0; which bytes before are of the same word; and hashes give them back."""
    streams = [b"\n", b"a \n", b"\n", b"\n", b"ab\0cdefgh\0i jklmnopqrstu v \n", b"\0 \0\0 x \n", *(stream_of(t) for t in _texts()[:5]), b"abcdefghij \n", b"k \n"]
    body, offsets = packed(streams)
    want = []
    for s in streams:
        for i in range(len(s)):
            before = bytes([0] * C.REACH + list(s[:i]))[-C.REACH :]
            size = C.REACH - 1 - max(before.rfind(b" "), before.rfind(b"\0"))
            kept = before[-max(size, *C.ORDERS) :]
            want.append((int.from_bytes(bytes(C.REACH - len(kept)) + kept + s[i : i + 1], "little"), before[C.REACH - size :]))
    for part in (1 << 15, 64, 1):
        monkeypatch.setattr(C, "_PART", part)
        got = list(C.contexts(body, offsets))
        assert [a for a, _ in got] == list(range(0, len(body), part))
        key = np.concatenate([x for _, x in got])
        word = C.spoken(key & np.uint64((1 << 56) - 1))
        assert [(int(k), int(x).to_bytes(7, "little").lstrip(b"\0")) for k, x in zip(key, word, strict=True)] == want
        assert (C._unmixed(C._mixed(key.copy())) == key).all()


def test_bytes_that_nothing_is_foretold_have_windows_of_their_own(spark):
    """They come first, so their windows look for no follower, and counting holds no more than a window's choices."""
    texts = _texts()[:60]
    streams, m = toy(spark, texts)
    told = [bytes(b if 20 < i < 90 and n % 3 == 0 else 0 for i, b in enumerate(s)) for n, s in enumerate(streams)]
    (body, offsets), (follow, _) = packed(streams), packed(told)
    x = C.Bytes(m.code, body, follow, offsets)
    silent = int((x.run == 0).sum())
    assert 0 < silent < len(x) and not x.run[:silent].any() and x.run[silent:].all() and x.many[silent:].sum() == (follow > 0).sum()
    assert [c.run is None for c in x.choices(100)] == [lo + 100 <= silent or not x.run[lo : lo + 100].any() for lo in range(0, len(x), 100)]
    assert sorted(x.spread(x.run.astype(float))[follow > 0]) == sorted(x.run[silent:].repeat(x.many[silent:]))
    turns = [(c.run is not None, len(c.before)) for c in x.dealt(20)]
    assert sum(n for run, n in turns if run) <= len(x) - silent and sum(n for _, n in turns) == len(x)
    half = [run for run, _ in turns[: len(turns) // 2]]
    assert abs(2 * sum(half) - sum(run for run, _ in turns)) <= 2
    y = C.Bytes(m.code, body, follow, offsets, back=False)
    kinds = [sorted(zip(z.row.tolist(), z.many.tolist(), z.told.tolist(), z.run.tolist(), *(h.tolist() for h in z.hashes), strict=True)) for z in (x, y)]
    assert kinds[0] == kinds[1]


def test_distinct_hashes_that_differ_in_low_bits_only():
    r = np.random.default_rng(1)
    some = r.integers(0, 1 << 64, 50, dtype=np.uint64)
    for h in (r.choice(some, 500), r.choice(np.append(some, some[:9] ^ np.uint64(1)), 500), some[:1], some[:0]):
        for got, want in zip(C._distinct(h), np.unique(h, return_inverse=True), strict=True):
            assert (got == want).all()


def test_pairs_of_bytes_are_those_of_each_text(monkeypatch):
    streams = [b"\n", b"\n", b"a \n", b"\xff\xff \n", *(stream_of(t) for t in _texts()[:3]), b"\n"]
    want = collections.Counter(p for s in streams for p in zip(b"\0" + s, s))
    for part in (1 << 15, 7, 1):
        monkeypatch.setattr(C, "_PART", part)
        got = C._pairs(*packed(streams))
        assert got.sum() == sum(want.values()) and all(got[a * 256 + b] == n for (a, b), n in want.items())


def test_counting_holds_a_window_at_a_time(spark, monkeypatch):
    streams, m = toy(spark, _texts()[:60])
    body, offsets = packed(streams)
    made, whole = [], C.Choices

    def seen(x, lo, hi):
        made.append(hi - lo)
        return whole(x, lo, hi)

    x = C.Bytes(m.code, body, np.zeros_like(body), offsets)
    monkeypatch.setattr(C, "STEP", 50)
    monkeypatch.setattr(C, "Choices", seen)
    counts = np.zeros(2 * C._AT[-1], np.int32)
    C.tally(x, counts)
    assert max(made) <= 50 and sum(made) == len(x) and counts.sum() == len(C.SLOTS) * (m.code.length[x.row] * x.many).sum()


def test_bytes_have_a_distribution(spark):
    """Whatever came before and is foretold, the probabilities of all bytes add up to one."""
    _, m = toy(spark, _texts()[:40])
    for before, said in ((b"", 0), (b"kato ri", 0), (b"kato ri", 107), (b"\xff\xfe", 32)):
        total = 0.0
        for b in range(256):
            body = np.frombuffer(before + bytes([b]), np.uint8)
            told = np.zeros(len(body), np.uint8)
            told[-1] = said
            x = C.Bytes(m.code, body, told, np.array([0, len(body)]))
            total += 10 ** float(x.spread(m.log10(x))[-1])
        assert total == pytest.approx(1.0, abs=2e-3)


def test_learning_lowers_the_cost(spark):
    streams, m = toy(spark, _texts())
    body, offsets = packed(streams)
    start = C.Mixer(m.code, m.table, *C._start())
    c = C.Choices(C.Bytes(m.code, body, np.zeros(len(body), np.uint8), offsets), 0, 1 << 20)

    def cost(x):
        p = C.squash(x.mixed(c, True, *x.ready())[0])
        return -float((c.many * np.log(np.where(c.turn == 1, p, 1 - p))).sum())

    assert cost(m) < cost(start)


def test_a_copy_is_foretold(spark):
    texts = _texts()
    ids = iter(i for i in range(10_000) if zlib.crc32(str(i).encode()) % 7 != 2)
    held = next(i for i in range(10_000) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = [(next(ids), t) for t in texts] + [(held, texts[7] + " " + texts[8])]
    got = {r.doc_id: r for r in C.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[held].score > 0.8 * got[held].base_score


def test_both_of_two_copies_are_foretold(spark):
    texts = [" ".join(_texts()[i : i + 4]) for i in range(0, 200, 4)]
    ids = iter(i for i in range(10_000) if zlib.crc32(str(i).encode()) % 7 != 2)
    rows = [(next(ids), t) for t in [*texts, texts[3]]]
    got = {r.doc_id: r.bits_per_byte for r in C.score(spark.createDataFrame(rows, "doc_id long, text string")).selectExpr("doc_id", "-score / n_bytes AS bits_per_byte").collect()}
    pair, rest = [got[rows[3][0]], got[rows[-1][0]]], [got[i] for i, t in rows if t != texts[3]]
    assert max(pair) < 0.6 * min(rest)


def test_continuations_go_on_to_the_next_run(spark):
    """However far that is: of a text in which no run that is looked up follows the first one, all the rest."""
    w = [f"w{i}" for i in range(20_000)]
    data = np.frombuffer(" ".join(w).encode(), np.uint8)
    words = C.Words(data, np.array([0, len(data)]), lower=True)
    place, g, _ = C.grams_by_doc(words.hashes(), words.first, C.SEED)
    place = place[g % np.uint64(C.EVERY) == 0]
    gap = int(np.argmax(np.diff(place)))
    assert place[gap + 1] - place[gap] > 64 + C.SEED
    text = " ".join(w[place[gap] : place[gap + 1]])
    taught = [i for i in range(99) if zlib.crc32(str(i).encode()) % 7 != 2][:2]
    run = len(" ".join(text.split()[: C.SEED])) + 1
    for ids in (taught, [taught[0], None], [None, taught[0]]):
        streams = streams_of(spark, [(i, text) for i in ids])
        assert [told for _, told in streams] == [b"\0" * run + body[run:] for body, _ in streams] and len(streams) == 2
    assert all(told == bytes(len(body)) for body, told in streams_of(spark, [(taught[0], text)] * 2))


def streams_of(spark, rows):
    """Stream and foretold bytes of each row."""
    import tempfile

    with tempfile.TemporaryDirectory() as d:
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        blocks = C._packed(docs, 3, f"file://{d}/a")
        streams = C._foretold(blocks, C._met(blocks, 3, f"file://{d}/b")).toArrow()
    out = []
    for _, body, told, offsets in C._streams(iter(streams.to_batches())):
        out += [(body[a:b].tobytes(), told[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return out


def foretold_by_brute_force(rows):
    """What each stream is foretold: from each run of SEED words that is looked up on, what came next in the least other training text."""
    streams = [stream_of(t) for _, t in rows]
    found, places = {}, []
    for n, ((i, _), s) in enumerate(zip(rows, streams, strict=True)):
        w = s[:-1].split()
        starts = [0]
        for x in w:
            starts.append(starts[-1] + len(x) + 1)
        words = C.Words(np.frombuffer(s, np.uint8), np.array([0, len(s)]))
        at = list(zip(*C.anchors(words.hashes(), words.first)[1:], strict=True))
        ends = [starts[p + C.SEED] for p, _ in at]
        places.append(list(zip([a for _, a in at], ends, strict=True)))
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for k, (a, end) in enumerate(places[n]):
                found.setdefault(int(a), []).append((i, k, s[end : ends[k + 1] if k + 1 < len(ends) else len(s)]))
    out = []
    for (i, _), s, own in zip(rows, streams, places, strict=True):
        told = bytearray(len(s))
        for a, end in own:
            known = sorted(found.get(int(a), []))
            source = next((x for x in (known[:1] + [next(y for y in known if y[0] == known[-1][0])] if known else []) if x[0] != i), None)
            for k, b in enumerate(source[2][: len(s) - end] if source else b""):
                told[end + k] = b
                if s[end + k] != b:
                    break
        out.append((s, bytes(told)))
    return out


def test_what_is_foretold_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 4000)
    texts = _texts()
    rows = [(i, f"{t} {texts[(i * 7) % 50]}") for i, t in enumerate(texts[:90])] + [(400 + i, " ".join(texts[i : i + 3])) for i in range(20)] + [(600, ""), (601, "a b")]
    want = foretold_by_brute_force(rows)
    assert sorted(streams_of(spark, rows)) == sorted(want) and sum(any(told) for _, told in want) > 80


def test_a_text_over_a_block_is_scored_whole(spark):
    long = " ".join(_texts()) * 20  # over BLOCK_BYTES
    assert len(long) > 1 << 20
    rows = C.score(spark.createDataFrame([(i, t) for i, t in enumerate([long, *_texts()[:5]])], "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_tokens for r in rows}[0] == len(long.split()) + 1 and all(r.score < 0 for r in rows)
