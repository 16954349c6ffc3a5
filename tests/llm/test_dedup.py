from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lamina.llm import near_dedup as N, quality_rules as Q, substring_dedup as S

WORD = "[^\x20\x09-\x0d]+"


def rows_of(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def shingle_sets(rows):
    out = []
    for i, t in rows:
        w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), t))
        out.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    return out


def near_by_brute_force(rows):
    sets = shingle_sets(rows)
    parent = {i: i for i, _ in sets if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = [(i, s) for i, s in sets if i is not None and s]
    for k, (i, a) in enumerate(known):
        for j, b in known[:k]:
            if 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return sorted(((i, len(s), root(i) if i is not None else None, i is None or root(i) == i) for i, s in sets), key=str)


def test_near_dedup_by_brute_force(docs):
    got = N.classes(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == near_by_brute_force(rows_of(docs))


@pytest.mark.parametrize("region", [4, 9])
def test_near_dedup_of_crowded_regions(spark, monkeypatch, region):
    """One large group of near copies around a few texts, with regions so small that deeper forests and parts are needed."""
    import random

    monkeypatch.setattr(N, "REGION", region)
    monkeypatch.setattr(N, "SMALL", 3)
    r = random.Random(4)
    base = [f"w{r.randint(0, 999)}" for _ in range(120)]
    rows = []
    for i in range(60):
        v = list(base)
        for _ in range(i % 5):
            v[r.randrange(len(v))] = f"x{r.randint(0, 999)}"
        rows.append((i + 1, " ".join(v)))
    got = N.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in got), key=str) == near_by_brute_force(rows)


def test_near_dedup_compares_all_parts_of_large_regions(spark, monkeypatch):
    """Texts with one long passage in common meet in regions of the last forest that are too large; each has one near copy."""
    import random

    monkeypatch.setattr(N, "REGION", 8)
    monkeypatch.setattr(N, "SMALL", 3)
    monkeypatch.setattr(N, "FORESTS", ((1, 1),))
    r = random.Random(9)
    passage = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(40):
        own = [f"o{i}x{r.randint(0, 9999)}" for _ in range(60)]
        rows += [(i + 1, " ".join([*passage, *own])), (i + 101, " ".join([*passage, *own, "more"]))]
    got = N.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in got), key=str) == near_by_brute_force(rows)


def test_near_dedup_of_documents_with_several_texts(spark):
    """A doc_id is one document with the links of all its texts; rows that repeat stay rows."""
    import random

    r = random.Random(12)
    a, b, c = ([f"w{r.randint(0, 9999)}" for _ in range(80)] for _ in range(3))
    rows = [(1, a), (1, b), (2, [*a, "more"]), (3, [*b, "more"]), (4, c), (4, c), (5, [*c, "more"]), (6, []), (6, c[:40])]
    rows = [(i, " ".join(t)) for i, t in rows] + [(7, ""), (7, "one two"), (-8, "one two")]
    got = N.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in got), key=str) == near_by_brute_force(rows)


def test_near_dedup_stage_leaves_repeated_rows_once(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (3, "q r"), (3, "s t"), (None, "q r")]
    out = N.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(1, "a b c d e f g"), (3, "q r"), (3, "s t"), (None, "q r")], key=str)


def test_regions_are_sorted_by_the_order_of_their_tree():
    import numpy as np

    r = np.random.RandomState(5)
    sig, tree, key = r.randint(0, 3, (500, N.HASHES)).astype(np.uint8), r.randint(0, 136, 500), r.randint(0, 9, 500)
    orders = N._orders(N.FORESTS)
    path = N._paths(sig, tree, orders)
    assert all((path[i] == sig[i, orders[tree[i]]]).all() for i in range(500))
    order = N._sorted_in(key, path)
    rows = [(int(key[i]), path[i].tobytes()) for i in order]
    assert rows == sorted(rows)


def _agreeing(agree, shared):
    """A batch of one region: rows 2 k and 2 k + 1 agree in agree[k] minima, and have shared[k] of 100 shingles in common."""
    import numpy as np
    import pyarrow as pa

    m = 2 * len(agree)
    sig = np.random.RandomState(3).randint(0, 256, (m, N.HASHES)).astype(np.uint8)
    sets = [np.arange(1000 * i, 1000 * i + 100, dtype=np.uint64) for i in range(m)]
    for k, n in enumerate(agree):
        sig[2 * k + 1] = sig[2 * k] + 1
        sig[2 * k + 1, :n] = sig[2 * k, :n]
        sets[2 * k + 1] = np.sort(np.append(sets[2 * k][: shared[k]], sets[2 * k + 1][shared[k] :]))
    columns = {"key": [5] * m, "id": list(range(1, m + 1)), "tree": pa.array([0] * m, pa.int32()), "n": [100] * m, "component": list(range(1, m + 1))}
    return pa.table(columns | {"sig": [x.tobytes() for x in sig], "shingles": [x.tobytes() for x in sets]}).to_batches()[0]


def test_last_look_finds_what_reaches_the_threshold():
    """86 of 100 in common is a similarity of 0.754, 85 one of 0.739."""
    out = list(N._apart(N.FORESTS, True)(iter([_agreeing([N.AGREE, 250, 200, N.AGREE - 1], [86, 85, 100, 100])])))
    assert [(a, b) for x in out for a, b in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)] == [(1, 2), (5, 6)]


def test_near_dedup_recall_of_borderline_pairs(spark):
    """Chains of texts whose neighbours are at 0.75 to 0.8, beside others at 0.65 to 0.74: every link counts, no other one."""
    import random

    r = random.Random(21)
    rows = []
    for i in range(120):
        base = [f"w{r.randint(0, 99_999)}" for _ in range(r.randint(40, 200))]
        rows.append((3 * i, base))
        for k in (1, 2):
            v, n = list(rows[-1][1]), len(base)
            edits = max(1, round(n * r.uniform(0.02, 0.055)))
            for e in range(edits):
                v[(e * n) // edits + r.randrange(max(1, n // edits - 4))] = f"x{r.randint(0, 99_999)}"
            rows.append((3 * i + k, v))
    rows = [(i, " ".join(t)) for i, t in rows]
    got = N.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = near_by_brute_force(rows)
    assert 40 < sum(not kept for *_, kept in want) < 200
    assert sorted(((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in got), key=str) == want


def test_near_dedup_stage_keeps_columns_and_one_of_each_group(spark, docs, empty):
    out = N.stage(spark, docs, "")
    assert out.schema.simpleString() == docs.schema.simpleString()
    kept = {i for i, _, _, k in near_by_brute_force(rows_of(docs)) if k}
    assert {r.doc_id for r in out.collect()} == kept
    assert N.classes(empty).count() == N.stage(spark, empty, "").count() == 0


def substrings_by_brute_force(rows, length):
    words = [(i, re.findall(WORD, t)) for i, t in rows]
    key = lambda i: 2**63 if i is None else i
    least: dict[tuple, int] = {}
    for i, w in words:
        for k in range(len(w) - length + 1):
            g = tuple(w[k : k + length])
            least[g] = min(least.get(g, 2**64), key(i))
    out = []
    for i, w in words:
        gone = {k + j for k in range(len(w) - length + 1) if least[tuple(w[k : k + length])] < key(i) for j in range(length)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("length", "seed"), [(50, 10), (12, 4), (6, 6)])
def test_substring_dedup_by_brute_force(docs, length, seed):
    got = S.remove(docs, length, seed).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("h")).collect()
    assert sorted(map(tuple, got), key=str) == substrings_by_brute_force(rows_of(docs), length)


def test_regions_do_not_depend_on_how_windows_are_chunked(monkeypatch):
    import numpy as np

    h = S.mix(np.random.RandomState(0).randint(0, 40, 3000).astype(np.uint64))
    first = np.array([0, 10, 700, 700, 3000])

    def windows():
        doc, lo, n, a, _ = S.regions(h, first, 20, 5)
        return {(int(d), int(x + k)): int(y) for d, x, m, y in zip(doc, lo, n, a, strict=True) for k in range(m)}

    whole = windows()
    assert len(whole) == (700 - 10 - 19) + (2300 - 19)
    monkeypatch.setattr(S, "_CHUNK", 64)
    assert windows() == whole


def test_substring_stage(spark, docs, empty):
    out = S.stage(spark, docs, "")
    assert out.schema.simpleString() == docs.schema.simpleString() and out.count() == docs.count()
    before = {r.doc_id: r.text for r in docs.collect()}
    changed = [r for r in out.collect() if r.text != before[r.doc_id]]
    assert changed and all(r.n_chars == len(r.text) for r in changed)
    assert S.remove(empty).count() == 0


def test_rules_policies_and_ablation(spark, docs, empty):
    book = Q.ledger(docs)
    assert book.count() == docs.count() and Q.ledger(empty).count() == 0
    blank = {r.n_words for r in book.join(docs.where("trim(coalesce(text, '')) = ''").select("doc_id"), "doc_id").collect()}
    assert blank == {0}
    rows = book.collect()
    table = {r.rule: (r.n_failed, r.n_only_this, r.n_all) for r in Q.ablation(book, "v2").collect()}
    for i, (name, _) in enumerate(Q.RULES):
        failed = [r.failed_bits for r in rows if r.failed_bits >> i & 1]
        assert table[name] == (len(failed), sum(b & Q.mask(Q.POLICIES["v2"]) == 1 << i for b in failed), len(rows))
    out = Q.stage(spark, docs, "")
    assert out.schema.simpleString() == docs.schema.simpleString()
    assert out.count() == sum(r.failed_bits & Q.mask(Q.POLICIES[Q.CURRENT]) == 0 for r in rows) > 0


def test_texts_over_a_block_are_handled_whole(spark):
    """A text over BLOCK_BYTES, a near copy of it, and one that repeats a passage from its end."""
    import random

    from lamina.llm.text import BLOCK_BYTES

    r = random.Random(13)
    w = [f"w{r.randint(0, 10**6)}" for _ in range(160_000)]
    assert len(" ".join(w)) > BLOCK_BYTES
    rows = [(1, " ".join(w)), (2, " ".join([*w[:-1], "other"])), (3, " ".join(["x", *w[-120:-20], "y"])), (4, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in N.classes(docs).collect()), key=str)
    assert got == near_by_brute_force(rows) and got[1][2] == 1
    gone = S.remove(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("h")).collect()
    assert sorted(map(tuple, gone), key=str) == substrings_by_brute_force(rows, S.LENGTH)
    book = {x.doc_id: (x.n_words, x.n_repeat_words) for x in Q.ledger(docs).collect()}
    assert book[1] == (160_000, 0) and book[4] == (2, 0)
