from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lamina.llm import text as X

TEXT = st.text(st.sampled_from("ab Z\n\t\x0b\x1cé 😀") | st.characters(exclude_categories=["Cs"]), max_size=60)


@settings(max_examples=200, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=8), st.integers(1, 40))
def test_words_are_those_of_the_pattern_in_blocks_of_any_size(texts, limit):
    rows = []
    for lo, hi, data, offsets in X.blocks(pa.array(texts), limit):
        w = X.Words(data, offsets)
        words = [bytes(data[a:b]).decode() for a, b in zip(w.starts, w.ends, strict=True)]
        h = w.hashes()
        for d in range(hi - lo):
            rows.append((words[w.first[d] : w.first[d + 1]], h[w.first[d] : w.first[d + 1]].tolist()))
    assert [r[0] for r in rows] == [re.findall("[^\x20\x09-\x0d]+", t) for t in texts]
    by_word: dict[str, int] = {}
    for words, hashes in rows:
        for x, y in zip(words, hashes, strict=True):
            assert by_word.setdefault(x, y) == y
    assert len(set(by_word.values())) == len(by_word)


def test_hashes_of_long_words_differ_in_any_byte():
    words = ["a" * n for n in range(1, 40)] + ["a" * n + "b" + "a" * (30 - n) for n in range(31)]
    _, _, data, offsets = next(X.blocks(pa.array([" ".join(words)])))
    assert len(set(X.Words(data, offsets).hashes().tolist())) == len(set(words))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 12))
def test_grams_are_equal_where_items_are(items, k):
    h = X.mix(np.array(items, np.uint64) + np.uint64(5))
    g = X.grams(h, k).tolist()
    assert len(g) == max(0, len(items) - k + 1)
    seen: dict[tuple, int] = {}
    for i, x in enumerate(g):
        assert seen.setdefault(tuple(items[i : i + k]), x) == x
    assert len(set(seen.values())) == len(seen)
