from __future__ import annotations

import random

import numpy as np
import pytest

from lamina.llm import decontamination as D, licences as L


def distances(pattern, text):
    row, out = list(range(len(pattern) + 1)), []
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (p != c)))
        row = new
        out.append(row[-1])
    return out


def test_myers_by_brute_force():
    r = random.Random(2)
    for _ in range(500):
        p, t = [r.randint(0, 4) for _ in range(r.randint(1, 80))], [r.randint(0, 4) for _ in range(r.randint(0, 90))]
        assert D.myers(D._places(np.array(p)), len(p), t) == distances(p, t)


@pytest.fixture(scope="module")
def planted(spark):
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(600)]
    items = [" ".join(r.choice(vocabulary) for _ in range(r.randint(9, 50))) for _ in range(20)] + ["too short", "", None]
    rows = []
    for i in range(150):
        w = items[i % 20].split()
        for _ in range(r.randint(0, len(w) * D.ERROR_PERCENT // 100 + 2)):
            k = r.randrange(len(w))
            [lambda: w.__setitem__(k, r.choice(vocabulary)), lambda: w.pop(k), lambda: w.insert(k, r.choice(vocabulary))][r.randint(0, 2)]()
        pad = [[r.choice(vocabulary) for _ in range(r.randint(0, 40))] for _ in range(2)]
        rows.append((i, ", ".join([*pad[0], *w, *pad[1]]).title() if i % 2 else "\n".join([*pad[0], *w, *pad[1]])))
    rows += [(900, None), (901, ""), (902, items[0] + " x y z " + items[0])]
    docs = spark.createDataFrame([(*x, "k") for x in rows], "doc_id long, text string, distance string")
    return docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), rows, items


def test_leaks_by_brute_force(spark, planted, docs, empty, monkeypatch):
    table, bench, rows, items = planted
    want = {}
    for i, t in rows:
        words = (t or "").lower().replace(",", " ").split()
        for k, item in enumerate(items):
            p = (item or "").split()
            if len(p) >= D.LEAST_WORDS and words and (d := min(distances(p, words))) <= len(p) * D.ERROR_PERCENT // 100:
                want[i, k] = d
    found = D.leaks(table, bench).collect()
    best: dict[tuple, int] = {}
    for r in found:
        best[r.doc_id, r.item_id] = min(best.get((r.doc_id, r.item_id), 99), r.distance)
    assert best == want
    assert sum(r.doc_id == 902 and r.item_id == 0 for r in found) == 2
    text = dict(rows)
    assert all(text[r.doc_id].encode()[r.start : r.end].decode().strip() for r in found)
    monkeypatch.setattr(D, "BLOCK_WORDS", 60)  # several blocks of items
    assert {(r.doc_id, r.item_id) for r in D.leaks(table, bench).collect()} == set(want)
    assert sorted(r.item_id for r in D.short_items(bench).collect()) == [20, 21, 22]
    assert D.leaks(empty, bench).count() == D.leaks(table, bench.where("false")).count() == 0
    assert D.leaks(docs, bench).count() == 0


def test_short_items_are_found_verbatim(spark):
    bench = spark.createDataFrame([(1, "What is the capital?"), (2, "alone"), (3, ""), (4, "..."), (5, None), (6, "one two three four five six seven")], "item_id long, text string")
    rows = [(1, "Asked: what is THE capital? What is the capital"), (2, "what is a capital"), (3, "left alone"), (4, "one two three five four six seven"), (5, "zero one two three four five six seven"), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = D.leaks(docs, bench).collect()
    assert sorted((r.doc_id, r.item_id, r.distance) for r in found) == [(1, 1, 0), (1, 1, 0), (3, 2, 0), (5, 6, 0)]


def test_stage_drops_leaking_documents(spark, planted, table_dir):
    table, bench, rows, _ = planted
    out = D.stage(spark, table, table_dir(benchmark=bench))
    leaking = {r.doc_id for r in D.leaks(table, bench).collect()}
    assert out.columns == table.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, _ in rows if i not in leaking)


def test_signals_and_bounds_lose_no_licence():
    words = set(L.signals())
    for _, t in L.TEMPLATES:
        grams = L.template_bigrams(t)
        with_signal = sum(bool(set(g.split()) & words) for g in grams)
        assert with_signal > len(grams) - min(L.size_bounds(len(grams)))
    for n in range(1, 60):
        reach = [m for m in range(1, 200) if 2 * min(n, m) / (n + m) >= L.THRESHOLD]
        assert reach == list(L.size_bounds(n))


def test_licences_in_lines_paragraphs_and_texts(spark, docs, empty):
    mit = L.TEMPLATES[0][1]
    rows = [
        (1, "Some text.\nReleased under the MIT License.\nMore."), (2, mit.replace("\n", "\n   ")), (3, f"Intro\n\n{mit}\n\nOutro words"), (4, "This work is LICENSED under the GNU General Public License, version 3!"),
        (5, "A license is not a text about the MIT"), (6, None), (7, ""), (8, "license"),
    ]
    got = {(r.doc_id, r.licence) for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(1, "MIT"), (2, "MIT"), (3, "MIT"), (4, "GPL-3.0")} <= got and not {i for i, _ in got} & {5, 6, 7, 8}
    assert L.scan(empty).count() == L.scan(docs).count() == 0


def dice_by_brute_force(rows, threshold):
    import re

    out = set()
    for i, t in rows:
        for part in [t, *t.split("\n"), *re.split(r"\n[^A-Za-z0-9\n]*\n", t), *re.split(r"[.!?]\s+", t)]:
            a = set(L.template_bigrams(part))
            found = sorted((-2 * len(a & set(b)) / (len(a) + len(b)), name) for name, x in L.TEMPLATES for b in [L.template_bigrams(x)] if a)
            if found and -found[0][0] >= threshold:
                out.add((i, found[0][1]))
    return out


@pytest.mark.parametrize("threshold", [0.3, 0.55, 0.8])
def test_licences_by_brute_force(spark, threshold):
    """Other thresholds, sentences, notices in comments, and parts that are equally like two templates."""
    gpl = next(t for n, t in L.TEMPLATES if n == "GPL-3.0")
    rows = [
        (1, "Released under the MIT License. See the LICENSE file for details."), (2, "This project is released under the MIT License, see LICENSE."),
        (3, "# " + gpl.replace("\n", "\n# ") + "\n#\n# You should have received a copy.\nimport os"), (4, "Released under the License."), (5, "Some words. Distributed under the ISC License! More words"),
        (6, "a text that has nothing to do with it"), (7, "provided that the following conditions are met"),
    ]
    got = {(r.doc_id, r.licence) for r in L.scan(spark.createDataFrame(rows, "doc_id long, text string"), threshold).collect()}
    assert got == dice_by_brute_force(rows, threshold) and (1, "MIT") in got and (3, "GPL-3.0") in got


def test_decontamination_query_answers_repeated_items_and_rows(spark, table_dir):
    item = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(1, item), (2, item), (2, item)], "item_id long, text string")
    long = "x " * 600_000 + item + " y" * 10  # over BLOCK_BYTES
    table = spark.createDataFrame([(5, f"a {item} b"), (5, f"a {item} b"), (6, "nothing"), (None, item), (7, long)], "doc_id long, text string")
    rows = D.op1_decontamination(spark, table_dir(documents=table, benchmark=bench)).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in rows) == sorted([("5", 1), ("5", 2), ("5", 2)] * 2 + [("None", 1), ("None", 2), ("None", 2), ("7", 1), ("7", 2), ("7", 2)])
    assert [(r.start, r.end) for r in rows if r.doc_id == 7][0] == (1_200_000, 1_200_000 + len(item))
