"""The whole pipeline against plain Python, stage by stage as documented."""

from __future__ import annotations

import random
import re

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from conftest import made_up
from test_dedup import WORD, near_by_brute_force
from test_matching import distances

from lamina.llm import byte_bpe as B, decontamination as D, quality_rules as Q, substring_dedup as S


def passes_rules(text: str) -> bool:
    words = re.findall(WORD, text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    m = {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_lines": len(lines),
        "n_repeat_words": len({i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}), "n_upper": len(re.findall("[A-Z]", text)), "n_letters": len(re.findall("[A-Za-z]", text)), "n_bangs": text.count("!"),
    }
    failed = [eval(fails.replace("AND", "and").replace("OR", "or"), {}, m) for name, fails in Q.RULES if name in Q.POLICIES[Q.CURRENT]]  # noqa: S307
    return not any(failed)


def without_repeats(rows: list[tuple]) -> list[tuple]:
    words = [re.findall(WORD, t) for _, t in rows]
    key = lambda i: 2**63 if i is None else i
    least: dict[tuple, int] = {}
    for (i, _), w in zip(rows, words, strict=True):
        for k in range(len(w) - S.LENGTH + 1):
            g = tuple(w[k : k + S.LENGTH])
            least[g] = min(least.get(g, 2**64), key(i))
    out = []
    for (i, t), w in zip(rows, words, strict=True):
        gone = {k + j for k in range(len(w) - S.LENGTH + 1) if least[tuple(w[k : k + S.LENGTH])] < key(i) for j in range(S.LENGTH)}
        out.append((i, " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t))
    return out


def leaks(text: str, items: list[str]) -> bool:
    words = re.findall("[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    for item in items:
        p = re.findall("[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), item or ""))
        if p and min(distances(p, words), default=99) <= (len(p) * D.ERROR_PERCENT // 100 if len(p) >= D.LEAST_WORDS else 0):
            return True
    return False


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(5)
    base = made_up(21, 30, 90)
    items = [" ".join(t.split()[:14]) for t in made_up(22, 6)] + ["", None]
    passage = " ".join(made_up(23, 1, 200)[0].split()[:70])
    texts = [*base, base[0], base[1].upper(), base[2] + " more"]
    texts += [" ".join(w if k % 41 else "changed" for k, w in enumerate(t.split())) for t in base[:6]]
    texts += [f"{t} {passage} {t[::-1]}" for t in made_up(24, 5, 60)]
    texts += [f"{t} {items[i % 6]} {t[::-1]}" for i, t in enumerate(made_up(25, 6, 60))]
    texts += [None, "", "short", "same same " * 60, "# * $ % & | " * 40, "\n".join(["a line of some words that repeats"] * 20), "SHOUT! " * 80]
    rows = [(7 * i % 101, t, r.choice(["en", None]), len(t or ""), i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars int, ids long").repartition(3)
    return docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), items


def test_pipeline_by_brute_force(spark, corpus, table_dir):
    docs, bench, items = corpus
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert len({i for i, _ in rows}) == len(rows)
    rows = [(i, t) for i, t in rows if passes_rules(t or "")]
    n = [len(rows)]
    kept = {i for i, _, _, k in near_by_brute_force(rows) if k}
    rows = [(i, t) for i, t in rows if i in kept]
    n.append(len(rows))
    changed = without_repeats(rows)
    assert changed != rows
    rows = [(i, t) for i, t in changed if not leaks(t, items)]
    n.append(len(rows))
    assert len(docs.collect()) > n[0] > n[1] > n[2] > 20
    use = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=B.read_ranks(public_tokenizers.path(B.VOCABULARY)), special_tokens={})
    want = sorted((i, t, len(t), use.encode_ordinary(t)) for i, t in rows)
    out = corpus_pipeline.run(spark, table_dir(documents=docs, benchmark=bench))
    assert out.columns == [*docs.columns, "n_tokens", "bpe_ids"]  # docs has a column ids of its own
    got = sorted((r.doc_id, r.text, r.n_chars, memoryview(bytes(r.bpe_ids)).cast("I").tolist()) for r in out.collect())
    assert got == want


def test_pipeline_of_nothing(spark, corpus, table_dir):
    docs, bench, _ = corpus
    assert corpus_pipeline.run(spark, table_dir(documents=docs.where("false"), benchmark=bench)).count() == 0
    assert corpus_pipeline.run(spark, table_dir(documents=docs.limit(3), benchmark=bench.where("false"))).count() <= 3


def test_stages_are_those_of_the_contract():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "substring_dedup", "decontamination", "byte_bpe"]
