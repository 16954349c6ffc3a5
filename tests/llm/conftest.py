from __future__ import annotations

import random

import pytest


def made_up(seed: int, n: int, words: int = 60) -> list[str]:
    r = random.Random(seed)
    vocabulary = ["".join(r.choice(["ka", "to", "ri", "né", "su", "mo", "la"]) for _ in range(r.randint(1, 4))) for _ in range(400)]
    return [" ".join(r.choice(vocabulary) for _ in range(r.randint(words // 2, words * 3))) for _ in range(n)]


@pytest.fixture(scope="session")
def texts() -> list[str | None]:
    """Ordinary texts, copies, near copies, shared passages, and odd cases: null, empty, blank, one word, one long text, one huge word."""
    base = made_up(1, 12)
    near = []
    for i, t in enumerate(base[:4]):
        w = t.split()
        for k in range(3):
            v = list(w)
            v[(7 * k + i) % len(v)] = "changed"
            near.append(" ".join(v))
    passage = " ".join(made_up(2, 1, 70)[0].split()[:75])
    shared = [f"{made_up(10 + i, 1, 20)[0]} {passage} {made_up(30 + i, 1, 20)[0]}" for i in range(4)]
    odd = [None, "", "  \n\t ", "Word", "two words", "A B c D", "a b C d", base[0].upper(), base[1].replace(" ", "\n"), " ".join(made_up(3, 30, 200)), "x" * 5000, "é😀   ñ\x0bz\x0cq", "ho " * 300]
    return [*base, *base[:3], *near, *shared, *odd]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts with ids that are no row numbers, a null id, a repeated row, and columns whose names operators use themselves."""
    rows = [((i * 37) % 1009 + 1, t, ["en", "fr", None][i % 3], "s", len(t or ""), "mine", 7) for i, t in enumerate(texts)]
    rows += [rows[0], (None, texts[1], "en", "s", 1, "mine", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words int").repartition(3)


@pytest.fixture(scope="session")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)


@pytest.fixture
def table_dir(spark, tmp_path):
    """Writes tables as the driver has them, and gives their folder."""

    def write(**tables):
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
