"""Quality rules as a bitmask ledger: every rule is evaluated once and its verdict kept as a bit beside the measurements.

Policies are versioned sets of rules applied to the bits; ablations are bitwise aggregates over the ledger and never read
the texts again.

Defined cases: a null or empty text has no words and fails the base rules; repeated rows are judged one by one; an empty
table gives an empty ledger; other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import documents
from .text import IS_WORD, Words, carried, grams_by_doc, mix, per_document, restored

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_bangs")

#: Rule name -> condition of failure over the measurements, all in whole numbers. The place in this list is the bit.
RULES = (
    ("too_few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbol_heavy", "10 * n_symbols > n_words"),
    ("repeated_lines", "n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    ("shouting", "10 * n_upper > 5 * n_letters AND n_letters > 0"),
    ("exclaiming", "10 * n_bangs > 3 * n_words"),
)
BASE = ("too_few_words", "repeated_words")
#: Policies by version. A document passes one if none of its rules failed.
POLICIES = {
    "v1": (*BASE, "symbol_heavy"),
    "v2": (*BASE, "symbol_heavy", "repeated_lines", "word_length", "shouting", "exclaiming"),
}
CURRENT = "v2"

_CHAR = IS_WORD & ((np.arange(256) & 0xC0) != 0x80)
_LINE = np.ones(256, bool)
_LINE[10] = False


def _of(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(chars, np.uint8))


_SYMBOL, _UPPER, _BANG = _of(b"#*$%&|<>"), _of(bytes(range(65, 91))), _of(b"!")
_LETTER = _UPPER | _of(bytes(range(97, 123)))


def measure(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The MEASURES of each document of a block."""
    n = len(offsets) - 1

    def count(table: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(table[data], out=sums[1:])
        return np.diff(sums[offsets])

    def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        return order, same

    w = Words(data, offsets)
    place, gram, windows = grams_by_doc(w.hashes(), w.first, 3)
    order, same = distinct(gram ^ mix(np.repeat(np.arange(n), windows).astype(np.uint64)))
    again = np.zeros(len(order), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    covered = np.zeros(len(w) + 3, bool)
    for k in range(3):
        covered[place[again] + k] = True
    repeat = np.zeros(len(w) + 1, np.int64)
    np.cumsum(covered[: len(w)], out=repeat[1:])

    lines = Words(data, offsets, is_word=_LINE)
    worded = np.searchsorted(w.starts, lines.ends) > np.searchsorted(w.starts, lines.starts)
    of = lines.doc()[worded]
    key = lines.hashes()[worded] ^ mix(of.astype(np.uint64))
    order, same = distinct(key)
    n_dup = np.bincount(of[order[1:][same]], minlength=n)
    return [w.counts, count(_CHAR), count(_SYMBOL), n_dup, np.diff(repeat[w.first]), np.bincount(of, minlength=n), count(_UPPER), count(_LETTER), count(_BANG)]


def ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, MEASURES and failed_bits of each row: bit i is set if rule i of RULES failed."""
    measured = per_document(docs, [(m, "long") for m in MEASURES], measure, keep)
    bits = F.expr(" + ".join(f"(CASE WHEN {fails} THEN {1 << i} ELSE 0 END)" for i, (_, fails) in enumerate(RULES)))
    return measured.withColumn("failed_bits", bits.cast("long"))


def mask(rules: tuple[str, ...]) -> int:
    names = [name for name, _ in RULES]
    return sum(1 << names.index(r) for r in rules)


def verdict(policy: str = CURRENT) -> F.Column:
    """True for rows of a ledger that pass the policy."""
    return F.col("failed_bits").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablation(book: DataFrame, policy: str = CURRENT, by: tuple[str, ...] = ()) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that would pass if it alone were dropped.

    The ledger is first summed by its masked bits, so what is shuffled has at most 2 ** len(RULES) rows a task and group.
    """
    bits = F.col("failed_bits").bitwiseAND(F.lit(mask(POLICIES[policy]))).alias("bits")
    sums = book.groupBy(*by, bits).agg(F.count("*").alias("n"))
    rule = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask((r,))).cast("long").alias("bit")) for r in POLICIES[policy]])).alias("r")
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return (
        sums.select(*by, "bits", "n", rule)
        .groupBy(*by, F.col("r.rule").alias("rule"))
        .agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"), F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only_this"), F.sum("n").alias("n_all"))
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.col("failed_bits").bitwiseAND(F.lit(mask(BASE))) != 0
    return ledger(documents(spark, sf_dir)).select("doc_id", *MEASURES[:5], base.alias("base_failed"), (~base & verdict()).alias("kept"), "failed_bits", F.lit(CURRENT).alias("policy"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the current policy, with their own columns."""
    return restored(ledger(carried(docs), ("_row", "text")).where(verdict()), docs.columns)


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_BITS = " + ".join(f"(CASE WHEN {fails} THEN {1 << i} ELSE 0 END)" for i, (_, fails) in enumerate(RULES))
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w, row_number() OVER () AS row FROM documents),
g AS (SELECT row, unnest(range(1, greatest(len(w) - 1, 1))) AS i, w FROM d WHERE len(w) >= 3),
tri AS (SELECT row, i, count(*) OVER (PARTITION BY row, w[i], w[i + 1], w[i + 2]) AS c FROM g),
rep AS (SELECT row, count(DISTINCT i + k) AS n FROM tri, range(3) r(k) WHERE c >= 2 GROUP BY row),
l AS (SELECT row, unnest(string_split(t, chr(10))) AS line FROM d),
ll AS (SELECT row, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY row),
m AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words,
  CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
  CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper,
  CAST(length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS BIGINT) AS n_letters,
  CAST(length(t) - length(regexp_replace(t, '!', '', 'g')) AS BIGINT) AS n_bangs
  FROM d LEFT JOIN rep USING (row) LEFT JOIN ll USING (row)),
b AS (SELECT *, CAST({_BITS} AS BIGINT) AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & {mask(BASE)}) <> 0 AS base_failed,
  (failed_bits & {mask(BASE)}) = 0 AND (failed_bits & {mask(POLICIES[CURRENT])}) = 0 AS kept, failed_bits, '{CURRENT}' AS policy FROM b
"""
