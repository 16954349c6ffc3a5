"""Toxicity: a linear classifier over character n-grams, whose features are scaled by naive Bayes log-count ratios.

Texts are lower-cased (ASCII) and seen as bytes, white space being one sign. Features are the hashed n-grams of ORDERS that
occur in a text. For each, the ratio r = log((a + n1) / (a + N1)) - log((a + n0) / (a + N0)) of its document counts in toxic and
other texts scales its value; the FEATURES with the strongest association (chi squared) get weights by logistic regression.

The classifier is fitted on at most TRAIN_ROWS labelled documents, those with the least hash of their doc_id; scoring reads
every whole text and moves no data but the model, which has at most FEATURES weights. More features fit the sample and not the rest: see the
README's figures.

Defined cases: a null or empty text has no features and gets the score of the intercept; rows whose label or doc_id is null
don't teach, nor do labels without a document; several labels of one doc_id count as toxic if one does; of several texts of one doc_id the least one teaches; without labels of both kinds every score is the smoothed
share of toxic rows; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import documents
from .text import IS_WORD, LOWER, blocks, column, per_document

ORDERS = (3, 4, 5)
BITS = 20
#: Bounds of what is learnt from and of the model.
TRAIN_ROWS, FEATURES = 20_000, 4096
LEAST_DOCS, SMOOTHING, PENALTY, THRESHOLD = 5, 1.0, 1e-4, 0.3

_rng = np.random.RandomState(4_242)
_SIGN = np.where(IS_WORD, LOWER, 32).astype(np.uint8)
_TABLES = _rng.randint(0, 2**32, (max(ORDERS), 256), dtype=np.uint64).astype(np.uint32)


def features(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(document, hashed n-gram) of a block, each once; with wanted, (document, wanted[n-gram]) where that isn't negative."""
    signs, docs, out = _SIGN[data], [], []
    sums = _TABLES[0][signs]
    for n in range(2, max(ORDERS) + 1):
        if len(signs) < n:
            break
        sums = sums[:-1] + _TABLES[n - 1][signs[n - 1 :]]
        if n not in ORDERS:
            continue
        b = ((sums ^ (sums >> np.uint32(15))) * np.uint32(0x9E3779B1 + 2 * n)) >> np.uint32(32 - BITS)
        if wanted is not None:
            b = wanted[b]
            at = np.flatnonzero(b >= 0)
            b = b[at]
        else:
            at = np.arange(len(b))
        doc = np.searchsorted(offsets, at, "right") - 1
        inside = at + n <= offsets[doc + 1]
        docs.append(doc[inside])
        out.append(b[inside])
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = np.unique(np.concatenate(docs).astype(np.int64) << BITS | np.concatenate(out).astype(np.int64))
    return key >> BITS, key & ((1 << BITS) - 1)


class Model:
    """The places of the chosen n-grams, their weights (already times the ratio) and the intercept."""

    def __init__(self, grams: np.ndarray, weights: np.ndarray, intercept: float):
        self.grams, self.weights, self.intercept = grams, weights, intercept

    def places(self) -> np.ndarray:
        out = np.full(1 << BITS, -1, np.int32)
        out[self.grams] = np.arange(len(self.grams))
        return out


def fit(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression (accelerated gradient steps) on rows of present features, each scaled by its ratio."""
    n, k = len(rows), len(ratios)
    prior = (labels.sum() + 0.5) / (n + 1)
    bias = float(np.log(prior / (1 - prior)))
    if not k or labels.min(initial=1) == labels.max(initial=0):
        return np.zeros(k), bias
    doc = np.repeat(np.arange(n), [len(r) for r in rows])
    col = np.concatenate(rows).astype(np.int64)
    scale = ratios[col]

    def forward(w: np.ndarray) -> np.ndarray:
        return np.bincount(doc, scale * w[col], n)

    def back(e: np.ndarray) -> np.ndarray:
        return np.bincount(col, scale * e[doc], k)

    v = np.ones(k)
    for _ in range(12):  # the largest eigenvalue
        v = back(forward(v))
        size = float(np.linalg.norm(v))
        v /= size or 1.0
    step = 1 / (0.25 * size / n * 1.1 + PENALTY)
    step_bias = 2.0
    w = prev = np.zeros(k)
    b = prev_b = bias
    for i in range(steps):
        t = i / (i + 3)
        y, yb = w + t * (w - prev), b + t * (b - prev_b)
        e = 1 / (1 + np.exp(-(forward(y) + yb))) - labels
        prev, prev_b = w, b
        w, b = y - step * (back(e) / n + PENALTY * y), yb - min(step, step_bias) * float(e.mean())
    return w * ratios, b


def train(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS, max_features: int = FEATURES) -> Model:
    """labels: doc_id, toxic. Only the rows of docs with a label are read further than their ids, and each document teaches once."""
    spark = docs.sparkSession
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.expr("CAST(toxic AS INT)")).alias("toxic"))
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    rows = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).collect()
    few = spark.createDataFrame([(r.doc_id, int(r.toxic > 0)) for r in rows], "doc_id long, toxic int")
    taught = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(few), "doc_id")  # few has max_rows rows at most
    taught = taught.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, 1 << BITS), np.int32)
        for batch in batches:
            toxic = column(batch, "toxic", pa.int32()).to_numpy()
            for lo, _, data, offsets in blocks(column(batch, "text", pa.string())):
                doc, gram = features(data, offsets)
                of = toxic[lo + doc]
                for c in (0, 1):
                    n[c] += np.bincount(gram[of == c], minlength=1 << BITS).astype(np.int32)
        some = np.flatnonzero(n.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[0][some]), pa.array(n[1][some])], names=["gram", "n0", "n1"])

    total = [sum(1 - int(r.toxic > 0) for r in rows), sum(int(r.toxic > 0) for r in rows)]
    if not all(total):
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log((total[1] + 0.5) / (total[0] + 0.5))))
    n0, n1 = float(total[0]), float(total[1])
    counts = taught.mapInArrow(count, "gram int, n0 int, n1 int").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where(f"n0 + n1 >= {LEAST_DOCS}")
    strength = F.expr(f"pow(n1 * ({n0} - n0) - n0 * ({n1} - n1), 2) / ((n0 + n1) * ({n0 + n1} - n0 - n1 + 0.5))")
    best = counts.orderBy(strength.desc(), "gram").limit(max_features).collect()
    grams = np.array([r.gram for r in best], np.int64)
    ratios = np.array([np.log((SMOOTHING + r.n1) / (SMOOTHING + n1)) - np.log((SMOOTHING + r.n0) / (SMOOTHING + n0)) for r in best])
    places = spark.sparkContext.broadcast(Model(grams, ratios, 0.0).places())

    def present(data: np.ndarray, offsets: np.ndarray) -> list:
        doc, at = features(data, offsets, places.value)
        cuts = np.searchsorted(doc, np.arange(len(offsets)))
        at = at.astype(np.uint16)
        return [[at[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]]

    sample = per_document(taught, [("at", "binary")], present, ("toxic",)).toArrow()
    weights, intercept = fit([np.frombuffer(x.as_py(), np.uint16) for x in sample.column("at")], sample.column("toxic").to_numpy().astype(float), ratios)
    return Model(grams, weights, intercept)


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and score, the probability of the toxic label, of each row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    cached: dict[str, np.ndarray] = {}

    def kernel(data: np.ndarray, offsets: np.ndarray) -> list:
        m = sent.value
        if "places" not in cached:
            cached["places"] = m.places()
        doc, at = features(data, offsets, cached["places"])
        return [1 / (1 + np.exp(-(np.bincount(doc, m.weights[at], len(offsets) - 1) + m.intercept).clip(-500, 500)))]

    return per_document(docs, [("score", "double")], kernel, keep)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.expr("coalesce(pmod(crc32(CAST(doc_id AS STRING)), 4) = 2, false)")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~held_out)
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.expr(f"CAST(score >= {THRESHOLD} AS INT)").alias("predicted"))
