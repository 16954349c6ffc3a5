"""Quality by perplexity under an interpolated modified Kneser-Ney model, trained on trusted text.

The model's signs are the bytes of a text, after ORDER - 1 start signs; its longest grams have ORDER signs. Counts of all trusted
texts are summed in shards; continuation counts (of grams that begin with a start sign, which nothing else can precede, plain counts), totals of contexts and the interpolation from order to order are joins of these
sharded tables, each on a gram or its context. One trusted document in ASIDE isn't learnt from but sets the limits: a document's
perplexity is per byte, and it is kept if that is at most the QUANTILE of its language's documents set aside (of all of them, for
languages without any).

The finished tables are sent to the executors if they have at most MODEL_ROWS rows. Beyond that, the documents' grams are counted
and joined with the shards of the model, order by order.

Defined cases: a null or empty text has no perplexity and isn't kept; a null language is a language of its own; without trusted
text the model is uniform, and without any set aside every text that isn't empty is kept; several labels of one doc_id trust it if none is low; rows
that repeat are judged one by one; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import documents, written
from .tables import Table
from .text import blocks, column, per_document

ORDER, SIGNS, QUANTILE, ASIDE = 5, 256, 0.995, 10
#: Rows of a model that is sent whole (12 bytes each on the driver, about 40 in a worker), and ids that are broadcast.
MODEL_ROWS, BROADCAST_IDS = 6_000_000, 2_000_000
#: Distinct grams that a task gathers before it hands them on.
GATHERED = 2_000_000


#: Bits of a sign in a gram: 0 is the start sign, a byte is one more than itself.
BITS = 9


def _mask(k: int) -> int:
    return (1 << BITS * k) - 1


def codes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The gram of ORDER signs that ends at each byte of a block, as a number."""
    out = data.astype(np.int64) + 1
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    whole = out.copy()
    for k in range(1, ORDER):
        before = np.zeros(len(data), np.int64)
        before[k:] = out[:-k]
        before[place < k] = 0
        whole |= before << (BITS * k)
    return whole


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """g, c: the grams of a partition's texts."""
    kept: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        g, c = (np.concatenate(x) for x in zip(*kept, strict=True))
        order = np.argsort(g, kind="stable")
        g, c = g[order], c[order]
        first = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        return g[first], np.add.reduceat(c, first)

    for batch in batches:
        for _, _, data, offsets in blocks(column(batch, "text", pa.string())):
            if len(data):
                g, c = np.unique(codes(data, offsets), return_counts=True)
                kept.append((g, c.astype(np.int64)))
            if sum(len(g) for g, _ in kept) > GATHERED:
                kept = [merged()]
                if len(kept[0][0]) > GATHERED // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in kept.pop()], names=["g", "c"])
    if kept:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], names=["g", "c"])


def _discount(grams: DataFrame) -> Column:
    """The modified Kneser-Ney discount of a count c, from the counts of counts of an order."""
    n1, n2, n3, n4 = grams.select(*[F.count(F.when(F.col("c") == i, 1)) for i in (1, 2, 3, 4)]).first()
    d = [0.5, 1.0, 1.5]
    if n1 and n2:
        y = n1 / (n1 + 2 * n2)
        d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    d = [min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)]
    return F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])


def train(trusted: DataFrame) -> DataFrame:
    """kind, k, g, v: for each order k, ln of the probability of each seen gram (kind p) and of the weight that each seen
    context (kind b, g without its last byte) leaves to the next lower order."""
    counts = written(trusted.select(F.col("text").cast("string").alias("text")).mapInArrow(_count, "g long, c long").groupBy("g").agg(F.sum("c").alias("c")), "grams")
    orders = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):  # in how many ways a gram goes on to the left
        left = orders[k + 1].select(F.expr(f"g & {_mask(k)}").alias("g"), "c").groupBy("g").agg(F.count("*").alias("ways"), F.sum("c").alias("times"))
        begins = F.shiftright("g", BITS * (k - 1)) == 0
        orders[k] = written(left.select("g", F.when(begins, F.col("times")).otherwise(F.col("ways")).alias("c")), "grams")
    lower: DataFrame | None = None
    out = []
    for k in range(1, ORDER + 1):
        d = orders[k].withColumn("d", _discount(orders[k])).withColumn("h", F.shiftright("g", BITS))
        contexts = d.groupBy("h").agg(F.sum("c").alias("total"), (F.sum("d") / F.sum("c")).alias("rest"))
        p = d.join(contexts, "h").withColumn("suffix", F.expr(f"g & {_mask(k - 1)}"))
        if lower is None:
            p = p.withColumn("low", F.lit(1 / SIGNS))
        else:
            p = p.join(lower.select(F.col("g").alias("suffix"), F.col("p").alias("low")), "suffix")
        lower = written(p.select("g", (((F.col("c") - F.col("d")) / F.col("total")) + F.col("rest") * F.col("low")).alias("p")), "probabilities")
        out += [lower.select(F.lit("p").alias("kind"), F.lit(k).alias("k"), "g", F.ln("p").cast("float").alias("v")), contexts.select(F.lit("b"), F.lit(k), "h", F.ln("rest").cast("float"))]
    whole = out[0]
    for x in out[1:]:
        whole = whole.union(x)
    return written(whole, "model")


class Model:
    def __init__(self, tables: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]):
        self.tables = {key: Table(*x) for key, x in tables.items()}

    def ln(self, g: np.ndarray, k: int = ORDER) -> np.ndarray:
        """ln of the probability of each gram of order k."""
        if not k:
            return np.full(len(g), -np.log(SIGNS), np.float32)
        if ("p", k) not in self.tables:
            return self.ln(g & _mask(k - 1), k - 1)
        out, hit = self.tables["p", k].get(g)
        if not hit.all():
            miss, back = np.unique(g[~hit], return_inverse=True)
            rest, _ = self.tables["b", k].get(miss >> BITS)
            out[~hit] = (rest + self.ln(miss & _mask(k - 1), k - 1))[back]
        return out


def perplexity(docs: DataFrame, model: DataFrame, keep: tuple[str, ...], most_rows: int = MODEL_ROWS) -> DataFrame:
    """keep, n_bytes and ln_p (the logarithm of the probability) of each row of docs."""
    if model.count() > most_rows:
        return _joined(docs, model, keep)
    table = model.toArrow()
    kind, k, g, v = (table.column(c).to_numpy() for c in ("kind", "k", "g", "v"))
    parts = {(a, n): (g[at], v[at]) for a in ("p", "b") for n in range(1, ORDER + 1) if len(at := np.flatnonzero((kind == a) & (k == n)))}
    sent = docs.sparkSession.sparkContext.broadcast(parts)
    made: dict[str, Model] = {}

    def kernel(data: np.ndarray, offsets: np.ndarray) -> list:
        if not made:
            made["model"] = Model(sent.value)
        sums = np.zeros(len(data) + 1)
        np.cumsum(made["model"].ln(codes(data, offsets)), out=sums[1:])
        return [np.diff(offsets), np.diff(sums[offsets])]

    return per_document(docs, [("n_bytes", "long"), ("ln_p", "double")], kernel, keep)


def _joined(docs: DataFrame, model: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """perplexity() by joins of the documents' counted grams with the model's shards."""
    ids = written(docs.select(*keep, F.expr("uuid()").alias("_key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")), "texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(batch.schema.names.index("_key"))
            for lo, _, data, offsets in blocks(column(batch, "_text", pa.string())):
                whole = codes(data, offsets)
                for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
                    g, n = np.unique(whole[a:b], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([key[lo + i].as_py()] * len(g), pa.string()), pa.array(g), pa.array(n.astype(np.int64))], names=["_key", "g", "n"])

    left = ids.select("_key", "_text").mapInArrow(run, "_key string, g long, n long").withColumn("ln", F.lit(0.0))
    done = []
    for k in range(ORDER, 0, -1):
        p = model.where(f"kind = 'p' AND k = {k}").select("g", F.col("v").alias("p"))
        b = model.where(f"kind = 'b' AND k = {k}").select(F.col("g").alias("h"), F.col("v").alias("b"))
        tried = left.join(p, "g", "left")
        done.append(tried.where("p IS NOT NULL").select("_key", (F.col("n") * (F.col("ln") + F.col("p"))).alias("x")))
        missed = tried.where("p IS NULL").withColumn("h", F.shiftright("g", BITS)).join(b, "h", "left")
        left = missed.select("_key", F.expr(f"g & {_mask(k - 1)}").alias("g"), "n", (F.col("ln") + F.coalesce("b", F.lit(0.0))).alias("ln"))
    done.append(left.select("_key", (F.col("n") * (F.col("ln") - float(np.log(SIGNS)))).alias("x")))
    whole = done[0]
    for x in done[1:]:
        whole = whole.union(x)
    sums = whole.groupBy("_key").agg(F.sum("x").alias("ln_p"))
    return ids.join(sums, "_key", "left").select(*keep, F.octet_length("_text").cast("long").alias("n_bytes"), F.coalesce("ln_p", F.lit(0.0)).alias("ln_p"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.expr("CAST(quality AS INT)")).alias("q")).where("q > 0").select("doc_id")


def _known(ids: DataFrame) -> DataFrame:
    """ids, marked for a broadcast if they are few enough."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids


def judged(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, threshold and kept of each row of docs (doc_id, text, lang)."""
    ids = written(trusted_ids(labels).withColumn("aside", F.expr(f"pmod(crc32(CAST(doc_id AS STRING)), {ASIDE}) = 0")), "trusted")
    model = train(docs.select("doc_id", "text").join(_known(ids.where("NOT aside").select("doc_id")), "doc_id", "left_semi"))
    scored = written(perplexity(docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")), model, ("doc_id", "lang")).withColumn("perplexity", F.expr("CASE WHEN n_bytes > 0 THEN exp(-ln_p / n_bytes) END")), "scored")
    good = scored.join(_known(ids.where("aside").select("doc_id")), "doc_id", "left_semi").where("perplexity IS NOT NULL")
    cut = F.percentile_approx("perplexity", F.lit(quantile), F.lit(10_000))
    limits = good.groupBy(F.coalesce("lang", F.lit("")).alias("_lang")).agg(cut.alias("own"))
    overall = good.agg(cut.alias("overall")).first().overall
    joined = scored.withColumn("_lang", F.coalesce("lang", F.lit(""))).join(limits, "_lang", "left")
    limit = F.coalesce("own", F.lit(overall).cast("double"))
    kept = F.expr("perplexity IS NOT NULL") & F.coalesce(F.col("perplexity") <= limit, F.lit(True))
    return joined.select("doc_id", "lang", "n_bytes", "perplexity", limit.alias("threshold"), kept.alias("kept"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
