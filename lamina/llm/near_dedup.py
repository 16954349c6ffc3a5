"""Near-duplicate detection with an LSH forest over MinHash signatures.

Documents are linked if 100 * |A & B| >= 75 * |A | B| for their sets of five-word shingles. A signature has HASHES minima. The
trees of the forest are sorted orders of the signatures, each by its own order of the minima; documents whose orders agree on
the first `depth` minima share a region. In a region of a few documents all of them are candidates for each other. In a larger
one the descent goes on: it is sorted by the further minima of its tree, and a document's candidates are its neighbours there, with
which it has the longest common prefix, so depth adapts to the region. A pair at 0.75 shares a region in some tree but for one time in
900,000. Where more than REGION documents meet, all of them go on to the next forest, which is deeper and has as many more trees
as such a pair needs. Regions that are still too large in the last one are dealt into parts, and while
they hold several components, each part is compared with each other part.

The first look confirms, on the full sets of shingles, all candidates in small regions and each document's likeliest one in larger ones.
The last look goes through the regions that hold several components with the full sets at hand: each document is compared
with those of other components that may reach the threshold by their signatures, the likeliest first, until none is left. So no
pair that shares a region is lost unless it is connected already, and a group of copies costs a few confirmations for
each member, not one for each pair.

Equal sequences of words are one node from the start. Rows that share a doc_id are one document: it has the links of all its texts.

Defined cases: a text without words has no shingles and is linked with nothing; a null doc_id is linked with nothing and kept,
with a null component; rows that repeat are answered one by one; an empty table gives an empty result; other columns are carried, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from .store import documents, written
from .text import Words, blocks, carried, column, grams_by_doc, mix, per_document, release, restored, segments, sequence_hashes, signed

SHINGLE, PERCENT, HASHES = 5, 75, 256
#: Depth and trees of each forest: (1 - 0.75 ** depth) ** trees < 1.2e-6.
FORESTS = ((4, 36), (7, 100), (11, 320))
#: Documents of a region that are compared in one task; a larger region is looked up at the next depth.
REGION = 2048
#: Regions up to this size are compared at once, larger ones by neighbours first.
SMALL = 12
#: Equal minima that a pair at the threshold has but for one time in ten million (192 on average, 5.2 deviations).
AGREE = 156
#: Minima of a tree's order that a region is sorted by.
PATH = 16
#: Hash buckets of ids by which texts are left out early.
BUCKETS = 1 << 20

_rng = np.random.RandomState(77_001)
_MUL = (_rng.randint(0, 2**31, HASHES).astype(np.uint32) << 1) | np.uint32(1)
_ADD = _rng.randint(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the shingles of each document, how many, and two hashes of each document's sequence of words.

    Fewer than SHINGLE words make one shingle."""
    w = Words(data, offsets, lower=True)
    h, counts = w.hashes(), w.counts
    d1, d2 = sequence_hashes(h, counts)
    _, g, n = grams_by_doc(h, w.first, SHINGLE)
    short = (counts > 0) & (counts < SHINGLE)
    if short.any():
        g = np.insert(g, (np.cumsum(n) - n)[short], d1[short])
        n = n + short
    return g, n, d1, d2


def distinct_by_doc(g: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each document, sorted, and how many."""
    doc = np.repeat(np.arange(len(n)), n)
    bits = np.uint64(max(1, int(len(n)).bit_length()))
    if len(n) > 1:
        order = np.argsort((doc.astype(np.uint64) << (np.uint64(64) - bits)) | (g >> bits), kind="stable")
        g, doc = g[order], doc[order]  # by document, and by hash but for its last bits
        fix = np.flatnonzero((g[1:] >> bits == g[:-1] >> bits) & (g[1:] < g[:-1]) & (doc[1:] == doc[:-1]))
        if len(fix):
            order = np.lexsort((g, doc))
            g = g[order]
    else:
        g = np.sort(g)
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return g[new], np.bincount(doc[new], minlength=len(n))


def signatures(data: np.ndarray, offsets: np.ndarray) -> list:
    """d1, d2, number of distinct shingles and signature (HASHES minima, a byte of each) of each document of a block."""
    g, n, d1, d2 = shingles(data, offsets)
    g, n = distinct_by_doc(g, n)
    low = (g >> np.uint64(32)).astype(np.uint32)
    sig = np.empty((len(n), HASHES), np.uint8)
    for i in range(HASHES):
        least = segments(low * _MUL[i] + _ADD[i], n, np.minimum, np.uint32(0))
        sig[:, i] = (least * np.uint32(0x9E3779B1)) >> np.uint32(24)
    return [signed(d1), signed(d2), n.astype(np.int64), [x.tobytes() for x in sig]]


@lru_cache(maxsize=1)
def _orders(forests: tuple[tuple[int, int], ...]) -> np.ndarray:
    """The minima by which each tree is sorted, those of the first forest first."""
    rng = np.random.RandomState(1_000)
    return np.array([rng.permutation(HASHES)[:PATH] for _ in range(sum(trees for _, trees in forests))])


def _trees(sigs: DataFrame, level: int, forests: tuple[tuple[int, int], ...]) -> DataFrame:
    """key, id, tree: the region of each document (id, sig) in each tree of a forest."""
    depth, trees = forests[level]
    first = sum(n for _, n in forests[:level])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = _orders(forests)[first : first + trees, :depth]
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                sig = _matrix(column(part, "sig", pa.binary()))
                ids = column(part, "id", pa.int64()).to_numpy()
                keys = np.empty((trees, len(ids)), np.uint64)
                for t, order in enumerate(orders):
                    k = np.full(len(ids), first + t + 1, np.uint64)
                    for i in order:
                        k = mix(k * np.uint64(0x9E3779B97F4A7C15) + sig[:, i])
                    keys[t] = k
                yield pa.RecordBatch.from_arrays([pa.array(signed(keys.ravel())), pa.array(np.tile(ids, trees)), pa.array(np.repeat(np.arange(first, first + trees, dtype=np.int32), len(ids)))], names=["key", "id", "tree"])
        release()

    return sigs.select("id", "sig").mapInArrow(run, "key long, id long, tree int")


def _matrix(arr: pa.Array) -> np.ndarray:
    offset = np.frombuffer(arr.buffers()[1], np.int32, len(arr) + 1 + arr.offset)[arr.offset]
    return np.frombuffer(arr.buffers()[2], np.uint8, len(arr) * HASHES, offset).reshape(len(arr), HASHES)


def _regions(sigs: DataFrame, forests: tuple[tuple[int, int], ...]) -> tuple[DataFrame, DataFrame | None, bool]:
    """key, m, id, tree: the regions with 2 to REGION documents, and their number m. The regions of the last forest with more
    documents, if there are any. And whether all regions are of the first forest."""
    out, nodes = [], sigs
    for level in range(len(forests)):
        keys = _trees(nodes, level, forests)
        crowded = written(keys.groupBy("key").agg(F.count("*").alias("m"), F.min("id").alias("leader")).where("m > 1"), "sizes")
        rows = written(keys.join(crowded, "key"), "regions")
        large = rows.where(f"m > {REGION}")
        out.append(rows.where(f"m <= {REGION}").select("key", "m", "id", "tree"))
        if large.isEmpty():
            return _union(out), None, level == 0
        if level + 1 < len(forests):
            nodes = written(sigs.join(large.select("id").distinct(), "id"), "crowded")
    return _union(out), large, False


def _union(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for x in frames[1:]:
        whole = whole.unionByName(x)
    return whole


def _parts() -> tuple[Column, Column]:
    """Into how many parts a large region (key, m, id) is dealt, and the document's own."""
    parts = F.ceil(F.col("m") / F.lit(REGION // 2)).cast("long")
    return parts, F.pmod(F.xxhash64("id"), parts)


def _dealt(large: DataFrame) -> DataFrame:
    """The parts of large regions, each with the region's first document, for the first look: it links most copies cheaply."""
    parts, own = _parts()
    mine = large.where("id <> leader").select(F.xxhash64("key", own).alias("key"), "id", "tree")
    first = large.where("id = leader").select("key", F.col("leader").alias("id"), "tree", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    return mine.unionByName(first.select(F.xxhash64("key", "part").alias("key"), "id", "tree")).select("key", F.lit(REGION).cast("long").alias("m"), "id", "tree")


def _in_blocks(large: DataFrame) -> DataFrame:
    """Each two parts of large regions (key, m, id, component) as a region: all pairs of documents meet in one."""
    parts, own = _parts()
    met = large.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).where("own <> other")
    return met.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "id", "tree", "component")


def _labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))


def _split(labelled: DataFrame) -> DataFrame:
    """The regions that hold several components."""
    several = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    return labelled.join(several, "key")


def _by_region(rows: DataFrame) -> DataFrame:
    """rows (key, id), each region whole in one partition. The partitions are dealt by a hash of the key and not by the key itself: Spark
    drops a repartition by what a join below it has dealt by, and may then split that join's partitions."""
    return rows.repartition(F.xxhash64("key", F.lit(1))).sortWithinPartitions("key", "id")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches of a partition sorted by key, cut so that no key goes over a cut."""
    rest: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        keys = table.column("key").to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield table.slice(0, cut).combine_chunks().to_batches()[0]
        rest = table.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks().to_batches()[0]


def _sketch(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return column(batch, "id", pa.int64()).to_numpy(), column(batch, "n", pa.int64()).to_numpy(), _matrix(column(batch, "sig", pa.binary()))


def _may_link(n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    return 100 * np.minimum(n1, n2) >= PERCENT * np.maximum(n1, n2)


_PAIR = "a long, b long, same int"


def _pair_batch(a: list, b: list, same: list) -> pa.RecordBatch:
    """Pairs, and how much of their sketches agrees; more than all of it marks pairs that are confirmed in any case."""
    x, y, z = (np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for v in (a, b, same))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(z.astype(np.int32))], names=["a", "b", "same"])


def _chosen(pairs: DataFrame) -> DataFrame:
    """a, b: of pairs found in any tree, the marked ones, and for each document the one that agrees most."""
    pairs = written(pairs.where("a < b").groupBy("a", "b").agg(F.max("same").alias("same")), "found")
    ends = pairs.where(f"same <= {HASHES}").select("a", "b", "same", F.explode(F.array("a", "b")).alias("id"))
    best = ends.groupBy("id").agg(F.min_by(F.struct("a", "b"), F.struct(-F.col("same"), F.col("a"), F.col("b"))).alias("p")).select("p.a", "p.b")
    return written(pairs.where(f"same > {HASHES}").select("a", "b").unionByName(best).distinct(), "pairs")


def _paths(sketch: np.ndarray, tree: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """The minima of each document in the order of its tree."""
    return np.take_along_axis(sketch, orders[tree], axis=1)


def _sorted_in(key: np.ndarray, path: np.ndarray) -> np.ndarray:
    """The order by key, then path."""
    parts = np.ascontiguousarray(path).view(">u8")
    return np.lexsort([*(parts[:, i] for i in range(parts.shape[1] - 1, -1, -1)), key])


def _neighbours(forests: tuple[tuple[int, int], ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The candidates of the first look: all pairs of small regions, marked, and in larger ones neighbours in the tree's order, of
    which a document takes the one on the side with the longer common prefix, or both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = _orders(forests)
        for batch in _groups(batches):
            key, m = (column(batch, c, pa.int64()).to_numpy() for c in ("key", "m"))
            ids, n, sketch = _sketch(batch)
            path = _paths(sketch, column(batch, "tree", pa.int32()).to_numpy(), orders)
            order = _sorted_in(key, path)
            key, m, ids, n, sketch, path = (x[order] for x in (key, m, ids, n, sketch, path))
            common = np.where(key[1:] == key[:-1], np.cumprod(path[1:] == path[:-1], axis=1).sum(axis=1), -1)
            side = np.concatenate([[-1], common, [-1]])
            longest = np.maximum(side[:-1], side[1:])  # of each document with a neighbour
            a, b, agree = [], [], []
            for lag in range(1, SMALL):
                here = key[lag:] == key[:-lag]
                if lag == 1:
                    here &= (m[1:] <= SMALL) | (common == longest[1:]) | (common == longest[:-1])
                else:
                    here &= m[lag:] <= SMALL
                i = np.flatnonzero(here)
                i = i[_may_link(n[i], n[i + lag])]
                for at in range(0, len(i), 8192):
                    j = i[at : at + 8192]
                    same = (sketch[j] == sketch[j + lag]).sum(axis=1)
                    j, same = j[same >= AGREE], same[same >= AGREE]
                    a.append(ids[j])
                    b.append(ids[j + lag])
                    agree.append(np.where(m[j] <= SMALL, HASHES + 1, same))
            yield _pair_batch(a, b, agree)
        release()

    return run


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold."""
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= PERCENT * (len(x) + len(y) - common)


def _apart(forests: tuple[tuple[int, int], ...], whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links between different components of each region, found on the full sets; none is left when they are followed. whole: all
    regions are of the first forest, so a pair that has met in an earlier tree is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = _orders(forests)[:, : forests[0][0]]
        for batch in _groups(batches):
            key, component = (column(batch, c, pa.int64()).to_numpy() for c in ("key", "component"))
            tree, sets = column(batch, "tree", pa.int32()).to_numpy(), column(batch, "shingles", pa.binary())
            ids, n, sketch = _sketch(batch)
            cuts = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
            out: list[tuple[int, int]] = []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                names, of, many = np.unique(component[lo:hi], return_inverse=True, return_counts=True)
                if len(names) < 2:
                    continue
                x, y = sketch[lo:hi], n[lo:hi]
                held = [np.frombuffer(sets[int(i)].as_buffer(), np.uint64) for i in range(lo, hi)]
                order = np.argsort(of == np.argmax(many), kind="stable")  # the largest component last: it isn't compared with itself
                for at in range((hi - lo) - int(many.max())):
                    i, j = int(order[at]), order[at + 1 :]
                    j = j[(of[j] != of[i]) & _may_link(y[i], y[j])]
                    same = (x[i] == x[j]).sum(axis=1)
                    j, same = j[same >= AGREE], same[same >= AGREE]
                    if whole and len(j):
                        earlier = orders[: tree[lo]]
                        new = ~(x[i][earlier][None] == x[j][:, earlier]).all(axis=2).any(axis=1)
                        j, same = j[new], same[new]
                    for k in j[np.argsort(-same, kind="stable")].tolist():
                        if of[i] != of[k] and _linked(held[i], held[k]):
                            out.append((int(ids[lo + i]), int(ids[lo + k])))
                            of[of == of[k]] = of[i]
            yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in out], pa.int64()), pa.array([max(p) for p in out], pa.int64())], names=["a", "b"])
        release()

    return run


def _sets(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """id, shingles: the sorted distinct shingles of the documents with these ids, as 64-bit hashes.

    Before texts are shuffled to the ids, those whose id falls into none of the ids' BUCKETS are left out: that list is
    broadcast, and has at most BUCKETS rows however many ids there are."""
    bucket = F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int")
    likely = rows.select("id", "text").withColumn("bucket", bucket).join(F.broadcast(ids.select(bucket.alias("bucket")).distinct()), "bucket", "left_semi")
    wanted = likely.select("id", "text").join(ids, "id")

    def kernel(data: np.ndarray, offsets: np.ndarray) -> list:
        g, n = distinct_by_doc(*shingles(data, offsets)[:2])
        ends = np.cumsum(n)
        return [[g[e - k : e].tobytes() for k, e in zip(n, ends, strict=True)]]

    return per_document(wanted, [("shingles", "binary")], kernel, ("id",)).dropDuplicates(["id"])


def _confirmed(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = written(_sets(rows, ids), "sets")
    full = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [_linked(*(np.frombuffer(v.as_buffer(), np.uint64) for v in both)) for both in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))
        release()

    return full.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


_FIELDS = [("d1", "long"), ("d2", "long"), ("n", "long"), ("sig", "binary")]


def _named(docs: DataFrame) -> tuple[DataFrame, bool]:
    """doc_id, id, text of each row: id is doc_id, but for documents with several texts, where each text has its own. And whether there are any."""
    rows = docs.select("doc_id", F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    often = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("lo"), F.max(F.xxhash64("text")).alias("hi")).where("lo <> hi")
    often = written(often.select("doc_id"), "often")
    if often.isEmpty():
        return rows, False
    own = rows.join(often, "doc_id", "left_semi").withColumn("id", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    return written(rows.join(often, "doc_id", "left_anti").unionByName(own), "named"), True


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row of docs."""
    forests = FORESTS
    rows, several = _named(docs)
    made = written(per_document(rows, _FIELDS, signatures, ("doc_id", "id")), "signatures")
    known = made.where("doc_id IS NOT NULL AND n > 0")
    first = known.groupBy("d1", "d2").agg(F.min("id").alias("node"))
    thin = made.select("doc_id", "id", "d1", "d2", "n").join(first, ["d1", "d2"], "left")
    sigs = known.join(first, ["d1", "d2"]).where("id = node").select("id", "n", "sig").dropDuplicates(["id"])
    sigs = written(sigs, "nodes")
    regions, large, whole = _regions(sigs, forests)
    first_look = regions if large is None else regions.unionByName(_dealt(large))
    near = _by_region(first_look.join(sigs, "id").select("key", "m", "id", "tree", "n", "sig")).mapInArrow(_neighbours(forests), _PAIR)
    links = _confirmed(rows, _chosen(near))
    if several:  # a document's texts belong together
        texts = thin.where("node IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("a"), F.collect_set("node").alias("all"))
        links = links.unionByName(texts.select("a", F.explode("all").alias("b")).where("a <> b"))
    found = components(written(links, "links"))

    apart = _split(_labelled(regions.where(f"m > {SMALL}").select("key", "id", "tree"), found))
    if large is not None:
        apart = apart.unionByName(_split(_in_blocks(_split(_labelled(large.select("key", "m", "id", "tree"), found)))))
    apart = written(apart, "apart")
    full = sigs.join(_sets(rows, apart.select("id").distinct()), "id")
    again = _by_region(apart.join(full, "id").select("key", "id", "tree", "component", "n", "sig", "shingles")).mapInArrow(_apart(forests, whole), "a long, b long")
    more = written(again.distinct(), "links")
    if not more.isEmpty():
        found = _joined_up(found, more)
    label = F.coalesce("component", "node")
    found = found.withColumnRenamed("id", "node")
    at = thin.drop("id").join(found, "node", "left").withColumn("component", label)
    if several:  # all rows of a document, also those without words, are where its texts are
        least = at.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("least"))
        own = at.join(least, "component").groupBy("doc_id").agg(F.min("least").alias("component"))
        at = at.drop("component").join(own, "doc_id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    done = at.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return done.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _joined_up(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components with more links: only links between components are followed."""
    ends = links
    for c in ("a", "b"):
        ends = ends.join(found.select(F.col("id").alias(c), F.col("component").alias(f"c{c}")), c, "left").withColumn(f"c{c}", F.coalesce(f"c{c}", c))
    between = components(ends.where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))).select(F.col("id").alias("component"), F.col("component").alias("least"))
    ids = found.unionByName(links.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(found, "id", "left_anti").withColumn("component", F.col("id")))
    return written(ids.join(between, "component", "left").select("id", F.coalesce("least", "component").alias("component")), "components")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir).select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component: the one with the smallest doc_id. Its rows with the same text become one."""
    gone = classes(docs.select("doc_id", "text")).where("NOT kept").select("doc_id").distinct()
    left = carried(docs).join(gone, "doc_id", "left_anti")
    often = written(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "often")
    if not often.isEmpty():
        once = left.join(often, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.first("_row").alias("_row"))
        left = left.join(often, "doc_id", "left_anti").unionByName(once)
    return restored(left, docs.columns)


ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a, min(b) AS b FROM r GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(b, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(b, doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.a = doc_id
"""
