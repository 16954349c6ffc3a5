"""Edges between regions: neighbours in feature space, hierarchy, assembly, attributes, and clean-up."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import written

RAG, KNN, HIERARCHY = 0, 1, 2
#: Vectors in a block of the similarity join.
BLOCK = 2048


def zscored_vectors(vectors: DataFrame, column: str, keys: tuple[str, ...], id_col: str, out: str = "z") -> DataFrame:
    """vectors and out: the column z-scored by component within keys; 0 where a component is no number."""
    long = vectors.select(*keys, id_col, F.posexplode(column).alias("i", "v"))
    stats = long.groupBy(*keys, "i").agg(F.avg(F.col("v").cast("double")).alias("m"), F.stddev_pop(F.col("v").cast("double")).alias("s"))
    packed = stats.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "m", "s"))).alias("_stats"))
    joined = vectors.join(packed, list(keys)) if keys else vectors.crossJoin(packed)  # packed is one row for each key

    def z(v: Column, t: Column) -> Column:
        score = (v.cast("double") - t["m"]) / (t["s"] + 1e-6)
        return F.when(score.isNull() | F.isnan(score), 0.0).otherwise(score)

    return joined.withColumn(out, F.zip_with(F.col(column), F.col("_stats"), z)).drop("_stats")


def unit_zscored(vectors: DataFrame, column: str, keys: tuple[str, ...], id_col: str) -> DataFrame:
    """Vectors z-scored by component within keys, then scaled to length 1 (a zero vector stays)."""
    scored = zscored_vectors(vectors, column, keys, id_col).withColumn("size", F.sqrt(F.aggregate("z", F.lit(0.0), lambda a, v: a + v * v)))
    return scored.withColumn("unit", F.transform("z", lambda v: v / F.greatest(F.col("size"), F.lit(1e-12)))).drop("z", "size")


def knn(vectors: DataFrame, k: int, id_col: str = "id", column: str = "unit", keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, src, dst: of each vector the k most similar others (largest inner product; the smaller id of equals), both ways, each
    pair of ends once. With k <= 0 there are none.

    Blocks of vectors meet in pairs, each pair in a task of its own, which hands on k candidates of each vector: a task holds two
    blocks, whatever the number of vectors, and what is shuffled are blocks and candidates."""
    if k <= 0:
        return vectors.select(*keys, F.col(id_col).alias("src"), F.col(id_col).alias("dst")).where(F.lit(False))
    blocks = vectors.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    placed = vectors.select(*keys, F.col(id_col).alias("id"), F.col(column).alias("v"))
    placed = (placed.join(blocks, list(keys)) if keys else placed.crossJoin(blocks)).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    sides = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = placed.select(*keys, "id", "v", F.lit(0).alias("side"), F.col("own").alias("p"), sides.alias("q")).unionByName(placed.select(*keys, "id", "v", F.lit(1).alias("side"), sides.alias("p"), F.col("own").alias("q")))

    def nearest(table: pa.Table) -> pa.Table:
        side, ids = (table.column(c).to_numpy() for c in ("side", "id"))
        v = pa.concat_arrays([x.flatten() for x in table.column("v").chunks]).to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        b = b[np.argsort(ids[b], kind="stable")]
        out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if len(a) and len(b):
            sim = np.round(v[a] @ v[b].T, 12)
            sim[ids[a][:, None] == ids[b][None]] = -np.inf
            n = min(k, len(b))
            top = np.argsort(-sim, axis=1, kind="stable")[:, :n]
            s = np.take_along_axis(sim, top, 1).ravel()
            ok = np.isfinite(s)
            out = [np.repeat(ids[a], n)[ok], ids[b][top].ravel()[ok], s[ok]]
        at = np.zeros(len(out[0]), np.int64)
        return pa.table({**{c: table.column(c).combine_chunks().take(pa.array(at)) for c in keys}, "id": out[0], "near": out[1], "sim": out[2]})

    schema = ", ".join([*(f"{c} {vectors.schema[c].dataType.simpleString()}" for c in keys), "id long, near long, sim double"])
    found = met.groupBy(*keys, "p", "q").applyInArrow(nearest, schema)
    best = found.groupBy(*keys, "id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("d"), "near"))), 1, k).alias("top"))
    pairs = best.select(*keys, F.col("id").alias("src"), F.explode("top.near").alias("dst"))
    return symmetrised(pairs, keys)


def symmetrised(edges: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Both directions of each edge, each once."""
    return edges.select(*keys, F.inline(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"))))).distinct()


def hierarchy(parents: DataFrame, child_offset: Column, parent_offset: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Edges between children and parents (null and negative parents have none) as node numbers, both ways."""
    c, p = F.col("child") + child_offset, F.col("parent") + parent_offset
    ends = F.array(F.struct(c.alias("src"), p.alias("dst")), F.struct(p.alias("src"), c.alias("dst")))
    return parents.where("parent >= 0").select(*keys, F.inline(ends))


def assembled(parts: list[tuple[DataFrame, int]], keys: tuple[str, ...]) -> DataFrame:
    """The edges of all relations, with their edge_type."""
    out: DataFrame | None = None
    for edges, kind in parts:
        typed = edges.select(*keys, "src", "dst", *[F.col("contact") if "contact" in edges.columns else F.lit(0).cast("long").alias("contact")], F.lit(kind).alias("edge_type"))
        out = typed if out is None else out.unionByName(typed)
    assert out is not None
    return out


def attributes(edges: DataFrame, nodes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The eight attributes of edges: offsets from source to target and their length, whether both are in one slice, faces in
    contact, also by the smaller region's size, and the distance of the nodes' features.

    nodes: keys, node, px, py, pz, n_voxels, and the z-scored features as arrays: `features` among nodes of their scale, and
    `across` among all nodes, for edges of the hierarchy."""
    cells = ("px", "py", "pz", "n_voxels", "features", "across")
    nodes = nodes if "across" in nodes.columns else nodes.withColumn("across", F.col("features"))
    src = nodes.select(*keys, F.col("node").alias("src"), *[F.col(c).alias(f"s_{c}") for c in cells])
    dst = nodes.select(*keys, F.col("node").alias("dst"), *[F.col(c).alias(f"d_{c}") for c in cells])
    both = edges.join(src, [*keys, "src"]).join(dst, [*keys, "dst"])
    dx, dy, dz = (F.col(f"d_p{a}") - F.col(f"s_p{a}") for a in "xyz")
    contact = F.when(F.col("edge_type") == RAG, F.col("contact")).otherwise(0)
    ratio = contact / F.greatest(F.lit(1), F.least("s_n_voxels", "d_n_voxels"))
    fdist = F.when(F.col("edge_type") == HIERARCHY, _apart("s_across", "d_across")).otherwise(_apart("s_features", "d_features"))
    return both.select(*keys, "src", "dst", "edge_type", dx.alias("dx"), dy.alias("dy"), dz.alias("dz"), F.sqrt(dx * dx + dy * dy + dz * dz).alias("dist"), (F.abs(dz) < 1e-6).cast("int").alias("same_z"), contact.alias("contact"), ratio.alias("contact_ratio"), fdist.alias("fdist"))


def _apart(a: str, b: str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def refreshed(edges: DataFrame, nodes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """edges (keys, src, dst, ...) with fdist anew, from the features (an array) of changed nodes, z-scored over all nodes of a graph."""
    z = zscored_vectors(nodes.select(*keys, "node", "features"), "features", keys, "node")
    src, dst = (z.select(*keys, F.col("node").alias(c), F.col("z").alias(f"_{c}")) for c in ("src", "dst"))
    both = edges.drop("fdist").join(src, [*keys, "src"]).join(dst, [*keys, "dst"])
    return both.withColumn("fdist", _apart("_src", "_dst")).drop("_src", "_dst")


def weighted_degree(edges: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, src, dst, w: the symmetric weights of a multigraph. Repeated edges add up; of both directions the larger counts."""
    one = edges.groupBy(*keys, "src", "dst").agg(F.count("*").cast("double").alias("w"))
    turned = one.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return one.unionByName(turned).groupBy(*keys, "src", "dst").agg(F.max("w").alias("w"))


def adversarial(features: DataFrame, edges: DataFrame, names: list[str], eps: float = 0.5, steps: int = 3, norm: str = "linf", keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, node and names, pushed away from their neighbours' mean: z-scores take `steps` steps of eps / steps along the graph's
    Laplacian (its sign, or its direction for any other norm) and are clipped to -3..3, which also clips what was beyond before.

    Each step is two joins of the edges with the nodes; lineage is cut after each."""
    stats = features.groupBy(*keys).agg(*[F.avg(n).alias(f"m_{n}") for n in names], *[F.stddev_pop(n).alias(f"s_{n}") for n in names])

    def beside(df: DataFrame) -> DataFrame:
        return df.join(stats, list(keys)) if keys else df.crossJoin(stats)  # without keys, stats is one row

    start = beside(features).select(*keys, "node", *[((F.col(n) - F.col(f"m_{n}")) / (F.col(f"s_{n}") + 1e-6)).alias(n) for n in names])
    z = written(start.select(*keys, "node", *[F.when(F.isnan(n) | F.col(n).isNull(), 0.0).otherwise(F.col(n)).alias(n) for n in names]), "z")
    w = written(weighted_degree(edges, keys), "weights")
    alpha = eps / max(1, steps)
    for _ in range(max(1, steps)):
        sums = w.join(z.withColumnRenamed("node", "dst"), [*keys, "dst"]).groupBy(*keys, F.col("src").alias("node")).agg(F.sum("w").alias("_deg"), *[F.sum(F.col("w") * F.col(n)).alias(f"_{n}") for n in names])
        both = z.join(sums, [*keys, "node"], "left")
        lap = {n: F.coalesce(F.round(F.col("_deg") * F.col(n) - F.col(f"_{n}"), 9), F.lit(0.0)) for n in names}
        length = F.sqrt(sum((v * v for v in lap.values()), F.lit(0.0))) + 1e-6
        move = {n: F.signum(v) * alpha if norm == "linf" else v / length * alpha for n, v in lap.items()}
        z = written(both.select(*keys, "node", *[F.greatest(F.lit(-3.0), F.least(F.lit(3.0), F.col(n) + move[n])).alias(n) for n in names]), "z")
    return beside(z).select(*keys, "node", *[(F.col(n) * (F.col(f"s_{n}") + 1e-6) + F.col(f"m_{n}")).alias(n) for n in names])
