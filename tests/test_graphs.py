"""Whole graphs against plain Python."""

from __future__ import annotations

from collections import Counter

import numpy as np

from pyspark.sql import functions as F

from lamina import queries as Q
from lamina.operators import embeddings as V
from lamina.operators import raster as R
from lamina.plans import graphs as G


def test_graphs_by_plain_python(spark, sf_dir):
    """Sizes, relations, coverage and the largest part of each view's graph; likeness from the nodes' features."""
    voxels = Q.labelled(spark, sf_dir)
    for name in R.SCALES:
        voxels = R.dense_labels(voxels, name, out="_d").drop(name).withColumn(name, F.col("_d").cast("long")).drop("_d")
    cells: dict[str, dict] = {}
    for r in voxels.collect():
        cells.setdefault(r.view_key, {})[r.z, r.y, r.x] = tuple(r[n] for n in R.SCALES)
    features: dict = {}
    for r in G.nodes(voxels).collect():
        features.setdefault((r.view_key, r.scale), {})[r.label] = [float(r[c]) for c in G.FEATURES]
    got = {r.view_key: r for r in Q.QUERIES["graph_build"](spark, sf_dir).collect()}
    assert set(got) == set(cells)
    for view, own in cells.items():
        k = [len({c[s] for c in own.values()}) for s in range(3)]
        start = [0, k[0], k[0] + k[1]]
        rag = set()
        for (z, y, x), labels in own.items():
            for d in ((1, 0, 0), (0, 1, 0), (0, 0, 1)):
                other = own.get((z + d[0], y + d[1], x + d[2]))
                for s in range(3):
                    if other and other[s] != labels[s]:
                        rag |= {(start[s] + labels[s], start[s] + other[s]), (start[s] + other[s], start[s] + labels[s])}
        links = set(rag)
        for s in (0, 1):
            counts = Counter((c[s], c[s + 1]) for c in own.values())
            for child in {c for c, _ in counts}:
                parent = min((-n, p) for (c, p), n in counts.items() if c == child)[1]
                links |= {(start[s] + child, start[s + 1] + parent), (start[s + 1] + parent, start[s] + child)}
        knn = set()
        for s, n in ((0, 6), (1, 3)):
            x = np.array([features[view, s][i] for i in range(k[s])])
            z = (x - x.mean(0)) / (x.std(0) + 1e-6)
            z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
            sim = np.round(z @ z.T, 12)
            np.fill_diagonal(sim, -np.inf)
            for i, row in enumerate(np.argsort(-sim, axis=1, kind="stable")[:, : min(n, k[s] - 1)]):
                for j in row.tolist():
                    knn |= {(s, i, j), (s, j, i)}
        root = list(range(sum(k)))

        def top(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for a, b in links:
            root[max(top(a), top(b))] = min(top(a), top(b))
        parts = Counter(top(i) for i in range(sum(k)))
        r = got[view]
        assert (r.n_nodes, r.e_rag, r.e_hier) == (sum(k), len(rag), len(links) - len(rag))
        assert abs(r.e_knn - len(knn)) <= 0.02 * len(knn)  # equals up to rounding may be chosen otherwise
        assert abs(r.avg_degree - 2 * len(links) / sum(k)) < 1e-5 and abs(r.lcc_frac - max(parts.values()) / sum(k)) < 1e-5 and r.tissue_coverage == 1.0
        want = "reject:disconnected_graph" if r.lcc_frac < 0.85 else "reject:low_avg_degree" if r.avg_degree < 2 else "ok"
        assert r.status == want


def test_projection_is_orthonormal_and_defined_for_odd_vectors(spark):
    p = np.array(V.projection(10, 4))
    assert np.allclose(p @ p.T, np.eye(4)) and V.projection(10, 4) == V.projection(10, 4) and len(V.projection(3, 8)) == 3
    df = spark.createDataFrame([(1, [float(i) for i in range(10)]), (2, [1.0]), (3, None)], "i int, v array<double>")
    rows = {r.i: r.projected for r in V.projected(df, "v", 4, 10).collect()}
    assert np.allclose(rows[1], p @ np.arange(10)) and rows[2] is rows[3] is None


def test_edges_keep_their_distances_up_to_date(spark):
    from lamina.operators import edges as E

    nodes = spark.createDataFrame([("v", i, [float(i * i), 2.0, float("nan") if i == 2 else float(i)]) for i in range(4)], "view_key string, node long, features array<double>")
    e = spark.createDataFrame([("v", 0, 1, 9.0), ("v", 3, 1, 9.0)], "view_key string, src long, dst long, fdist double")
    x = np.array([0.0, 1.0, 4.0, 9.0])
    z = (x - x.mean()) / (x.std() + 1e-6)
    got = {(r.src, r.dst): r.fdist for r in E.refreshed(e, nodes, ("view_key",)).collect()}
    assert abs(got[0, 1] - abs(z[0] - z[1])) < 1e-6 and abs(got[3, 1] - abs(z[3] - z[1])) < 1e-6
