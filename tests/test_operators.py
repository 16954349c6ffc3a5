from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lamina.operators import edges as E, kernels as K, quality as Q, raster as R, segment as S
from lamina.operators.components import components


@pytest.mark.parametrize("links", [[], [(1, 2)], [(1, 2), (2, 3), (3, 4), (9, 8)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 9)], [(5, 5)]])
def test_components(spark, links):
    parent = {x: x for e in links for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}


def test_ties_go_to_the_smallest(spark):
    v = spark.createDataFrame([("v", 0, 0, i, 1, p) for i, p in enumerate([7, 3, 7, 3])], "view_key string, z int, y int, x int, c int, p int")
    assert R.parents(v, "c", "p").first().parent == 3


def test_knn_over_several_blocks_is_exact(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 16)
    v = np.random.RandomState(0).randn(70, 5)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    sim = np.round(v @ v.T, 12)
    np.fill_diagonal(sim, -np.inf)
    want = {(i, int(j)) for i in range(70) for j in np.argsort(-sim[i], kind="stable")[:3]}
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, unit array<double>")
    got = {(r.src, r.dst) for r in E.knn(df, 3).collect()}
    assert got == want | {(b, a) for a, b in want}
    assert E.knn(df, 0).count() == 0


def test_supervoxels_agree_with_the_kernel(spark):
    rng = np.random.RandomState(3)
    vol = rng.randint(0, 50, (4, 9, 8)).astype(float)
    mask = rng.rand(4, 9, 8) < 0.8
    want = K.slic(vol, mask, 12, 1.0, (1.0, 1.0, 1.0), 3)
    rows = [("v", *map(int, at), float(vol[tuple(at)])) for at in np.argwhere(mask)]
    df = spark.createDataFrame(rows, "view_key string, z int, y int, x int, q double")
    got = R.dense_labels(S.supervoxels(df, 12, 3), "k").collect()
    assert all(want[r.z, r.y, r.x] == r.dense for r in got) and len(got) == mask.sum()


def test_contacts_are_symmetric_and_have_no_loops(spark):
    rng = np.random.RandomState(5)
    rows = [("v", z, y, x, int(rng.randint(4))) for z in range(3) for y in range(5) for x in range(5) if rng.rand() < 0.9]
    lab = {r[1:4]: r[4] for r in rows}
    want: dict[tuple[int, int], int] = {}
    for (z, y, x), a in lab.items():
        for d in ((1, 0, 0), (0, 1, 0), (0, 0, 1)):
            b = lab.get((z + d[0], y + d[1], x + d[2]))
            if b is not None and a != b:
                for k in ((a, b), (b, a)):
                    want[k] = want.get(k, 0) + 1
    got = R.contacts(spark.createDataFrame(rows, "view_key string, z int, y int, x int, lab int"), "lab").collect()
    assert {(r.src, r.dst): r.contact for r in got} == want


def test_texture_of_a_box_by_brute_force(spark):
    rng = np.random.RandomState(9)
    vol = rng.rand(3, 6, 7)
    df = spark.createDataFrame([("v", z, y, x, float(vol[z, y, x])) for z in range(3) for y in range(6) for x in range(7)], "view_key string, z int, y int, x int, scaled double")
    box = df.where("z < 2 AND y >= 1 AND x < 5").withColumn("label", F.lit(1))
    got = R.glcm(df, R.bounds(box, ("view_key", "label")), ("view_key", "label")).first()
    img = (vol[:2, 1:, :5].max(0) * 63).astype(int)
    p = np.zeros((64, 64))
    for a, b in zip(img[:, :-1].ravel(), img[:, 1:].ravel(), strict=True):
        p[a, b] += 1
        p[b, a] += 1
    p /= p.sum()
    i, j = np.indices(p.shape)
    mean = (p * i).sum()
    want = [(p * (i - j) ** 2).sum(), (p / (1 + (i - j) ** 2)).sum(), np.sqrt((p**2).sum()), (p * (i - mean) * (j - mean)).sum() / (p * (i - mean) ** 2).sum()]
    assert np.allclose([got.contrast, got.homogeneity, got.energy, got.correlation], want)


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 2**32 - 1), st.floats(0.1, 0.9))
def test_parts_of_a_mask(seed, share):
    mask = np.random.RandomState(seed).rand(3, 5, 6) < share
    got = K.label(mask)
    seen = np.zeros(mask.shape, int)
    n = 0
    for at in map(tuple, np.argwhere(mask)):
        if not seen[at]:
            n += 1
            todo = [at]
            while todo:
                p = todo.pop()
                if all(0 <= c < s for c, s in zip(p, mask.shape, strict=True)) and mask[p] and not seen[p]:
                    seen[p] = n
                    todo += [tuple(np.add(p, d)) for a in range(3) for d in (np.eye(3, dtype=int)[a], -np.eye(3, dtype=int)[a])]
    assert (got == 0).tolist() == (~mask).tolist()
    assert len({(a, b) for a, b in zip(got[mask], seen[mask], strict=True)}) == n == got.max(initial=0)


def test_kernels_stay_in_range_and_repeat():
    vol = np.random.RandomState(1).rand(2, 24, 24).astype("f4")
    assert (K.augmix(vol, 5) == K.augmix(vol, 5)).all() and (K.augmix(vol, 5) != K.augmix(vol, 6)).any()
    smooth = K.diffusion(vol * 0 + 0.5, 5, 0.05, "nlmeans", 0.5)
    assert abs(smooth - 0.5).max() < abs(K.diffusion(vol * 0 + 0.5, 5, 0.05, "none") - 0.5).max()
    flat = K.clahe(np.full((24, 24), 9, "u1"), 0.4)
    assert flat.shape == (24, 24) and flat.std() == 0
    assert K.otsu(np.array([[1, 1, 9, 9]], "u1")) == 1
    disc = np.zeros((4, 30, 30))
    disc[:, 5:20, 5:20] = 0.9
    disc[:, 25:27, 25:27] = 0.9
    assert K.tissue(disc, 100)[1:3, 6:19, 6:19].all() and not K.tissue(disc, 100)[:, 25:, 25:].any()


def test_degree_counts_both_ends(spark):
    n = spark.createDataFrame([("v", 0), ("v", 1), ("w", 0)], "view_key string, node long")
    e = spark.createDataFrame([("v", 0, 1), ("v", 1, 0)], "view_key string, src long, dst long")
    got = {r.view_key: (r.avg_degree, r.lcc_frac) for r in Q.metrics(n, e, ("view_key",)).collect()}
    assert got == {"v": (2.0, 1.0), "w": (0.0, 0.0)}


def test_targets_round_to_even_and_keep_a_floor(spark):
    n = spark.createDataFrame([(5,), (1_000_000,)], "n_tissue long")
    got = [r.targets for r in R.adaptive_targets(n, (1.0, 1.0, 1.0), (2 ** (1 / 3), 1.0), (1, 1), (10**6, 10**6), 1500).orderBy("n_tissue").collect()]
    assert got == [[2, 5], [1000, 1000]]


def test_a_step_of_the_adversary(spark):
    x = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 5.0)], "node long, f double")
    e = spark.createDataFrame([(0, 1), (0, 1), (1, 2)], "src long, dst long")
    got = [r.f for r in E.adversarial(x, e, ["f"], 0.3, 1).orderBy("node").collect()]
    v = np.array([0.0, 1.0, 5.0])
    w = np.array([[0, 2, 0], [2, 0, 1], [0, 1, 0]], float)
    sd = v.std() + 1e-6
    z = (v - v.mean()) / sd
    z = np.clip(z + 0.3 * np.sign(w.sum(1) * z - w @ z), -3, 3)
    assert np.allclose(got, z * sd + v.mean())
