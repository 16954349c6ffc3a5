"""Dense kernels against plain loops, by themselves and by the queries that run them."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from lamina import queries as Q
from lamina.operators import kernels as K


def clahe(img, clip, tiles=8):
    """Pixel by pixel: the mapping of each tile from its clipped histogram, blended between the four tiles around."""
    h, w = img.shape
    ph, pw = -h % tiles, -w % tiles
    wide = np.pad(img, ((0, ph), (0, pw)), "reflect" if h > ph and w > pw else "edge")
    th, tw = wide.shape[0] // tiles, wide.shape[1] // tiles
    limit = max(1, int(clip * th * tw / 256))
    maps = {}
    for i in range(tiles):
        for j in range(tiles):
            hist = [0] * 256
            for v in wide[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel().tolist():
                hist[v] += 1
            over = sum(max(0, n - limit) for n in hist)
            hist = [min(n, limit) + over // 256 for n in hist]
            left, at = over % 256, 0
            step = max(1, 256 // left) if left else 1
            while left and at < 256:
                hist[at] += 1
                at, left = at + step, left - 1
            total, maps[i, j] = 0, []
            for n in hist:
                total += n
                maps[i, j].append(min(255, max(0, round(total * 255 / (th * tw)))))
    out = np.zeros_like(img)
    for y in range(h):
        for x in range(w):
            fy, fx = y / th - 0.5, x / tw - 0.5
            y0, x0 = math.floor(fy), math.floor(fx)
            fy, fx = fy - y0, fx - x0
            at = lambda a, b: maps[min(max(a, 0), tiles - 1), min(max(b, 0), tiles - 1)][img[y, x]]  # noqa: B023, E731
            top, low = at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx, at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx
            out[y, x] = round(top * (1 - fy) + low * fy)
    return out


def parts(mask):
    """Lists of places that hang together."""
    left, out = set(map(tuple, np.argwhere(mask).tolist())), []
    for start in sorted(left):
        if start in left:
            left.discard(start)
            todo, own = [start], []
            while todo:
                p = todo.pop()
                own.append(p)
                for a in range(mask.ndim):
                    for d in (-1, 1):
                        n = tuple(c + d * (i == a) for i, c in enumerate(p))
                        if n in left:
                            left.discard(n)
                            todo.append(n)
            out.append(own)
    return out


def threshold(levels):
    best, at = -1.0, int(min(levels))
    for t in range(256):
        low, high = [v for v in levels if v <= t], [v for v in levels if v > t]
        if low and high:
            gap = len(low) * len(high) * (sum(low) / len(low) - sum(high) / len(high)) ** 2
            if gap > best * (1 + 1e-12):
                best, at = gap, t
    return at


def tissue(vol, least):
    m = np.zeros(vol.shape, bool)
    for z, s in enumerate(vol):
        over = s > threshold((s * 255).astype(np.uint8).ravel().tolist()) / 255.0
        for p in parts(over):
            if len(p) >= least:
                m[z][tuple(np.array(p).T)] = True
    near = lambda a, p: [a[q] if all(0 <= c < n for c, n in zip(q, a.shape, strict=True)) else False for q in (tuple(c + d * (i == k) for i, c in enumerate(p)) for k in range(3) for d in (-1, 0, 1))]
    grown = np.array([any(near(m, p)) for p in np.ndindex(*m.shape)]).reshape(m.shape)
    closed = np.array([all(near(grown, p)) for p in np.ndindex(*m.shape)]).reshape(m.shape)
    out = np.zeros(m.shape, bool)
    found = parts(closed)
    if found:
        out[tuple(np.array(max(found, key=len)).T)] = True  # the first of equals
    return out


def nl_means(img, h, patch=5, reach=6):
    pad, half = reach + patch // 2, patch // 2
    wide = np.pad(img.astype(float), pad, "reflect" if min(img.shape) > pad else "symmetric")
    out = np.zeros(img.shape)
    for y in range(img.shape[0]):
        for x in range(img.shape[1]):
            cy, cx, total, weight = y + pad, x + pad, 0.0, 0.0
            own = wide[cy - half : cy + half + 1, cx - half : cx + half + 1]
            for j in range(cy - reach, cy + reach + 1):
                for i in range(cx - reach, cx + reach + 1):
                    w = math.exp(-float(((own - wide[j - half : j + half + 1, i - half : i + half + 1]) ** 2).mean()) / (h * h))
                    total, weight = total + w * wide[j, i], weight + w
            out[y, x] = total / weight
    return out


def blurred(img, sigma):
    r = max(1, int(4 * sigma + 0.5))
    k = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    mirror = lambda i, n: (i % (2 * n) if i % (2 * n) < n else 2 * n - 1 - i % (2 * n))
    for axis in range(2):
        img = img if axis else img.T
        img = np.array([[sum(w * row[mirror(x + d - r, len(row))] for d, w in enumerate(k)) / sum(k) for x in range(len(row))] for row in img])
        img = img if axis else img.T
    return img


def augmix(vol, seed, severity=3, width=3, depth=-1, alpha=1.0, m=0.2):
    """The same draws in the same order, each step by itself."""
    rng, i = np.random.RandomState(seed), severity - 1
    noise, contrast, blur = [0.01, 0.02, 0.03, 0.04, 0.05][i], [0.9, 0.95, 1.05, 1.1, 1.2][i], [0.5, 1.0, 1.5, 2.0, 2.5][i]
    total = np.zeros(vol.shape)
    for share in rng.dirichlet([alpha] * width):
        v = vol.astype(float)
        for _ in range(depth if depth > 0 else rng.randint(1, 4)):
            what = rng.randint(3)
            for z in range(len(v)):
                s = v[z]
                s = s + rng.normal(0, noise, s.shape) if what == 0 else (s - s.mean()) * contrast + s.mean() if what == 1 else blurred(s, blur)
                v[z] = np.clip(s, 0, 1)
        total += share * v
    keep = rng.beta(m, m)
    return keep * vol + (1 - keep) * total


@pytest.mark.parametrize("shape", [(24, 24), (19, 30), (6, 9)])
def test_equalisation(shape):
    img = np.random.RandomState(sum(shape)).randint(0, 256, shape).astype("u1") // 3
    assert (K.clahe(img, 0.4) == clahe(img, 0.4)).mean() > 0.999 and abs(K.clahe(img, 0.4).astype(int) - clahe(img, 0.4)).max() <= 1
    assert (K.clahe(img, 40.0) == clahe(img, 40.0)).mean() > 0.999


@pytest.mark.parametrize("seed", range(6))
def test_tissue(seed):
    rng = np.random.RandomState(seed)
    vol = rng.rand(3, 9, 10) * 0.4 + (np.indices((3, 9, 10))[2] > 3) * 0.5 * (rng.rand(3, 9, 10) < 0.85)
    vol /= vol.max()
    for least in (1, 4, 30):
        assert (K.tissue(vol, least) == tissue(vol, least)).all()
    assert not K.tissue(vol, 10**6).any()


def test_blur_and_denoising():
    img = np.random.RandomState(2).rand(13, 11)
    for sigma in (0.5, 1.5, 4.0):
        assert np.allclose(K.blurred(img, sigma), blurred(img, sigma))
    for shape in ((18, 17), (7, 9)):
        img = np.random.RandomState(3).rand(*shape)
        assert np.allclose(K.nl_means(img, 0.2), nl_means(img, 0.2))


def test_noise_that_a_seed_determines():
    vol = np.random.RandomState(4).rand(2, 12, 12).astype("f4")
    for seed in (1, 5, 9):
        assert np.allclose(K.augmix(vol, seed), augmix(vol, seed), atol=1e-5)
        noisy = np.clip(vol + np.random.RandomState(seed).normal(0, 0.05, vol.shape), 0, 1).astype("f4")
        assert (K.diffusion(vol, seed, 0.05, "none") == noisy).all()
        assert np.allclose(K.diffusion(vol, seed, 0.05, "nlmeans", 0.2), np.clip([nl_means(s, 0.2) for s in noisy], 0, 1), atol=1e-5)
        assert np.allclose(K.diffusion(vol, seed, 0.05, "nlmeans", 8), np.clip([nl_means(s, 0.06) for s in noisy], 0, 1), atol=1e-5)  # over 1, it follows from the noise


def test_queries_run_the_kernels(spark, sf_dir):
    """Each query's digests are those of the plain versions' volumes (of the kernel's, where rounding may differ)."""
    volumes: dict[str, dict] = {}
    for r in Q._slices(spark, sf_dir).collect():
        volumes.setdefault(r.view_key, {})[r.z] = np.frombuffer(r.px, "<f4").reshape(r.h, r.w)
    volumes = {k: np.stack([v[z] for z in sorted(v)]) for k, v in volumes.items()}
    plain = {
        "kernel_tissue": lambda v: tissue(v, 20), "kernel_clahe": lambda v: np.stack([K.clahe((s * 255).astype("u1"), 0.4) / 255.0 for s in v]),
        "variant_augmix": lambda v: K.augmix(v, 7), "variant_diffusion": lambda v: K.diffusion(v, 7), "kernel_slic": lambda v: K.slic(v, v > 0, 60),
    }
    for name, kernel in plain.items():
        want = sorted((k, z, hashlib.sha256(np.ascontiguousarray(s, "<f4").tobytes()).hexdigest()) for k, v in volumes.items() for z, s in enumerate(kernel(v)))
        assert sorted((r.view_key, r.z, r.px_sha256) for r in Q.QUERIES[name](spark, sf_dir).collect()) == want, name
