"""Dense kernels in NumPy for one view or slice, and their use on many views by applyInArrow.

They are for steps that have no good relational form. Slices are numbered rows of a table (view_key, z, h, w, px), px being the
little-endian 32-bit floats of h * w pixels."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SLICE = "view_key string, z int, h int, w int, px binary"


def clahe(img: np.ndarray, clip: float, tiles: int = 8, bins: int = 256) -> np.ndarray:
    """Contrast-limited adaptive histogram equalisation of an 8-bit image: each tile's histogram is clipped, the excess spread
    evenly, and pixels take the bilinear mean of the mappings of the four tiles around."""
    h, w = img.shape
    ph, pw = -h % tiles, -w % tiles
    wide = np.pad(img, ((0, ph), (0, pw)), "reflect" if h > ph and w > pw else "edge")
    th, tw = wide.shape[0] // tiles, wide.shape[1] // tiles
    limit = max(1, int(clip * th * tw / bins))
    maps = np.empty((tiles, tiles, bins))
    for i in range(tiles):
        for j in range(tiles):
            hist = np.bincount(wide[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=bins)
            over = int(np.maximum(hist - limit, 0).sum())
            hist = np.minimum(hist, limit) + over // bins
            rest = over % bins
            if rest:
                hist[:: max(1, bins // rest)][:rest] += 1
            maps[i, j] = np.clip(np.rint(np.cumsum(hist) * (bins - 1) / (th * tw)), 0, bins - 1)
    y, x = (np.arange(n) / t - 0.5 for n, t in ((h, th), (w, tw)))
    (y0, fy), (x0, fx) = ((np.floor(v).astype(int), v - np.floor(v)) for v in (y, x))
    ya, yb, xa, xb = (np.clip(v, 0, tiles - 1) for v in (y0, y0 + 1, x0, x0 + 1))

    def tile(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return maps[a[:, None], b[None], img]

    top = tile(ya, xa) * (1 - fx) + tile(ya, xb) * fx
    low = tile(yb, xa) * (1 - fx) + tile(yb, xb) * fx
    return np.rint(top * (1 - fy[:, None]) + low * fy[:, None]).astype(np.uint8)


def otsu(img: np.ndarray) -> int:
    """The level that separates an 8-bit image best; the lowest of equals."""
    hist = np.bincount(img.ravel(), minlength=256).astype(float)
    n, s = np.cumsum(hist), np.cumsum(hist * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = n * (n[-1] - n) * (s / n - (s[-1] - s) / (n[-1] - n)) ** 2
    return int(np.argmax(np.nan_to_num(between))) if (hist > 0).sum() > 1 else int(img.flat[0])


def label(mask: np.ndarray) -> np.ndarray:
    """Connected parts (neighbours along axes) of a mask of any dimension, numbered from 1; union-find over runs of labels."""
    out = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    flat = np.arange(mask.size + 1)
    pairs = []
    for axis in range(mask.ndim):
        a, b = (np.take(out, range(lo, mask.shape[axis] + lo - 1), axis).ravel() for lo in (0, 1))
        ok = (a > 0) & (b > 0)
        pairs.append(np.stack([a[ok], b[ok]], 1))
    edges = np.concatenate(pairs)
    while True:  # least labels with pointer jumping
        low = np.minimum(flat[edges[:, 0]], flat[edges[:, 1]])
        new = flat.copy()
        np.minimum.at(new, flat[edges[:, 0]], low)
        np.minimum.at(new, flat[edges[:, 1]], low)
        new = new[new]
        if (new == flat).all():
            break
        flat = new
    names, inverse = np.unique(flat[out], return_inverse=True)
    return inverse.reshape(mask.shape) + (names[0] != 0)


def tissue(vol: np.ndarray, least: int = 1000) -> np.ndarray:
    """The tissue of a volume scaled to 0..1: what is over the threshold of its slice, without parts of fewer than `least` pixels,
    closed once, and of that the largest part (the first of equals). What is outside of the volume counts as background."""
    m = np.zeros(vol.shape, bool)
    for z, s in enumerate(vol):
        over = s > otsu((s * 255).astype(np.uint8)) / 255.0
        parts = label(over)
        size = np.bincount(parts.ravel())
        m[z] = over & (size[parts] >= least)
    wide = np.pad(m, 1)
    for closing in (True, False):
        moved = [np.roll(wide, d, a) for a in range(3) for d in (-1, 1)]
        wide = np.logical_or.reduce([wide, *moved]) if closing else np.logical_and.reduce([wide, *moved])
        edge = np.zeros_like(wide)
        edge[1:-1, 1:-1, 1:-1] = True
        wide &= edge
    parts = label(wide[1:-1, 1:-1, 1:-1])
    size = np.bincount(parts.ravel())
    size[0] = 0
    return (parts == size.argmax()) if size.any() else parts > 0


def slic(vol: np.ndarray, mask: np.ndarray, n_segments: int, compactness: float = 1.0, spacing: tuple[float, ...] = (1.0, 1.0, 1.0), iterations: int = 8) -> np.ndarray:
    """Supervoxels of a view, as operators.segment makes them, numbered densely; -1 outside of the mask."""
    out = np.full(vol.shape, -1, np.int64)
    at = np.argwhere(mask)
    if not len(at):
        return out
    space = np.array(spacing)
    length = (len(at) * space.prod() / min(n_segments, len(at))) ** (1 / 3)
    step = np.maximum(1, np.rint(length / space)).astype(int)
    start = at.min(0) + step // 2
    axes = [np.arange(a, b + 1, s) for a, b, s in zip(start, at.max(0), step, strict=True)]
    shape = np.array([len(a) for a in axes])
    if not shape.all():
        return out
    seeds = np.stack(np.meshgrid(*axes, indexing="ij"), -1).reshape(-1, 3)
    c = np.concatenate([seeds, np.where(mask, vol, 0)[tuple(seeds.T)][:, None]], 1).astype(float)
    cell = np.clip((at - start) // step, 0, shape - 1)
    value = vol[tuple(at.T)].astype(float)
    near = [np.clip(cell + np.array([i, j, k]), 0, shape - 1) @ np.array([shape[1] * shape[2], shape[2], 1]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]

    def nearest() -> np.ndarray:
        best, k = np.full(len(at), np.inf), np.zeros(len(at), np.int64)
        for n in near:
            d = np.round((value - c[n, 3]) ** 2 + (compactness / length) ** 2 * (((at - c[n, :3]) * space) ** 2).sum(1), 9)
            closer = (d < best) | ((d == best) & (n < k))
            best, k = np.where(closer, d, best), np.where(closer, n, k)
        return k

    for _ in range(iterations):
        k = nearest()
        n = np.bincount(k, minlength=len(c))
        for i, v in enumerate((*at.T, value)):
            c[:, i] = np.where(n > 0, np.bincount(k, v, len(c)) / np.maximum(n, 1), c[:, i])
    out[mask] = np.unique(nearest(), return_inverse=True)[1]
    return out


def blurred(img: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing, along each axis in turn, with mirrored borders."""
    if sigma <= 0:
        return img
    r = max(1, int(4 * sigma + 0.5))
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    for axis in range(img.ndim):
        wide = np.pad(img, [(r, r) if a == axis else (0, 0) for a in range(img.ndim)], "symmetric")
        img = sum(w * np.take(wide, range(i, i + img.shape[axis]), axis) for i, w in enumerate(k))
    return img


def augmix(vol: np.ndarray, seed: int, severity: int = 3, width: int = 3, depth: int = -1, alpha: float = 1.0, m: float = 0.2) -> np.ndarray:
    """A blend of the volume with a mixture of chains of random noise, contrast and blur; determined by the seed."""
    rng = np.random.RandomState(seed % 2**32)
    i = min(max(1, severity), 5) - 1
    noise, contrast, blur = (0.01, 0.02, 0.03, 0.04, 0.05)[i], (0.9, 0.95, 1.05, 1.1, 1.2)[i], (0.5, 1.0, 1.5, 2.0, 2.5)[i]
    mixture = np.zeros_like(vol, np.float64)
    for share in rng.dirichlet([alpha] * width):
        v = vol.astype(np.float64)
        for _ in range(depth if depth > 0 else rng.randint(1, 4)):
            what = rng.randint(3)
            v = np.stack([np.clip(s + rng.normal(0, noise, s.shape) if what == 0 else (s - s.mean()) * contrast + s.mean() if what == 1 else blurred(s, blur), 0, 1) for s in v])
        mixture += share * v
    keep = rng.beta(m, m)
    return (keep * vol + (1 - keep) * mixture).astype(np.float32)


def nl_means(img: np.ndarray, h: float, patch: int = 5, reach: int = 6) -> np.ndarray:
    """Non-local means: each pixel is the mean of those within reach, weighted by the likeness of the patches around them."""
    pad = reach + patch // 2
    wide = np.pad(img.astype(np.float64), pad, "reflect" if min(img.shape) > pad else "symmetric")
    total, weight = np.zeros(img.shape), np.zeros(img.shape)
    rows, cols = img.shape
    box = np.ones(patch) / patch
    mid = wide[reach : reach + rows + patch - 1, reach : reach + cols + patch - 1]
    for dy in range(-reach, reach + 1):
        for dx in range(-reach, reach + 1):
            other = wide[reach + dy : reach + dy + rows + patch - 1, reach + dx : reach + dx + cols + patch - 1]
            d = (mid - other) ** 2
            d = np.apply_along_axis(np.convolve, 0, np.apply_along_axis(np.convolve, 1, d, box, "valid"), box, "valid")
            w = np.exp(-d / (h * h))
            total += w * other[patch // 2 : patch // 2 + rows, patch // 2 : patch // 2 + cols]
            weight += w
    return total / weight


def diffusion(vol: np.ndarray, seed: int, sigma: float = 0.05, denoiser: str = "nlmeans", h: float = 0.06) -> np.ndarray:
    """Noise, determined by the seed, and its removal slice by slice; any other denoiser leaves the noise."""
    rng = np.random.RandomState(seed % 2**32)
    noisy = np.clip(vol + rng.normal(0, sigma, vol.shape), 0, 1).astype(np.float32)
    if denoiser != "nlmeans":
        return noisy
    h = max(1e-6, 1.2 * sigma) if h > 1 else h
    return np.clip(np.stack([nl_means(s, h) for s in noisy]), 0, 1).astype(np.float32)


def volume(table: pa.Table) -> np.ndarray:
    """The volume of one view's slices, in the order of z."""
    order = np.argsort(table.column("z").to_numpy(), kind="stable")
    px, h, w = (table.column(c).to_pylist() for c in ("px", "h", "w"))
    rows, cols = min(h), min(w)
    return np.stack([np.frombuffer(px[i], "<f4").reshape(h[i], w[i])[:rows, :cols] for i in order])


def slices(view: str, vol: np.ndarray) -> pa.Table:
    z, h, w = vol.shape
    return pa.table({"view_key": pa.array([view] * z), "z": pa.array(np.arange(z, dtype=np.int32)), "h": pa.array([h] * z, pa.int32()), "w": pa.array([w] * z, pa.int32()), "px": pa.array([np.ascontiguousarray(s, "<f4").tobytes() for s in vol], pa.binary())})


def over_views(df: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """kernel on the volume of each view of a table of slices. A view is held by one task, whole."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        return slices(key[0].as_py(), kernel(volume(table)))

    return df.groupBy("view_key").applyInArrow(run, SLICE)


def over_slices(df: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """kernel on each slice by itself, without a shuffle."""

    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            px = [np.ascontiguousarray(kernel(np.frombuffer(p, "<f4").reshape(h, w)), "<f4").tobytes() for p, h, w in zip(*(b.column(c).to_pylist() for c in ("px", "h", "w")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("view_key", "z", "h", "w")] + [pa.array(px, pa.binary())], names=["view_key", "z", "h", "w", "px"])

    return df.select("view_key", "z", "h", "w", "px").mapInArrow(run, SLICE)
