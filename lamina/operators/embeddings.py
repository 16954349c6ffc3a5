"""Vectors that were made elsewhere, as features of regions: sampled at centroids, projected to fewer components, and set beside others."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@lru_cache(maxsize=8)
def projection(size: int, dims: int, seed: int = 123) -> tuple[tuple[float, ...], ...]:
    """dims orthonormal directions among size components, the same for every run; with as many dims as components or more, the components."""
    if dims >= size:
        return tuple(map(tuple, np.eye(size).tolist()))
    q, r = np.linalg.qr(np.random.RandomState(seed).standard_normal((size, dims)))
    return tuple(map(tuple, (q * np.sign(np.diag(r))).T.tolist()))


def projected(vectors: DataFrame, column: str, dims: int, size: int, out: str = "projected", seed: int = 123) -> DataFrame:
    """vectors and out: their column, of size components, along dims fixed orthonormal directions. A vector of another size, or none, gives null."""
    directions = F.array(*[F.array(*map(F.lit, d)) for d in projection(size, dims, seed)])
    dot = F.transform(directions, lambda d: F.aggregate(F.zip_with(column, d, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v))
    return vectors.withColumn(out, F.when(F.size(column) == size, dot))


def at_centroids(nodes: DataFrame, grid: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """nodes (view_key, cz, cy, cx, ny, nx, ...) and vector: that of the cell of a slice's grid (view_key, z, row, col, vector) in which the
    centroid lies, for grids of that many rows and columns over each slice; null where there is none."""
    cell = {"z": F.rint("cz").cast("int"), "row": F.least(F.lit(shape[0] - 1), F.floor(F.col("cy") * shape[0] / F.col("ny"))).cast("int"), "col": F.least(F.lit(shape[1] - 1), F.floor(F.col("cx") * shape[1] / F.col("nx"))).cast("int")}
    had = nodes.columns
    keyed = nodes.withColumns({f"_{k}": c for k, c in cell.items()})
    cells = grid.select("view_key", *[F.col(k).alias(f"_{k}") for k in cell], "vector")
    return keyed.join(cells, ["view_key", *(f"_{k}" for k in cell)], "left").select(*had, "vector")


def beside(nodes: DataFrame, given: DataFrame, dims: int, column: str = "_raw") -> DataFrame:
    """nodes with the projected vectors of their regions (given: view_key, scale, label, vector) after their features; zeros where one is missing."""
    size = given.select(F.max(F.size("vector")).alias("n")).first().n or 0
    if not size:
        return nodes
    short = projected(given, "vector", dims, size).select("view_key", "scale", "label", "projected")
    none = F.array_repeat(F.lit(0.0), min(dims, size))
    return nodes.join(short, ["view_key", "scale", "label"], "left").withColumn(column, F.concat(column, F.coalesce("projected", none))).drop("projected")
