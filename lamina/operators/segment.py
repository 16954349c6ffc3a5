"""Supervoxels in relational form: voxels are assigned to the nearest of the centroids around them, centroids are their means.

A seed grid covers the box of the tissue. A voxel looks at the 27 grid cells around its own, so an assignment is an equi-join on
cells with at most 27 centroids a voxel, never a join of all voxels with all centroids. A view too thin for a seed has no regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import written


def seed_grid(voxels: DataFrame, n_segments: int, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """view_key, the box's corner (z0, y0, x0), steps (tz, ty, tx), cells (gz, gy, gx) and length (mm) of each view's grid.

    The wanted number of seeds sets the length of a cell; steps are half-even roundings of it, of one voxel at least."""
    box = voxels.groupBy("view_key").agg(F.count("*").alias("n"), *[f(a).alias(f"{a}{s}") for a in "zyx" for f, s in ((F.min, "0"), (F.max, "1"))])
    mm3 = F.col("n") * (spacing[0] * spacing[1] * spacing[2])
    box = box.withColumn("length", F.pow(mm3 / F.least(F.lit(n_segments), F.col("n")), 1 / 3))
    for a, s in zip("zyx", spacing, strict=True):
        box = box.withColumn(f"t{a}", F.greatest(F.lit(1), F.rint(F.col("length") / s).cast("int")))
    for a in "zyx":
        seeds = F.floor((F.col(f"{a}1") - F.col(f"{a}0") - F.floor(F.col(f"t{a}") / 2)) / F.col(f"t{a}")) + 1
        box = box.withColumn(f"g{a}", seeds.cast("int"))
    return box.where("gz > 0 AND gy > 0 AND gx > 0").select("view_key", *[f"{a}0" for a in "zyx"], *[f"t{a}" for a in "zyx"], *[f"g{a}" for a in "zyx"], "length")


def celled(voxels: DataFrame, grid: DataFrame) -> DataFrame:
    """voxels with the grid cell (kz, ky, kx) that each lies in. A cell begins at its seed; those at the border take what is beyond."""
    on = voxels.join(grid, "view_key")
    for a in "zyx":
        on = on.withColumn(f"k{a}", F.least(F.col(f"g{a}") - 1, F.greatest(F.lit(0), F.floor((F.col(a) - F.col(f"{a}0") - F.floor(F.col(f"t{a}") / 2)) / F.col(f"t{a}")))).cast("int"))
    return on


def _cell() -> Column:
    return ((F.col("kz") * F.col("gy") + F.col("ky")) * F.col("gx") + F.col("kx")).cast("long")


def seeds(voxels: DataFrame, grid: DataFrame, value: str = "q") -> DataFrame:
    """view_key, k, cz, cy, cx, ci: the seed of each cell, in its middle, with the intensity there (0 outside of the tissue)."""
    cells = grid
    for a in "zyx":
        cells = cells.withColumn(f"k{a}", F.explode(F.sequence(F.lit(0), F.col(f"g{a}") - 1)))
    for a in "zyx":
        cells = cells.withColumn(a, (F.col(f"{a}0") + F.floor(F.col(f"t{a}") / 2) + F.col(f"k{a}") * F.col(f"t{a}")).cast("int"))
    placed = cells.select("view_key", _cell().alias("k"), *"zyx")
    found = placed.join(voxels.select("view_key", *"zyx", F.col(value).alias("ci")), ["view_key", *"zyx"], "left")
    return found.select("view_key", "k", *[F.col(a).cast("double").alias(f"c{a}") for a in "zyx"], F.coalesce("ci", F.lit(0.0)).cast("double").alias("ci"))


def assigned(voxels: DataFrame, grid: DataFrame, centroids: DataFrame, compactness: float = 1.0, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), value: str = "q") -> DataFrame:
    """voxels with k: the centroid of least distance, in intensity and (weighted) in space, among the cells around; the smallest
    of equals."""
    cells = celled(voxels.select("view_key", *"zyx", value), grid)
    near = cells
    for a in "zyx":
        steps = F.sequence(F.greatest(F.lit(0), F.col(f"k{a}") - 1), F.least(F.col(f"g{a}") - 1, F.col(f"k{a}") + 1))
        near = near.withColumn(f"k{a}", F.explode(steps))
    pairs = near.withColumn("k", _cell()).join(centroids, ["view_key", "k"])
    weight = (F.lit(compactness) / F.col("length")) ** 2
    space = sum((((F.col(a) - F.col(f"c{a}")) * s) ** 2 for a, s in zip("zyx", spacing, strict=True)), F.lit(0.0))
    d = F.round((F.col(value) - F.col("ci")) ** 2 + weight * space, 9)
    return pairs.groupBy("view_key", *"zyx", value).agg(F.min_by("k", F.struct(d.alias("d"), F.col("k"))).alias("k"))


def updated(assignment: DataFrame, centroids: DataFrame, value: str = "q") -> DataFrame:
    """Centroids as the means of their voxels; one without voxels stays where it was."""
    means = assignment.groupBy("view_key", "k").agg(*[F.avg(a).alias(f"n{a}") for a in "zyx"], F.avg(value).alias("ni"))
    both = centroids.join(means, ["view_key", "k"], "left")
    return both.select("view_key", "k", *[F.coalesce(f"n{a}", f"c{a}").alias(f"c{a}") for a in "zyxi"])


def supervoxels(voxels: DataFrame, n_segments: int, iterations: int = 8, compactness: float = 1.0, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), value: str = "q") -> DataFrame:
    """voxels with k, after a fixed number of updates and a last assignment. Centroids are cut from their lineage each time."""
    grid = written(seed_grid(voxels, n_segments, spacing), "grid")
    centroids = written(seeds(voxels, grid, value), "centroids")
    for _ in range(iterations):
        centroids = written(updated(assigned(voxels, grid, centroids, compactness, spacing, value), centroids, value), "centroids")
    return assigned(voxels, grid, centroids, compactness, spacing, value)
