"""Relational operators over voxels (view_key, z, y, x, q): scaling, masks, statistics, gradients, textures, regions.

A view is a key, so any number of views are processed in one job. A label of null means that a voxel is in no region. What isn't
tissue has no row and is 0; how large a volume is stands in the columns nz, ny and nx, or follows from its last voxels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VIEW = ("view_key",)
SCALES = ("lab_fine", "lab_med", "lab_coarse")


def minmax_scaled(df: DataFrame, value: str, keys: tuple[str, ...] = VIEW, out: str = "scaled") -> DataFrame:
    """value scaled to 0..1 in each group; a constant group is 0."""
    lo, hi = F.col("_lo"), F.col("_hi")
    bounds = df.groupBy(*keys).agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    scaled = F.when(hi > lo, (F.col(value) - lo) / (hi - lo)).otherwise(0.0)
    return _beside(df, bounds, keys).withColumn(out, scaled).drop("_lo", "_hi")


def zscored(df: DataFrame, value: str, keys: tuple[str, ...] = VIEW, out: str = "z") -> DataFrame:
    """(value - mean) / (population deviation + 1e-6) in each group."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    return _beside(df, stats, keys).withColumn(out, (F.col(value) - F.col("_mean")) / (F.col("_sd") + 1e-6)).drop("_mean", "_sd")


def _beside(df: DataFrame, stats: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return df.join(stats, list(keys)) if keys else df.crossJoin(stats)  # without keys, stats is one row


def regions(voxels: DataFrame, scales: tuple[str, ...] = SCALES) -> DataFrame:
    """A row for each voxel and scale in which it has a label: scale (0, 1, ...) and label are added."""
    cells = F.array(*[F.struct(F.lit(i).alias("scale"), F.col(s).cast("long").alias("label")) for i, s in enumerate(scales)])
    kept = [c for c in voxels.columns if c not in scales]
    return voxels.select(*kept, F.inline(cells)).where("label IS NOT NULL")


def dense_labels(df: DataFrame, label: str, keys: tuple[str, ...] = VIEW, out: str = "dense") -> DataFrame:
    """Used labels renumbered 0, 1, ... in their order, view by view. Ranked are the distinct labels, not the voxels."""
    used = df.where(F.col(label).isNotNull()).select(*keys, label).distinct()
    rank = used.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(label)) - 1)
    return df.join(rank, [*keys, label], "left")


def bounds(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Size and half-open bounding box of each region."""
    axes = [f(F.col(a) + d).cast("int").alias(f"{a}{i}") for i, f, d in ((0, F.min, 0), (1, F.max, 1)) for a in "zyx"]
    return rows.groupBy(*keys).agg(F.count("*").alias("n_voxels"), *axes)


def slice_membership(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The sorted slices that each region touches. A region touches as many as a volume has, at most."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set(F.col("z").cast("int"))).alias("slices"))


def distribution(value: str, prefix: str = "") -> list[Column]:
    """Mean, deviation, extremes, median, interquartile range, skewness and excess kurtosis; 0 where one is undefined."""
    few = F.count(value) <= 2

    def safe(c: Column) -> Column:
        return F.when(few | c.isNull() | F.isnan(c), 0.0).otherwise(c)

    quartile = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return [
        F.avg(value).alias(f"{prefix}mean"), F.stddev_pop(value).alias(f"{prefix}std"), F.min(value).alias(f"{prefix}min"), F.max(value).alias(f"{prefix}max"),
        quartile[1].alias(f"{prefix}median"), (quartile[2] - quartile[0]).alias(f"{prefix}iqr"), safe(F.skewness(value)).alias(f"{prefix}skewness"), safe(F.kurtosis(value)).alias(f"{prefix}kurtosis"),
    ]


SIZE = ("nz", "ny", "nx")


def sized(voxels: DataFrame) -> DataFrame:
    """voxels with the size of their volume; where it isn't given, up to the last voxel along each axis."""
    if set(SIZE) <= set(voxels.columns):
        return voxels
    return voxels.join(voxels.groupBy("view_key").agg(*[(F.max(a) + 1).cast("int").alias(f"n{a}") for a in "zyx"]), "view_key")


def by_slice(voxels: DataFrame, keys: tuple[str, ...] = VIEW) -> DataFrame:
    """voxels, dealt by slices: windows along y and along x need no further shuffle then, and only the one along z does."""
    return voxels.repartition(*keys, "z")


def gradient(voxels: DataFrame, value: str = "q", spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), out: str = "gradient") -> DataFrame:
    """The size of the gradient over the whole volume, in which a place without a voxel is 0: central differences, one-sided at the
    volume's first and last place along an axis, 0 along an axis of one place.
"""
    had = voxels.columns
    v = by_slice(sized(voxels))
    total: Column | None = None
    for axis, step in zip("yxz", (spacing[1], spacing[2], spacing[0]), strict=True):
        w = Window.partitionBy("view_key", *[a for a in "zyx" if a != axis]).orderBy(axis)
        at, n = F.col(axis), F.col(f"n{axis}")
        after = F.when(F.lead(axis).over(w) == at + 1, F.lead(value).over(w)).when(at + 1 < n, 0.0)
        before = F.when(F.lag(axis).over(w) == at - 1, F.lag(value).over(w)).when(at > 0, 0.0)
        v = v.withColumn(f"_a{axis}", after).withColumn(f"_b{axis}", before)
        after, before, own = F.col(f"_a{axis}"), F.col(f"_b{axis}"), F.col(value)
        d = F.when(after.isNotNull() & before.isNotNull(), (after - before) / (2 * step)).when(after.isNotNull(), (after - own) / step).when(before.isNotNull(), (own - before) / step).otherwise(0.0)
        total = d * d if total is None else total + d * d
    return v.withColumn(out, F.sqrt(total)).select(*had, out)


def shape(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """bounds() with compactness (voxels in the box) and elongation (longest by shortest side, in voxels)."""
    z, y, x = (F.col(f"{a}1") - F.col(f"{a}0") for a in "zyx")
    return bounds(rows, keys).withColumn("compactness", F.col("n_voxels") / (z * y * x)).withColumn("elongation", F.greatest(z, y, x) / F.least(z, y, x).cast("double"))


def location(rows: DataFrame, keys: tuple[str, ...], spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Centroids, their distance in mm from the centroid of the view's regions (of a scale, if keys has one), and their place in the volume
    from 0 to 1.

    The view's figures come from the regions' sums, so voxels are read once and only regions are shuffled again."""
    rows = sized(rows)
    sums = [F.sum(a).alias(f"_s{a}") for a in "zyx"]
    each = rows.groupBy(*keys).agg(F.count("*").alias("_n"), *sums, *[F.max(n).alias(n) for n in SIZE])
    of = [k for k in ("view_key", "scale") if k in keys]
    whole = each.groupBy(*of).agg(*[(F.sum(f"_s{a}") / F.sum("_n")).alias(f"_w{a}") for a in "zyx"])
    c = {a: F.col(f"_s{a}") / F.col("_n") for a in "zyx"}
    square = sum((((c[a] - F.col(f"_w{a}")) * s) ** 2 for a, s in zip("zyx", spacing, strict=True)), F.lit(0.0))
    return each.join(whole, of).select(*keys, *[c[a].alias(f"c{a}") for a in "zyx"], F.sqrt(square).alias("dist_mm"), *[(c[a] / F.greatest(F.lit(1), F.col(f"n{a}") - 1)).alias(f"norm_{a}") for a in "zyx"])


def glcm(voxels: DataFrame, boxes: DataFrame, keys: tuple[str, ...], value: str = "scaled", levels: int = 64, least: int = 16) -> DataFrame:
    """Texture of each region's box (bounds()), projected along z: pairs of neighbours along x, counted both ways, in grey levels.

    The box holds all voxels in it, of any region; a place without a voxel is 0. contrast, homogeneity, energy and correlation
    (1 where a side has no variance) are 0 for boxes of fewer than `least` places. Boxes are spread over their places and
    joined with the voxels by view, y and x, so no range join is needed."""
    area = (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))
    rows = boxes.where(area >= least).withColumn("y", F.explode(F.sequence(F.col("y0"), F.col("y1") - 1)))
    places = rows.withColumn("x", F.explode(F.sequence(F.col("x0"), F.col("x1") - 1)))
    inside = voxels.select("view_key", F.col("z").alias("_z"), "y", "x", F.col(value).cast("double").alias("_v"))
    met = places.select(*keys, "z0", "z1", "y", "x").join(inside, ["view_key", "y", "x"], "left")
    flat = met.groupBy(*keys, "y", "x").agg(F.coalesce(F.max(F.when((F.col("_z") >= F.col("z0")) & (F.col("_z") < F.col("z1")), F.col("_v"))), F.lit(0.0)).alias("v"))
    level = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("v"))) * (levels - 1)).cast("int")
    w = Window.partitionBy(*keys, "y").orderBy("x")
    pairs = flat.withColumn("i", level).withColumn("j", F.when(F.lead("x").over(w) == F.col("x") + 1, F.lead("i").over(w))).where("j IS NOT NULL")
    both = pairs.select(*keys, F.inline(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))))
    cells = both.groupBy(*keys, "i", "j").agg(F.count("*").alias("n"))
    d2 = (F.col("i") - F.col("j")) * (F.col("i") - F.col("j"))
    n = F.col("n")
    sums = cells.groupBy(*keys).agg(
        F.sum("n").alias("t"), F.sum(n * d2).alias("c"), F.sum(n / (1 + d2)).alias("h"), F.sum(n * n).alias("e"),
        F.sum(n * F.col("i")).alias("si"), F.sum(n * F.col("i") * F.col("i")).alias("sii"), F.sum(n * F.col("i") * F.col("j")).alias("sij"),
    )
    t = F.col("t").cast("double")
    variance = F.col("sii") / t - (F.col("si") / t) ** 2
    covariance = F.col("sij") / t - (F.col("si") / t) ** 2
    found = sums.select(*keys, (F.col("c") / t).alias("contrast"), (F.col("h") / t).alias("homogeneity"), (F.sqrt(F.col("e")) / t).alias("energy"), F.when(variance < 1e-12, 1.0).otherwise(covariance / variance).alias("correlation"))
    names = ("contrast", "homogeneity", "energy", "correlation")
    return boxes.select(*keys).join(found, list(keys), "left").select(*keys, *[F.coalesce(n, F.lit(0.0)).alias(n) for n in names])


def otsu(df: DataFrame, level: Column, keys: tuple[str, ...], out: str = "threshold") -> DataFrame:
    """The level that separates each group best: largest variance between what is up to it and what is above; the lowest of equals.

    Histograms of whole-number levels are summed first; windows run over levels, not over rows."""
    hist = df.groupBy(*keys, level.cast("int").alias("level")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    up = w.orderBy("level")
    n, s = F.sum("n").over(up), F.sum(F.col("n") * F.col("level")).over(up)
    total, mass = F.sum("n").over(w), F.sum(F.col("n") * F.col("level")).over(w)
    gap = s / n - (mass - s) / (total - n)
    between = F.when(total > n, F.round(n.cast("double") * (total - n) * gap * gap / (total.cast("double") * total), 6)).otherwise(0.0)
    rated = hist.select(*keys, "level", between.alias("between"))
    return rated.groupBy(*keys).agg(F.min_by("level", F.struct(-F.col("between"), F.col("level"))).alias(out))


def contacts(voxels: DataFrame, label: str, keys: tuple[str, ...] = VIEW) -> DataFrame:
    """Regions that touch (6 neighbours), both ways: src, dst, contact (touching faces). Each face is counted by its lower voxel."""
    label_ = F.col(label).cast("long")
    voxels = by_slice(voxels.select(*keys, *"zyx", label), keys)
    for axis in "yxz":
        w = Window.partitionBy(*keys, *[a for a in "zyx" if a != axis]).orderBy(axis)
        voxels = voxels.withColumn(f"_n{axis}", F.when(F.lead(axis).over(w) == F.col(axis) + 1, F.lead(label).over(w)).cast("long"))
    faces = voxels.select(*keys, label_.alias("a"), F.explode(F.array(*[f"_n{a}" for a in "zyx"])).alias("b")).where("a <> b")
    pairs = faces.groupBy(*keys, F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.count("*").alias("contact"))
    return pairs.select(*keys, F.inline(F.array(F.struct(F.col("u").alias("src"), F.col("v").alias("dst")), F.struct(F.col("v").alias("src"), F.col("u").alias("dst")))), "contact").select(*keys, "src", "dst", "contact")


def parents(voxels: DataFrame, child: str, parent: str, keys: tuple[str, ...] = VIEW) -> DataFrame:
    """Of each child region the parent region that holds most of its voxels; the smallest of equals."""
    counts = voxels.where(F.col(child).isNotNull() & F.col(parent).isNotNull()).groupBy(*keys, F.col(child).alias("child"), F.col(parent).alias("parent")).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys, "child").agg(F.min_by("parent", F.struct(-F.col("n"), F.col("parent"))).alias("parent"), F.max("n").alias("n_shared"))


def adaptive_targets(views: DataFrame, spacing: tuple[float, float, float], lengths: tuple[float, ...], least: tuple[int, ...], most: tuple[int, ...], cap: int, tissue: str = "n_tissue") -> DataFrame:
    """targets: how many regions a view should have at each scale, by the volume of its tissue; half-even rounding.

    If their sum is over the cap all are scaled down, but to no less than 1000."""
    mm3 = F.col(tissue) * (spacing[0] * spacing[1] * spacing[2])
    raw = F.array(*[F.greatest(F.lit(lo), F.least(F.lit(hi), F.rint(mm3 / max(1e-6, n**3)).cast("long"))) for n, lo, hi in zip(lengths, least, most, strict=True)])
    total = F.expr("aggregate(_raw, 0L, (a, k) -> a + k)")
    scaled = F.expr(f"transform(_raw, k -> greatest(1000L, CAST(rint(k * ({float(cap)}D / _sum)) AS BIGINT)))")
    return views.withColumn("_raw", raw).withColumn("_sum", total).withColumn("targets", F.when(F.col("_sum") > cap, scaled).otherwise(F.col("_raw"))).drop("_raw", "_sum")
