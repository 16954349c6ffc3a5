"""Graphs of views: from labelled voxels to nodes, typed edges with attributes, and verdicts, for many views in one job."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import edges, embeddings, quality, raster
from ..sources.config import DEFAULTS
from ..store import written

KEYS = ("view_key",)


def nodes(labelled: DataFrame, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """A row for each region: node (its number in the graph, scale by scale), its statistics, shape, place and texture."""
    key = ("view_key", "scale", "label")
    scaled = raster.gradient(raster.sized(labelled), "q", spacing)  # volumes are scaled to 0..1 already
    rows = raster.regions(scaled)
    stats = rows.groupBy(*key).agg(*raster.distribution("q"), F.avg("gradient").alias("grad_mean"), F.stddev_pop("gradient").alias("grad_std"), F.max("gradient").alias("grad_max"), F.percentile("gradient", F.lit(0.9)).alias("grad_p90"))
    shape = raster.shape(rows, key)
    place = raster.location(rows, key, spacing)
    texture = raster.glcm(scaled, shape, key, "q")
    whole = stats.join(shape, list(key)).join(place, list(key)).join(texture, list(key))
    sizes = scale_sizes(whole)
    offset = F.when(F.col("scale") == 0, 0).when(F.col("scale") == 1, F.col("k_fine")).otherwise(F.col("k_fine") + F.col("k_med"))
    return whole.join(sizes, "view_key").withColumn("node", F.col("label") + offset).withColumn("scale_code", F.col("scale").cast("double"))


def scale_sizes(regions: DataFrame) -> DataFrame:
    """k_fine, k_med and k_coarse: how many regions each view has at each scale (labels are dense)."""
    return regions.groupBy("view_key").agg(*[F.count_if(F.col("scale") == i).alias(f"k_{n}") for i, n in enumerate(("fine", "med", "coarse"))])


FEATURES = (
    "mean", "std", "min", "max", "median", "iqr", "skewness", "kurtosis", "grad_mean", "grad_std", "grad_max", "grad_p90", "n_voxels", "compactness",
    "elongation", "dist_mm", "norm_z", "norm_y", "norm_x", "contrast", "homogeneity", "energy", "correlation", "scale_code",
)


def built(labelled: DataFrame, config: dict[str, Any] = DEFAULTS, given: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges with attributes, verdicts) of the graphs of labelled voxels (dense labels at three scales).

    given: view_key, scale, label, vector: vectors of regions, made elsewhere, which are projected and stand beside their features."""
    spacing = tuple(config["spacing_mm"])
    n = written(nodes(labelled, spacing), "graph-nodes")
    vectors = n.withColumn("_raw", F.array(*[F.col(c).cast("double") for c in FEATURES]))
    if given is not None:
        vectors = embeddings.beside(vectors, given, config["embed"]["dims"])
    vectors = edges.zscored_vectors(vectors, "_raw", ("view_key", "scale"), "node", "features")
    vectors = written(edges.zscored_vectors(vectors, "_raw", KEYS, "node", "across"), "graph-vectors")
    unit = edges.unit_zscored(vectors.select("view_key", "scale", "node", "_raw"), "_raw", ("view_key", "scale"), "node")
    parts: list[tuple[DataFrame, int]] = []
    offsets = n.groupBy("view_key").agg(F.max("k_fine").alias("k_fine"), F.max("k_med").alias("k_med"), F.max("k_coarse").alias("k_coarse"))
    starts = (F.lit(0), F.col("k_fine"), F.col("k_fine") + F.col("k_med"))
    for name, start in zip(raster.SCALES, starts, strict=True):
        found = raster.contacts(labelled, name).join(offsets, "view_key")
        parts.append((found.select("view_key", (F.col("src") + start).alias("src"), (F.col("dst") + start).alias("dst"), "contact"), edges.RAG))
    for i, k in enumerate((config["knn"]["k_fine"], config["knn"]["k_med"], config["knn"]["k_coarse"])):
        parts.append((edges.knn(unit.where(f"scale = {i}"), k, "node", "unit", KEYS), edges.KNN))
    for i in (0, 1):
        of = raster.parents(labelled, raster.SCALES[i], raster.SCALES[i + 1]).join(offsets, "view_key")
        parts.append((edges.hierarchy(of, starts[i], starts[i + 1], KEYS), edges.HIERARCHY))
    e = written(edges.assembled(parts, KEYS), "graph-edges")
    placed = vectors.select("view_key", "node", (F.col("cx") * spacing[2]).alias("px"), (F.col("cy") * spacing[1]).alias("py"), (F.col("cz") * spacing[0]).alias("pz"), "n_voxels", "features", "across")
    attributes = edges.attributes(e, placed, KEYS)
    structure = e.where(f"edge_type <> {edges.KNN}")
    labels = F.coalesce(*raster.SCALES)
    covered = labelled.groupBy("view_key").agg((F.count_if(labels.isNotNull()) / F.count("*")).alias("tissue_coverage"))
    sizes = vectors.groupBy("view_key").agg(*[F.count_if(F.col("scale") == i).alias(f"K_{c}") for i, c in enumerate(("fine", "med", "coarse"))], F.count("*").alias("K_total"), F.max(F.size("_raw")).alias("features_per_node"))
    sizes = sizes.withColumn("used_embed", F.lit(int(given is not None))).join(e.groupBy("view_key").agg(F.count("*").alias("E_edges")), "view_key", "left").fillna(0, ["E_edges"])
    verdict = quality.metrics(n.select("view_key", "node"), structure, KEYS).join(quality.audit(e, offsets, KEYS), "view_key").join(covered, "view_key").join(sizes, "view_key")
    limits = config["qc"]
    reason = quality.gate(limits["min_tissue_coverage"], limits["min_lcc_frac"], limits["min_avg_degree"])
    return n, attributes, verdict.withColumn("reason", reason).withColumn("status", F.when(F.col("reason") == "", "ok").otherwise(F.concat(F.lit("reject:"), F.col("reason"))))


def variants(views: DataFrame, config: dict[str, Any] = DEFAULTS) -> DataFrame:
    """A row for each variant of each view: clean 0, then augmix, diffusion and adversarial from 1 on."""
    kinds = [("clean", 0), *((k, i) for k in ("augmix", "diffusion", "adversarial") for i in range(1, config[k]["n_per_view"] + 1))]
    return views.select("*", F.inline(F.array(*[F.struct(F.lit(k).alias("aug_kind"), F.lit(i).alias("aug_idx")) for k, i in kinds])))
