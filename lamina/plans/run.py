"""Whole runs: study files to volumes, and a manifest of volumes to graphs, with tables of what happened."""

from __future__ import annotations

import json
import re
import time
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import class_label, graph_name, label_problem, output_seed
from ..operators import edges, kernels
from ..operators.raster import SCALES
from ..sources import metadata as M
from ..sources.config import DEFAULTS
from ..sources.tiff import slices_at
from ..store import written
from . import conversion, graphs

LABELLED = "view_key string, z int, y int, x int, nz int, ny int, nx int, q double, lab_fine long, lab_med long, lab_coarse long"
#: Endings of sources that the decoder at hand reads, and of those that need one.
ENDINGS = (*M.DICOM_ENDINGS, ".tif", ".tiff")
#: Features that an adversary leaves alone.
PROTECTED = ("n_voxels", "compactness", "elongation", "dist_mm", "norm_z", "norm_y", "norm_x", "scale_code")


def convert(spark: SparkSession, splits: list[tuple[str, str, str, str]], folder: str, mode: str = "cancer", compression: str = "zlib", overwrite: bool = False, smart_update: bool = True, endings: tuple[str, ...] = ENDINGS) -> tuple[DataFrame, DataFrame]:
    """Writes the volumes of all splits (name, labels CSV, paths CSV, root); (counters of each split, failures in the order of the views).

    A volume that is there already is skipped, with smart_update only if it is no older than its sources."""
    names = [_sanitised(s[0]) for s in splits]
    if len(set(names)) < len(splits):
        raise ValueError("names of splits must differ")
    plans, contents = [], []
    for name, (_, labels, paths, root) in zip(names, splits, strict=True):
        views = M.labels(M.read_csv(spark, labels)).withColumn("split", F.lit(name))
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        of = M.path_map(M.read_csv(spark, paths), F.monotonically_increasing_id())
        base = root if ":" in root else f"file:{root.rstrip('/')}"
        views = views.withColumn("_order", F.monotonically_increasing_id())
        plans.append(conversion.resolved(conversion.planned(views, of, mode), base, files.select("path"), endings).select(*conversion.FAILURE, "sources", "target", F.struct(F.lit(len(plans)), "_order").alias("_order")))
        contents.append(files)
    plan, files = M.union_ledgers(*plans), M.union_ledgers(*contents)
    if not overwrite:
        key = ("target",)
        made = _listing(spark, folder).select(F.col("path").alias("_at"), F.col("modificationTime").alias("modified"))
        ready = plan.where("reason = ''").select("target", F.explode("sources").alias("path"))
        sources = ready.join(files.select("path", F.col("modificationTime").alias("modified")), "path").select("target", "modified")
        at = F.concat(F.lit(folder.rstrip("/") if ":" in folder else f"file:{folder.rstrip('/')}"), F.lit("/"), "target")
        outputs = plan.select("target").distinct().join(made, at == F.col("_at")).select("target", "modified")
        fresh = outputs.select("target") if not smart_update else outputs.select("target").join(M.outdated(sources, outputs, key), list(key), "left_anti")
        plan = plan.join(fresh.distinct().withColumn("_fresh", F.lit(True)), list(key), "left")
        plan = plan.withColumn("reason", F.when((F.col("reason") == "") & F.col("_fresh"), "skip").otherwise(F.col("reason"))).drop("_fresh")
    plan = written(plan, "plan")
    done = written(conversion.written_volumes(plan, files, folder, compression=compression), "done")
    order = plan.groupBy(*conversion.FAILURE[:4]).agg(F.min("_order").alias("_order"))
    rest = plan.where("reason <> ''").select(*conversion.FAILURE, "_order").unionByName(done.join(order, list(conversion.FAILURE[:4])))
    status = F.when(F.col("reason") == "", "written").when(F.col("reason") == "skip", "skipped").otherwise("failed")
    failed = rest.where("reason NOT IN ('', 'skip')")
    return conversion.counters(rest.withColumn("status", status)), M.distinct_failures(failed, "_order")


def _sanitised(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9_.-]+", "_", name.strip()) or "split"


def _listing(spark: SparkSession, folder: str) -> DataFrame:
    try:
        return M.listing(spark, folder, "*.tif")
    except AnalysisException:  # nothing has been written yet
        return spark.createDataFrame([], "path string, modificationTime timestamp, length long")


def resolved_views(manifest: DataFrame, config: dict[str, Any] = DEFAULTS) -> DataFrame:
    """The rows of a manifest with label and problem ('' for those that have a label)."""
    m = M.manifest(manifest)
    fallback = F.col(config["label_col"]) if config["label_col"] in m.columns else F.lit("0")
    cells = [F.col(c) for c in ("GraphLabel", "Normal", "Benign", "Cancer", "Mask_path")]
    return m.withColumn("label", class_label(*cells, fallback)).withColumn("problem", label_problem(*cells, fallback))


def planned_variants(views: DataFrame, config: dict[str, Any] = DEFAULTS) -> DataFrame:
    """A row for each graph to build: its name, the kind of variant and the seed of its noise."""
    rows = graphs.variants(views.where("problem = ''"), config)
    cells: list[Column] = [F.trim("PatientID"), F.trim("View")]
    named = graph_name(*cells, F.col("label"), F.col("aug_kind"), F.col("aug_idx"))
    return rows.withColumn("name", named).withColumn("seed", output_seed(config["seed"], *cells, F.col("aug_kind"), F.col("aug_idx")))


def labelled_voxels(slices: DataFrame, plan: DataFrame, config: dict[str, Any] = DEFAULTS) -> DataFrame:
    """Tissue voxels of each graph, with supervoxels at three scales. A task holds the volume of one graph, and no more.

    slices: view_key (the path of the volume), z, h, w, px; plan: path, name, aug_kind, seed."""
    slic, spacing = config["slic"], tuple(config["spacing_mm"])
    work = slices.join(plan.select(F.col("path").alias("view_key"), "name", "aug_kind", "seed"), "view_key").select("name", "aug_kind", "seed", "z", "h", "w", "px")

    def targets(n: int) -> list[int]:
        mm3 = n * spacing[0] * spacing[1] * spacing[2]
        raw = [min(max(round(mm3 / size**3), lo), hi) for size, lo, hi in zip(slic["lin_scales_mm"], slic["K_min"], slic["K_max"], strict=True)]
        over = slic["K_cap_total"] / sum(raw)
        return raw if over >= 1 else [max(1000, round(k * over)) for k in raw]

    def run(key: tuple, table: pa.Table) -> pa.Table:
        name, kind, seed = (table.column(c)[0].as_py() for c in ("name", "aug_kind", "seed"))
        vol = kernels.volume(table)
        vol = np.stack([kernels.clahe((s * 255).astype(np.uint8), max(0.001, config["clahe_clip"]) * 40.0) / 255.0 for s in vol])
        mask = kernels.tissue(vol, config.get("least_tissue", 1000))
        vol = vol * mask
        if kind == "augmix":
            c = config["augmix"]
            vol = kernels.augmix(vol, seed, c["severity"], c["width"], c["depth"], c["alpha"], c["m"]) * mask
        elif kind == "diffusion":
            c = config["diffusion"]
            vol = kernels.diffusion(vol, seed, c["sigma"], c["denoiser"], c["nlmeans_h"]) * mask
        at = np.argwhere(mask)
        smooth = kernels.blurred(vol, slic["sigma"])
        labels = [kernels.slic(smooth, mask, k, slic["compactness"], spacing)[mask] for k in targets(len(at))]
        cells = {"view_key": pa.array([name] * len(at), pa.string())}
        cells |= {a: pa.array(at[:, i].astype(np.int32)) for i, a in enumerate("zyx")}
        cells |= {f"n{a}": pa.array([n] * len(at), pa.int32()) for a, n in zip("zyx", vol.shape, strict=True)}
        cells["q"] = pa.array(vol[mask].astype(np.float64))
        cells |= {n: pa.array(v, pa.int64(), mask=v < 0) for n, v in zip(SCALES, labels, strict=True)}
        return pa.table(cells)

    return work.groupBy("name").applyInArrow(run, LABELLED)


def build(spark: SparkSession, manifest: DataFrame, out: str, config: dict[str, Any] = DEFAULTS, wanted: DataFrame | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """Builds the graphs of a manifest: nodes, edges, voxels and graphs are Parquet tables under out, and what happened is added to
    its ledger, which is returned. Graphs that are there already are skipped; rejected ones leave only a row in the ledger. vectors (view_key,
    scale, label, vector) are given to the nodes of graphs, unless the configuration turns them off."""
    vectors = vectors if config["embed"]["enabled"] else None
    views = M.of_patients(manifest, wanted) if wanted is not None else manifest
    rows = written(resolved_views(views, config), "views")
    plan = planned_variants(rows, config).withColumn("path", F.when(F.col("Raw_path").contains(":"), F.col("Raw_path")).otherwise(F.concat(F.lit("file:"), "Raw_path")))
    try:
        have = spark.read.parquet(f"{out}/graphs").select(F.col("view_key").alias("name")).distinct()
        skipped = plan.join(have, "name", "left_semi")
        plan = plan.join(have, "name", "left_anti")
    except AnalysisException:  # the first run
        skipped = plan.where("false")
    plan = written(plan, "plan")
    ledger = rows.where("problem <> ''").select(F.concat_ws("__", "PatientID", "View").alias("view_key"), F.concat(F.lit("reject:"), "problem").alias("status"))
    ledger = ledger.unionByName(skipped.select(F.col("name").alias("view_key"), F.lit("skip_exists").alias("status")))
    if not plan.isEmpty():
        clock = [time.monotonic()]
        slices = written(slices_at(plan.select("path").distinct().repartition(F.xxhash64("path"))), "slices")
        clock.append(time.monotonic())
        bad = slices.where("reason <> ''").select(F.col("view_key").alias("path"), "reason").join(plan, "path").select(F.col("name").alias("view_key"), F.col("reason").alias("status"))
        base = plan.where("aug_kind <> 'adversarial'")
        voxels = written(labelled_voxels(slices.where("reason = ''"), base, config), "voxels")
        clock.append(time.monotonic())
        nodes, attributes, verdict = graphs.built(voxels, config, vectors)
        verdict = written(verdict, "verdicts")
        clock.append(time.monotonic())
        ok = verdict.where("status = 'ok'")
        keep = ok.select("view_key")
        attributes = attributes.join(keep, "view_key", "left_semi")
        nodes = nodes.join(keep, "view_key", "left_semi")
        turned, pushed = _adversaries(plan, nodes, attributes, config)
        nodes.write.mode("append").parquet(f"{out}/nodes")
        attributes.write.mode("append").parquet(f"{out}/edges")
        voxels.join(keep, "view_key", "left_semi").write.mode("append").parquet(f"{out}/voxels")
        if turned is not None:
            turned.write.mode("append").parquet(f"{out}/adversarial")
            pushed.write.mode("append").parquet(f"{out}/adversarial_edges")
        about = plan.select(F.col("name").alias("view_key"), "PatientID", "View", "label", "aug_kind", "aug_idx", "seed", F.lit(json.dumps(config)).alias("config"))
        ok.join(about, "view_key").write.mode("append").parquet(f"{out}/graphs")
        clock.append(time.monotonic())
        took = {f"t_{what}": F.lit(round(b - a, 3)) for what, a, b in zip(("load", "segment", "graph", "save"), clock, clock[1:], strict=False)}
        ledger = M.union_ledgers(ledger, bad, verdict.withColumns(took))  # seconds of the whole job's steps
    M.append_ledger(written(ledger, "ledger"), f"{out}/ledger")
    return M.read_ledger(spark, f"{out}/ledger")


def _adversaries(plan: DataFrame, nodes: DataFrame, attributes: DataFrame, config: dict[str, Any]) -> tuple[DataFrame | None, DataFrame | None]:
    """Features and edges of the adversarial variants, from those of the clean graphs: topology and verdict are the clean graph's, the
    distances of features are taken anew."""
    c = config["adversarial"]
    if not c["n_per_view"]:
        return None, None
    clean = plan.where("aug_kind = 'clean'").select(F.col("name").alias("view_key"), "PatientID", "View")
    names = [n for n in graphs.FEATURES if n not in PROTECTED]
    own, linked = (df.join(clean, "view_key", "left_semi") for df in (nodes, attributes))
    pushed = edges.adversarial(own.select("view_key", "node", *names), linked.select("view_key", "src", "dst"), names, c["eps"], c["steps"], c["norm"], ("view_key",))
    pushed = written(pushed, "pushed")
    whole = pushed.join(own.select("view_key", "node", *[n for n in graphs.FEATURES if n in PROTECTED]), ["view_key", "node"])
    features = F.array(*[F.col(n).cast("double") for n in graphs.FEATURES]).alias("features")
    anew = edges.refreshed(linked, whole.select("view_key", "node", features), ("view_key",))
    variants = plan.where("aug_kind = 'adversarial'").select(F.col("name").alias("variant"), "PatientID", "View")
    return tuple(df.join(clean, "view_key").join(variants, ["PatientID", "View"]).drop("PatientID", "View") for df in (pushed, anew))
