"""Conversion of studies: labels and paths become a plan of work with a status for each view, and counters of it.

Pixels come from a decoder, a function from the bytes of a source to an array; one for TIFF is at hand. DICOM needs a decoder that
isn't part of this package: without one its files are conversion errors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import binary_label, volume_path
from ..sources.metadata import DICOM_ENDINGS, LABEL_COLUMNS, candidates, found_sources, with_paths
from ..sources.tiff import decode, stacked, write_atomic

FAILURE = ("split", "PatientID", "StudyUID", "View", "reason")


def planned(views: DataFrame, paths: DataFrame, mode: str = "cancer") -> DataFrame:
    """views (split, PatientID, StudyUID, View and flags) with label, path, target and reason."""
    flags = {c: F.col(c) if c in views.columns else None for c in ("Cancer", "Benign", "Actionable")}
    if flags["Cancer"] is None and (mode == "cancer" or not any(c is not None for c in flags.values())):
        raise ValueError("labels must contain Cancer" + (", Benign, or Actionable" if mode != "cancer" else ""))
    cancer = flags["Cancer"] if flags["Cancer"] is not None else F.lit("0")
    labelled = views.withColumn("label", binary_label(mode, cancer, flags["Benign"], flags["Actionable"]))
    return with_paths(labelled, paths).withColumn("target", volume_path(F.col("PatientID"), F.col("StudyUID"), F.col("View"), F.col("label")))


def resolved(plan: DataFrame, root: str, files: DataFrame, endings: tuple[str, ...] = DICOM_ENDINGS) -> DataFrame:
    """plan with sources (the files of each view, in the order of their names), and reason dicom_not_found where no place has any.
    files: path, and series where files of one folder belong to several ones."""
    key = ("split", *LABEL_COLUMNS)
    places = plan.where("reason = ''").withColumn("_places", candidates(root, F.col("PatientID"), F.col("path"))).dropDuplicates(list(key))
    joined = plan.join(found_sources(places, "_places", files, key, endings), list(key), "left")
    return joined.withColumn("reason", F.when((F.col("reason") == "") & F.col("sources").isNull(), "dicom_not_found").otherwise(F.col("reason")))


def written_volumes(plan: DataFrame, contents: DataFrame, folder: str, decoder: Callable[[bytes], np.ndarray] = decode, compression: str = "zlib") -> DataFrame:
    """split, the view's key and reason of each planned view with sources, after its volume was written to the shared folder.
    contents: path, content, modificationTime. The slices of a series are stacked in the order of its files; a task holds one view."""
    names = [*FAILURE[:4], "reason"]
    key = [*FAILURE[:4], "target"]
    each = plan.where("reason = ''").select(*key, F.posexplode("sources").alias("at", "source"))
    work = each.join(contents.select(F.col("path").alias("source"), "content", F.col("modificationTime").cast("double").alias("modified")), "source")

    def run(group: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        try:
            parts = [decoder(x.as_py()) for x in table.column("content")]
            write_atomic(f"{folder}/{group[4].as_py()}", parts[0] if len(parts) == 1 else stacked(parts), compression, max(table.column("modified").to_pylist()))
            reason = ""
        except Exception as e:  # one bad source must not end the others
            reason = f"conversion_error:{type(e).__name__}:{e}"
        return pa.table({n: pa.array([v], pa.string()) for n, v in zip(names, [*(x.as_py() for x in group[:4]), reason], strict=True)})

    return work.groupBy(*key).applyInArrow(run, ", ".join(f"{n} string" for n in names))


def counters(rows: DataFrame, status: str = "status", split: str = "split") -> DataFrame:
    """requested, written, skipped and failed views of each split."""
    counts = [F.count_if(F.col(status) == s).alias(s) for s in ("written", "skipped", "failed")]
    return rows.groupBy(split).agg(F.count("*").alias("requested"), *counts)
