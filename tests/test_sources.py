from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.plans import conversion as C
from lamina.sources import config, metadata as M, tiff


@pytest.mark.parametrize("kind", ["u1", "u2", "i2", "f4"])
@pytest.mark.parametrize("compression", ["zlib", "none"])
def test_volumes_round_trip(kind, compression):
    vol = np.arange(24).reshape(2, 3, 4).astype(kind)
    back = tiff.decode(tiff.encode(vol, compression))
    assert (back == vol).all() and back.dtype == vol.dtype


def test_volumes_have_two_or_three_dimensions():
    with pytest.raises(ValueError, match="dimensions"):
        tiff.encode(np.zeros((2, 2, 2, 2)))


def test_orientation_and_scale():
    assert tiff.oriented(np.zeros((5, 6))).shape == (1, 5, 6)
    assert tiff.oriented(np.zeros((5, 6, 3))).shape == (1, 5, 6)
    assert tiff.oriented(np.zeros((9, 2, 7))).shape == (2, 9, 7)
    assert tiff.scaled(np.full((1, 2, 2), 7.0)).max() == 0
    assert tiff.scaled(np.array([[[1.0, 3.0]]])).tolist() == [[[0.0, 1.0]]]


def test_unreadable_files_become_rows_with_a_reason(spark, tmp_path):
    tiff.write_atomic(str(tmp_path / "good.tif"), np.arange(30).reshape(2, 3, 5).astype("u2"), modified=1_000_000.0)
    (tmp_path / "bad.tif").write_bytes(b"no")
    assert os.path.getmtime(tmp_path / "good.tif") == 1_000_000.0
    rows = tiff.slices_of(spark.read.format("binaryFile").load(str(tmp_path))).collect()
    assert sorted((r.z, r.reason[:16]) for r in rows if r.reason) == [(None, "conversion_error")]
    assert sorted(r.z for r in rows if not r.reason) == [0, 1]
    tiff.register(spark)
    os.remove(tmp_path / "bad.tif")
    assert spark.read.format("volume").load(str(tmp_path)).count() == 2


def test_csv_keeps_ids_and_paths_take_the_first(spark, tmp_path):
    (tmp_path / "labels.csv").write_text("PatientID,StudyUID,View,Cancer\n001,S1, LCC,1\nNA,S2,RCC,\n,S3,RCC,0\n")
    (tmp_path / "paths.csv").write_text("PatientID,StudyInstanceUID,view,FILE_PATH\n001,S1,lcc,a.tif\n001,S1,LCC,b.tif\nNA,S2,RCC, \n")
    views = M.labels(M.read_csv(spark, str(tmp_path / "labels.csv"))).withColumn("split", F.lit("train"))
    assert [r.PatientID for r in views.collect()] == ["001", "NA", None]
    paths = M.path_map(M.read_csv(spark, str(tmp_path / "paths.csv")), F.monotonically_increasing_id())
    plan = {r.StudyUID: r for r in C.planned(views, paths).collect()}
    assert (plan["S1"].path, plan["S1"].label, plan["S1"].target, plan["S1"].reason) == ("a.tif", 1, "001/001_S1_LCC_lbl1.tif", "")
    assert plan["S2"].reason == plan["S3"].reason == "no_matching_path"


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="must contain StudyUID, View"):
        M.labels(spark.createDataFrame([("1",)], "PatientID string"))
    with pytest.raises(ValueError, match="Cancer"):
        C.planned(spark.createDataFrame([("1", "2", "3")], "PatientID string, StudyUID string, View string"), None)
    with pytest.raises(ValueError, match="one of"):
        M.manifest(spark.createDataFrame([("1", "2", "3")], "PatientID string, View string, Raw_path string"))


def views_of(spark, rows):
    """(views, paths) of (patient, path)."""
    views = spark.createDataFrame([("t", p, "S", "lcc", str(i % 2)) for i, (p, _) in enumerate(rows)], "split string, PatientID string, StudyUID string, View string, Cancer string")
    return views, spark.createDataFrame([(p, "S", "lcc", path) for p, path in rows], "PatientID string, StudyUID string, View string, path string")


def test_sources_are_files_folders_and_the_largest_series(spark, tmp_path):
    folder = M.DATASET_FOLDER
    for name in ("a.dcm", f"{folder}/b.DCM", f"{folder}/P2/c.dcm", f"{folder}/P2/c2.dcm", "d/2.dcm", "d/1.dicom", "d/notes.txt", "d/sub/9.dcm", "e/note.txt", f"{folder}/e/1.dcm", "f.txt", "g/x1", "g/x2", "g/y1"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"-")
    rows = [("P0", "a.dcm"), ("P1", "b.DCM"), ("P2", "c.dcm"), ("P3", f"{tmp_path}/a.dcm"), ("P4", "d"), ("P5", "d/"), ("P6", "e"), ("P7", "f.txt"), ("P8", "none.dcm"), ("P9", f"{tmp_path}/d/sub"), ("P10", "g"), ("P11", f"file:{tmp_path}/a.dcm")]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path)).select("path")
    files = files.withColumn("series", F.when(F.col("path").rlike("/g/[xy][0-9]$"), F.substring_index("path", "/", -1).substr(1, 1)))
    plan = {r.PatientID: r for r in C.resolved(C.planned(*views_of(spark, rows)), f"file:{tmp_path}", files).collect()}
    got = {k: [s.removeprefix(f"file:{tmp_path}/") for s in r.sources or []] for k, r in plan.items()}
    assert got == {
        "P0": ["a.dcm"], "P1": [f"{folder}/b.DCM"], "P2": [f"{folder}/P2/c.dcm"], "P3": ["a.dcm"], "P4": ["d/1.dicom", "d/2.dcm"], "P5": ["d/1.dicom", "d/2.dcm"], "P6": [],
        "P7": [], "P8": [], "P9": ["d/sub/9.dcm"], "P10": ["g/x1", "g/x2"], "P11": ["a.dcm"],
    }
    assert {k for k, r in plan.items() if r.reason == "dicom_not_found"} == {"P6", "P7", "P8"}


def test_conversion_writes_volumes_and_reports_failures(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    tiff.write_atomic(str(source / f"{M.DATASET_FOLDER}/P1/a.tif"), np.arange(24).reshape(2, 3, 4).astype("u2"))
    (source / "P2.tif").write_bytes(b"broken")
    for i in (2, 1):
        tiff.write_atomic(str(source / f"P4/{i}.tif"), np.full((3, 4 + i), i, "u2"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(source))
    planned = C.planned(*views_of(spark, [("P1", "a.tif"), ("P2", "P2.tif"), ("P3", "none.tif"), ("P4", "P4")]))
    plan = C.resolved(planned, f"file:{source}", files, (".tif",))
    assert {r.PatientID: r.reason for r in plan.collect()} == {"P1": "", "P2": "", "P3": "dicom_not_found", "P4": ""}
    done = {r.PatientID: r.reason for r in C.written_volumes(plan, files, str(out)).collect()}
    assert done["P1"] == done["P4"] == "" and done["P2"].startswith("conversion_error:ValueError")
    assert tiff.decode((out / "P1/P1_S_LCC_lbl0.tif").read_bytes()).sum() == 276
    series = tiff.decode((out / "P4/P4_S_LCC_lbl1.tif").read_bytes())
    assert series.shape == (2, 3, 5) and series[:, 0, 0].tolist() == [1, 2]


def test_failures_are_one_file_in_the_order_of_their_first_row(spark, tmp_path):
    rows = spark.createDataFrame([("b", "x", 1), ("a", "y\tz", 2), ("b", "x", 3)], "split string, reason string, i int")
    path = str(tmp_path / "failed_views.tsv")
    for some in (rows, rows.where("false")):
        M.write_failures(M.distinct_failures(some, "i"), path)
        want = ["split\treason", "b\tx", "a\ty z"] if some is rows else ["split\treason"]
        assert open(path).read().splitlines() == want


def test_flags_that_each_mode_needs(spark):
    paths = views_of(spark, [("P", "a")])[1]
    views = spark.createDataFrame([("t", "P", "S", "lcc", "1")], "split string, PatientID string, StudyUID string, View string, Benign string")
    assert [r.label for r in C.planned(views, paths, "abnormal").collect()] == [1]
    for mode, df in (("cancer", views), ("abnormal", views.drop("Benign"))):
        with pytest.raises(ValueError, match="Cancer"):
            C.planned(df, paths, mode)


def test_a_folder_of_images_is_one_volume(spark, tmp_path):
    for i, shape in enumerate(((4, 6), (5, 5))):
        tiff.write_atomic(str(tmp_path / f"v/{i}.tif"), np.full(shape, i, "u1"))
    (tmp_path / "v/2.tif").write_bytes(b"no")
    (tmp_path / "empty").mkdir()
    rows = tiff.slices_at(spark.createDataFrame([(f"file:{tmp_path}/v",), (f"{tmp_path}/v/1.tif",), (f"{tmp_path}/empty",), (f"{tmp_path}/none.tif",)], "path string")).collect()
    assert sorted((r.z, r.h, r.w) for r in rows if r.view_key.endswith("/v")) == [(0, 4, 5), (1, 4, 5)]
    assert sum(not r.reason for r in rows) == 3 and sum(r.reason.startswith("conversion_error") for r in rows) == 2


def test_ledgers_take_new_columns(spark, tmp_path):
    path = str(tmp_path / "ledger")
    M.append_ledger(spark.createDataFrame([(1, "ok")], "i int, status string"), path)
    M.append_ledger(spark.createDataFrame([(2, 0.5)], "i int, seconds double"), path)
    assert sorted(tuple(r) for r in M.read_ledger(spark, path).select("i", "status", "seconds").collect()) == [(1, "ok", None), (2, None, 0.5)]


def test_outdated_outputs(spark):
    rows = spark.createDataFrame([(1, 100), (2, 100), (3, 100)], "k int, s int").select("k", F.timestamp_seconds("s").alias("modified"))
    made = spark.createDataFrame([(1, 99.9995), (2, 99.0)], "k int, s double").select("k", F.timestamp_seconds("s").alias("modified"))
    assert sorted(r.k for r in M.outdated(rows, made, ("k",)).collect()) == [2, 3]


def test_patients_from_a_file_or_a_list(spark, tmp_path):
    (tmp_path / "p.txt").write_text(" 1\n\n2 \n")
    assert sorted(r[0] for r in M.patients(spark, str(tmp_path / "p.txt")).collect()) == ["1", "2"]
    assert sorted(r[0] for r in M.patients(spark, "a, b,,").collect()) == ["a", "b"]
    views = spark.createDataFrame([(" a", 1), ("a", 2), ("c", 3)], "PatientID string, i int")
    assert M.matched(views, M.patients(spark, "a, b")).first().asDict() == {"rows_before": 3, "rows_after": 2, "patients_matched": 1, "patients_requested": 2}


def test_config_overlay(tmp_path):
    (tmp_path / "c.yaml").write_text("slic:\n  compactness: 2.0\n")
    got = config.load(str(tmp_path / "c.yaml"))
    assert got["slic"]["compactness"] == 2.0 and got["slic"]["sigma"] == 0.0 and config.DEFAULTS["slic"]["compactness"] == 1.0
    (tmp_path / "c.yaml").write_text("augmix:\n  n_per_view: 0\ndiffusion: {nlmeans_h: 0.1}\nknn: {batch: 64}\nembed: {enabled: false}\nparallel: {num_gpus: 4}\nout_dir: x\n")
    got = config.load(str(tmp_path / "c.yaml"))
    assert got["augmix"]["n_per_view"] == 0 and got["diffusion"]["nlmeans_h"] == 0.1 and not got["embed"]["enabled"]
    (tmp_path / "c.yaml").write_text("augmix: {n: 0}\nseeds: 3\n")
    with pytest.raises(ValueError, match="augmix.n, seeds"):
        config.load(str(tmp_path / "c.yaml"))
    (tmp_path / "c.yaml").write_text("")
    assert config.load(str(tmp_path / "c.yaml")) == config.DEFAULTS
    (tmp_path / "c.yaml").write_text("- 1\n")
    with pytest.raises(TypeError):
        config.load(str(tmp_path / "c.yaml"))


def test_files_arrive_once(spark, tmp_path):
    from lamina.streaming.incremental import process, watch

    folder, log = tmp_path / "in", str(tmp_path / "log")
    tiff.write_atomic(str(folder / "a.tif"), np.ones((2, 2), "u1"))
    schema = "path string"

    def done():
        return spark.read.schema(schema).parquet(log) if os.path.exists(log) else spark.createDataFrame([], schema)

    for name in ("b", None):
        process(watch(spark, str(folder)), done, lambda df: df.select("path").write.mode("append").parquet(log), str(tmp_path / "cp")).awaitTermination()
        if name:
            tiff.write_atomic(str(folder / f"{name}.tif"), np.ones((2, 2), "u1"))
    assert done().count() == 2
