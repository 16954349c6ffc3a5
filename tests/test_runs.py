from __future__ import annotations

import os

import numpy as np
import pytest

from lamina import cli
from lamina.plans import run
from lamina.sources import config as C
from lamina.sources import metadata as M
from lamina.sources import tiff


def breast(seed: int) -> np.ndarray:
    rng = np.random.RandomState(seed)
    vol = np.zeros((5, 30, 32), np.uint16)
    vol[:, 4:26, 5:27] = 20_000 + rng.randint(0, 20_000, (5, 22, 22))
    return vol


@pytest.fixture
def small() -> dict:
    over = {"spacing_mm": [1.0, 1.0, 1.0], "least_tissue": 20, "clahe_clip": 0.1, "slic": {"lin_scales_mm": [3.0, 5.0, 9.0], "K_min": [4, 3, 2], "K_max": [200, 60, 20]}, "knn": {"k_fine": 3, "k_med": 2}, "augmix": {"n_per_view": 1}, "diffusion": {"n_per_view": 1, "denoiser": "none"}}
    return C.overlaid(C.DEFAULTS, over)


def test_a_manifest_becomes_graphs_once(spark, tmp_path, small):
    for i in range(2):
        tiff.write_atomic(str(tmp_path / f"v/{i}.tif"), breast(i))
    (tmp_path / "v/bad.tif").write_bytes(b"no")
    rows = [("P0", "LCC", f"{tmp_path}/v/0.tif", "1"), ("P1", "LCC", f"{tmp_path}/v/1.tif", "0"), ("P2", "LCC", f"{tmp_path}/v/bad.tif", "0"), ("P3", "LCC", f"{tmp_path}/v/0.tif", "7"), ("P4", "LCC", f"{tmp_path}/v/0.tif", "1")]
    manifest = spark.createDataFrame(rows, "PatientID string, View string, Raw_path string, GraphLabel string")
    wanted = spark.createDataFrame([("P0",), ("P1",), ("P2",), ("P3",)], "PatientID string")
    out = str(tmp_path / "out")
    ledger = {r.view_key: r.status for r in run.build(spark, manifest, out, small, wanted).collect()}
    clean = {f"P{i}__LCC__lbl{1 - i}__{k}" for i in range(2) for k in ("clean0", "augmix1", "diffusion1")}
    assert {k for k, s in ledger.items() if s == "ok"} == clean
    assert ledger["P3__LCC"] == "reject:bad_class" and ledger["P2__LCC__lbl0__clean0"].startswith("conversion_error")
    assert not any(k.startswith("P4") for k in ledger)
    nodes, edges = (spark.read.parquet(f"{out}/{t}") for t in ("nodes", "edges"))
    assert {r.view_key for r in nodes.select("view_key").distinct().collect()} == clean
    assert edges.join(nodes.select("view_key", nodes.node.alias("src")), ["view_key", "src"], "left_anti").isEmpty()
    assert {r.variant for r in spark.read.parquet(f"{out}/adversarial").select("variant").distinct().collect()} == {f"P{i}__LCC__lbl{1 - i}__adversarial1" for i in range(2)}
    summary = {r.view_key: r for r in spark.read.parquet(f"{out}/ledger").where("status = 'ok'").collect()}
    one = summary["P0__LCC__lbl1__clean0"]
    assert one.K_total == one.K_fine + one.K_med + one.K_coarse == nodes.where("view_key = 'P0__LCC__lbl1__clean0'").count() and one.used_embed == 0
    assert one.E_edges == edges.where("view_key = 'P0__LCC__lbl1__clean0'").count() and one.features_per_node == 24
    assert min(one.t_load, one.t_segment, one.t_graph, one.t_save) >= 0
    pushed, plain = spark.read.parquet(f"{out}/adversarial_edges"), edges.where("view_key LIKE '%clean0'")
    assert pushed.count() == plain.count() and pushed.join(plain.withColumnRenamed("fdist", "before"), ["view_key", "src", "dst", "edge_type"]).where("abs(fdist - before) > 1e-6").count() > 0
    n = nodes.count()
    again = run.build(spark, manifest, out, small, wanted)
    assert again.where("status = 'skip_exists'").count() == len(clean) and spark.read.parquet(f"{out}/nodes").count() == n


def test_conversion_runs_once(spark, tmp_path):
    tiff.write_atomic(str(tmp_path / "in/a.tif"), breast(0))
    (tmp_path / "labels.csv").write_text("PatientID,StudyUID,View,Cancer\nP1,S1,LCC,1\nP2,S1,LCC,0\n")
    (tmp_path / "paths.csv").write_text("PatientID,StudyUID,View,path\nP1,S1,LCC,a.tif\n")
    splits = [("train", str(tmp_path / "labels.csv"), str(tmp_path / "paths.csv"), str(tmp_path / "in"))]
    counts, failures = run.convert(spark, splits, str(tmp_path / "out"))
    assert tuple(counts.first())[1:] == (2, 1, 0, 1)
    assert [(r.PatientID, r.reason) for r in failures.collect()] == [("P2", "no_matching_path")]
    assert (tiff.decode((tmp_path / "out/P1/P1_S1_LCC_lbl1.tif").read_bytes()) == breast(0)).all()
    counts, _ = run.convert(spark, splits, str(tmp_path / "out"))
    assert tuple(counts.first())[1:] == (2, 0, 1, 1)
    with pytest.raises(ValueError, match="must differ"):
        run.convert(spark, [(name, *splits[0][1:]) for name in ("tr ain", "tr_ain")], str(tmp_path / "out"))
    os.utime(tmp_path / "out/P1/P1_S1_LCC_lbl1.tif", (1, 1))
    for smart, n in ((False, 0), (True, 1)):
        counts, _ = run.convert(spark, [("tr ain", *splits[0][1:])], str(tmp_path / "out"), smart_update=smart)
        assert (counts.first()["split"], counts.first().written) == ("tr_ain", n)


def test_given_vectors_stand_beside_features(spark, tmp_path, small):
    tiff.write_atomic(str(tmp_path / "0.tif"), breast(0))
    manifest = spark.createDataFrame([("P0", "LCC", f"{tmp_path}/0.tif", "1")], "PatientID string, View string, Raw_path string, GraphLabel string")
    for kind in ("augmix", "diffusion", "adversarial"):
        small[kind]["n_per_view"] = 0
    small["embed"]["dims"] = 3
    vectors = spark.createDataFrame([("P0__LCC__lbl1__clean0", 0, i, [float(i), 1.0, 2.0, 0.5]) for i in range(5)], "view_key string, scale int, label long, vector array<double>")
    for enabled, n in ((True, 27), (False, 24)):
        small["embed"]["enabled"] = enabled
        row = run.build(spark, manifest, str(tmp_path / f"out{n}"), small, vectors=vectors).first()
        assert (row.status, row.features_per_node, row.used_embed) == ("ok", n, int(enabled))


def test_commands(spark, tmp_path, capsys):
    for argv, code in ((["--help"], 0), (["--version"], 0), (["nothing"], 2)):
        with pytest.raises(SystemExit) as e:
            cli.main(argv)
        assert e.value.code == code
    assert M.pick_column(["a", "A"], ("a",)) == "A"
