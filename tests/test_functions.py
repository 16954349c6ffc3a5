from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.functions import labels as L
from lamina.functions.arrays import half


def one(spark, column, **cells):
    df = spark.createDataFrame([tuple(cells.values())], ", ".join(f"{k} string" for k in cells))
    return df.select(column.alias("v")).first().v


@pytest.mark.parametrize(("text", "name"), [(" patient / view ", "patient_view"), ("...", "..."), ("  ", "series"), (None, "series"), ("é ñ\t1", "é_ñ_1")])
def test_sanitised_names(spark, text, name):
    assert one(spark, L.sanitize_name(F.col("a")), a=text) == name


@pytest.mark.parametrize(("cell", "flag"), [(None, 0), ("", 0), ("nan", 0), ("0", 0), ("1", 1), ("2", 1), ("0.5", 1), ("-1", 0)])
def test_binary_flags(spark, cell, flag):
    assert one(spark, L.binary_flag(F.col("a")), a=cell) == flag


def test_label_modes(spark):
    cells = {"c": "0", "b": "1", "a": "0"}
    assert one(spark, L.binary_label("cancer", F.col("c"), F.col("b"), F.col("a")), **cells) == 0
    assert one(spark, L.binary_label("abnormal", F.col("c"), F.col("b"), F.col("a")), **cells) == 1
    with pytest.raises(ValueError, match="unknown label mode"):
        L.binary_label("other", F.col("c"))


TRUTH = [  # class, normal, benign, cancer, mask, fallback -> class, problem
    ("2", None, None, None, None, None, 2, ""), ("3", None, None, None, None, None, None, "bad_class"), (None, None, "1", "1", None, "0", None, "benign_and_cancer"),
    (None, "1", "1", None, "m", "0", 2, ""), (None, "1", "1", None, " ", "0", 0, ""), (None, "1", None, "1", None, "1", 0, ""), (None, None, None, "1", None, "1", 1, ""),
    (None, "0", "1", None, None, "0", 2, ""), (None, "0", None, None, None, "0", 1, ""), ("2", None, None, "0", None, "0", None, "conflict"), (None, None, "0", None, None, "1.9", 1, ""),
    (None, None, None, None, None, None, None, "no_label"), (None, "2", None, None, None, "0", None, "bad_flag"), ("1", "0", None, None, None, "0", 1, ""),
]


@pytest.mark.parametrize("row", TRUTH)
def test_class_labels(spark, row):
    cells = dict(zip("gnbcmf", row[:6], strict=True))
    columns = [F.col(c) for c in "gnbcmf"]
    assert (one(spark, L.class_label(*columns), **cells), one(spark, L.label_problem(*columns), **cells)) == row[6:]


def test_half_precision(spark):
    values = [0.1, 1e9, -1e9, float("inf"), float("nan"), 65_504.0, 3.14159]
    got = [r.v for r in spark.createDataFrame([(v,) for v in values], "x double").select(half("x").alias("v")).collect()]
    want = np.clip(np.nan_to_num(values, nan=0.0, posinf=65_500, neginf=-65_500), -65_500, 65_500).astype(np.float16).astype(np.float32)
    assert got == want.tolist()
