"""Scalar functions over study metadata: flags, class labels, names and seeds. All are expressions for the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sanitize_name(c: Column, empty: str = "series") -> Column:
    """Strips, turns runs of characters other than letters, digits, _ . and - into _, and names what is then empty."""
    stripped = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.coalesce(F.nullif(F.regexp_replace(stripped, r"(?U)[^\w.-]+", "_"), F.lit("")), F.lit(empty))


def number(c: Column) -> Column:
    """A cell as a double; null if it is blank or NaN. Other text is an error, as a flag must be a number."""
    text = F.trim(c.cast("string"))
    value = F.when(text.isNull() | (text == "") | (F.lower(text) == "nan"), F.lit(None)).otherwise(text)
    return value.cast("double")


def binary_flag(c: Column) -> Column:
    """1 for a number over 0, else 0; a blank is 0."""
    return F.coalesce((number(c) > 0).cast("int"), F.lit(0))


def binary_label(mode: str, cancer: Column, benign: Column | None = None, actionable: Column | None = None) -> Column:
    """cancer: the cancer flag. abnormal: any of the three."""
    if mode == "cancer":
        return binary_flag(cancer)
    if mode == "abnormal":
        rest = [binary_flag(c) for c in (benign, actionable) if c is not None]
        return F.greatest(binary_flag(cancer), *rest) if rest else binary_flag(cancer)
    raise ValueError(f"unknown label mode: {mode}")


def row_flag(c: Column) -> Column:
    """A number cut to a whole one; null if blank. Whether it is 0 or 1 is for label_problem to say."""
    return number(c).cast("int")


def class_label(graph: Column, normal: Column, benign: Column, cancer: Column, mask: Column, fallback: Column) -> Column:
    """The class of a view (0 normal, 1 malignant, 2 benign) from a class column and component flags; null if label_problem."""
    g, n, b, c, f = row_flag(graph), row_flag(normal), row_flag(benign), row_flag(cancer), row_flag(fallback)
    has_mask = F.coalesce(F.trim(mask.cast("string")) != "", F.lit(False))
    resolved = _resolved(g, n, b, c, has_mask, f)
    return F.when(_problem(g, n, b, c, resolved) == "", resolved)


def label_problem(graph: Column, normal: Column, benign: Column, cancer: Column, mask: Column, fallback: Column) -> Column:
    """Why a row has no class: '' if it has one."""
    g, n, b, c, f = row_flag(graph), row_flag(normal), row_flag(benign), row_flag(cancer), row_flag(fallback)
    has_mask = F.coalesce(F.trim(mask.cast("string")) != "", F.lit(False))
    return _problem(g, n, b, c, _resolved(g, n, b, c, has_mask, f))


def _resolved(g: Column, n: Column, b: Column, c: Column, has_mask: Column, f: Column) -> Column:
    return (
        F.when(g.isNotNull() & n.isNull() & b.isNull() & c.isNull(), g)
        .when((n == 1) & (b == 1), F.when(has_mask, 2).otherwise(0))
        .when(n == 1, 0)
        .when(c == 1, 1)
        .when(b == 1, 2)
        .when((n == 0) & b.isNull() & c.isNull(), 1)
        .otherwise(f)
    )


def _problem(g: Column, n: Column, b: Column, c: Column, resolved: Column) -> Column:
    odd = F.lit(False)
    for x in (n, b, c):
        odd = odd | F.coalesce(~x.isin(0, 1), F.lit(False))
    return (
        F.when(F.coalesce(~g.isin(0, 1, 2), F.lit(False)), "bad_class")
        .when(odd, "bad_flag")
        .when((b == 1) & (c == 1), "benign_and_cancer")
        .when(resolved.isNull(), "no_label")
        .when(F.coalesce(g != resolved, F.lit(False)), "conflict")
        .otherwise("")
    )


def graph_name(patient: Column, view: Column, label: Column, kind: Column, idx: Column) -> Column:
    """patient__view__lblL__kindI"""
    return F.concat(F.trim(patient), F.lit("__"), F.trim(view), F.lit("__lbl"), label.cast("string"), F.lit("__"), kind, idx.cast("string"))


def volume_path(patient: Column, study: Column, view: Column, label: Column) -> Column:
    """P/P_S_VIEW_lblL.tif with sanitised parts."""
    p, s, v = sanitize_name(patient), sanitize_name(study), F.upper(sanitize_name(view))
    return F.concat(p, F.lit("/"), p, F.lit("_"), s, F.lit("_"), v, F.lit("_lbl"), label.cast("string"), F.lit(".tif"))


def output_seed(seed: int, patient: Column, view: Column, kind: Column, idx: Column) -> Column:
    """The first 32 bits of the MD5 of seed|patient|view|kind|idx."""
    text = F.concat_ws("|", F.lit(str(seed)), patient, view, kind, idx.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def half_clip(c: Column, limit: float = 65_500.0) -> Column:
    """What a half-precision store can hold: NaN is 0, infinities and beyond are the limit. (Rounding: functions.arrays.half.)"""
    x = c.cast("double")
    return F.when(x.isNull() | F.isnan(x), 0.0).otherwise(F.greatest(F.lit(-limit), F.least(F.lit(limit), x)))
