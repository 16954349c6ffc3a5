"""Configuration: defaults, with a YAML file laid over them."""

from __future__ import annotations

import copy
from typing import Any

#: Settings that a run has unless its file says otherwise, by their documented names. Those of knn.batch, embed
#: and parallel are taken and change nothing: Spark deals the work, and vectors of nodes are given, not made.
DEFAULTS: dict[str, Any] = {
    "seed": 123,
    "label_col": "Cancer",
    "spacing_mm": [1.0, 0.10, 0.10],
    "clahe_clip": 0.01,
    "slic": {
        "lin_scales_mm": [2.0, 3.5, 7.0],
        "K_min": [16000, 8000, 2000],
        "K_max": [64000, 32000, 8000],
        "K_cap_total": 100000,
        "compactness": 1.0,
        "sigma": 0.0,
    },
    "knn": {"k_fine": 6, "k_med": 3, "k_coarse": 0, "batch": 4096},
    "embed": {"enabled": True, "dims": 128, "max_side": 768, "n_slices": 3, "weights_path": None, "amp": True},
    "qc": {"min_tissue_coverage": 0.95, "min_lcc_frac": 0.85, "min_avg_degree": 2.0},
    "parallel": {"enabled": False, "num_gpus": 1},
    "augmix": {"n_per_view": 2, "severity": 3, "width": 3, "depth": -1, "alpha": 1.0, "m": 0.2},
    "diffusion": {"n_per_view": 1, "sigma": 0.05, "denoiser": "nlmeans", "nlmeans_h": 0.06},
    "adversarial": {"n_per_view": 1, "eps": 0.5, "steps": 3, "norm": "linf"},
}
#: Settings that are not among the defaults: voxels that a tissue mask must have, places and ids of a run.
MORE = frozenset({"least_tissue", "manifest", "out_dir", "run_id"})


def unknown(over: dict[str, Any], base: dict[str, Any] = DEFAULTS, before: str = "") -> list[str]:
    """The settings that nothing reads."""
    out = []
    for key, value in over.items():
        if key not in base and (before or key not in MORE):
            out.append(before + key)
        elif isinstance(value, dict) and isinstance(base.get(key), dict):
            out += unknown(value, base[key], f"{before}{key}.")
    return sorted(out)


def overlaid(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """A copy of base with the values of over, mapping by mapping."""
    out = copy.deepcopy(base)
    for key, value in over.items():
        out[key] = overlaid(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else copy.deepcopy(value)
    return out


def load(path: str | None = None) -> dict[str, Any]:
    """The defaults, with the mapping in a YAML file over them. An empty file changes nothing; a setting that nothing reads is an error."""
    if path is None:
        return copy.deepcopy(DEFAULTS)
    import yaml

    with open(path) as f:
        found = yaml.safe_load(f)
    if found is not None and not isinstance(found, dict):
        raise TypeError(f"{path} must hold a mapping")
    if wrong := unknown(found or {}):
        raise ValueError(f"{path} has unknown settings: {', '.join(wrong)}")
    return overlaid(DEFAULTS, found or {})
