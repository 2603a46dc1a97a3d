"""Workflow configuration: defaults, merging, checks, an example file."""

from __future__ import annotations

import copy
import json
from typing import Any

DEFAULTS: dict[str, Any] = {
    "general": {"name": "run", "output_dir": "results/run", "seed": 42, "log_level": "INFO"},
    "data": {"variants": None, "annotation": None, "phe_file": None, "psam": None, "chromosomes": list(range(1, 23))},
    "phenotype": {"mode": "single", "name": None, "type": "continuous", "phenotype_list": None},
    "cohort": {"build": "auto", "base": None, "binary": None, "impute_missing": False},
    "covariates": {"columns": ["age", "sex", *[f"PC{i}" for i in range(1, 11)]]},
    "screening": {"run": True, "window_size": 8192, "top_pct": 20.0, "maf_min": 1e-3, "strength": "r2_se", "split_chrs": ["1:11", "12:22"], "split_chrs_by": [2, 1], "default_chunks": 1},
    "local_lasso": {"alpha": 6e-4, "max_iter": 1000},
    "joint_lasso": {"run": True, "alpha": 6e-3, "ridge": 1e-2, "max_iter": 2000, "loco_mode": "ols", "precomputed_loco": None, "max_snps": None, "max_features": 8000, "max_snps_rank_by": "strength"},
    "gwas": {"run": True, "test": "wald", "family": "linear", "maf_min": 1e-3, "min_mac": 20.0, "spa_p": 0.05, "spa_sd": 2.0, "variants": None, "annotation": None},
    "loci": {"run": True, "p_threshold": 5e-8, "window_kb": 500, "merge_overlapping": True, "clump_window": 1_000_000, "max_loci": None},
    "finemapping": {"run": True, "tier": 1, "n_signals": 10, "coverage": 0.95, "max_variants": 15000, "weights": "z", "gamma": 1.0, "lasso_cs_level": 50, "pairs": 50, "n_lambda": 20, "top_loci": None},
    "qc": {"variant": False, "sample": False, "maf_min": None, "max_missing": None, "hwe_min": None, "sample_max_missing": None},
    "output": {"sumstats": True, "loco": False, "active_set": True, "finemapping": True, "plots": True, "format": "parquet"},
}

ALIASES = {("screening", "block_size"): "window_size", ("screening", "block_pct"): "top_pct", ("data", "annotation_file"): "annotation"}
CHOICES = {("phenotype", "mode"): ("single", "batch"), ("phenotype", "type"): ("continuous", "binary"), ("gwas", "test"): ("wald", "score", "standardized"), ("gwas", "family"): ("linear", "binary"), ("joint_lasso", "loco_mode"): ("ols", "masked", "lasso"), ("finemapping", "tier"): (1, 2), ("finemapping", "weights"): ("z", "strength", None), ("joint_lasso", "max_snps_rank_by"): ("strength", "r2")}
REQUIRED = (("general", "name"), ("general", "output_dir"), ("data", "variants"))


def merge(base: dict, over: dict) -> dict:
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def load(source: str | dict) -> dict:
    """Defaults overlaid with a file or dict, old names resolved, then checked."""
    raw = source if isinstance(source, dict) else json.load(open(source))
    raw = copy.deepcopy(raw)
    for (sec, old), new in ALIASES.items():
        if old in raw.get(sec, {}):
            raw[sec][new] = raw[sec].pop(old)
    unknown = [f"{s}.{k}" for s, d in raw.items() if s in DEFAULTS and isinstance(d, dict) for k in d if k not in DEFAULTS[s]] + [s for s in raw if s not in DEFAULTS and not s.startswith("_")]
    if unknown:
        raise ValueError(f"unknown configuration keys: {', '.join(unknown)}")
    cfg = merge(DEFAULTS, raw)
    check(cfg)
    return cfg


def check(cfg: dict) -> None:
    bad = [f"{s}.{k} is required" for s, k in REQUIRED if cfg[s][k] in (None, "")]
    bad += [f"{s}.{k} must be one of {ok}" for (s, k), ok in CHOICES.items() if cfg[s][k] not in ok]
    if cfg["phenotype"]["mode"] == "single" and not cfg["phenotype"]["name"]:
        bad.append("phenotype.name is required")
    if cfg["phenotype"]["mode"] == "batch" and not cfg["phenotype"]["phenotype_list"]:
        bad.append("phenotype.phenotype_list is required")
    if len(cfg["screening"]["split_chrs"]) != len(cfg["screening"]["split_chrs_by"]):
        bad.append("screening.split_chrs and split_chrs_by differ in length")
    if bad:
        raise ValueError("; ".join(bad))


def write_example(path: str) -> None:
    ex = merge(DEFAULTS, {"data": {"variants": "variants.parquet", "annotation": "annotation.parquet", "phe_file": "phenotypes.tsv", "psam": "samples.psam"}, "phenotype": {"name": "height"}})
    with open(path, "w") as f:
        json.dump(ex, f, indent=2)


def parse_range(text: str) -> range:
    """'lo:hi', both ends included; a single number is a range of one."""
    lo, _, hi = str(text).partition(":")
    return range(int(lo), int(hi or lo) + 1)


def chunk_counts(cfg: dict) -> dict[int, int]:
    """How many screening chunks each chromosome gets."""
    s = cfg["screening"]
    out = {c: s["default_chunks"] for c in cfg["data"]["chromosomes"]}
    for text, k in zip(s["split_chrs"], s["split_chrs_by"], strict=True):
        out.update({c: k for c in parse_range(text) if c in out})
    return out
