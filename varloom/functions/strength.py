"""Screening strengths: a registry of functions of (slope, sxx, maf, n, syy) columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Strength = Callable[[Column, Column, Column, Column, Column], Column]

_REGISTRY: dict[str, Strength] = {
    "r2_se": lambda slope, sxx, maf, n, syy: slope * slope * maf * (1 - maf) * n * sxx / syy,
    "r2": lambda slope, sxx, maf, n, syy: slope * slope * sxx / syy,
    "beta_abs": lambda slope, sxx, maf, n, syy: F.abs(slope),
    "z_abs": lambda slope, sxx, maf, n, syy: F.abs(slope) * F.sqrt(n * sxx / syy),
    "chi2": lambda slope, sxx, maf, n, syy: slope * slope * n * sxx / syy,
}


def register_strength(name: str, fn: Strength | None = None):
    """Add a strength; usable as a decorator. User-defined functions may build any column expression."""
    if fn is None:
        return lambda f: register_strength(name, f)
    _REGISTRY[name] = fn
    return fn


def strength(name_or_fn: str | Strength) -> Strength:
    if callable(name_or_fn):
        return name_or_fn
    if name_or_fn not in _REGISTRY:
        raise ValueError(f"unknown strength {name_or_fn!r}; known: {sorted(_REGISTRY)}")
    return _REGISTRY[name_or_fn]


def names() -> list[str]:
    return sorted(_REGISTRY)
