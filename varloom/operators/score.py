"""Polygenic scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.operators.stats import valid, variant_stats

BETA_NAMES = ("beta", "BETA", "weight", "WEIGHT")


def resolve_weights(weights: DataFrame) -> DataFrame:
    """(gidx, beta) from a table whose weight column has one of the accepted names."""
    for c in BETA_NAMES:
        if c in weights.columns:
            return weights.select(F.col("gidx").cast("long").alias("gidx"), F.col(c).cast("double").alias("beta"))
    raise ValueError(f"weights need one of the columns {BETA_NAMES}")


def score(genotypes: DataFrame, weights: DataFrame, center: bool = True, missing: str = "ref", stats: DataFrame | None = None) -> DataFrame:
    """(sample_idx, score): the weighted sum of dosages, centred at the variant means.

    A missing call adds -mu * beta when centred (it reads as dosage 0), or nothing with ``missing="mean"``.
    """
    w = resolve_weights(weights).groupBy("gidx").agg(F.sum("beta").alias("beta"))
    g = genotypes.join(w, "gidx")
    d = valid(F.col("dosage"))
    if not center:
        return g.groupBy("sample_idx").agg(F.sum(F.col("beta") * F.coalesce(d, F.lit(0.0))).alias("score"))
    mu = stats if stats is not None else variant_stats(g)
    g = g.join(mu.select("gidx", "mu_x"), "gidx")
    x = F.coalesce(d, F.lit(0.0) if missing == "ref" else F.col("mu_x")) - F.col("mu_x")
    return g.groupBy("sample_idx").agg(F.sum(F.col("beta") * x).alias("score"))
