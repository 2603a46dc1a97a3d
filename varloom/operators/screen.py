"""Windowed univariate screening: filter, ridge-quantile slopes, strength, window top-K, LOO, positive LASSO."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from varloom.functions.strength import Strength, strength
from varloom.operators.linalg import fista
from varloom.operators.stats import valid, variant_stats

TINY = 1e-20


def chunk_edges(n: int, k: int) -> list[tuple[int, int]]:
    """k nearly equal ranges of 0..n (edges n * i // k); empty ones are left out."""
    e = [n * i // k for i in range(k + 1)]
    return [(a, b) for a, b in zip(e[:-1], e[1:], strict=True) if b > a]


def with_position(stats: DataFrame) -> DataFrame:
    """Adds vidx, the 0-based position of a variant in its chromosome, where it is absent."""
    if "vidx" in stats.columns:
        return stats
    return stats.withColumn("vidx", F.row_number().over(W.partitionBy("chr").orderBy("gidx")) - 1)


def ridge_quantile(stats: DataFrame, maf_min: float = 1e-2, quantile: float = 5.0) -> DataFrame:
    """(chr, lam): the percentile of sxx over the variants that pass the frequency filter."""
    return stats.where((F.col("maf") >= maf_min) & (F.col("sxx") > 0)).groupBy("chr").agg(F.percentile("sxx", quantile / 100).alias("lam"))


def univariate(genotypes: DataFrame, pheno: DataFrame, stats: DataFrame, maf_min: float = 1e-2, quantile: float = 5.0, vidx_range: tuple[int, int] | None = None, y_col: str = "y_train", missing: str = "ref") -> DataFrame:
    """chr, gidx, vidx, mu_x, sxx, maf, den, beta, alpha, n, syy per variant.

    A missing call contributes (0 - mu) * y with ``missing="ref"`` and nothing with ``"mean"``.
    """
    st = with_position(stats).select("chr", "gidx", "vidx", "mu_x", "sxx", "maf")
    lam = ridge_quantile(st, maf_min, quantile)
    ok = st.where((F.col("maf") >= maf_min) & (F.col("sxx") > 0))
    if vidx_range:
        ok = ok.where((F.col("vidx") >= vidx_range[0]) & (F.col("vidx") < vidx_range[1]))
    y = pheno.select("sample_idx", F.col(y_col).cast("double").alias("y"))
    ys = y.agg(F.avg("y").alias("ybar"), F.count(F.lit(1)).alias("n"), (F.var_pop("y") * F.count("y")).alias("syy"))
    yc = y.join(F.broadcast(ys)).select("sample_idx", (F.col("y") - F.col("ybar")).alias("yc"))
    d = valid(F.col("dosage"))
    g = genotypes.join(yc, "sample_idx").groupBy("chr", "gidx").agg(F.coalesce(F.sum(d * F.col("yc")), F.lit(0.0)).alias("dy"), F.sum("yc").alias("sy"), F.coalesce(F.sum(F.when(d.isNotNull(), F.col("yc"))), F.lit(0.0)).alias("sy_called"))
    sy = F.col("sy") if missing == "ref" else F.col("sy_called")
    j = g.join(ok, ["chr", "gidx"]).join(F.broadcast(lam), "chr").join(F.broadcast(ys))
    j = j.withColumn("den", F.col("sxx") + F.col("lam"))
    slope = (F.col("dy") - F.col("mu_x") * sy) / F.greatest("den", F.lit(TINY))
    j = j.withColumn("beta", slope).withColumn("alpha", F.col("ybar") - F.col("beta") * F.col("mu_x"))
    return j.select("chr", "gidx", "vidx", "mu_x", "sxx", "maf", "den", "beta", "alpha", "n", "syy")


def with_strength(uni: DataFrame, by: str | Strength = "r2_se") -> DataFrame:
    f = strength(by)
    return uni.withColumn("strength", f(F.col("beta"), F.col("sxx"), F.col("maf"), F.col("n").cast("double"), F.col("syy")))


def top_k(n_per_window: int, pct: float) -> int:
    return max(50, int(n_per_window * pct / 100))


def window_top(uni: DataFrame, window_size: int = 8192, pct: float = 20, k: int | None = None) -> DataFrame:
    """The K strongest variants of each positional window (window 1, 2, ... over the filtered variants)."""
    k = k or top_k(window_size, pct)
    pos = F.row_number().over(W.partitionBy("chr").orderBy("vidx")) - 1
    w = uni.withColumn("window", (F.floor(pos / window_size) + 1).cast("int"))
    rank = F.row_number().over(W.partitionBy("chr", "window").orderBy(F.desc("strength"), "vidx"))
    return w.withColumn("rank", rank).where(F.col("rank") <= k)


def loo_predictions(genotypes: DataFrame, pheno: DataFrame, cand: DataFrame, y_col: str = "y_train") -> DataFrame:
    """(chr, gidx, sample_idx, y, loo): each candidate's leave-one-out prediction, as one column expression."""
    y = pheno.select("sample_idx", F.col(y_col).cast("double").alias("y"))
    c = cand.select("chr", "gidx", "mu_x", "den", "beta", "alpha", "n")
    j = genotypes.join(c, ["chr", "gidx"]).join(y, "sample_idx")
    xc = F.coalesce(valid(F.col("dosage")), F.lit(0.0)) - F.col("mu_x")
    h = 1 / F.col("n") + xc * xc / F.greatest("den", F.lit(TINY))
    fit = F.col("alpha") + F.col("beta") * F.col("mu_x") + F.col("beta") * xc
    return j.select("chr", "gidx", "sample_idx", "y", (F.col("y") - (F.col("y") - fit) / (1 - h)).alias("loo"))


def loo_lasso(genotypes: DataFrame, pheno: DataFrame, cand: DataFrame, alpha: float = 6e-4, y_col: str = "y_train", max_iter: int = 1000, tol: float = 1e-6) -> DataFrame:
    """(chr, window, gidx, theta): non-negative LASSO of the phenotype on each window's LOO predictions.

    The Gram matrix of a window is summed by Spark from sample-wise products (a window has at most K
    candidates), so a task receives K-square sums and never the samples.
    """
    loo = loo_predictions(genotypes, pheno, cand, y_col).join(cand.select("chr", "gidx", "window"), ["chr", "gidx"])
    row = loo.groupBy("chr", "window", "sample_idx").agg(F.first("y").alias("y"), F.sort_array(F.collect_list(F.struct("gidx", "loo"))).alias("x"))
    row = row.select("chr", "window", "y", F.col("x.gidx").alias("g"), F.col("x.loo").alias("v"))

    def partial(batches):
        import pyarrow as pa

        acc: dict[tuple[int, int], list] = {}
        for b in batches:
            pdf = b.to_pandas()
            for key, part in pdf.groupby(["chr", "window"]):
                m = np.stack(part.v.to_numpy())
                y = part.y.to_numpy()
                g = acc.setdefault(key, [part.g.iloc[0], 0.0, 0.0, 0.0, 0.0, 0])
                g[1] = g[1] + m.T @ m
                g[2] = g[2] + m.T @ y
                g[3] = g[3] + m.sum(0)
                g[4] += y.sum()
                g[5] += len(y)
        if acc:
            yield pa.RecordBatch.from_pydict(
                {
                    "chr": pa.array([k[0] for k in acc], pa.int32()),
                    "window": pa.array([k[1] for k in acc], pa.int32()),
                    "g": [np.asarray(v[0]).tolist() for v in acc.values()],
                    "xtx": [v[1].ravel().tolist() for v in acc.values()],
                    "xty": [v[2].tolist() for v in acc.values()],
                    "xs": [v[3].tolist() for v in acc.values()],
                    "ys": [float(v[4]) for v in acc.values()],
                    "n": [int(v[5]) for v in acc.values()],
                }
            )

    sums = row.mapInArrow(partial, "chr int, window int, g array<long>, xtx array<double>, xty array<double>, xs array<double>, ys double, n long")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.asarray(pdf.g.iloc[0])
        k, n, ys = len(g), int(pdf.n.sum()), float(pdf.ys.sum())
        xtx = np.sum(np.stack(pdf.xtx.to_numpy()), axis=0).reshape(k, k) / n
        xty = np.sum(np.stack(pdf.xty.to_numpy()), axis=0) - np.sum(np.stack(pdf["xs"].to_numpy()), axis=0) * ys / n
        theta = fista(xtx, xty / n, alpha, positive=True, max_iter=max_iter, tol=tol)
        return pd.DataFrame({"chr": pdf.chr.iloc[0], "window": pdf.window.iloc[0], "gidx": g, "theta": theta})

    return sums.groupBy("chr", "window").applyInPandas(solve, "chr int, window int, gidx long, theta double")


def screen(genotypes: DataFrame, pheno: DataFrame, stats: DataFrame | None = None, window_size: int = 8192, pct: float = 20, alpha: float = 6e-4, maf_min: float = 1e-2, by: str | Strength = "r2_se", quantile: float = 5.0, vidx_range: tuple[int, int] | None = None, y_col: str = "y_train", return_candidates: bool = False) -> DataFrame:
    """Candidates with a positive LASSO weight: gidx, chr, mu_x, den, alpha, beta, strength, window,
    lasso_weight, final_coef_corrected."""
    stats = variant_stats(genotypes) if stats is None else stats
    cand = window_top(with_strength(univariate(genotypes, pheno, stats, maf_min, quantile, vidx_range, y_col), by), window_size, pct).persist()
    if return_candidates:
        return cand
    theta = loo_lasso(genotypes, pheno, cand, alpha, y_col)
    j = cand.join(theta, ["chr", "window", "gidx"]).where("theta > 0")
    return j.select("gidx", "chr", "mu_x", "den", "alpha", "beta", "strength", "window", F.col("theta").alias("lasso_weight"), (F.col("theta") * F.col("beta")).alias("final_coef_corrected"))


def cap(cand: DataFrame, max_snps: int | None, by: str = "strength") -> DataFrame:
    """The strongest max_snps candidates, by ``strength`` or by r2 = beta^2 * den."""
    if max_snps is None:
        return cand
    key = F.col("beta") * F.col("beta") * F.col("den") if by == "r2" else F.col("strength")
    return cand.orderBy(key.desc(), "chr", "gidx").limit(max_snps)
