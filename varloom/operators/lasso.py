"""Genome-wide LASSO and leave-one-chromosome-out predictions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.operators.linalg import fista, ridge_solve
from varloom.operators.stats import valid
from varloom.session import kept, ship

MAX_FEATURES = 8000  # a dense Gram matrix of this size is 512 MB
SLAB_BYTES = 64 << 20  # of a Gram matrix in one row


@dataclass
class JointFit:
    """Coefficients on the standardised scale with what is needed to predict."""

    gidx: np.ndarray  # -1 for covariates
    chr: np.ndarray  # 0 for covariates
    names: list[str]
    coef_norm: np.ndarray
    mean: np.ndarray
    sd: np.ndarray
    y_mean: float
    n: int
    gram: np.ndarray
    xty: np.ndarray

    @property
    def active(self) -> np.ndarray:
        return np.abs(self.coef_norm) > 1e-10

    def table(self, spark) -> DataFrame:
        rows = [(int(g), int(c), nm, float(b / s), float(b), bool(a)) for g, c, nm, b, s, a in zip(self.gidx, self.chr, self.names, self.coef_norm, self.sd, self.active, strict=True)]
        return spark.createDataFrame(rows, "gidx long, chr int, name string, beta double, beta_norm double, step3_active boolean")


def design_rows(genotypes: DataFrame, cand: DataFrame, pheno: DataFrame, y_col: str, covariates: list[str]) -> DataFrame:
    """One row a sample: y, covariates, and its sparse non-zero dosages of the candidates (missing reads as 0)."""
    g = genotypes.join(cand.select("chr", "gidx"), ["chr", "gidx"])
    d = F.coalesce(valid(F.col("dosage")), F.lit(0.0))
    x = g.where(d != 0).groupBy("sample_idx").agg(F.collect_list(F.struct(F.col("gidx"), d.alias("d"))).alias("x"))
    y = pheno.where(F.col(y_col).isNotNull()).select("sample_idx", F.col(y_col).cast("double").alias("y"), F.array(*[F.col(c).cast("double") for c in covariates]).alias("cov") if covariates else F.array().cast("array<double>").alias("cov"))
    return y.join(x, "sample_idx", "left")


def sufficient(rows: DataFrame, gidx: np.ndarray, n_cov: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float, int]:
    """X'X, X'y, column sums, sum y, sum y^2, n: each task adds up its samples and writes one matrix, in slabs of rows."""
    ship(rows.sparkSession)
    p = len(gidx) + n_cov
    order = np.sort(gidx)
    slab = max(SLAB_BYTES // (8 * max(p, 1)), 1)

    def run(batches):
        a, b, s, y1, y2, n = np.zeros((p, p)), np.zeros(p), np.zeros(p), 0.0, 0.0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                m = np.zeros((part.num_rows, p))
                x = part.column("x")
                cells = x.flatten()  # the cells of rows that are not null
                if len(cells):
                    row = np.repeat(np.arange(part.num_rows), pc.fill_null(pc.list_value_length(x), 0).to_numpy())
                    g, d = (c.to_numpy(zero_copy_only=False) for c in cells.flatten())
                    m[row, np.searchsorted(order, g)] = d
                if n_cov:
                    v = part.column("cov").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n_cov)
                    m[:, len(gidx) :] = np.where(np.isnan(v), 0.0, v)
                y = part.column("y").to_numpy(zero_copy_only=False)
                a += m.T @ m
                b += m.T @ y
                s += m.sum(0)
                y1, y2, n = y1 + y.sum(), y2 + y @ y, n + len(y)
        if n:
            for at in range(0, max(p, 1), slab):  # a matrix of 16,384 columns and more doesn't fit one value
                first = at == 0
                yield pa.RecordBatch.from_pydict({"at": [at], "a": [a[at : at + slab].tobytes()], "b": [b.tobytes() if first else b""], "s": [s.tobytes() if first else b""], "y1": [y1 if first else 0.0], "y2": [y2 if first else 0.0], "n": [n if first else 0]})

    a, b, s, y1, y2, n = np.zeros((p, p)), np.zeros(p), np.zeros(p), 0.0, 0.0, 0
    parts = rows.select("y", "cov", "x").mapInArrow(run, "at long, a binary, b binary, s binary, y1 double, y2 double, n long")
    # toLocalIterator runs one task after another: the sums are made by all at once first
    for r in kept(parts, "sums").toLocalIterator():  # one task's matrix at a time
        rows_of = np.frombuffer(bytes(r.a)).reshape(-1, p)
        a[r["at"] : r["at"] + len(rows_of)] += rows_of
        if r["at"] == 0:
            b += np.frombuffer(bytes(r.b))
            s += np.frombuffer(bytes(r.s))
        y1, y2, n = y1 + r.y1, y2 + r.y2, n + r.n
    return a, b, s, y1, y2, n


def joint_lasso(genotypes: DataFrame, cand: DataFrame, pheno: DataFrame, alpha: float = 6e-3, y_col: str = "y_original", covariates: list[str] = (), max_iter: int = 1000, max_features: int = MAX_FEATURES) -> JointFit:
    """LASSO over all candidates (and covariates, penalised alike) on z-scored columns."""
    meta = sorted({(r.gidx, r.chr) for r in cand.select("gidx", "chr").distinct().limit(max_features + 1).collect()})
    if len(meta) > max_features:
        raise ValueError(f"more than {max_features} candidates: cap them, or raise max_features with the memory for a square matrix")
    gidx = np.array([m[0] for m in meta], np.int64)
    chrs = np.array([m[1] for m in meta], np.int64)
    covariates = list(covariates)
    a, b, s, y1, _, n = sufficient(design_rows(genotypes, cand, pheno, y_col, covariates), gidx, len(covariates))
    mean = s / n
    sd = np.sqrt(np.maximum(np.diag(a) / n - mean**2, 0))
    sd = np.where(sd < 1e-6, 1.0, sd)
    gram = (a / n - np.outer(mean, mean)) / np.outer(sd, sd)
    xty = (b / n - mean * (y1 / n)) / sd
    theta = fista(gram, xty, alpha, max_iter=max_iter, check_every=50)
    k = len(covariates)
    return JointFit(np.concatenate([gidx, np.full(k, -1)]), np.concatenate([chrs, np.zeros(k, np.int64)]), [f"v{g}" for g in gidx] + covariates, theta, mean, sd, y1 / n, n, gram, xty)


def chromosome_features(fit: JointFit) -> dict[int, np.ndarray]:
    return {int(c): np.flatnonzero(fit.chr == c) for c in np.unique(fit.chr) if c > 0}


def loco_masked(genotypes: DataFrame, coef: DataFrame, y_mean: float | None = None, samples: DataFrame | None = None) -> DataFrame:
    """(sample_idx, chr, yhat): the full prediction less the chromosome's own part, plus the phenotype mean.

    coef has (gidx, chr, beta, mean): per-chromosome sums, then total minus own; samples without calls of the
    active variants keep the centring terms.
    """
    c = coef.select("gidx", F.col("chr").alias("cchr"), "beta", "mean")
    base = coef.groupBy(F.col("chr").alias("cchr")).agg(F.sum(F.col("beta") * F.col("mean")).alias("shift"))
    d = F.coalesce(valid(F.col("dosage")), F.lit(0.0))
    own = genotypes.join(F.broadcast(c), "gidx").groupBy("sample_idx", "cchr").agg(F.sum(F.col("beta") * d).alias("raw"))
    ids = (samples if samples is not None else genotypes).select("sample_idx").distinct()
    grid = ids.join(F.broadcast(base))
    part = grid.join(own, ["sample_idx", "cchr"], "left").select("sample_idx", "cchr", (F.coalesce("raw", F.lit(0.0)) - F.col("shift")).alias("part"))
    from pyspark.sql import Window as W

    total = F.sum("part").over(W.partitionBy("sample_idx"))
    return part.select("sample_idx", F.col("cchr").alias("chr"), (total - F.col("part") + F.lit(y_mean or 0.0)).alias("yhat"))


def loco_coefficients(fit: JointFit, ridge: float = 1e-2) -> dict[int, np.ndarray]:
    """Refitted coefficients (original scale) with each chromosome's active variants left out."""
    active = fit.active | (fit.chr == 0)
    out = {}
    for c in sorted(int(x) for x in np.unique(fit.chr[active]) if x > 0):
        keep = np.flatnonzero(active & (fit.chr != c))
        b = np.zeros(len(fit.chr))
        if len(keep):
            b[keep] = ridge_solve(fit.gram[np.ix_(keep, keep)], fit.xty[keep], ridge) / fit.sd[keep]
        out[c] = b
    return out


def loco_ols(genotypes: DataFrame, fit: JointFit, pheno: DataFrame, covariates: list[str] = (), ridge: float = 1e-2, chromosomes: list[int] | None = None) -> DataFrame:
    """(sample_idx, chr, yhat) from the refits: solves on the driver (22 small systems), one scan to predict."""
    spark = genotypes.sparkSession
    fits = loco_coefficients(fit, ridge)
    full = np.zeros(len(fit.chr))
    keep = np.flatnonzero(fit.active | (fit.chr == 0))
    if len(keep):
        full[keep] = ridge_solve(fit.gram[np.ix_(keep, keep)], fit.xty[keep], ridge) / fit.sd[keep]
    chrs = chromosomes or sorted(int(c) for c in np.unique(fit.chr) if c > 0)
    rows, shift, cov_rows = [], [], []
    for c in chrs:
        b = fits.get(c, full)
        shift.append((c, float(fit.y_mean - b @ fit.mean)))
        rows += [(int(fit.gidx[i]), c, float(b[i])) for i in np.flatnonzero(b) if fit.chr[i] > 0]
        cov_rows.append((c, [float(b[i]) for i in np.flatnonzero(fit.chr == 0)]))
    w = spark.createDataFrame(rows, "gidx long, out_chr int, b double") if rows else spark.createDataFrame([], "gidx long, out_chr int, b double")
    s = spark.createDataFrame(shift, "out_chr int, shift double")
    d = F.coalesce(valid(F.col("dosage")), F.lit(0.0))
    x = genotypes.select("sample_idx", "gidx", d.alias("d")).join(F.broadcast(w), "gidx").groupBy("sample_idx", "out_chr").agg(F.sum(F.col("b") * F.col("d")).alias("xb"))
    base = pheno.select("sample_idx", *covariates).join(F.broadcast(s))
    if covariates:
        cb = spark.createDataFrame(cov_rows, "out_chr int, cb array<double>")
        base = base.join(F.broadcast(cb), "out_chr")
        add = F.lit(0.0)
        for i, c in enumerate(covariates):
            add = add + F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * F.col("cb")[i]
        base = base.withColumn("shift", F.col("shift") + add)
    j = base.join(x, ["sample_idx", "out_chr"], "left")
    return j.select("sample_idx", F.col("out_chr").alias("chr"), (F.col("shift") + F.coalesce("xb", F.lit(0.0))).alias("yhat"))


def predict(genotypes: DataFrame, fit: JointFit) -> DataFrame:
    """(sample_idx, xb): the linear predictor of the LASSO's own coefficients."""
    spark = genotypes.sparkSession
    on = [i for i in np.flatnonzero(fit.active) if fit.chr[i] > 0]
    w = spark.createDataFrame([(int(fit.gidx[i]), float(fit.coef_norm[i] / fit.sd[i]), float(fit.mean[i])) for i in on], "gidx long, b double, m double")
    d = F.coalesce(valid(F.col("dosage")), F.lit(0.0))
    return genotypes.join(F.broadcast(w), "gidx").groupBy("sample_idx").agg(F.sum(F.col("b") * (d - F.col("m"))).alias("xb"))


def coefficients(fit: JointFit) -> pd.DataFrame:
    return pd.DataFrame({"gidx": fit.gidx, "chr": fit.chr, "name": fit.names, "beta": fit.coef_norm / fit.sd, "active": fit.active})
