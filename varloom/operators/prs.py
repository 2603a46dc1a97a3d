"""Polygenic score pipeline: splits, screening, penalty sweep, selection, refit, evaluation."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from varloom.operators import lasso
from varloom.operators.cohort import complete, least_squares, residualise
from varloom.operators.linalg import fista
from varloom.operators.score import score
from varloom.operators.screen import cap, screen
from varloom.operators.stats import valid, variant_stats
from varloom.operators.subset import keep_samples
from varloom.session import kept

ALPHAS = (6e-3, 8e-3, 1e-2, 1.2e-2, 1.5e-2, 2e-2)
ALPHAS_BINARY = (6e-5, 1e-4, 2e-4, 4e-4, 8e-4, 1.5e-3)


def load_phenotype(ids: DataFrame, phe: DataFrame, y_col: str = "y", binary: bool = False) -> DataFrame:
    """(sample_idx, fid, y) in cohort terms: binary 2 -> 1, 1 -> 0, all else missing; 0/1-coded data stay as they are."""
    j = ids.join(phe.select("fid", F.col(y_col).cast("double").alias("y")), "fid", "left")
    if not binary:
        return j.withColumn("y", F.when(F.col("y") != -9, F.col("y")))
    two = bool(j.agg(F.coalesce(F.bool_or(F.col("y") == 2), F.lit(False))).first()[0])
    y = F.when(F.col("y") == 2, 1.0).when(F.col("y") == 1, 0.0) if two else F.when(F.col("y").isin(0, 1), F.col("y"))
    return j.withColumn("y", y)


def split_coverage(splits: DataFrame, cohort: DataFrame) -> DataFrame:
    """split, nominal, in_cohort, pct: how many listed ids the cohort has."""
    c = cohort.select("fid").distinct().withColumn("_in", F.lit(1))
    a = splits.select("split", "fid").distinct().join(c, "fid", "left").groupBy("split").agg(F.count(F.lit(1)).alias("nominal"), F.count("_in").alias("in_cohort"))
    return a.withColumn("pct", 100.0 * F.col("in_cohort") / F.col("nominal"))


def check_disjoint(splits: DataFrame) -> None:
    """No id is in two of train, val and test."""
    twice = splits.select("split", "fid").distinct().groupBy("fid").count().where("count > 1").limit(1).count()
    if twice:
        raise ValueError("the splits overlap")


def build_splits(cohort: DataFrame, splits: DataFrame, phe: DataFrame, covariates: list[str], y_col: str = "y", binary: bool = False) -> tuple[DataFrame, DataFrame]:
    """(sample_idx, fid, split, y, resid, yhat, covariates) with residuals fitted within each split, and coverage."""
    check_disjoint(splits)
    # written once: every split reads it for its fit and for its rows
    base = kept(load_phenotype(cohort.select("sample_idx", "fid"), phe, y_col, binary).join(splits.select("fid", "split").distinct(), "fid").join(phe.select("fid", *covariates), "fid"), "splits")
    parts = []
    for name in ("train", "val", "test"):
        part = base.where((F.col("split") == name) & complete(base, ["y", *covariates]))
        r, _ = residualise(part, "y", covariates)
        parts.append(r.select("sample_idx", "fid", "split", "y", F.col("y_train").alias("resid"), F.col("y_hat").alias("yhat"), *covariates))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]), split_coverage(splits, cohort)


def r2(df: DataFrame, y_col: str = "y", score_col: str = "score", covariates: list[str] = ()) -> DataFrame:
    """r2_cov, r2_full, r2_increment, n: least-squares fits by cross-products."""
    ok = df.where(complete(df, [y_col, score_col, *covariates])).select(y_col, score_col, *covariates)
    if covariates:
        ok = kept(ok, "r2")  # both fits read it: the scores are made once
    cov = least_squares(ok, y_col, list(covariates)) if covariates else None
    full = least_squares(ok, y_col, [*covariates, score_col])
    a = cov.r2 if cov else 0.0
    return df.sparkSession.createDataFrame([(float(a), float(full.r2), float(full.r2 - a), full.n)], "r2_cov double, r2_full double, r2_increment double, n long")


def rank_auc(df: DataFrame, y_col: str = "y", score_col: str = "score") -> DataFrame:
    """auc, n_case, n_ctrl by rank sums with ties at half.

    Scores are counted by distinct value first; ranks are running sums within bins of the score, so no task
    sorts the cohort.
    """
    d = df.where(F.col(y_col).isin(0, 1) & F.col(score_col).isNotNull() & ~F.isnan(score_col)).groupBy(F.col(score_col).alias("s")).agg(F.count_if(F.col(y_col) == 1).alias("p"), F.count_if(F.col(y_col) == 0).alias("q"))
    edges = [float(x) for x in (d.agg(F.percentile_approx("s", F.array(*[F.lit(i / 64) for i in range(1, 64)]), 10_000)).first()[0] or [])]
    d = d.withColumn("b", F.size(F.filter(F.array(*[F.lit(e) for e in sorted(set(edges))]) if edges else F.array().cast("array<double>"), lambda e: e < F.col("s"))))
    base = d.groupBy("b").agg(F.sum("q").alias("qb"))
    base = base.select("b", F.coalesce(F.sum("qb").over(W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    below = F.col("base") + F.coalesce(F.sum("q").over(W.partitionBy("b").orderBy("s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    j = d.join(F.broadcast(base), "b").withColumn("below", below)
    return j.agg((F.sum(F.col("p") * (F.col("below") + 0.5 * F.col("q"))) / (F.sum("p") * F.sum("q"))).alias("auc"), F.sum("p").alias("n_case"), F.sum("q").alias("n_ctrl"))


def logistic_fit(df: DataFrame, y_col: str, x_cols: list[str], max_iter: int = 50, tol: float = 1e-10, penalty: float = 1e-6) -> Column:
    """The linear predictor of a logistic model of the columns: every Newton step is one aggregation of its sums."""
    k = len(x_cols)
    m = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(x_cols) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first() if k else None
    x = [F.lit(1.0), *[(F.col(c).cast("double") - float(m[f"m{i}"] or 0)) / float(m[f"s{i}"] or 1) for i, c in enumerate(x_cols)]]
    base = df.select(F.col(y_col).cast("double").alias("y"), *[c.alias(f"x{i}") for i, c in enumerate(x)])
    b, pen = np.zeros(k + 1), np.append(0.0, np.full(k, penalty))
    for _ in range(max_iter):
        lin = sum((F.col(f"x{i}") * float(v) for i, v in enumerate(b)), F.lit(0.0))
        mu = 0.5 * (F.tanh(lin * 0.5) + 1)
        step = base.select("*", (F.col("y") - mu).alias("r"), F.greatest(mu * (1 - mu), F.lit(1e-12)).alias("w"))
        pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
        got = step.agg(*[F.sum(F.col(f"x{i}") * F.col("r")) for i in range(k + 1)], *[F.sum(F.col("w") * F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs]).first()
        if got[0] is None:
            break
        h = np.diag(pen)
        for (i, j), v in zip(pairs, got[k + 1 :], strict=True):
            h[i, j] += v
            if i != j:
                h[j, i] += v
        d = np.linalg.solve(h, np.array(got[: k + 1]) - pen * b)
        b = b + d
        if np.abs(d).max() < tol:
            break
    return sum((c * float(v) for c, v in zip(x, b, strict=True)), F.lit(0.0))


def auc(df: DataFrame, y_col: str = "y", score_col: str = "score", covariates: list[str] = ()) -> tuple[float, float]:
    """In-sample AUC of a logistic model of the covariates, and with the score added, for any number of rows."""
    cols = [*covariates, score_col]
    rows = kept(df.where(complete(df, [y_col, *cols])).select(F.col(y_col).cast("double").alias(y_col), *[F.col(c).cast("double").alias(c) for c in cols]), "auc")

    def one(use: list[str]) -> float:
        return float(rank_auc(rows.withColumn("_lin", logistic_fit(rows, y_col, use)), y_col, "_lin").first()["auc"])

    return (one(list(covariates)) if covariates else 0.5), one(cols)


def select_alpha(sweep: DataFrame, by: str = "val_full") -> float:
    r = sweep.agg(F.max_by("alpha", by)).first()
    if r is None or r[0] is None:
        raise RuntimeError("the sweep is empty")
    return float(r[0])


@dataclass
class Prs:
    weights: DataFrame
    scores: DataFrame
    sweep: DataFrame
    alpha: float
    metrics: DataFrame


def sweep(genotypes: DataFrame, cand: DataFrame, data: DataFrame, alphas=ALPHAS, covariates: list[str] = (), max_features: int = lasso.MAX_FEATURES) -> DataFrame:
    """alpha, n_active, val_cov, val_full, val_increment: one Gram matrix and one scan of scores for all penalties,
    skipping empty fits."""
    spark = genotypes.sparkSession
    train = data.where("split = 'train'")
    fit = lasso.joint_lasso(keep_samples(genotypes, train), cand, train, alphas[0], "resid", max_features=max_features)
    stats = variant_stats(keep_samples(genotypes, train)).select("gidx", "mu_x")
    val = data.where("split = 'val'")
    fits, beta = [], {int(g): [] for g in fit.gidx}
    for a in alphas:
        fit.coef_norm = fista(fit.gram, fit.xty, a, check_every=50)
        if not fit.active.any():
            continue
        fits.append((float(a), int(fit.active.sum())))
        for g, b, s, on in zip(fit.gidx, fit.coef_norm, fit.sd, fit.active, strict=True):
            beta[int(g)].append(float(b / s) if on else None)
    out = []
    if fits:
        w = spark.createDataFrame([(g, b) for g, b in beta.items() if any(x is not None for x in b)], "gidx long, b array<double>")
        calls = keep_samples(genotypes, val).join(F.broadcast(w), "gidx").join(stats, "gidx")
        x = F.coalesce(valid(F.col("dosage")), F.lit(0.0)) - F.col("mu_x")
        # null where a sample has no call of a fit's variants: it is out of that fit's r2
        s = calls.groupBy("sample_idx").agg(*[F.sum(F.col("b")[i] * x).alias(f"score{i}") for i in range(len(fits))])
        scored = kept(val.select("sample_idx", "y", *covariates).join(s, "sample_idx"), "sweep")
        for i, (a, n) in enumerate(fits):
            m = r2(scored, "y", f"score{i}", list(covariates)).first()
            out.append((a, n, m.r2_cov, m.r2_full, m.r2_increment))
    return spark.createDataFrame(out, "alpha double, n_active int, val_cov double, val_full double, val_increment double")


def prs(genotypes: DataFrame, data: DataFrame, alphas=ALPHAS, covariates: list[str] = (), screen_alpha: float | None = None, binary: bool = False, max_snps: int | None = 44_000, window_size: int = 8192, maf_min: float = 1e-2, max_features: int = lasso.MAX_FEATURES) -> Prs:
    """Screen on train, sweep on val, refit on train + val, score test.

    More than ``max_features`` candidates are an error, not a silent cut; ``max_snps`` cuts to the strongest.
    """
    if binary and screen_alpha is None:
        raise ValueError("a binary trait needs an explicit screening penalty")
    # the sweep and the refit read both again and again
    genotypes, data = kept(genotypes, "calls"), kept(data, "data")
    train = data.where("split = 'train'")
    cand = cap(screen(keep_samples(genotypes, train), train, alpha=screen_alpha or 6e-4, y_col="resid", window_size=window_size, maf_min=maf_min), max_snps).persist()
    sw = sweep(genotypes, cand, data, alphas, covariates, max_features)
    best = select_alpha(sw)
    both = data.where("split in ('train', 'val')")
    fit = lasso.joint_lasso(keep_samples(genotypes, both), cand, both, best, "resid", max_features=max_features)
    w = fit.table(genotypes.sparkSession).where("step3_active").select("gidx", "beta")
    stats = variant_stats(keep_samples(genotypes, both)).select("gidx", "mu_x")
    s = score(genotypes, w, stats=stats)
    test = data.where("split = 'test'").join(s, "sample_idx")
    m = r2(test, "y", "score", list(covariates))
    if binary:
        cov, full = auc(test, "y", "score", list(covariates))
        m = m.withColumn("auc_cov", F.lit(cov)).withColumn("auc_full", F.lit(full))
    return Prs(w, s, sw, best, m)
