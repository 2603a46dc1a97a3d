"""Fine-mapping: SuSiE on sufficient statistics, stability selection, model averaging, consensus sets.

A locus is one group of packed variant rows, bounded by ``max_variants``; the phenotype is a broadcast vector of
checked size. Inside a group the Gram matrix is added up over blocks of samples, so memory is the packed bytes
plus p-square matrices. Loci that are too large (or too small) are reported as skipped.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from varloom.functions.codec import MISSING, unpack
from varloom.operators.linalg import fista, lambda_grid
from varloom.operators.loci import locus_variants
from varloom.operators.packed import VECTOR_BYTES, phenotype_vectors
from varloom.session import kept, ship

CS_LEVELS = (50, 60, 70, 80, 90)


@dataclass
class Sufficient:
    """X'X/n, X'y/n of centred columns, var(y), n, and the columns' frequencies."""

    xtx: np.ndarray
    xty: np.ndarray
    var_y: float
    n: int
    maf: np.ndarray


class Blocked:
    """A locus' genotypes in packed form, with half-sample Gram matrices by blocks of samples."""

    def __init__(self, packed: list[bytes], y: np.ndarray, block: int = 16_384):
        self.raw = np.stack([np.frombuffer(p, np.uint8) for p in packed])
        self.rows = np.flatnonzero(~np.isnan(y))
        self.y = y[self.rows] - y[self.rows].mean()
        self.n_all, self.block = len(y), block
        s, c = np.zeros(len(self.raw)), np.zeros(len(self.raw))
        for x, _ in self._blocks(None, centred=False):
            s += x.sum(0)
            c += len(x)
        self.mean = s / np.maximum(c, 1)

    def _blocks(self, mask: np.ndarray | None, centred: bool = True):
        """Blocks of samples (rows in the mask only); a missing call reads as dosage 0."""
        for a in range(0, self.n_all, self.block - self.block % 4):
            b = min(a + self.block - self.block % 4, self.n_all)
            lo, hi = np.searchsorted(self.rows, [a, b])
            if lo == hi:
                continue
            code = unpack(self.raw[:, a // 4 : (b + 3) // 4], b - a).T[self.rows[lo:hi] - a]
            x = np.where(code == MISSING, 0.0, code)
            y = self.y[lo:hi]
            if mask is not None:
                x, y = x[mask[lo:hi]], y[mask[lo:hi]]
            yield (x - self.mean if centred else x), y

    def sums(self, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        p = len(self.raw)
        xtx, xty, n = np.zeros((p, p)), np.zeros(p), 0
        for x, y in self._blocks(mask):
            xtx += x.T @ x
            xty += x.T @ y
            n += len(y)
        return xtx, xty, n

    def sufficient(self) -> Sufficient:
        xtx, xty, n = self.sums()
        mu = self.mean / 2
        return Sufficient(xtx / n, xty / n, float(self.y @ self.y / n), n, np.minimum(mu, 1 - mu))


# ---------------------------------------------------------------- engines
def susie(s: Sufficient, effects: int = 10, max_iter: int = 100, prior_var: float = 50.0, tol: float = 1e-4, prior: np.ndarray | None = None, coverage: float = 0.95) -> tuple[np.ndarray, np.ndarray, list[dict]]:
    """Sum of single effects on z-scores and correlations: pips, alphas (effects, p), credible sets."""
    p = len(s.xty)
    d = np.maximum(np.diag(s.xtx), 1e-10)
    sd = np.sqrt(d)
    r = s.xtx / np.outer(sd, sd)
    np.fill_diagonal(r, 1 + 1e-4)
    z = np.sqrt(s.n) * s.xty / d * sd / np.sqrt(max(s.var_y, 1e-300))
    log_prior = np.zeros(p) if prior is None else np.log(np.maximum(prior, 1e-10))
    alpha = np.tile(np.full(p, 1 / p) if prior is None else prior, (effects, 1))
    mu = np.zeros((effects, p))
    shrink = prior_var / (1 + prior_var)
    fitted = r @ (alpha * mu).sum(0)  # kept up to date as effects change
    for _ in range(max_iter):
        old = alpha.copy()
        for k in range(effects):
            fitted -= r @ (alpha[k] * mu[k])
            res = z - fitted
            bf = 0.5 * np.log(1 / (1 + prior_var)) + 0.5 * shrink * res * res + log_prior
            a = np.exp(bf - bf.max())
            alpha[k] = a / a.sum()
            mu[k] = shrink * res
            fitted += r @ (alpha[k] * mu[k])
        if np.abs(alpha - old).max() < tol:
            break
    pips = 1 - np.prod(1 - alpha, axis=0)
    sets = [credible_set(alpha[k], coverage) | {"effect": k} for k in range(effects) if alpha[k].max() >= 0.05]
    return pips, alpha, sets


def credible_set(alpha: np.ndarray, coverage: float = 0.95) -> dict:
    """The smallest prefix, by falling alpha, that reaches the coverage."""
    order = np.argsort(-alpha, kind="stable")
    cum = np.cumsum(alpha[order])
    size = min(int(np.searchsorted(cum, coverage)) + 1, len(alpha))
    return {"members": order[:size].tolist(), "size": size, "max_pip": float(alpha.max()), "coverage": float(cum[size - 1])}


@dataclass
class Stability:
    freq: np.ndarray
    avg_beta: np.ndarray
    models: list[frozenset[int]]
    per_lambda: np.ndarray


def _select(halves, lambdas: np.ndarray, p: int, pairs: int, ridge: float, weights: np.ndarray | None) -> Stability:
    total, beta, per, runs, models = np.zeros(p), np.zeros(p), np.zeros((len(lambdas), p)), 0, set()
    for xtx, xty in halves:
        for li, lam in enumerate(lambdas):
            th = fista(xtx, xty, lam, ridge=ridge, weights=weights, max_iter=300, tol=1e-5, check_every=50)
            on = th != 0
            total += on
            beta += np.abs(th)
            per[li] += on
            runs += 1
            if 0 < on.sum() <= max(100, p // 10):
                models.add(frozenset(np.flatnonzero(on).tolist()))
    return Stability(total / max(runs, 1), beta / max(runs, 1), sorted(models, key=lambda m: (len(m), sorted(m))), per / (2 * pairs))


def stability_selection(x: Blocked, pairs: int = 50, n_lambda: int = 20, ratio: float = 0.01, ridge: float = 1e-4, seed: int = 42, weights: np.ndarray | None = None) -> Stability:
    """Complementary pairs: the second half's sums are the total less the first half's."""
    full_a, full_b, n = x.sums()
    lambdas = lambda_grid(full_b / n, n_lambda, ratio, weights)
    rng = np.random.RandomState(seed)
    half = n // 2

    def halves():
        for _ in range(pairs):
            mask = np.zeros(n, bool)
            mask[rng.permutation(n)[:half]] = True
            a, b, _ = x.sums(mask)
            yield a / half, b / half
            # both halves count half samples; an odd sample out is spread, as 2 * half of n are used
            used = 2 * half / n
            yield (full_a * used - a) / half, (full_b * used - b) / half

    return _select(halves(), lambdas, len(full_b), pairs, ridge, weights)


def stability_from_stats(s: Sufficient, pairs: int = 50, n_lambda: int = 20, ratio: float = 0.01, ridge: float = 1e-4, seed: int = 42, weights: np.ndarray | None = None) -> Stability:
    """Without genotypes: symmetric Gaussian perturbations of the sufficient statistics stand for the halves."""
    p = len(s.xty)
    lambdas = lambda_grid(s.xty, n_lambda, ratio, weights)
    rng = np.random.RandomState(seed)
    sd = np.sqrt(2 / s.n)

    def halves():
        for _ in range(pairs):
            e = np.triu(rng.normal(0, sd, (p, p)))
            e = (e + e.T - np.diag(np.diag(e))) * np.sqrt(np.outer(np.diag(s.xtx), np.diag(s.xtx)))
            v = rng.normal(0, sd, p) * np.sqrt(np.diag(s.xtx) * s.var_y)
            for sign in (1, -1):
                a = s.xtx + sign * e
                yield a + max(0.0, -float(np.linalg.eigvalsh(a)[0])) * np.eye(p), s.xty + sign * v

    return _select(halves(), lambdas, p, pairs, ridge, weights)


def model_average(models: list[frozenset[int]], s: Sufficient, max_models: int = 5000) -> np.ndarray:
    """Inclusion probabilities by BIC weights over the proposed models."""
    ok = [m for m in models if 0 < len(m) <= 100]
    if len(ok) > max_models:
        ok = sorted(ok, key=len, reverse=True)[:max_models]
    bic, used = [], []
    for m in ok:
        idx = sorted(m)
        try:
            b = np.linalg.solve(s.xtx[np.ix_(idx, idx)], s.xty[idx])
        except np.linalg.LinAlgError:
            continue
        bic.append(s.n * np.log(max(s.var_y - float(b @ s.xty[idx]), 1e-10)) + len(idx) * np.log(s.n))
        used.append(idx)
    pips = np.zeros(len(s.xty))
    if bic:
        w = np.exp(-0.5 * (np.array(bic) - min(bic)))
        for idx, v in zip(used, w / w.sum(), strict=True):
            pips[idx] += v
    return pips


def joint_r2(s: Sufficient, idx: list[int]) -> float:
    """Variance explained by the least-squares fit on some columns."""
    if not len(idx):
        return 0.0
    b = np.linalg.lstsq(s.xtx[np.ix_(idx, idx)], s.xty[idx], rcond=None)[0]
    return float(np.clip(b @ s.xty[idx] / s.var_y, 0, 1))


def converge(select, s: Sufficient, effects: int = 10, rounds: int = 3, strength: float = 0.5, weights: np.ndarray | None = None, coverage: float = 0.95) -> tuple[Stability, np.ndarray, np.ndarray, list[dict], list[dict]]:
    """Both engines, and up to three rounds of mutual priors where their leads disagree.

    ``select(weights, seed_shift)`` runs stability selection; adaptive weights stay in force in every round.
    """
    p = len(s.xty)
    st = select(weights, 0)
    bma = model_average(st.models, s)
    pips, _, sets = susie(s, effects, coverage=coverage)

    def agree() -> tuple[bool, bool]:
        lead = int(np.argmax(bma))
        return lead == int(np.argmax(pips)), any(lead in c["members"] for c in sets)

    def note(k: int, strength_used: float) -> dict:
        same, inside = agree()
        return {"round": k, "max_discrepancy": float(np.abs(bma - pips).max()), "mean_discrepancy": float(np.abs(bma - pips).mean()), "strength": strength_used, "same_lead": same, "lead_in_cs": inside}

    history = [note(0, 0.0)]
    if any(agree()) or not sets:
        return st, bma, pips, sets, history
    high = int((bma > 0.5).sum())
    for k in range(1, rounds + 1):
        w = np.ones(p)
        for c in sets:
            m = c["members"]
            w[m] = np.minimum(w[m], max(1 - strength / max(c["size"], 1), 0.1))
        st = select(w if weights is None else w * weights, k)
        bma = model_average(st.models, s)
        prior = strength * st.freq + (1 - strength) / p
        pips, _, sets = susie(s, effects, prior=prior / prior.sum(), coverage=coverage)
        history.append(note(k, strength))
        now = int((bma > 0.5).sum())
        if any(agree()) or (k > 1 and now > 2 * high):
            break
        high = now
    return st, bma, pips, sets, history


# ---------------------------------------------------------------- columns
def adaptive_weights(stats: DataFrame, by: str = "z", gamma: float = 1.0, coding: str | None = None, coding_factor: float = 0.5) -> DataFrame:
    """``weight`` per variant of a locus: (median / own)^gamma of |z|, or of the explained share; clipped to
    [0.2, 5], then multiplied for coding variants and clipped again. Unmatched values take the locus' median."""
    z = F.abs("Z") if by == "z" else F.col("BETA") * F.col("BETA") * 2 * F.col("MAF") * (1 - F.col("MAF")) / (F.col("SE") * F.col("SE"))
    med = F.percentile(z, 0.5).over(W.partitionBy("locus_id"))
    s = stats.withColumn("_z", z).withColumn("_med", med).withColumn("_z", F.coalesce("_z", "_med"))
    raw = F.pow(F.col("_med") / F.greatest("_z", F.lit(1e-6)), F.lit(gamma))
    w = F.greatest(F.least(raw, F.lit(5.0)), F.lit(0.2))
    if coding:
        w = F.greatest(F.least(w * F.when(F.col(coding), coding_factor).otherwise(1.0), F.lit(5.0)), F.lit(0.2))
    return s.withColumn("weight", F.coalesce(w, F.lit(1.0))).drop("_z", "_med")


def consensus(rows: DataFrame, level: int = 60) -> DataFrame:
    """in_cs_50..90, in_CCS, consensus_pPIP, concordance, locus_status from sel_freq, susie_pip, in_susie_cs."""
    if level not in CS_LEVELS:
        raise ValueError(f"the level must be one of {CS_LEVELS}")
    out = rows
    for t in CS_LEVELS:
        out = out.withColumn(f"in_cs_{t}", (F.col("sel_freq") >= t / 100).cast("int"))
    out = out.withColumn("in_CCS", ((F.col(f"in_cs_{level}") == 1) & (F.col("in_susie_cs") == 1)).cast("int"))
    w = W.partitionBy("locus_id")
    prod = F.when(F.col("in_CCS") == 1, F.col("susie_pip") * F.col("sel_freq")).otherwise(0.0)
    out = out.withColumn("_prod", prod).withColumn("concordance", F.sum("_prod").over(w))
    out = out.withColumn("consensus_pPIP", F.when(F.col("concordance") > 0, F.col("_prod") / F.col("concordance")).otherwise(0.0))
    n, top = F.sum("in_CCS").over(w), F.max("consensus_pPIP").over(w)
    return out.withColumn("locus_status", status(n, top, F.col("concordance"))).drop("_prod")


def status(n: Column, top: Column, conc: Column) -> Column:
    return F.when((n > 0) & (n <= 3) & (top > 0.5) & (conc > 0.3), "Resolved").when((n > 0) & (n <= 10) & (conc > 0.1), "Narrowed").otherwise("Unresolved")


def summarise(per_variant: DataFrame) -> DataFrame:
    """One row a locus."""
    return per_variant.groupBy("locus_id").agg(
        F.count(F.lit(1)).alias("n_variants"), F.count_if(F.col("susie_pip") > 0.5).alias("n_pip50"), F.max("susie_pip").alias("max_susie_pip"), F.max("sel_freq").alias("max_sel_freq"), F.sum("in_susie_cs").alias("n_susie_cs"), F.sum("in_CCS").alias("n_ccs"), F.sum("h2_contribution").alias("h2"), F.max("concordance").alias("concordance"), F.first("locus_status").alias("locus_status"), F.max_by("gidx", F.struct("consensus_pPIP", "susie_pip", -F.col("gidx"))).alias("lead_gidx")
    )


def credible_prefix(rows: DataFrame, coverage: float = 0.95) -> DataFrame:
    """Marks the credible set of each (locus_id, effect): the smallest prefix by falling alpha."""
    w = W.partitionBy("locus_id", "effect").orderBy(F.desc("alpha"), "gidx").rowsBetween(W.unboundedPreceding, 0)
    cum = F.sum("alpha").over(w)
    return rows.withColumn("in_cs", (cum - F.col("alpha")) < coverage)


# ---------------------------------------------------------------- Spark
OUT = "locus_id int, chr int, gidx long, MAF double, sel_freq double, lasso_pip double, susie_pip double, avg_beta double, h2_contribution double, in_susie_cs int, note string"


def finemap(variants: DataFrame, loci: DataFrame, annotation: DataFrame, pheno: DataFrame, n_samples: int, tier: int = 2, effects: int = 10, coverage: float = 0.95, max_variants: int = 15_000, level: int = 60, pairs: int = 50, n_lambda: int = 20, rounds: int = 3, weights: DataFrame | None = None, y_col: str = "y") -> tuple[DataFrame, DataFrame]:
    """(per variant, per locus): tier 1 is SuSiE alone, tier 2 adds stability selection, averaging and consensus.

    pheno has (sample_idx, y) or (sample_idx, chr, y) residuals.
    """
    spark = variants.sparkSession
    ship(spark)
    yc = pheno.select("sample_idx", *(["chr"] if "chr" in pheno.columns else []), F.col(y_col).cast("double").alias("yc"))
    vec = spark.sparkContext.broadcast(phenotype_vectors(yc, n_samples))
    if 8 * n_samples > VECTOR_BYTES:
        raise ValueError("too many samples for a broadcast vector")
    members = locus_variants(annotation.select("gidx", "CHR", "POS"), loci)
    size = members.groupBy("locus_id").agg(F.count(F.lit(1)).alias("p"))
    fits = members.join(F.broadcast(size.where((F.col("p") >= 2) & (F.col("p") <= max_variants))), "locus_id", "left_semi")
    rows = fits.select("locus_id", "gidx").join(variants.select("chr", "gidx", "packed"), "gidx")
    if weights is not None:
        rows = rows.join(weights.select("locus_id", "gidx", "weight"), ["locus_id", "gidx"], "left")
    rows = rows.select("locus_id", "chr", "gidx", "packed", F.coalesce("weight", F.lit(1.0)).alias("weight") if weights is not None else F.lit(1.0).alias("weight"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("gidx")
        c = int(pdf.chr.iloc[0])
        x = Blocked(list(pdf.packed), vec.value.get(c, vec.value.get(0)))
        s = x.sufficient()
        p = len(pdf)
        w = None if (pdf.weight == 1).all() else pdf.weight.to_numpy()
        if tier == 1:
            pips, _, sets = susie(s, effects, coverage=coverage)
            freq, bma, avg = np.zeros(p), np.zeros(p), np.zeros(p)
        else:
            st, bma, pips, sets, _ = converge(lambda wt, k: stability_selection(x, pairs, n_lambda, seed=42 + k, weights=wt), s, effects, rounds, weights=w, coverage=coverage)
            freq, avg = st.freq, st.avg_beta
        inside = np.zeros(p, int)
        for cs in sets:
            inside[cs["members"]] = 1
        beta = s.xty / np.maximum(np.diag(s.xtx), 1e-10)
        h2 = beta**2 * 2 * s.maf * (1 - s.maf) / max(s.var_y, 1e-300)
        return pd.DataFrame({"locus_id": pdf.locus_id.iloc[0], "chr": c, "gidx": pdf.gidx, "MAF": s.maf, "sel_freq": freq, "lasso_pip": bma, "susie_pip": pips, "avg_beta": avg, "h2_contribution": h2, "in_susie_cs": inside, "note": ""})

    # both results come from one pass over the loci
    got = kept(rows.groupBy("locus_id").applyInPandas(one, OUT), "finemap")
    per = consensus(got, level).drop("note").join(annotation.select("gidx", *[c for c in ("POS", "ID", "REF", "ALT") if c in annotation.columns]), "gidx", "left")
    skipped = loci.select("locus_id").join(size, "locus_id", "left").where(F.col("p").isNull() | (F.col("p") < 2) | (F.col("p") > max_variants))
    summary = summarise(per).unionByName(skipped.select("locus_id", F.coalesce("p", F.lit(0)).alias("n_variants"), F.lit("Skipped").alias("locus_status")), allowMissingColumns=True)
    return per, summary
