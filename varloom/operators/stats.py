"""Per-variant and per-sample statistics and quality control on the long genotype view.

``genotypes`` has (sample_idx, chr, gidx, dosage) with a null dosage where the call is missing. Everything here
is one hash aggregation with map-side partial sums; a variant or sample with any number of rows is never
held in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.functions.special import chi2_p

def nan() -> Column:
    return F.lit(float("nan"))


def valid(d: Column) -> Column:
    """The dosage where it counts: finite and in [0, 2]."""
    d = d.cast("double")
    return F.when((d >= 0) & (d <= 2) & ~F.isnan(d), d)


def variant_stats(genotypes: DataFrame, by: tuple[str, ...] = ("chr", "gidx")) -> DataFrame:
    """n_samples, n_called, mu_x, sxx, maf per variant; 0, 0, 0 where nothing is called."""
    d = valid(F.col("dosage"))
    mu = F.coalesce(F.avg(d), F.lit(0.0))
    out = genotypes.groupBy(*by).agg(F.count(F.lit(1)).alias("n_samples"), F.count(d).alias("n_called"), mu.alias("mu_x"), F.coalesce(F.var_pop(d) * F.count(d), F.lit(0.0)).alias("sxx"))
    return out.withColumn("maf", F.when(F.col("n_called") > 0, F.least(F.col("mu_x") / 2, 1 - F.col("mu_x") / 2)).otherwise(0.0))


def variant_stats_sparse(carriers: DataFrame, n_samples: int, by: tuple[str, ...] = ("gidx",)) -> DataFrame:
    """The same from carrier rows only: an absent row is dosage 0."""
    d = F.col("dosage").cast("double")
    a = carriers.groupBy(*by).agg(F.sum(d).alias("s"), F.sum(d * d).alias("ss"), F.count(F.lit(1)).alias("n_carriers"))
    mu = F.col("s") / n_samples
    return a.select(*by, "n_carriers", mu.alias("mu_x"), (F.col("ss") - n_samples * mu * mu).alias("sxx"), F.least(mu / 2, 1 - mu / 2).alias("maf"))


def genotype_counts(genotypes: DataFrame, by: tuple[str, ...] = ("chr", "gidx")) -> DataFrame:
    d = F.col("dosage")
    return genotypes.groupBy(*by).agg(
        F.count_if(d == 0).alias("n_geno0"), F.count_if(d == 1).alias("n_geno1"), F.count_if(d == 2).alias("n_geno2"), F.count_if(valid(d).isNull()).alias("n_missing"), F.count(F.lit(1)).alias("n_samples")
    )


def hwe_chi2(n0: Column, n1: Column, n2: Column) -> Column:
    """Pearson chi-square against Hardy-Weinberg proportions; NaN where an expected count is below 5."""
    n = (n0 + n1 + n2).cast("double")
    p = (2 * n2 + n1) / F.greatest(2 * n, F.lit(1.0))
    q = 1 - p
    e0, e1, e2 = n * q * q, 2 * n * p * q, n * p * p
    chi = (n0 - e0) ** 2 / e0 + (n1 - e1) ** 2 / e1 + (n2 - e2) ** 2 / e2
    return F.when(F.least(e0, e1, e2) < 5, nan()).otherwise(chi)


def with_hwe(counts: DataFrame) -> DataFrame:
    c = counts.withColumn("hwe_chi2", hwe_chi2(F.col("n_geno0"), F.col("n_geno1"), F.col("n_geno2")))
    return c.withColumn("hwe_p", chi2_p(F.col("hwe_chi2")))


def at_least(x: Column, low: float | None) -> Column:
    return F.lit(True) if low is None else F.coalesce(x >= low, F.lit(False))


def at_most(x: Column, high: float | None) -> Column:
    return F.lit(True) if high is None else F.coalesce(x <= high, F.lit(False)) & ~F.isnan(x)


def variant_qc(genotypes: DataFrame | None = None, stats: DataFrame | None = None, maf_min: float | None = None, maf_max: float | None = None, max_missing: float | None = None, hwe_min: float | None = None) -> DataFrame:
    """Statistics, counts and the ``keep`` flag per variant. A NaN Hardy-Weinberg p passes.

    With stored ``stats`` and neither a missingness nor a Hardy-Weinberg bound, no genotype is read: the counts
    are -1 and the rates NaN.
    """
    if stats is not None and max_missing is None and hwe_min is None:
        cols = {**{c: F.lit(-1).cast("long") for c in ("n_geno0", "n_geno1", "n_geno2", "n_missing")}, **{c: nan() for c in ("missing_rate", "hwe_chi2", "hwe_p")}}
        out = stats.select("chr", "gidx", "mu_x", "sxx", "maf", *[v.alias(k) for k, v in cols.items()])
        return out.withColumn("keep", at_least(F.col("maf"), maf_min) & at_most(F.col("maf"), maf_max))
    if genotypes is None:
        raise ValueError("missingness and Hardy-Weinberg bounds need genotypes")
    d = valid(F.col("dosage"))
    one = genotypes.groupBy("chr", "gidx").agg(
        F.coalesce(F.avg(d), F.lit(0.0)).alias("mu_x"),
        F.coalesce(F.var_pop(d) * F.count(d), F.lit(0.0)).alias("sxx"),
        F.count_if(d == 0).alias("n_geno0"),
        F.count_if(d == 1).alias("n_geno1"),
        F.count_if(d == 2).alias("n_geno2"),
        F.count_if(d.isNull()).alias("n_missing"),
        F.count(F.lit(1)).alias("n"),
    )
    one = one.withColumn("maf", F.when(F.col("n") > F.col("n_missing"), F.least(F.col("mu_x") / 2, 1 - F.col("mu_x") / 2)).otherwise(0.0))
    return qc_flags(one.withColumn("missing_rate", F.col("n_missing") / F.col("n")), maf_min, maf_max, max_missing, hwe_min)


def qc_flags(counted: DataFrame, maf_min: float | None, maf_max: float | None, max_missing: float | None, hwe_min: float | None) -> DataFrame:
    out = with_hwe(counted)
    hwe_ok = F.lit(True) if hwe_min is None else F.isnan("hwe_p") | (F.col("hwe_p") >= hwe_min)
    keep = at_least(F.col("maf"), maf_min) & at_most(F.col("maf"), maf_max) & at_most(F.col("missing_rate"), max_missing) & hwe_ok
    return out.select("chr", "gidx", "mu_x", "sxx", "maf", "n_geno0", "n_geno1", "n_geno2", "n_missing", "missing_rate", "hwe_chi2", "hwe_p", keep.alias("keep"))


def sample_qc(genotypes: DataFrame, max_missing: float | None = None, het_min: float | None = None, het_max: float | None = None) -> DataFrame:
    """n_missing, n_het, their rates over all variants, and ``keep`` per sample."""
    d = F.col("dosage")
    a = genotypes.groupBy("sample_idx").agg(F.count_if(valid(d).isNull()).alias("n_missing"), F.count_if(d == 1).alias("n_het"), F.count(F.lit(1)).alias("n_variants"))
    return sample_flags(a, max_missing, het_min, het_max)


def sample_flags(a: DataFrame, max_missing: float | None = None, het_min: float | None = None, het_max: float | None = None) -> DataFrame:
    """Rates and ``keep`` of samples from n_missing, n_het and n_variants."""
    a = a.withColumn("missing_rate", F.col("n_missing") / F.col("n_variants")).withColumn("het_rate", F.col("n_het") / F.col("n_variants"))
    return a.withColumn("keep", at_most(F.col("missing_rate"), max_missing) & at_least(F.col("het_rate"), het_min) & at_most(F.col("het_rate"), het_max))


def frequency(stats: DataFrame) -> DataFrame:
    """The stored statistics: only their columns are read."""
    return stats.select("chr", "gidx", "n_samples", "mu_x", "sxx", "maf")


def variant_count(variants: DataFrame) -> DataFrame:
    return variants.groupBy("chr").agg(F.count(F.lit(1)).alias("n_variants"))
