"""Sample and variant subsets of the long view, statistics repair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.operators.stats import variant_stats


def keep_samples(genotypes: DataFrame, samples: DataFrame, invert: bool = False) -> DataFrame:
    return genotypes.join(samples.select("sample_idx").distinct(), "sample_idx", "left_anti" if invert else "left_semi")


def remove_samples(genotypes: DataFrame, samples: DataFrame) -> DataFrame:
    return keep_samples(genotypes, samples, invert=True)


def extract_variants(genotypes: DataFrame, variants: DataFrame, invert: bool = False) -> DataFrame:
    return genotypes.join(variants.select("gidx").distinct(), "gidx", "left_anti" if invert else "left_semi")


def exclude_variants(genotypes: DataFrame, variants: DataFrame) -> DataFrame:
    return extract_variants(genotypes, variants, invert=True)


def reindex_samples(genotypes: DataFrame, order: DataFrame) -> DataFrame:
    """Gather samples in the order of (new_idx, sample_idx); a sample may be taken more than once."""
    return genotypes.join(order, "sample_idx").drop("sample_idx").withColumnRenamed("new_idx", "sample_idx")


def repair_report(genotypes: DataFrame, stored: DataFrame, rel: float = 1e-3) -> DataFrame:
    """Stored against recomputed statistics per variant, and which need repair: a relative change of sxx
    above ``rel``, or a zero frequency where there is variation."""
    new = variant_stats(genotypes).select("chr", "gidx", F.col("mu_x").alias("mu_new"), F.col("sxx").alias("sxx_new"), F.col("maf").alias("maf_new"))
    j = stored.select("chr", "gidx", F.col("sxx").alias("sxx_old"), F.col("maf").alias("maf_old")).join(new, ["chr", "gidx"])
    delta = F.abs(F.col("sxx_new") - F.col("sxx_old")) / F.greatest(F.abs("sxx_new"), F.lit(1e-12))
    j = j.withColumn("rel_change", F.when((F.col("sxx_new") == 0) & (F.col("sxx_old") == 0), 0.0).otherwise(delta))
    j = j.withColumn("was_zeroed", (F.col("sxx_old") < 1e-6) & (F.col("sxx_new") > 1))
    return j.withColumn("repair", (F.col("rel_change") > rel) | ((F.col("maf_old") == 0) & (F.col("maf_new") > 0)))


def repair_summary(report: DataFrame) -> DataFrame:
    return report.groupBy("chr").agg(F.count(F.lit(1)).alias("n_variants"), F.count_if("repair").alias("n_repaired"), F.count_if("was_zeroed").alias("n_sxx_zeroed"), F.max("rel_change").alias("max_rel_change"))
