"""Short names for the operators, as genetics users know them."""

from __future__ import annotations

from varloom.operators import assoc, ld, loci, stats, subset
from varloom.operators.finemap import finemap
from varloom.operators.score import score
from varloom.operators.subset import exclude_variants as exclude
from varloom.operators.subset import extract_variants as extract
from varloom.operators.subset import keep_samples as keep
from varloom.operators.subset import remove_samples as remove

freq = stats.frequency
clump = loci.define_loci
r2 = ld.ld_r2
ld_matrix = ld.gram
ld_clump = ld.ld_prune
make_king = king = ld.king
make_grm = grm = realized_relationship_matrix = ld.grm
pca = hwe_normalized_pca = ld.pca
pc_project = ld.pc_project
repair = subset.repair_report


def glm(genotypes, pheno, **kw):
    return assoc.gwas(genotypes, pheno, **kw)


def linear_regression_rows(genotypes, pheno, **kw):
    return assoc.gwas(genotypes, pheno, family="linear", **kw)


def logistic_regression_rows(genotypes, pheno, **kw):
    return assoc.gwas(genotypes, pheno, family="binary", **kw)


def susie(*args, **kw):
    """Tier 1 fine-mapping."""
    return finemap(*args, tier=1, **kw)


def consensus_map(*args, **kw):
    """Tier 2 fine-mapping."""
    return finemap(*args, tier=2, **kw)


def spark_info(spark) -> dict:
    sc = spark.sparkContext
    return {"version": spark.version, "master": sc.master, "parallelism": sc.defaultParallelism, "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions")}


__all__ = ["clump", "consensus_map", "exclude", "extract", "freq", "glm", "grm", "keep", "king", "ld_clump", "ld_matrix", "linear_regression_rows", "logistic_regression_rows", "make_grm", "make_king", "pc_project", "pca", "r2", "remove", "repair", "score", "spark_info", "susie"]
