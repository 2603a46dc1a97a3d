"""Locus definition: greedy clumping, flanks, interval merging, the HLA region."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HLA = (6, 25_000_000, 34_000_000)


def significant(sumstats: DataFrame, p_threshold: float = 5e-8) -> DataFrame:
    """Rows with P below the threshold and a numeric CHR; the filter reaches the scan."""
    s = sumstats.withColumn("CHR", F.expr("try_cast(CHR AS INT)"))
    return s.where(F.col("CHR").isNotNull() & (F.col("P") < p_threshold)).select("CHR", F.col("POS").cast("long").alias("POS"), "gidx", F.col("ID").cast("string").alias("ID"), F.col("P").cast("double").alias("P"))


def clump(hits: DataFrame, window: int = 1_000_000, islands_per_group: int = 64) -> DataFrame:
    """Leads: the best remaining hit takes all hits within ``window`` on its chromosome, again and again.

    Order is (P, POS, gidx). A chromosome's hits are first cut where two neighbours are more than ``window``
    apart: no clump crosses such a gap, so islands of hits are independent and a long chromosome is not one
    task. Groups hold significant rows only.
    """
    w = W.partitionBy("CHR").orderBy("POS", "gidx")
    gap = (F.col("POS") - F.lag("POS").over(w) > window).cast("int")
    # some islands share a group, as each group costs a call
    isl = hits.withColumn("island", F.floor(F.sum(F.coalesce(gap, F.lit(0))).over(w) / islands_per_group))

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["P", "POS", "gidx"], kind="stable")
        pos = pdf.POS.to_numpy()
        free = pd.Series(True, index=range(len(pdf))).to_numpy()
        take = []
        for i in range(len(pos)):
            if free[i]:
                take.append(i)
                free &= abs(pos - pos[i]) > window
        return pdf.iloc[take][["CHR", "POS", "gidx", "ID", "P"]]

    return isl.groupBy("CHR", "island").applyInPandas(greedy, "CHR int, POS long, gidx long, ID string, P double")


def flank(leads: DataFrame, hits: DataFrame, window_kb: int = 500) -> DataFrame:
    """start_bp, end_bp around each lead and the number of hits inside.

    Counted by prefix: hits with POS <= end less those with POS < start, from one ordered pass over hits and
    bounds, so there is no range self-join.
    """
    half = window_kb * 1000
    iv = leads.select("CHR", F.col("POS").alias("lead_pos"), F.col("gidx").alias("lead_gidx"), F.col("ID").alias("lead_id"), F.col("P").alias("lead_p"), F.greatest(F.col("POS") - half, F.lit(0)).alias("start_bp"), (F.col("POS") + half).alias("end_bp"))
    # at equal positions: a start bound sorts before the hits (kind 0), an end bound after them (kind 2)
    pts = hits.select("CHR", F.col("POS").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("lead_gidx"))
    pts = pts.unionByName(iv.select("CHR", F.col("start_bp").alias("at"), F.lit(0).alias("kind"), "lead_gidx")).unionByName(iv.select("CHR", F.col("end_bp").alias("at"), F.lit(2).alias("kind"), "lead_gidx"))
    run = F.sum((F.col("kind") == 1).cast("long")).over(W.partitionBy("CHR").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0))
    n = pts.withColumn("c", run).where("kind <> 1").groupBy("CHR", "lead_gidx").agg((F.max(F.when(F.col("kind") == 2, F.col("c"))) - F.max(F.when(F.col("kind") == 0, F.col("c")))).alias("n_gws_variants"))
    return iv.join(n, ["CHR", "lead_gidx"])


def merge_overlapping(loci: DataFrame) -> DataFrame:
    """Overlapping intervals of a chromosome become one: hits add up, the lead is that with the smallest P."""
    w = W.partitionBy("CHR").orderBy("start_bp", "lead_pos", "lead_gidx")
    before = F.max("end_bp").over(w.rowsBetween(W.unboundedPreceding, -1))
    g = loci.withColumn("new", F.coalesce((F.col("start_bp") > before).cast("int"), F.lit(1))).withColumn("grp", F.sum("new").over(w))
    best = F.min(F.struct("lead_p", "lead_pos", "lead_gidx", "lead_id")).alias("b")
    m = g.groupBy("CHR", "grp").agg(F.min("start_bp").alias("start_bp"), F.max("end_bp").alias("end_bp"), F.sum("n_gws_variants").alias("n_gws_variants"), best)
    return m.select("CHR", "b.lead_gidx", "b.lead_pos", "b.lead_id", "b.lead_p", "start_bp", "end_bp", "n_gws_variants")


def collapse_hla(loci: DataFrame, hla: tuple[int, int, int] = HLA) -> DataFrame:
    """Loci that touch the HLA region become one when there are several; ``is_hla`` marks them."""
    c, a, b = hla
    inside = (F.col("CHR") == c) & (F.col("start_bp") <= b) & (F.col("end_bp") >= a)
    tag = loci.withColumn("is_hla", inside).withColumn("key", F.when(inside, F.lit("hla")).otherwise(F.col("lead_gidx").cast("string")))
    best = F.min(F.struct("lead_p", "lead_pos", "lead_gidx", "lead_id")).alias("b")
    m = tag.groupBy("CHR", "key").agg(F.min("start_bp").alias("start_bp"), F.max("end_bp").alias("end_bp"), F.sum("n_gws_variants").alias("n_gws_variants"), best, F.max("is_hla").alias("is_hla"))
    return m.select("CHR", "b.lead_gidx", "b.lead_pos", "b.lead_id", "b.lead_p", "start_bp", "end_bp", "n_gws_variants", "is_hla")


def number(loci: DataFrame, max_loci: int | None = None) -> DataFrame:
    """The ``max_loci`` smallest lead P, renumbered 1..L by (CHR, start). Loci are few: one row a locus."""
    if max_loci is not None:
        loci = loci.orderBy("lead_p", "CHR", "start_bp").limit(max_loci)
    out = loci.withColumn("locus_id", F.row_number().over(W.orderBy("CHR", "start_bp", "lead_gidx")))
    return out.withColumn("size_kb", (F.col("end_bp") - F.col("start_bp")) / 1000.0)


def define_loci(sumstats: DataFrame, p_threshold: float = 5e-8, window_kb: int = 500, merge: bool = True, clump_window: int = 1_000_000, hla: tuple[int, int, int] | None = HLA, chromosomes: list[int] | None = None, max_loci: int | None = None) -> DataFrame:
    hits = significant(sumstats, p_threshold)
    if chromosomes:
        hits = hits.where(F.col("CHR").isin(*chromosomes))
    loci = flank(clump(hits, clump_window), hits, window_kb)
    if merge:
        loci = merge_overlapping(loci)
    loci = collapse_hla(loci, hla) if hla else loci.withColumn("is_hla", F.lit(False))
    out = number(loci, max_loci)
    return out.select("locus_id", "CHR", "start_bp", "end_bp", "size_kb", "lead_gidx", "lead_pos", "lead_p", "lead_id", "n_gws_variants", "is_hla")


def with_aliases(loci: DataFrame) -> DataFrame:
    """The second set of names that some readers expect."""
    return loci.select("*", F.col("CHR").alias("chrom"), F.col("start_bp").alias("start"), F.col("end_bp").alias("end"), F.col("n_gws_variants").alias("n_signif"), F.col("size_kb").alias("span_kb"))


def locus_variants(annotation: DataFrame, loci: DataFrame, bin_bp: int = 1_000_000) -> DataFrame:
    """Variants with start <= POS <= end of each locus: a range join by equality on position bins."""
    a = annotation.withColumn("bin", F.floor(F.col("POS") / bin_bp))
    b = loci.select("locus_id", "CHR", "start_bp", "end_bp").withColumn("bin", F.explode(F.sequence(F.floor(F.col("start_bp") / bin_bp), F.floor(F.col("end_bp") / bin_bp))))
    return a.join(b, ["CHR", "bin"]).where((F.col("POS") >= F.col("start_bp")) & (F.col("POS") <= F.col("end_bp"))).drop("bin", "start_bp", "end_bp")
