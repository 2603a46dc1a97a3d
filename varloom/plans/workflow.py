"""The whole analysis as one driver-side plan: cohort, screen, joint LASSO with LOCO, scan, loci, fine-mapping.

Every stage writes its result below ``output_dir/<phenotype>/`` and later stages read that table back, so a run
that stops is taken up where it was (``resume``), and lineages stay short.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.operators import assoc, cohort, finemap, lasso, loci, packed, plotdata, screen, stats
from varloom.plans import config as conf
from varloom.sources import tables


def phenotypes(spark: SparkSession, cfg: dict) -> list[dict]:
    p = cfg["phenotype"]
    if p["mode"] == "batch":
        return tables.read_batch(spark, p["phenotype_list"])
    return [{"name": p["name"], "file": cfg["data"]["phe_file"], "type": p["type"]}]


def plan(spark: SparkSession, cfg: dict) -> list[tuple[str, str]]:
    """(phenotype, stage) in order."""
    names = ["cohort", *[n for n in ("screening", "joint_lasso", "gwas", "loci", "finemapping") if cfg[n]["run"]]]
    return [(p["name"], s) for p in phenotypes(spark, cfg) for s in names]


class Run:
    """One phenotype's stages."""

    def __init__(self, spark: SparkSession, cfg: dict, pheno: dict, resume: bool = True):
        self.spark, self.cfg, self.pheno, self.resume = spark, cfg, pheno, resume
        self.dir = os.path.join(cfg["general"]["output_dir"], pheno["name"])
        self.seconds: dict[str, float] = {}
        self.variants = spark.read.parquet(cfg["data"]["variants"]).where(F.col("chr").isin(*cfg["data"]["chromosomes"]))
        self.covariates = list(cfg["covariates"]["columns"])

    def stage(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        path = os.path.join(self.dir, name)
        if not (self.resume and os.path.exists(os.path.join(path, "_SUCCESS"))):
            t = time.time()
            build().write.mode("overwrite").parquet(path)
            self.seconds[name] = round(time.time() - t, 2)
        return self.spark.read.parquet(path)

    def n_samples(self) -> int:
        return self.variants.select("n_samples").first()[0]

    def cohort(self) -> DataFrame:
        master = tables.read_phenotypes(self.spark, self.pheno["file"] or self.cfg["data"]["phe_file"], [self.pheno["name"], *self.covariates])
        ph = master.select("fid", F.col(self.pheno["name"]).alias("y"))
        psam = tables.read_psam(self.spark, self.cfg["data"]["psam"])
        base = tables.read_keep(self.spark, self.cfg["cohort"]["base"]) if self.cfg["cohort"]["base"] else None
        binary = self.pheno["type"] == "binary" if self.cfg["cohort"]["binary"] is None else self.cfg["cohort"]["binary"]
        out, _ = cohort.prepare_cohort(ph, master.select("fid", *self.covariates), psam, base, "y", self.covariates, binary, self.cfg["cohort"]["impute_missing"])
        return out.join(master.select("fid", *self.covariates), "fid")

    def qc(self) -> DataFrame:
        q = self.cfg["qc"]
        if not q["variant"]:
            return self.variants
        keep = packed.variant_qc(self.variants, q["maf_min"], None, q["max_missing"], q["hwe_min"]).where("keep").select("chr", "gidx")
        return self.variants.join(keep, ["chr", "gidx"], "left_semi")

    def candidates(self, co: DataFrame) -> DataFrame:
        s, v = self.cfg["screening"], self.qc()
        counts = {r["chr"]: r["n"] for r in v.groupBy("chr").agg((F.max("vidx") + 1).alias("n")).collect()}
        want = conf.chunk_counts(self.cfg)
        parts = []
        by_k: dict[int, list[int]] = {}
        for c in counts:
            by_k.setdefault(want.get(c, 1), []).append(c)
        for k, chrs in sorted(by_k.items()):
            for i in range(k):
                # chunk i of each chromosome: one screen over all chromosomes that are cut alike
                edge = F.lit(False)
                for c in chrs:
                    e = screen.chunk_edges(counts[c], k)
                    if i < len(e):
                        edge = edge | ((F.col("chr") == c) & (F.col("vidx") >= e[i][0]) & (F.col("vidx") < e[i][1]))
                part = v.where(edge)
                g = packed.unpack_variants(part.where(F.col("maf") >= s["maf_min"]))
                parts.append(screen.screen(g, co, part.select("chr", "gidx", "vidx", "mu_x", "sxx", "maf"), s["window_size"], s["top_pct"], self.cfg["local_lasso"]["alpha"], s["maf_min"], s["strength"]))
        return screen.cap(tables.union_results(parts), self.cfg["joint_lasso"]["max_snps"], self.cfg["joint_lasso"]["max_snps_rank_by"])

    def loco(self, co: DataFrame, cand: DataFrame) -> DataFrame:
        j = self.cfg["joint_lasso"]
        if j["precomputed_loco"]:
            return self.spark.read.parquet(j["precomputed_loco"])
        g = packed.unpack_variants(self.variants.join(F.broadcast(cand.select("chr", "gidx")), ["chr", "gidx"], "left_semi"))
        fit = lasso.joint_lasso(g, cand, co, j["alpha"], "y_original", self.covariates, j["max_iter"], j["max_features"])
        if self.cfg["output"]["active_set"]:
            fit.table(self.spark).write.mode("overwrite").parquet(os.path.join(self.dir, "active_set"))
        chrs = [r[0] for r in self.variants.select("chr").distinct().collect()]
        if j["loco_mode"] == "ols":
            return lasso.loco_ols(g, fit, co, self.covariates, j["ridge"], chrs)
        mean = {int(a): float(m) for a, m in zip(fit.gidx, fit.mean, strict=True)}
        rows = [(int(r.gidx), int(r.chr), float(r.beta), mean[int(r.gidx)]) for r in lasso.coefficients(fit).itertuples() if r.active and r.chr > 0]
        rows += [(-1 - c, c, 0.0, 0.0) for c in chrs]
        coef = self.spark.createDataFrame(rows, "gidx long, chr int, beta double, mean double")
        return lasso.loco_masked(g, coef, fit.y_mean, co)

    def gwas(self, co: DataFrame, loco: DataFrame | None) -> DataFrame:
        c = self.cfg["gwas"]
        v = self.spark.read.parquet(c["variants"]) if c["variants"] else self.variants
        ann = c["annotation"] or self.cfg["data"]["annotation"]
        ann = self.spark.read.parquet(ann) if ann else None
        if c["family"] == "linear":
            yc = assoc.residual_phenotype(co, loco, "y_original") if loco is not None else assoc.residual_phenotype(co, None, "y_train")
            return assoc.annotate(packed.linear_gwas(v, yc, self.n_samples(), c["test"], c["maf_min"]), ann)
        v = v.where(F.col("maf") >= c["maf_min"])
        null = assoc.binary_null(v.select("chr").distinct(), co.select("sample_idx", F.col("y_original").alias("y")), loco)
        return assoc.annotate(packed.binary_gwas(v, null, self.n_samples(), min_mac=c["min_mac"], recalibrated=loco is not None), ann)

    def loci(self, ss: DataFrame) -> DataFrame:
        c = self.cfg["loci"]
        return loci.define_loci(ss, c["p_threshold"], c["window_kb"], c["merge_overlapping"], c["clump_window"], max_loci=c["max_loci"])

    def finemapping(self, lc: DataFrame, ss: DataFrame, co: DataFrame, loco: DataFrame | None, top: int | None = None) -> tuple[DataFrame, DataFrame]:
        c = self.cfg["finemapping"]
        ann = self.spark.read.parquet(self.cfg["gwas"]["annotation"] or self.cfg["data"]["annotation"])
        v = self.spark.read.parquet(self.cfg["gwas"]["variants"]) if self.cfg["gwas"]["variants"] else self.variants
        if top:
            lc = lc.orderBy("lead_p").limit(top)
        y = assoc.residual_phenotype(co, loco, "y_original" if loco is not None else "y_train").withColumnRenamed("yc", "y")
        w = None
        if c["tier"] == 2 and c["weights"]:
            m = loci.locus_variants(ann.select("gidx", "CHR", "POS"), lc).select("locus_id", "gidx").join(ss.select("gidx", "Z", "BETA", "SE", "MAF"), "gidx", "left")
            w = finemap.adaptive_weights(m, c["weights"], c["gamma"])
        return finemap.finemap(v, lc, ann, y, self.n_samples(), c["tier"], c["n_signals"], c["coverage"], c["max_variants"], c["lasso_cs_level"], c["pairs"], c["n_lambda"], weights=w)

    def all(self) -> dict[str, DataFrame]:
        cfg, out = self.cfg, {}
        co = out["cohort"] = self.stage("cohort", self.cohort)
        loco = None
        if cfg["qc"]["sample"]:
            q = packed.sample_qc(self.variants, cfg["qc"]["sample_max_missing"])
            co = co.join(q.where("keep").select("sample_idx"), "sample_idx", "left_semi")
        if cfg["screening"]["run"]:
            cand = out["candidates"] = self.stage("candidates", lambda: self.candidates(co))
            if cfg["joint_lasso"]["run"]:
                loco = out["loco"] = self.stage("loco", lambda: self.loco(co, cand))
        if cfg["gwas"]["run"]:
            ss = out["sumstats"] = self.stage("sumstats", lambda: self.gwas(co, loco))
            if cfg["output"]["plots"]:
                out["qq"] = self.stage("plot_qq", lambda: plotdata.qq(ss))
                out["manhattan"] = self.stage("plot_manhattan", lambda: plotdata.manhattan(ss, seed=cfg["general"]["seed"]))
            if cfg["loci"]["run"]:
                lc = out["loci"] = self.stage("loci", lambda: self.loci(ss))
                if cfg["finemapping"]["run"] and lc.limit(1).count():
                    per, summ = self.finemapping(lc, ss, co, loco)
                    out["finemapping"] = self.stage("finemapping", lambda: per)
                    out["finemapping_summary"] = self.stage("finemapping_summary", lambda: summ)
                    if cfg["finemapping"]["top_loci"]:
                        t = time.time()
                        self.finemapping(lc, ss, co, loco, cfg["finemapping"]["top_loci"])[0].write.mode("overwrite").parquet(os.path.join(self.dir, "finemapping_top"))
                        n = min(cfg["finemapping"]["top_loci"], lc.count())
                        self.seconds["per_1000_loci"] = round((time.time() - t) * 1000 / n, 1)
        with open(os.path.join(self.dir, "timing.json"), "w") as f:
            json.dump(self.seconds, f)
        return out


def run(spark: SparkSession, source: str | dict, dry_run: bool = False, resume: bool = True):
    """The plan (dry run), or {phenotype: {stage: DataFrame}}."""
    cfg = conf.load(source)
    if dry_run:
        return plan(spark, cfg)
    os.makedirs(cfg["general"]["output_dir"], exist_ok=True)
    with open(os.path.join(cfg["general"]["output_dir"], "config.resolved.json"), "w") as f:
        json.dump(cfg, f, indent=2)
    return {p["name"]: Run(spark, cfg, p, resume).all() for p in phenotypes(spark, cfg)}


def scan_pipeline(genotypes: DataFrame, pheno: DataFrame, covariates: list[str], alpha: float = 6e-4, joint_alpha: float = 6e-3, window_size: int = 8192, maf_min: float = 1e-3, annotation: DataFrame | None = None, y_col: str = "y") -> DataFrame:
    """Cohort to summary statistics in memory: residuals, screen, joint LASSO, LOCO, linear scan."""
    co, _ = cohort.residualise(pheno, y_col, covariates)
    cand = screen.screen(genotypes, co, window_size=window_size, alpha=alpha, maf_min=maf_min)
    fit = lasso.joint_lasso(genotypes, cand, co, joint_alpha, "y_original", covariates)
    loco = lasso.loco_ols(genotypes, fit, co, covariates, chromosomes=[r[0] for r in genotypes.select("chr").distinct().collect()])
    return assoc.gwas(genotypes, co.select("sample_idx", F.col("y_original").alias("y")), loco, annotation=annotation, maf_min=maf_min)
