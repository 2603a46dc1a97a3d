"""Command line: ``python -m varloom <command>``, or one JSON file to run a workflow."""

from __future__ import annotations

import argparse
import json
import sys

from varloom.plans import config, workflow
from varloom.session import local_session
from varloom.sources import gtpack, tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("varloom")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, *args: tuple, **flags):
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        for k, (kind, default) in flags.items():
            c.add_argument("--" + k.replace("_", "-"), dest=k, **({"action": "store_true"} if kind is bool else {"type": kind, "default": default}))
        return c

    add("info", "path")
    add("validate", "path")
    add("freq", "variants", out=(str, None))
    add("qc", "variants", out=(str, None), maf_min=(float, None), max_missing=(float, None), hwe_min=(float, None), samples=(bool, False))
    add("score", "variants", "weights", out=(str, None), no_center=(bool, False))
    add("prep", "phenotypes", "name", "psam", out=(str, None), covariates=(str, ""), binary=(bool, False), keep=(str, None))
    add("gwas", "variants", "cohort", out=(str, None), test=(str, "wald"), maf_min=(float, 1e-3), annotation=(str, None), loco=(str, None))
    add("convert", "kind", "source", "out", gidx_start=(int, 0), region=(str, None))
    add("workflow", "config", dry_run=(bool, False))
    add("example-config", "path")
    return p


def load_variants(spark, path: str):
    """Packed rows from Parquet, or from genotype files."""
    if path.endswith(".parquet") or "=" in path:
        return spark.read.parquet(path)
    gtpack.register(spark)
    return spark.read.format("gtpack").load(path)


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    if len(argv) == 1 and argv[0].endswith(".json"):
        argv = ["workflow", argv[0]]
    a = parser().parse_args(argv)
    if a.command in ("info", "validate"):
        got = (gtpack.info if a.command == "info" else gtpack.validate)(a.path)
        print(json.dumps(got, default=str))
        return 0 if got.get("ok", True) else 1
    if a.command == "example-config":
        config.write_example(a.path)
        return 0
    spark = local_session()
    from pyspark.sql import functions as F

    from varloom.operators import assoc, cohort, packed, stats
    from varloom.sources import convert

    if a.command == "workflow":
        got = workflow.run(spark, a.config, a.dry_run)
        print(json.dumps(got if a.dry_run else {k: sorted(v) for k, v in got.items()}))
        return 0
    if a.command == "freq":
        df = stats.frequency(load_variants(spark, a.variants))
    elif a.command == "qc" and a.samples:
        c = packed.sample_counts(load_variants(spark, a.variants))
        df = c.withColumn("missing_rate", F.col("n_missing") / F.col("n_variants")).withColumn("het_rate", F.col("n_het") / F.col("n_variants")).withColumn("keep", stats.at_most(F.col("missing_rate"), a.max_missing))
    elif a.command == "qc":
        df = packed.variant_qc(load_variants(spark, a.variants), a.maf_min, None, a.max_missing, a.hwe_min)
    elif a.command == "score":
        v = load_variants(spark, a.variants)
        df = packed.score(v, tables.read_weights(spark, a.weights), v.select("n_samples").first()[0], not a.no_center)
    elif a.command == "prep":
        cov = [c for c in a.covariates.split(",") if c]
        m = tables.read_phenotypes(spark, a.phenotypes, [a.name, *cov])
        base = tables.read_keep(spark, a.keep) if a.keep else None
        df, _ = cohort.prepare_cohort(m.select("fid", F.col(a.name).alias("y")), m.select("fid", *cov), tables.read_psam(spark, a.psam), base, "y", cov, a.binary)
    elif a.command == "gwas":
        v = load_variants(spark, a.variants)
        loco = spark.read.parquet(a.loco) if a.loco else None
        yc = assoc.residual_phenotype(spark.read.parquet(a.cohort), loco, "y_original" if a.loco else "y_train")
        df = assoc.annotate(packed.linear_gwas(v, yc, v.select("n_samples").first()[0], a.test, a.maf_min), spark.read.parquet(a.annotation) if a.annotation else None)
    else:
        if a.kind == "vcf":
            region = None
            if a.region:
                c, _, span = a.region.partition(":")
                lo, _, hi = span.partition("-")
                region = (c, int(lo), int(hi))
            g, ann, samples = convert.read_vcf(spark, a.source, region, gidx_start=a.gidx_start)
            v = packed.pack_variants(g, samples.count())
        elif a.kind == "bed":
            v, ann, samples = convert.read_bed(spark, a.source, gidx_start=a.gidx_start)
        else:
            convert.read_pgen(a.source)
            return 1
        gtpack.register(spark)
        gtpack.prepare_for_write(v).write.format("gtpack").mode("append").save(a.out)
        ann.write.mode("overwrite").parquet(f"{a.out}/annotation.parquet")
        convert.write_samples(f"{a.out}/all", [r.id for r in samples.orderBy("sample_idx").collect()])
        bad = [p for p in gtpack.files(a.out) if p.endswith(gtpack.SUFFIX) and not gtpack.validate(p)["ok"]]
        return 1 if bad else 0
    if a.out:
        tables.write_table(df, a.out)
    else:
        df.show(20, False)
    return 0
