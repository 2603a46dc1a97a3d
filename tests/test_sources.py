import gzip
import json
import os
import struct

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from varloom import fixtures as fx
from varloom.operators import packed
from varloom.plans import cli, config, workflow
from varloom.sources import convert, gtpack, tables
from varloom.streaming import arrivals


def test_file_round_trip(tmp_path):
    r = np.random.default_rng(0)
    d = r.integers(0, 4, (6, 11)).astype(float)
    d[d == 3] = np.nan
    for enc in (gtpack.BIT2, gtpack.U8, gtpack.F16, gtpack.F32):
        p = str(tmp_path / f"chr1-{enc}.gtpack")
        gtpack.write_file(p, d, gidx=np.arange(6) * 10, encoding=enc)
        assert gtpack.validate(p)["ok"]
        with gtpack.Reader(p) as f:
            assert f.shape == (11, 6) and list(f.gidx) == [0, 10, 20, 30, 40, 50]
            np.testing.assert_array_equal(f.dosages(), d.astype(np.float32))
            np.testing.assert_array_equal(f.dosages_at([4, 1, 4, 2]), d[[4, 1, 4, 2]].astype(np.float32))
            assert np.allclose(f.mu_x, np.nanmean(d, 1), atol=1e-6)
    assert gtpack.info(p)["n_variants"] == 6


def test_validation_reports(tmp_path):
    p = str(tmp_path / "x.gtpack")
    gtpack.write_file(p, np.zeros((3, 5)))
    raw = bytearray(open(p, "rb").read())
    struct.pack_into("<Q", raw, 48, 300)
    open(p, "wb").write(raw[:310])
    bad = gtpack.validate(p)
    assert not bad["ok"] and any("overlaps" in x for x in bad["problems"]) and any("ends at" in x for x in bad["problems"])
    assert not gtpack.validate(str(tmp_path / "none"))["ok"]
    with pytest.raises(ValueError), gtpack.Writer(p, 5, 2) as w:
        w.add(np.zeros(5))
    with pytest.raises(ValueError):
        gtpack.read_header(p, b"OTHERMAG")


def test_spark_source_and_sink(spark, tmp_path):
    gtpack.register(spark)
    g = fx.genotypes(spark, SF)
    n = 500
    v = packed.pack_variants(g, n)
    out = str(tmp_path / "set")
    gtpack.prepare_for_write(v, 3).write.format("gtpack").mode("append").save(out)
    assert all(gtpack.validate(p)["ok"] for p in gtpack.files(out)) and len(gtpack.files(out)) == 8
    back = spark.read.format("gtpack").option("rows_per_split", 3).load(out)
    key = lambda d: {(r.chr, r.gidx, r.vidx): bytes(r.packed) for r in d.collect()}
    assert key(back) == key(v)
    assert spark.read.format("gtpack").option("stats_only", "true").load(out).where("packed is not null").count() == 0
    assert back.where("chr = 2 and vidx >= 2 and vidx < 5").count() == 3


def test_subset_folder(spark, tmp_path):
    v = packed.pack_variants(fx.genotypes(spark, SF), 500)
    out = str(tmp_path / "sub")
    assert packed.subset_to(v.where("chr <= 2"), range(10), out).count() == 16
    assert packed.subset_to(v, range(10), out).count() == 64


VCF = """##fileformat=VCFv4.2
#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\tc
1\t100\tr1\tA\tG\t.\t.\t.\tGT:DP\t0/0:3\t0|1:4\t1/1:2
chr1\t200\tr2\tC\tT\t.\t.\t.\tDP:GT\t3:./.\t1:1|0\t2:0/.
1\t300\tr3\tC\tT,G\t.\t.\t.\tGT\t0/1\t0/2\t1/2
2\t50\tr4\tG\tA\t.\t.\t.\tGT\t0/0\t0/0\t0/0
"""


def test_vcf(spark, tmp_path):
    p = str(tmp_path / "x.vcf.gz")
    with gzip.open(p, "wt") as f:
        f.write(VCF)
    g, ann, s = convert.read_vcf(spark, p)
    d = g.orderBy("gidx", "sample_idx").toPandas().pivot(index="gidx", columns="sample_idx", values="dosage")
    assert d.fillna(-1).values.tolist() == [[0, 1, 2], [-1, 1, -1], [0, 0, 0]]
    assert [r.ID for r in ann.orderBy("gidx").collect()] == ["r1", "r2", "r4"] and s.count() == 3
    g, ann, _ = convert.read_vcf(spark, p, region=("chr1", 150, 400))
    assert [r.ID for r in ann.collect()] == ["r2"]
    keep = spark.createDataFrame([("b",)], "id string")
    g, ann, s = convert.read_vcf(spark, p, keep=keep, min_ac=1)
    assert [r.sample_idx for r in s.collect()] == [1] and ann.count() == 2 and g.count() == 2


def test_bed(spark, tmp_path):
    stem = str(tmp_path / "x")
    codes = [[0, 1, 2, 3, 0], [3, 3, 2, 0, 1], [2, 2, 2, 2, 2]]  # PLINK codes
    with open(stem + ".bed", "wb") as f:
        f.write(b"\x6c\x1b\x01")
        for row in codes:
            c = row + [0] * 3
            f.write(bytes(sum(c[4 * k + j] << (2 * j) for j in range(4)) for k in range(2)))
    open(stem + ".bim", "w").write("1 a 0 10 A G\n1 b 0 20 A G\n2 c 0 30 C T\n")
    open(stem + ".fam", "w").write("".join(f"f{i} i{i} 0 0 1 -9\n" for i in range(5)))
    v, ann, s = convert.read_bed(spark, stem + ".bed", rows_per_task=2)
    d = packed.unpack_variants(v).orderBy("gidx", "sample_idx").toPandas()
    lut = {0: 0, 1: -1, 2: 1, 3: 2}
    assert d.dosage.fillna(-1).tolist() == [lut[c] for row in codes for c in row]
    assert [r.id for r in s.orderBy("sample_idx").collect()] == [f"i{i}" for i in range(5)] and ann.count() == 3
    open(stem + ".bed", "wb").write(b"\x6c\x1b\x00")
    with pytest.raises(ValueError):
        convert.read_bed(spark, stem + ".bed")
    with pytest.raises((ImportError, NotImplementedError)):
        convert.read_pgen("x")


def test_tables(spark, tmp_path):
    w = tables.read_weights(spark, {3: 0.5})
    assert w.first().beta == 0.5
    np.savez(tmp_path / "w.npz", gidx=[1, 2], WEIGHT=[0.1, 0.2])
    assert tables.read_weights(spark, str(tmp_path / "w.npz")).count() == 2
    tables.write_table(w.withColumnRenamed("beta", "BETA"), str(tmp_path / "w.tsv.gz"), single=True)
    assert tables.read_weights(spark, str(tmp_path / "w.tsv.gz")).first().beta == 0.5
    assert tables.read_indices(spark, [5, 2, 5]).where("sample_idx = 5").count() == 2
    np.save(tmp_path / "i.npy", [3, 1])
    assert [r.sample_idx for r in tables.read_indices(spark, str(tmp_path / "i.npy")).orderBy("new_idx").collect()] == [3, 1]
    w.withColumn("x", F.lit(1)).write.parquet(str(tmp_path / "cand" / "chr=7"))
    assert tables.read_candidates(spark, str(tmp_path / "cand")).first().chr == 7
    assert convert.write_samples(str(tmp_path / "s"), ["x", "y"]).endswith(".samples.txt")
    (tmp_path / "k.txt").write_text("f1 f1\nf2\n\n")
    assert tables.read_keep(spark, str(tmp_path / "k.txt")).count() == 2


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("wf")
    g = fx.genotypes(spark, SF)
    packed.pack_variants(g, 500).write.parquet(str(d / "variants.parquet"))
    fx.annotation(spark, SF).write.parquet(str(d / "annotation.parquet"))
    p = fx.phenotypes_sig(spark, SF).orderBy("sample_idx").toPandas()
    with open(d / "phe.tsv", "w") as f:
        f.write("#FID\tage\tsex\ttrait\n" + "".join(f"{r.fid}\t{r.age}\t{r.sex}\t{'NA' if r.sample_idx == 7 else r.y_sig}\n" for r in p.itertuples()))
    (d / "x.psam").write_text("#FID IID\n" + "".join(f"{f} {f}\n" for f in p.fid))
    cfg = {"general": {"name": "t", "output_dir": str(d / "out")}, "data": {"variants": str(d / "variants.parquet"), "annotation": str(d / "annotation.parquet"), "phe_file": str(d / "phe.tsv"), "psam": str(d / "x.psam"), "chromosomes": list(range(1, 9))}, "phenotype": {"name": "trait"}, "covariates": {"columns": ["age", "sex"]}, "screening": {"window_size": 64, "split_chrs": ["1:4"], "split_chrs_by": [2]}, "joint_lasso": {"alpha": 0.2}, "finemapping": {"tier": 2, "pairs": 4, "n_lambda": 5}}
    (d / "cfg.json").write_text(json.dumps(cfg))
    return d, cfg


def test_workflow(spark, project):
    d, cfg = project
    assert workflow.run(spark, cfg, dry_run=True)[0] == ("trait", "cohort")
    out = workflow.run(spark, str(d / "cfg.json"))["trait"]
    assert out["cohort"].count() == 499
    lead = out["loci"].orderBy("lead_p").toPandas()
    assert {5, 40} <= set(lead.lead_gidx)
    best = out["finemapping"].orderBy(F.desc("susie_pip")).toPandas()
    assert {5, 40} <= set(best.gidx[best.susie_pip > 0.5])
    again = workflow.run(spark, cfg)["trait"]
    assert again["sumstats"].count() == out["sumstats"].count()
    assert os.path.exists(os.path.join(cfg["general"]["output_dir"], "config.resolved.json"))


def test_masked_loco_and_top_loci(spark, project):
    d, cfg = project
    c = config.merge(cfg, {"general": {"output_dir": str(d / "out2")}, "joint_lasso": {"loco_mode": "masked"}, "finemapping": {"tier": 1, "top_loci": 1}, "qc": {"variant": True, "maf_min": 0.05}})
    out = workflow.run(spark, c)["trait"]
    assert out["loco"].select("chr").distinct().count() == 8


def test_config(tmp_path):
    p = str(tmp_path / "e.json")
    config.write_example(p)
    cfg = config.load(p)
    assert config.chunk_counts(cfg)[11] == 2 and config.chunk_counts(cfg)[12] == 1
    with pytest.raises(ValueError, match="unknown"):
        config.load({"data": {"variantz": 1}})
    with pytest.raises(ValueError, match="test must be"):
        config.load({"data": {"variants": "x"}, "phenotype": {"name": "y"}, "gwas": {"test": "f"}})
    assert list(config.parse_range("3:5")) == [3, 4, 5]


def test_cli(spark, project, capsys, tmp_path):
    d, cfg = project
    f = str(tmp_path / "chr1.gtpack")
    gtpack.write_file(f, np.ones((2, 3)))
    assert cli.main(["info", f]) == 0 and '"n_variants": 2' in capsys.readouterr().out
    assert cli.main(["validate", f]) == 0
    assert cli.main(["freq", cfg["data"]["variants"], "--out", str(tmp_path / "freq.parquet")]) == 0
    assert spark.read.parquet(str(tmp_path / "freq.parquet")).count() == 64
    assert cli.main(["qc", cfg["data"]["variants"], "--maf-min", "0.2", "--out", str(tmp_path / "qc.parquet")]) == 0
    assert cli.main(["prep", cfg["data"]["phe_file"], "trait", cfg["data"]["psam"], "--covariates", "age,sex", "--out", str(tmp_path / "co.parquet")]) == 0
    assert cli.main(["gwas", cfg["data"]["variants"], str(tmp_path / "co.parquet"), "--out", str(tmp_path / "ss.parquet")]) == 0
    assert spark.read.parquet(str(tmp_path / "ss.parquet")).count() == 64
    v = tmp_path / "x.vcf"
    v.write_text(VCF)
    assert cli.main(["convert", "vcf", str(v), str(tmp_path / "conv")]) == 0
    assert cli.main(["workflow", str(d / "cfg.json"), "--dry-run"]) == 0


def test_stream(spark, tmp_path):
    v = packed.pack_variants(fx.genotypes(spark, SF), 500)
    src = str(tmp_path / "in")
    v.where("chr <= 4").write.parquet(src)
    args = (arrivals.arriving_variants(spark, src), str(tmp_path / "out"), str(tmp_path / "ck"))
    arrivals.qc_stream(*args, maf_min=0.2).awaitTermination(120)
    v.where("chr > 3").write.mode("append").parquet(src)
    arrivals.qc_stream(arrivals.arriving_variants(spark, src), str(tmp_path / "out"), str(tmp_path / "ck"), maf_min=0.2).awaitTermination(120)
    assert arrivals.latest(spark, str(tmp_path / "out")).count() == 64


def test_bed_is_written_and_read_by_tasks(spark, tmp_path, monkeypatch):
    """No call and no sample id passes the driver; samples keep the file's order over many parts."""
    from pyspark.sql.classic.dataframe import DataFrame

    from varloom.registry import QUERIES

    def never(*_, **__):
        raise AssertionError("rows through the driver")

    monkeypatch.setattr(DataFrame, "toLocalIterator", never)
    n = QUERIES["plink_import"](spark, SF).where("dosage is not null").count()
    assert n == fx.genotypes(spark, SF).where("dosage is not null").count()
    stem, n = str(tmp_path / "x"), 4001
    g = spark.range(n).selectExpr("id as sample_idx", "1 as chr", "3L as gidx", "cast(case when id % 5 < 3 then id % 5 end as tinyint) as dosage")
    assert convert.write_bed(packed.pack_variants(g.unionByName(g.withColumn("gidx", F.lit(9).cast("long"))), n), n, stem + ".bed") == 2
    open(stem + ".bim", "w").write("1 a 0 5 G A\n1 b 0 6 G A\n")
    open(stem + ".fam", "w").writelines(f"f{i} i{i} 0 0 0 -9\n" for i in range(n))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        v, _, s = convert.read_bed(spark, stem + ".bed")
        assert s.rdd.getNumPartitions() > 3
        assert sorted(map(tuple, s.collect())) == [(i, f"i{i}") for i in range(n)]
        assert packed.unpack_variants(v).where("gidx = 1").join(g.select("sample_idx", F.col("dosage").alias("d")), "sample_idx").where("dosage <=> d").count() == n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
