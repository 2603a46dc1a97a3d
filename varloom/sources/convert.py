"""Genotype imports: VCF text, PLINK 1 binaries; and the sample sidecar."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from varloom.functions.codec import DECODE, pack
from varloom.operators.cohort import rank_in_order
from varloom.session import ship

#: PLINK 1 two-bit codes to ours: 00 -> 0, 01 -> missing, 10 -> 1, 11 -> 2; its first sample is in the low bits.
BED_LUT = np.array([0, 3, 1, 2], np.uint8)
#: The PLINK 1 byte of each of our bytes.
BED_BYTES = (np.argsort(BED_LUT)[DECODE] << np.array([0, 2, 4, 6])).sum(1).astype(np.uint8)


def write_samples(path: str, ids: list[str]) -> str:
    """One id a line beside the genotype file."""
    out = path + ".samples.txt"
    with open(out, "w") as f:
        f.write("".join(f"{i}\n" for i in ids))
    return out


def vcf_lines(spark: SparkSession, path: str) -> DataFrame:
    """Data lines of VCF text (plain or gzip, a file or many)."""
    return spark.read.text(path).where(~F.startswith("value", F.lit("#")) & (F.length("value") > 0))


def vcf_samples(spark: SparkSession, path: str) -> list[str]:
    head = spark.read.text(path).where(F.startswith("value", F.lit("#CHROM"))).first()
    if head is None:
        raise ValueError(f"{path}: no #CHROM line")
    return head.value.split("\t")[9:]


def read_vcf(spark: SparkSession, path: str, region: tuple[str, int, int] | None = None, keep: DataFrame | None = None, gidx_start: int = 0, min_ac: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(genotypes, annotation, samples) of biallelic records.

    The dosage counts ALT alleles in GT; any missing allele makes the call missing; records with several ALT
    alleles are left out (split them first). ``keep`` has (id); ``min_ac`` drops rarer alternate alleles.
    """
    ids = vcf_samples(spark, path)
    samples = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "sample_idx long, id string")
    f = F.split("value", "\t")
    v = vcf_lines(spark, path).select(F.regexp_replace(f[0], "^chr", "").alias("chrom"), f[1].cast("long").alias("POS"), f[2].alias("ID"), f[3].alias("REF"), f[4].alias("ALT"), F.array_position(F.split(f[8], ":"), "GT").cast("int").alias("gt"), F.slice(f, 10, len(ids)).alias("calls"))
    v = v.where(~F.contains("ALT", F.lit(",")) & (F.col("gt") > 0))
    if region:
        v = v.where((F.col("chrom") == str(region[0]).removeprefix("chr")) & F.col("POS").between(region[1], region[2]))
    gt = F.transform("calls", lambda c: F.get(F.split(c, ":"), F.col("gt") - 1))
    dose = F.transform(gt, lambda c: F.when(F.contains(c, F.lit(".")), F.lit(None)).otherwise(F.size(F.filter(F.split(c, "[/|]"), lambda a: a == "1"))).cast("tinyint"))
    v = v.withColumn("dose", dose)
    if min_ac is not None:
        v = v.where(F.aggregate("dose", F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) >= min_ac)
    v = v.withColumn("CHR", F.expr("try_cast(chrom AS INT)"))
    v = rank_in_order(v, ["CHR", "POS", "REF", "ALT", "ID"], "gidx").withColumn("gidx", (F.col("gidx") + gidx_start).cast("long"))
    ann = v.select("gidx", "CHR", "POS", "ID", "REF", "ALT")
    g = v.select(F.col("CHR").alias("chr"), "gidx", F.posexplode("dose").alias("s", "dosage")).select(F.col("s").cast("long").alias("sample_idx"), "chr", "gidx", "dosage")
    if keep is not None:
        samples = samples.join(keep.select("id"), "id", "left_semi").select("sample_idx", "id")
        g = g.join(samples.select("sample_idx"), "sample_idx", "left_semi")
    return g, ann, samples


def write_bed(variants: DataFrame, n_samples: int, bed: str) -> int:
    """The packed rows as a PLINK 1 .bed on a mounted path, in order of gidx; the number of variants.

    Each task writes its variants at their places in the file, so no call passes the driver.
    """
    ship(variants.sparkSession)
    rows = rank_in_order(variants.select("gidx", "packed"), "gidx", "place")
    size = (n_samples + 3) // 4
    with open(bed, "wb") as f:
        f.write(b"\x6c\x1b\x01")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            with open(bed, "r+b") as f:
                for place, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    f.seek(3 + place * size)
                    f.write(BED_BYTES[np.frombuffer(raw.as_buffer(), np.uint8)].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return rows.select(F.col("place").cast("long"), "packed").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_bed(spark: SparkSession, bed: str, bim: str | None = None, fam: str | None = None, gidx_start: int = 0, rows_per_task: int = 4096) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(packed variants, annotation, samples) of a PLINK 1 file set; each task reads its own range of the file."""
    stem = os.path.splitext(bed)[0]
    ship(spark)
    fam_rows = spark.read.text(fam or stem + ".fam").select(F.split(F.trim("value"), r"\s+").alias("f"), F.monotonically_increasing_id().alias("m"))
    # m has the part of the file above bit 33 and the line in it below: only the parts' sizes come to the driver
    part, n, first = F.shiftright("m", 33), 0, F.lit(None).cast("long")
    for k, size in sorted((r[0], r[1]) for r in fam_rows.groupBy(part).count().collect()):
        first, n = F.when(part == k, F.lit(n)).otherwise(first), n + size
    samples = fam_rows.select((first + F.col("m").bitwiseAND((1 << 33) - 1)).cast("long").alias("sample_idx"), F.col("f")[1].alias("id"))
    with open(bim or stem + ".bim") as f:
        bim_rows = [x.split() for x in f if x.strip()]
    ann = spark.createDataFrame([(gidx_start + i, int(x[0].removeprefix("chr")), int(x[3]), x[1], x[5], x[4]) for i, x in enumerate(bim_rows)], "gidx long, CHR int, POS long, ID string, REF string, ALT string")
    m = len(bim_rows)
    size = (n + 3) // 4
    with open(bed, "rb") as f:
        magic = f.read(3)
    if magic[:2] != b"\x6c\x1b":
        raise ValueError(f"{bed}: not a PLINK 1 file")
    if magic[2] != 1:
        raise ValueError(f"{bed}: sample-major files are not supported")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from varloom.functions.codec import counts, stats_of_counts

        for b in batches:
            for a in b.column(0).to_pylist():
                z = min(a + rows_per_task, m)
                with open(bed, "rb") as f:
                    f.seek(3 + a * size)
                    raw = np.frombuffer(f.read((z - a) * size), np.uint8).reshape(z - a, size)
                two = np.stack([(raw >> s) & 3 for s in (0, 2, 4, 6)], axis=-1).reshape(z - a, -1)[:, :n]
                out = pack(BED_LUT[two])
                mu, sxx, maf = stats_of_counts(counts(out, n))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, z) + gidx_start), pa.array(np.full(z - a, n), pa.int32()), pa.array(mu), pa.array(sxx), pa.array(maf), pa.array([r.tobytes() for r in out], pa.binary())], ["gidx", "n_samples", "mu_x", "sxx", "maf", "packed"])

    tasks = max(1, -(-m // rows_per_task))
    v = spark.range(0, m, rows_per_task, tasks).mapInArrow(run, "gidx long, n_samples int, mu_x double, sxx double, maf double, packed binary")
    v = v.join(ann.select("gidx", F.col("CHR").alias("chr")), "gidx")
    return v.withColumn("vidx", (F.row_number().over(W.partitionBy("chr").orderBy("gidx")) - 1).cast("long")).select("chr", "gidx", "vidx", "n_samples", "mu_x", "sxx", "maf", "packed"), ann, samples


def read_pgen(*_, **__):
    """PLINK 2 files need the pgenlib package."""
    try:
        import pgenlib  # noqa: F401
    except ImportError as e:
        raise ImportError("reading PLINK 2 files needs pgenlib, which is not installed; convert to VCF or PLINK 1") from e
    raise NotImplementedError("PLINK 2 import is not built here; convert to VCF or PLINK 1")
