"""Operators on the packed storage form: one row a variant, four genotypes a byte.

This is the form for large cohorts: a scan moves n / 4 bytes a variant instead of n rows, decodes in numpy blocks
inside ``mapInArrow``, and needs no shuffle for per-variant results. Per-sample results are added up per task
and then by sample. Both forms give the same numbers (a test compares them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from varloom.functions.codec import COUNTS, MISSING, counts, pack, stats_of_counts, unpack, width
from varloom.operators import assoc
from varloom.operators.assoc import wald_columns
from varloom.operators.score import resolve_weights
from varloom.operators.stats import qc_flags, sample_flags
from varloom.session import ship

SCHEMA = "chr int, gidx long, vidx long, n_samples int, mu_x double, sxx double, maf double, packed binary"
VECTOR_BYTES = 256 << 20  # the largest per-sample table that is sent to every task
BLOCK = 256


def pack_variants(genotypes: DataFrame, n_samples: int) -> DataFrame:
    """Packed rows from the long view, where sample_idx is 0 .. n_samples - 1; absent calls are missing."""
    ship(genotypes.sparkSession)
    code = F.coalesce(F.when(F.col("dosage").isin(0, 1, 2), F.col("dosage")).cast("int"), F.lit(MISSING))
    rows = genotypes.groupBy("chr", "gidx").agg(F.collect_list(F.col("sample_idx").cast("int")).alias("s"), F.collect_list(code).alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, st = [], []
            for s, c in zip(b.column(2), b.column(3), strict=True):
                x = np.full(n_samples, MISSING, np.uint8)
                x[s.values.to_numpy()] = c.values.to_numpy()
                out.append(pack(x).tobytes())
                st.append(counts(np.frombuffer(out[-1], np.uint8), n_samples))
            mu, sxx, maf = stats_of_counts(np.array(st).reshape(-1, 4))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.full(len(out), n_samples), pa.int32()), pa.array(mu), pa.array(sxx), pa.array(maf), pa.array(out, pa.binary())], ["chr", "gidx", "n_samples", "mu_x", "sxx", "maf", "packed"])

    p = rows.select(F.col("chr").cast("int"), F.col("gidx").cast("long"), "s", "c").mapInArrow(run, "chr int, gidx long, n_samples int, mu_x double, sxx double, maf double, packed binary")
    return p.withColumn("vidx", (F.row_number().over(W.partitionBy("chr").orderBy("gidx")) - 1).cast("long")).select(*[c.split()[0] for c in SCHEMA.split(", ")])


def unpack_variants(variants: DataFrame) -> DataFrame:
    """The long view: sample_idx, chr, gidx, dosage (null where missing)."""
    ship(variants.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                n = b.column(2)[i].as_py()
                c = unpack(np.frombuffer(b.column(3)[i].as_buffer(), np.uint8), n)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int64)), pa.array(np.full(n, b.column(0)[i].as_py(), np.int32)), pa.array(np.full(n, b.column(1)[i].as_py(), np.int64)), pa.array(c.astype(np.int8), mask=c == MISSING)], ["sample_idx", "chr", "gidx", "dosage"])

    return variants.select("chr", "gidx", "n_samples", "packed").mapInArrow(run, "sample_idx long, chr int, gidx long, dosage tinyint")


def _matrix(col: pa.Array) -> np.ndarray:
    """The packed bytes of a batch of equally wide rows, without copying row by row."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    offs = np.frombuffer(col.buffers()[1], np.int32, count=len(col) + 1, offset=col.offset * 4)
    data = np.frombuffer(col.buffers()[2], np.uint8)[offs[0] : offs[-1]]
    return data.reshape(len(col), -1)


def blocks(batches: Iterator[pa.RecordBatch], at: int, size: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for b in batches:
        for a in range(0, b.num_rows, size):
            part = b.slice(a, size)
            yield part, _matrix(part.column(at))


def genotype_counts(variants: DataFrame) -> DataFrame:
    """n_geno0 .. n_missing per variant by byte counts, without unpacking."""
    ship(variants.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, m in blocks(batches, 3):
            c = counts(m, b.column(2)[0].as_py())
            mu, sxx, maf = stats_of_counts(c)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c[:, k]) for k in range(4)], pa.array(mu), pa.array(sxx), pa.array(maf), b.column(2)], ["chr", "gidx", "n_geno0", "n_geno1", "n_geno2", "n_missing", "mu_x", "sxx", "maf", "n"])

    return variants.select("chr", "gidx", "n_samples", "packed").mapInArrow(run, "chr int, gidx long, n_geno0 long, n_geno1 long, n_geno2 long, n_missing long, mu_x double, sxx double, maf double, n int")


def variant_qc(variants: DataFrame, maf_min: float | None = None, maf_max: float | None = None, max_missing: float | None = None, hwe_min: float | None = None) -> DataFrame:
    return qc_flags(genotype_counts(variants).withColumn("missing_rate", F.col("n_missing") / F.col("n")), maf_min, maf_max, max_missing, hwe_min)


def sample_counts(variants: DataFrame) -> DataFrame:
    """sample_idx, n_missing, n_het, n_variants: added up per task, then by sample."""
    ship(variants.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        miss = het = None
        k = 0
        for b, m in blocks(batches, 1):
            c = unpack(m, b.column(0)[0].as_py())
            if miss is None:
                miss, het = np.zeros(c.shape[1], np.int64), np.zeros(c.shape[1], np.int64)
            miss += (c == MISSING).sum(0)
            het += (c == 1).sum(0)
            k += len(c)
        if miss is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(miss))), pa.array(miss), pa.array(het), pa.array(np.full(len(miss), k))], ["sample_idx", "n_missing", "n_het", "n_variants"])

    part = variants.select("n_samples", "packed").mapInArrow(run, "sample_idx long, n_missing long, n_het long, n_variants long")
    return part.groupBy("sample_idx").agg(*[F.sum(c).alias(c) for c in ("n_missing", "n_het", "n_variants")])


def sample_qc(variants: DataFrame, max_missing: float | None = None, het_min: float | None = None, het_max: float | None = None) -> DataFrame:
    """Rates and ``keep`` per sample, from sums per task: no row a call."""
    return sample_flags(sample_counts(variants), max_missing, het_min, het_max)


def phenotype_vectors(yc: DataFrame, n_samples: int, chromosomes: list[int] | None = None) -> dict[int, np.ndarray]:
    """{chr: centred phenotype by sample_idx} (key 0 for all chromosomes); its size is checked before it is sent."""
    per_chr = "chr" in yc.columns
    n_vec = len(chromosomes) if chromosomes else (yc.select("chr").distinct().count() if per_chr else 1)
    if 8 * n_samples * n_vec > VECTOR_BYTES:
        raise ValueError("the phenotype vectors pass the broadcast bound: scan fewer chromosomes at once, or use the long view")
    out: dict[int, np.ndarray] = {}
    for b in yc.select(F.col("chr") if per_chr else F.lit(0).alias("chr"), "sample_idx", "yc").toArrow().to_batches():
        c, s, y = (x.to_numpy(zero_copy_only=False) for x in b.columns)
        for k in np.unique(c):
            v = out.setdefault(int(k), np.full(n_samples, np.nan))
            v[s[c == k]] = y[c == k]
    return out


def linear_gwas(variants: DataFrame, yc: DataFrame, n_samples: int, test: str = "wald", maf_min: float = 1e-4) -> DataFrame:
    """The linear scan on packed rows: decode and cross-product in blocks, then expressions. No shuffle.

    The frequency filter comes first and reaches the scan as a pushed filter on the stored column.
    """
    spark = variants.sparkSession
    ship(spark)
    vec = spark.sparkContext.broadcast(phenotype_vectors(yc, n_samples))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, m in blocks(batches, 4):
            chrs = b.column(0).to_numpy()
            num = np.empty(len(chrs))
            syy = np.empty(len(chrs))
            n = np.empty(len(chrs), np.int64)
            code = unpack(m, n_samples)
            x = code.astype(np.float64)
            x[code == MISSING] = 0
            called = (code != MISSING).astype(np.float64)
            mu = b.column(2).to_numpy()
            for c in np.unique(chrs):
                y = vec.value.get(int(c), vec.value.get(0))
                ok = ~np.isnan(y)
                v = np.where(ok, y, 0.0)
                r = chrs == c
                num[r] = x[r] @ v - mu[r] * (called[r] @ v)
                syy[r], n[r] = v @ v, ok.sum()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(3), b.column(5), pa.array(num), pa.array(syy), pa.array(n)], ["chr", "gidx", "sxx", "MAF", "num", "syy", "n"])

    rows = variants.where(F.col("maf") >= maf_min).select("chr", "gidx", "mu_x", "sxx", "packed", "maf")
    return wald_columns(rows.mapInArrow(run, "chr int, gidx long, sxx double, MAF double, num double, syy double, n long"), test).select("chr", "gidx", "BETA", "SE", "Z", "P", "MAF")


def binary_sums(variants: DataFrame, null: DataFrame, n_samples: int) -> DataFrame:
    """The sums of ``assoc.score_columns`` for each variant, by products of decoded blocks with the null's vectors."""
    spark = variants.sparkSession
    ship(spark)
    mu = 0.5 * (F.tanh(F.col("eta") * 0.5) + 1)
    held = [phenotype_vectors(null.select("sample_idx", "chr", c.alias("yc")), n_samples) for c in (F.greatest(mu * (1 - mu), F.lit(1e-12)), F.col("y") - mu)]
    vec = spark.sparkContext.broadcast({c: (held[0][c], held[1][c]) for c in held[0]})
    names = ["sw", "sr", "gw", "ggw", "gr", "mean", "n", "MAC_CASE"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, m in blocks(batches, 2):
            chrs = b.column(0).to_numpy()
            code = unpack(m, n_samples)
            out = np.full((len(names), len(chrs)), np.nan)
            for c in np.unique(chrs).tolist():
                if c not in vec.value:
                    continue
                w, r = vec.value[c]
                at = np.flatnonzero(~np.isnan(r))
                mine = chrs == c
                k, w, r = code[mine][:, at], w[at], r[at]
                x = np.where(k == MISSING, 0, k).astype(np.float64)
                called = (k != MISSING).sum(1)
                with np.errstate(invalid="ignore"):
                    mean = x.sum(1) / np.where(called, called, np.nan)
                out[:, mine] = [np.full(len(x), w.sum()), np.full(len(x), r.sum()), x @ w, (x * x) @ w, x @ r, mean, np.full(len(x), len(r)), x @ (r > 0)]
            some = ~np.isnan(out[6])
            cols = [pa.array(v[some], pa.int64() if k == "n" else pa.float64(), from_pandas=True) for k, v in zip(names, out, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(some)), b.column(1).filter(pa.array(some)), *cols], ["chr", "gidx", *names])

    kinds = ", ".join(f"{k} {'long' if k == 'n' else 'double'}" for k in names)
    return variants.select("chr", "gidx", "packed").mapInArrow(run, f"chr int, gidx long, {kinds}")


def binary_gwas(variants: DataFrame, null: DataFrame, n_samples: int, **how) -> DataFrame:
    """``assoc.binary_gwas`` on packed rows: only the variants that the saddlepoint needs are unpacked."""

    def flagged(todo: DataFrame) -> DataFrame:
        return unpack_variants(variants.join(todo.select("chr", "gidx"), ["chr", "gidx"], "left_semi"))

    return assoc.binary_gwas(flagged, null, score=lambda nl: assoc.score_columns(binary_sums(variants, nl, n_samples)), **how)


def score(variants: DataFrame, weights: DataFrame, n_samples: int, center: bool = True, missing: str = "ref") -> DataFrame:
    """(sample_idx, score): each task adds up its variants' contributions to all samples."""
    ship(variants.sparkSession)
    w = resolve_weights(weights).groupBy("gidx").agg(F.sum("beta").alias("beta"))
    rows = variants.join(w, "gidx").select("mu_x", "beta", "packed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b, m in blocks(batches, 2):
            code = unpack(m, n_samples)
            mu = b.column(0).to_numpy()
            x = np.where(code == MISSING, mu[:, None] if missing == "mean" else 0.0, code)
            s = b.column(1).to_numpy() @ (x - mu[:, None] if center else np.where(code == MISSING, 0.0, code))
            total = s if total is None else total + s
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["sample_idx", "score"])

    return rows.mapInArrow(run, "sample_idx long, score double").groupBy("sample_idx").agg(F.sum("score").alias("score"))


def subset_samples(variants: DataFrame, samples: list[int] | np.ndarray) -> DataFrame:
    """Gather samples in the given order (repeats allowed) and recompute the statistics."""
    spark = variants.sparkSession
    ship(spark)
    idx = np.asarray(samples, np.int64)
    if idx.nbytes > VECTOR_BYTES:
        raise ValueError("the sample list passes the broadcast bound")
    held = spark.sparkContext.broadcast(idx)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take = held.value
        for b, m in blocks(batches, 4):
            out = pack(unpack(m, b.column(3)[0].as_py())[:, take])
            mu, sxx, maf = stats_of_counts(counts(out, len(take)))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(np.full(len(out), len(take)), pa.int32()), pa.array(mu), pa.array(sxx), pa.array(maf), pa.array([r.tobytes() for r in out], pa.binary())], [c.split()[0] for c in SCHEMA.split(", ")])

    return variants.select("chr", "gidx", "vidx", "n_samples", "packed").mapInArrow(run, SCHEMA)


def subset_to(variants: DataFrame, samples: list[int] | np.ndarray, folder: str, skip_existing: bool = True) -> DataFrame:
    """Subset all chromosomes into a folder partitioned by chr; chromosomes that are there already are left alone."""
    spark = variants.sparkSession
    todo = variants
    if skip_existing:
        try:
            done = [r[0] for r in spark.read.parquet(folder).select("chr").distinct().collect()]
        except AnalysisException:
            done = []
        todo = variants.where(~F.col("chr").isin(*done)) if done else variants
    subset_samples(todo, samples).write.mode("append").partitionBy("chr").parquet(folder)
    return spark.read.parquet(folder)


def recompute_stats(variants: DataFrame) -> DataFrame:
    """The packed rows with mu_x, sxx, maf computed anew: a repaired copy, the input stays as it is."""
    n = genotype_counts(variants).select("chr", "gidx", F.col("mu_x").alias("m"), F.col("sxx").alias("s"), F.col("maf").alias("f"))
    return variants.join(n, ["chr", "gidx"]).select("chr", "gidx", "vidx", "n_samples", F.col("m").alias("mu_x"), F.col("s").alias("sxx"), F.col("f").alias("maf"), "packed")


__all__ = ["COUNTS", "SCHEMA", "genotype_counts", "linear_gwas", "pack_variants", "phenotype_vectors", "recompute_stats", "sample_counts", "score", "subset_samples", "subset_to", "unpack_variants", "variant_qc", "width"]
