"""Further queries: files read back, and the operators around cohort, scores and models on given numbers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from varloom import fixtures as fx
from varloom.fixtures import ctes
from varloom.operators import assoc, cohort, finemap, lasso, packed, prs, screen
from varloom.registry import _TOP, ORACLE, _gwas_sql, _null, _scan, _split, _uni, query, r_, rnd
from varloom.session import scratch
from varloom.sources import convert, gtpack, tables


def _n(s, d) -> int:
    return s.read.parquet(f"{d}/embeddings.parquet").agg(F.max("vec_id") + 1).first()[0]


def _files(s, d) -> str:
    """The genotypes as packed files, one a chromosome."""
    folder = scratch(s, "gtpack")
    gtpack.register(s)
    v = packed.pack_variants(fx.genotypes(s, d), _n(s, d))
    gtpack.prepare_for_write(v).write.format("gtpack").mode("append").save(folder)
    return folder


# packed files
@query(ctes("g") + "SELECT sample_idx, chr, gidx, d::TINYINT AS dosage FROM g")
def gtpack_round_trip(s, d):
    """Written by the sink, read by the source, decoded."""
    return packed.unpack_variants(s.read.format("gtpack").load(_files(s, d))).select("sample_idx", "chr", "gidx", F.col("dosage").cast("tinyint").alias("dosage"))


@query(ctes("g", "st") + "SELECT chr, gidx, row_number() OVER (PARTITION BY chr ORDER BY gidx) - 1 AS vidx, n_samples::INT AS n_samples, round(mu_x::FLOAT::DOUBLE, 6) + 0.0 AS mu_x, round(sxx::FLOAT::DOUBLE, 3) + 0.0 AS sxx, round(maf::FLOAT::DOUBLE, 6) + 0.0 AS maf FROM st")
def gtpack_stats(s, d):
    """The statistics columns alone, as single-precision numbers in the file."""
    got = s.read.format("gtpack").option("stats_only", "true").load(_files(s, d)).drop("packed")
    return rnd(rnd(got, 6, "mu_x", "maf"), 3, "sxx")


@query(ctes("g", more="v AS (SELECT *, dense_rank() OVER (PARTITION BY chr ORDER BY gidx) - 1 AS vidx FROM g)") + "SELECT sample_idx, chr, gidx, d::TINYINT AS dosage FROM v WHERE chr IN (2, 5) AND vidx >= 2 AND vidx < 6")
def gtpack_ranges(s, d):
    """Pushed filters: only the asked chromosomes and variants are read."""
    got = s.read.format("gtpack").option("rows_per_split", "3").load(_files(s, d)).where("chr in (2, 5) and vidx >= 2 and vidx < 6")
    return packed.unpack_variants(got).select("sample_idx", "chr", "gidx", F.col("dosage").cast("tinyint").alias("dosage"))


@query(ctes("g", more="ix AS (SELECT * FROM (VALUES (0, 5), (1, 1), (2, 2), (3, 7)) t(place, k)), v AS (SELECT *, dense_rank() OVER (PARTITION BY chr ORDER BY gidx) - 1 AS vidx FROM g)") + "SELECT place::BIGINT AS place, chr, sample_idx, d::DOUBLE AS dosage FROM v JOIN ix ON v.vidx = ix.k")
def gtpack_index_read(s, d):
    """Variants by index, in the order asked for, adjacent ones in one read."""
    rows = []
    for path in gtpack.files(_files(s, d)):
        with gtpack.Reader(path) as r:
            for place, calls in enumerate(r.dosages_at([5, 1, 2, 7])):
                rows += [(place, gtpack.chromosome(path), i, None if np.isnan(x) else float(x)) for i, x in enumerate(calls)]
    return s.createDataFrame(rows, "place long, chr int, sample_idx long, dosage double")


@query(ctes("g") + "SELECT chr, count(DISTINCT sample_idx) AS n_samples, count(DISTINCT gidx) AS n_variants, true AS ok FROM g GROUP BY chr")
def gtpack_headers(s, d):
    """Header and validation of each file."""
    rows = []
    for path in gtpack.files(_files(s, d)):
        h, v = gtpack.read_header(path), gtpack.validate(path)
        rows.append((gtpack.chromosome(path), int(h.n_samples), int(h.n_variants), bool(v["ok"])))
    return s.createDataFrame(rows, "chr int, n_samples long, n_variants long, ok boolean")


@query(ctes("g", more="sub AS (SELECT * FROM g WHERE sample_idx % 3 = 0)") + f"SELECT chr, gidx, count(*) AS n_samples, {r_('avg(d)', 'mu_x')}, {r_('least(avg(d) / 2, 1 - avg(d) / 2)', 'maf')} FROM sub GROUP BY chr, gidx")
def packed_subset_folder(s, d):
    """A folder of subsets; the second call finds all chromosomes there and adds none."""
    n, folder = _n(s, d), scratch(s, "subset")
    v = packed.pack_variants(fx.genotypes(s, d), n)
    packed.subset_to(v.where("chr < 4"), range(0, n, 3), folder)
    got = packed.subset_to(v, range(0, n, 3), folder)
    return rnd(got.select(F.col("chr").cast("int").alias("chr"), "gidx", F.col("n_samples").cast("long").alias("n_samples"), "mu_x", "maf"))


@query(ctes("g") + "SELECT sample_idx, chr, gidx, d::TINYINT AS dosage FROM g WHERE gidx IN (3, 4, 5, 17, 40)")
def gtpack_gidx_list(s, d):
    """A pushed list of variants: only their records are read, adjacent ones at once."""
    got = s.read.format("gtpack").load(_files(s, d)).where(F.col("gidx").isin(3, 4, 5, 17, 40))
    return packed.unpack_variants(got).select("sample_idx", "chr", "gidx", F.col("dosage").cast("tinyint").alias("dosage"))


@query(ORACLE["binary_score"])
def binary_score_packed(s, d):
    """Score statistics by products of packed blocks."""
    v = packed.pack_variants(fx.genotypes(s, d), _n(s, d))
    got = assoc.score_columns(packed.binary_sums(v, _null(s, d), _n(s, d)))
    return rnd(got.select("chr", "gidx", "U", "V", "BETA", "SE", "Z", "P_NORM"))


@query()
def gwas_binary_packed(s, d):
    """The binary scan on packed rows; only flagged variants are unpacked."""
    return packed.binary_gwas(packed.pack_variants(fx.genotypes(s, d), _n(s, d)), _null(s, d), _n(s, d))


@query(ORACLE["sample_qc"])
def sample_qc_packed(s, d):
    return rnd(packed.sample_qc(packed.pack_variants(fx.genotypes(s, d), _n(s, d)), max_missing=0.04, het_min=0.2, het_max=0.6))


# imports
@query(ctes("g") + "SELECT sample_idx, chr, gidx, d::TINYINT AS dosage FROM g")
def vcf_import(s, d):
    """The genotypes as VCF text, imported again."""
    g, a, n = fx.genotypes(s, d), fx.annotation(s, d), _n(s, d)
    call = F.when(F.col("dosage") == 0, "0/0").when(F.col("dosage") == 1, "0|1").when(F.col("dosage") == 2, "1/1").otherwise("./.")
    calls = g.groupBy("gidx").agg(F.sort_array(F.collect_list(F.struct("sample_idx", call.alias("c")))).alias("x"))
    lines = a.join(calls, "gidx").select("gidx", F.concat_ws("\t", F.concat(F.lit("chr"), "CHR"), "POS", "ID", "REF", "ALT", F.lit("."), F.lit("PASS"), F.lit("."), F.lit("DP:GT"), F.concat_ws("\t", F.transform("x", lambda x: F.concat(F.lit("9:"), x["c"])))).alias("value"))
    head = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(f"f{i}" for i in range(n))
    path = scratch(s, "vcf")
    s.createDataFrame([(x,) for x in head.split("\n")], "value string").coalesce(1).write.text(path)
    lines.select("value").write.mode("append").text(path)
    return convert.read_vcf(s, path)[0].select("sample_idx", "chr", "gidx", "dosage")


@query(ctes("g") + "SELECT sample_idx, chr, gidx, d::TINYINT AS dosage FROM g")
def plink_import(s, d):
    """The genotypes as a PLINK 1 file set, imported again."""
    import os

    n, stem = _n(s, d), os.path.join(scratch(s, "plink"), "set")
    os.makedirs(os.path.dirname(stem), exist_ok=True)
    m = convert.write_bed(packed.pack_variants(fx.genotypes(s, d), n), n, stem + ".bed")
    with open(stem + ".bim", "w") as f:
        f.writelines(f"{1 + g // 8} v{g} 0 {1_000_000 + g % 8 * 400_000} G A\n" for g in range(m))
    with open(stem + ".fam", "w") as f:
        f.writelines(f"f{i} f{i} 0 0 0 -9\n" for i in range(n))
    return packed.unpack_variants(convert.read_bed(s, stem + ".bed")[0]).select("sample_idx", "chr", "gidx", F.col("dosage").cast("tinyint").alias("dosage"))


@query("SELECT vec_id AS sample_idx, concat('f', vec_id::VARCHAR) AS fid FROM embeddings")
def psam_file(s, d):
    """A sample file in genotype order, numbered as it stands."""
    import os

    folder = scratch(s, "psam")
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/a.psam", "w") as f:
        f.write("##x\n#FID IID SEX\n" + "".join(f"f{i} i{i} 1\n" for i in range(_n(s, d))))
    return tables.read_psam(s, f"{folder}/a.psam")


# tables
@query(ctes("g", "w") + "SELECT kind, gidx, beta FROM w, (VALUES ('csv'), ('dict'), ('npz'), ('parquet'), ('tsv')) t(kind)")
def weight_files(s, d):
    """Weights through every kind of file and a dict."""
    import os

    folder, w = scratch(s, "weights"), fx.weights(s, d)
    os.makedirs(folder, exist_ok=True)
    rows = w.collect()
    np.savez(f"{folder}/w.npz", gidx=[r.gidx for r in rows], BETA=[r.beta for r in rows])
    tables.write_table(w.withColumnRenamed("beta", "WEIGHT"), f"{folder}/w.tsv.gz")
    tables.write_table(w, f"{folder}/w.csv", single=True)
    tables.write_table(w, f"{folder}/w.parquet")
    sources = {"csv": f"{folder}/w.csv", "dict": {r.gidx: r.beta for r in rows}, "npz": f"{folder}/w.npz", "parquet": f"{folder}/w.parquet", "tsv": f"{folder}/w.tsv.gz"}
    return tables.union_results([tables.read_weights(s, x).select(F.lit(k).alias("kind"), F.col("gidx").cast("long").alias("gidx"), "beta") for k, x in sources.items()])


@query(_gwas_sql("wald"))
def gwas_merged(s, d):
    """The scan chromosome by chromosome, written and merged."""
    folder, scan = scratch(s, "scan"), _scan(s, d)
    for lo, hi in ((1, 3), (4, 8)):
        tables.write_table(scan.where(F.col("chr").between(lo, hi)), f"{folder}/{lo}.parquet")
    got = tables.union_results([s.read.parquet(f"{folder}/{lo}.parquet") for lo in (4, 1)])
    return rnd(rnd(got, 6, "BETA", "SE", "Z", "MAF"), 8, "P")


@query(ctes("g", "st", "ph", "sig", more=_TOP) + f"SELECT chr::INT AS chr, gidx, {r_('strength', 'strength')} FROM tk WHERE rank <= 2")
def candidate_files(s, d):
    """Screening candidates written a folder a chromosome and read as one table."""
    folder = scratch(s, "candidates")
    c = screen.window_top(screen.with_strength(_uni(s, d)), 4, k=2)
    c.select("chr", "gidx", "strength").write.partitionBy("chr").parquet(folder)
    return rnd(tables.read_candidates(s, folder).select("chr", "gidx", "strength"))


@query("SELECT k - 1 AS new_idx, v AS sample_idx FROM (SELECT unnest([7, 3, 9, 3]::BIGINT[]) AS v, unnest(range(1, 5)) AS k)")
def index_files(s, d):
    """Sample indices from an array file under a key, in the given order with repeats."""
    import os

    folder = scratch(s, "indices")
    os.makedirs(folder, exist_ok=True)
    np.savez(f"{folder}/i.npz", keep=[7, 3, 9, 3])
    return tables.read_indices(s, f"{folder}/i.npz", "keep")


# cohort and splits
_OLS2 = "avg({y}) AS my, avg(age) AS ma, avg(sex) AS ms, covar_pop(age, {y}) AS cay, covar_pop(sex, {y}) AS csy, var_pop(age) AS vaa, var_pop(sex) AS vss, covar_pop(age, sex) AS cas"
_HAT = "my + (cay * vss - csy * cas) / (vaa * vss - cas * cas) * (age - ma) + (csy * vaa - cay * cas) / (vaa * vss - cas * cas) * (sex - ms)"


@query(
    ctes("ph", more=f"""base AS (SELECT *, row_number() OVER (ORDER BY sample_idx) - 1 AS subset_row FROM ph WHERE sample_idx % 3 <> 0),
j AS (SELECT * FROM base WHERE sample_idx % 7 <> 0), m AS (SELECT {_OLS2.format(y='y')} FROM j)""")
    + f"SELECT sample_idx, fid, {r_('y - (' + _HAT + ')', 'y_train')}, y AS y_original, {r_(_HAT, 'y_hat')}, subset_row FROM j, m"
)
def cohort_prepared(s, d):
    """Phenotypes semi-joined to a base cohort, with sample numbers and covariates, residualised."""
    p = fx.phenotypes(s, d)
    got, _ = cohort.prepare_cohort(p.where("sample_idx % 7 <> 0").select("fid", "y"), p.select("fid", "age", "sex"), p.select("fid", "sample_idx"), p.where("sample_idx % 3 <> 0").select("fid", "sample_idx"), "y", ["age", "sex"])
    return rnd(got.select("sample_idx", "fid", "y_train", "y_original", "y_hat", F.col("subset_row").cast("long").alias("subset_row")), 6, "y_train", "y_hat")


@query(ctes("ph") + "SELECT sample_idx, fid, CASE WHEN sample_idx % 5 = 0 OR sample_idx % 10 = 9 THEN NULL ELSE y_bin::DOUBLE END AS y FROM ph")
def prs_phenotype(s, d):
    """A 1/2-coded phenotype on the cohort's ids: absent and -9 are missing."""
    p = fx.phenotypes(s, d)
    phe = p.where("sample_idx % 5 <> 0").select("fid", F.when(F.col("sample_idx") % 10 == 9, -9).otherwise(F.col("y_bin") + 1).alias("y"))
    return prs.load_phenotype(p.select("sample_idx", "fid"), phe, binary=True).select("sample_idx", "fid", "y")


@query(
    ctes("ph", more=f"j AS (SELECT *, CASE WHEN sample_idx % 5 < 3 THEN 'train' WHEN sample_idx % 5 = 3 THEN 'val' ELSE 'test' END AS split FROM ph), m AS (SELECT split, {_OLS2.format(y='y')} FROM j GROUP BY split)")
    + f"SELECT sample_idx, fid, split, y, {r_('y - (' + _HAT + ')', 'resid')}, {r_(_HAT, 'yhat')} FROM j JOIN m USING (split)"
)
def splits_built(s, d):
    """The union of train, validation and test, each with its own covariate fit."""
    p = fx.phenotypes(s, d)
    got = prs.build_splits(p.select("sample_idx", "fid"), p.select("fid", _split(F.col("sample_idx")).alias("split")), p.select("fid", "y", "age", "sex"), ["age", "sex"])[0]
    return rnd(got.select("sample_idx", "fid", "split", "y", "resid", "yhat"), 6, "resid", "yhat")


# models on given numbers
def _fit() -> lasso.JointFit:
    """A fit with fixed coefficients on sixteen variants and one covariate."""
    g = np.arange(0, 64, 4)
    b = np.where(g % 3 == 0, 0.0, (g % 7 - 3) / 10)
    one = np.ones(len(g) + 1)
    return lasso.JointFit(np.append(g, -1), np.append(1 + g // 8, 0), [f"v{x}" for x in g] + ["age"], np.append(b, 0.3), one * 0.5, one * 2, 1.0, 100, np.eye(len(one)), one)


@query(ctes("g") + f"SELECT sample_idx, {r_('sum((gidx % 7 - 3) / 20.0::DOUBLE * (coalesce(d, 0) - 0.5))', 'xb')} FROM g WHERE gidx % 4 = 0 AND gidx % 3 <> 0 AND gidx % 7 <> 3 GROUP BY sample_idx")
def lasso_predict(s, d):
    return rnd(lasso.predict(fx.genotypes(s, d), _fit()))


@query('SELECT (1 + g // 8)::INT AS chr, (g // 4)::BIGINT AS "column" FROM (SELECT unnest(range(0, 64, 4)) AS g)')
def chromosome_columns(s, d):
    """The fit's columns of each chromosome."""
    return s.createDataFrame([(int(c), int(i)) for c, at in lasso.chromosome_features(_fit()).items() for i in at], "chr int, column long")


@query(ctes("g", "ph") + "SELECT sample_idx, y, age, gidx, d::DOUBLE AS d FROM g JOIN ph USING (sample_idx) WHERE gidx % 5 = 0 AND d > 0")
def design_cells(s, d):
    """The sparse design of candidates by (chr, gidx), exploded."""
    g = fx.genotypes(s, d)
    rows = lasso.design_rows(g, g.where("gidx % 5 = 0").select("chr", "gidx").distinct(), fx.phenotypes(s, d), "y", ["age"])
    return rows.select("sample_idx", "y", F.col("cov")[0].alias("age"), F.explode("x").alias("x")).select("sample_idx", "y", "age", "x.gidx", "x.d")


def _blocked(s, d):
    """(chr, gidx list, genotypes in blocks) of each chromosome."""
    n = _n(s, d)
    y = np.full(n, np.nan)
    for r in fx.phenotypes_sig(s, d).select("sample_idx", "y_sig").toLocalIterator():
        y[r.sample_idx] = r.y_sig
    rows = sorted(packed.pack_variants(fx.genotypes(s, d), n).select("chr", "gidx", "packed").collect())
    for c in sorted({r.chr for r in rows}):
        mine = [r for r in rows if r.chr == c]
        yield c, [r.gidx for r in mine], finemap.Blocked([bytes(r.packed) for r in mine], y, 256)


@query(
    ctes("g", "ph", "sig", more="ce AS (SELECT chr, gidx, sample_idx, coalesce(d, 0) - avg(coalesce(d, 0)) OVER (PARTITION BY gidx) AS x FROM g)")
    + f"SELECT a.chr AS chr, a.gidx AS gidx_a, b.gidx AS gidx_b, {r_('sum(a.x * b.x)', 'xtx')} FROM ce a JOIN ce b ON a.sample_idx = b.sample_idx AND a.chr = b.chr WHERE a.sample_idx % 2 = 0 GROUP BY 1, 2, 3"
)
def half_sums(s, d):
    """Gram sums over half of the samples, block by block of samples."""
    rows = []
    for c, g, x in _blocked(s, d):
        xtx, _, _ = x.sums(x.rows % 2 == 0)
        rows += [(c, a, b, float(xtx[i, j])) for i, a in enumerate(g) for j, b in enumerate(g)]
    return rnd(s.createDataFrame(rows, "chr int, gidx_a long, gidx_b long, xtx double"))


@query(ctes("g", "ph", "sig") + f"SELECT chr, gidx, {r_('regr_r2(y_sig, coalesce(d, 0))', 'r2')} FROM g JOIN sig USING (sample_idx) GROUP BY chr, gidx")
def variance_explained(s, d):
    """The share of the phenotype's variance that each variant explains."""
    rows = []
    for c, g, x in _blocked(s, d):
        st = x.sufficient()
        rows += [(c, v, finemap.joint_r2(st, [i])) for i, v in enumerate(g)]
    return rnd(s.createDataFrame(rows, "chr int, gidx long, r2 double"))


@query(ctes(more="sw AS (SELECT (1 + user_id % 6) / 100.0::DOUBLE AS alpha, avg(value) AS val_full FROM events GROUP BY 1)") + "SELECT arg_max(alpha, val_full) AS alpha FROM sw")
def best_of_sweep(s, d):
    """The penalty with the largest validation metric."""
    sw = s.read.parquet(f"{d}/events.parquet").groupBy(((1 + F.col("user_id") % 6) / 100.0).alias("alpha")).agg(F.avg("value").alias("val_full"))
    return s.createDataFrame([(prs.select_alpha(sw),)], "alpha double")
