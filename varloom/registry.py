"""The genomics queries of the driver contract and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from varloom import fixtures as fx
from varloom.fixtures import ctes
from varloom.functions.special import chi2_isf_col, chi2_isf_sql, erfc_sql, p_from_z_sql
from varloom.functions.strength import names as strength_names
from varloom.operators import assoc, cohort, finemap, ld, lasso, loci, packed, plotdata, prs, score, screen, stats, subset

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def deco(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLE[key] = sql
        return f

    return deco


def rnd(df: DataFrame, digits: int = 6, *cols: str) -> DataFrame:
    """Doubles rounded alike on both engines (and negative zero made zero)."""
    pick = cols or [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, digits) + 0.0 for c in pick})


def r_(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0 AS {name}"


# statistics and quality control
_STATS = f"chr, gidx, n_samples, n_called, {r_('mu_x', 'mu_x')}, {r_('sxx', 'sxx')}, {r_('maf', 'maf')}"


@query(ctes("g", "st") + f"SELECT {_STATS} FROM st")
def variant_stats(s, d):
    return rnd(stats.variant_stats(fx.genotypes(s, d)))


@query(ctes("cr", more="n AS (SELECT count(*) AS n FROM orders), a AS (SELECT gidx, count(*) AS n_carriers, sum(dosage)::DOUBLE / (SELECT n FROM n) AS mu, sum(dosage * dosage)::DOUBLE AS ss FROM cr GROUP BY gidx)") + f"SELECT gidx, n_carriers, {r_('mu', 'mu_x')}, {r_('ss - (SELECT n FROM n) * mu * mu', 'sxx')}, {r_('least(mu / 2, 1 - mu / 2)', 'maf')} FROM a")
def variant_stats_sparse(s, d):
    n = s.read.parquet(f"{d}/orders.parquet").count()
    return rnd(stats.variant_stats_sparse(fx.carriers(s, d), n))


_COUNTS = "c AS (SELECT chr, gidx, count(*) FILTER (d = 0) AS n_geno0, count(*) FILTER (d = 1) AS n_geno1, count(*) FILTER (d = 2) AS n_geno2, count(*) FILTER (d IS NULL) AS n_missing, count(*) AS n_samples FROM g GROUP BY chr, gidx)"
_HWE = _COUNTS + """,
hp AS (SELECT *, (n_geno0 + n_geno1 + n_geno2)::DOUBLE AS n, (2 * n_geno2 + n_geno1) / greatest(2.0::DOUBLE * (n_geno0 + n_geno1 + n_geno2), 1) AS p FROM c),
he AS (SELECT *, n * (1 - p) * (1 - p) AS e0, 2 * n * p * (1 - p) AS e1, n * p * p AS e2 FROM hp),
hw AS (SELECT *, CASE WHEN least(e0, e1, e2) < 5 THEN 'NaN'::DOUBLE ELSE (n_geno0 - e0) ** 2 / e0 + (n_geno1 - e1) ** 2 / e1 + (n_geno2 - e2) ** 2 / e2 END AS chi2 FROM he)"""
_HWE_P = f"CASE WHEN isnan(chi2) THEN 'NaN'::DOUBLE ELSE {erfc_sql('sqrt(chi2 / 2)')} END"


@query(ctes("g", more=_COUNTS) + "SELECT * FROM c")
def genotype_counts(s, d):
    return stats.genotype_counts(fx.genotypes(s, d))


@query(ctes("g", more=_HWE) + f"SELECT chr, gidx, n_geno0, n_geno1, n_geno2, {r_('chi2', 'hwe_chi2')}, {r_(_HWE_P, 'hwe_p', 8)} FROM hw")
def hwe(s, d):
    h = stats.with_hwe(stats.genotype_counts(fx.genotypes(s, d))).select("chr", "gidx", "n_geno0", "n_geno1", "n_geno2", "hwe_chi2", "hwe_p")
    return rnd(rnd(h, 6, "hwe_chi2"), 8, "hwe_p")


@query(ctes("g", "st", more=_HWE + f", q AS (SELECT hw.*, mu_x, sxx, maf, n_missing::DOUBLE / hw.n_samples AS miss, {_HWE_P} AS hp FROM hw JOIN st USING (chr, gidx))") + f"SELECT chr, gidx, {r_('mu_x', 'mu_x')}, {r_('sxx', 'sxx')}, {r_('maf', 'maf')}, n_geno0, n_geno1, n_geno2, n_missing, {r_('miss', 'missing_rate')}, {r_('chi2', 'hwe_chi2')}, {r_('hp', 'hwe_p')}, maf >= 0.2 AND miss <= 0.036 AND (isnan(hp) OR hp >= 1e-6) AS keep FROM q")
def variant_qc(s, d):
    return rnd(stats.variant_qc(fx.genotypes(s, d), maf_min=0.2, max_missing=0.036, hwe_min=1e-6))


@query(ctes("g", "st") + f"SELECT chr, gidx, {r_('mu_x', 'mu_x')}, {r_('sxx', 'sxx')}, {r_('maf', 'maf')}, -1::BIGINT AS n_geno0, -1::BIGINT AS n_geno1, -1::BIGINT AS n_geno2, -1::BIGINT AS n_missing, 'NaN'::DOUBLE AS missing_rate, 'NaN'::DOUBLE AS hwe_chi2, 'NaN'::DOUBLE AS hwe_p, maf >= 0.3 AND maf <= 0.49 AS keep FROM st")
def variant_qc_fast(s, d):
    return rnd(stats.variant_qc(stats=stats.variant_stats(fx.genotypes(s, d)), maf_min=0.3, maf_max=0.49))


_SQC = "q AS (SELECT sample_idx, count(*) FILTER (d IS NULL) AS n_missing, count(*) FILTER (d = 1) AS n_het, count(*) AS n_variants FROM g GROUP BY 1)"


@query(ctes("g", more=_SQC) + f"SELECT sample_idx, n_missing, n_het, n_variants, {r_('n_missing::DOUBLE / n_variants', 'missing_rate')}, {r_('n_het::DOUBLE / n_variants', 'het_rate')}, n_missing::DOUBLE / n_variants <= 0.04 AND n_het::DOUBLE / n_variants BETWEEN 0.2 AND 0.6 AS keep FROM q")
def sample_qc(s, d):
    return rnd(stats.sample_qc(fx.genotypes(s, d), max_missing=0.04, het_min=0.2, het_max=0.6))


@query(ctes("g", "st") + f"SELECT chr, gidx, n_samples, {r_('mu_x', 'mu_x')}, {r_('sxx', 'sxx')}, {r_('maf', 'maf')} FROM st")
def frequency(s, d):
    return rnd(stats.frequency(stats.variant_stats(fx.genotypes(s, d))))


@query(ctes("g", "st") + "SELECT chr, count(*) AS n_variants FROM st GROUP BY chr")
def chromosome_counts(s, d):
    return stats.variant_count(stats.variant_stats(fx.genotypes(s, d)))


# subsets and repair
def _subset_sql(where: str) -> str:
    return ctes("g", more=f"sub AS (SELECT * FROM g WHERE {where})") + f"SELECT chr, gidx, count(*) AS n_samples, count(d) AS n_called, {r_('avg(d)', 'mu_x')}, {r_('var_pop(d) * count(d)', 'sxx')}, {r_('least(avg(d) / 2, 1 - avg(d) / 2)', 'maf')} FROM sub GROUP BY chr, gidx"


def _some(s, d, col, table="embeddings", key="vec_id", mod=3):
    return s.read.parquet(f"{d}/{table}.parquet").select(F.col(key).alias(col)).where(F.col(col) % mod == 0)


def _vars(s):
    return s.range(64).select(F.col("id").alias("gidx")).where(F.col("gidx") % 5 == 0)


@query(_subset_sql("sample_idx % 3 = 0"))
def keep_samples(s, d):
    return rnd(stats.variant_stats(subset.keep_samples(fx.genotypes(s, d), _some(s, d, "sample_idx"))))


@query(_subset_sql("sample_idx % 3 <> 0"))
def remove_samples(s, d):
    return rnd(stats.variant_stats(subset.remove_samples(fx.genotypes(s, d), _some(s, d, "sample_idx"))))


@query(_subset_sql("gidx % 5 = 0"))
def extract_variants(s, d):
    return rnd(stats.variant_stats(subset.extract_variants(fx.genotypes(s, d), _vars(s))))


@query(_subset_sql("gidx % 5 <> 0"))
def exclude_variants(s, d):
    return rnd(stats.variant_stats(subset.exclude_variants(fx.genotypes(s, d), _vars(s))))


@query(_subset_sql("sample_idx % 3 = 0").replace("n_samples, count(d) AS n_called, ", "n_samples, "))
def packed_subset(s, d):
    """The packed form: gather every third sample, then the recomputed statistics."""
    n = s.read.parquet(f"{d}/embeddings.parquet").agg(F.max("vec_id") + 1).first()[0]
    v = packed.subset_samples(packed.pack_variants(fx.genotypes(s, d), n), range(0, n, 3))
    return rnd(v.select("chr", "gidx", F.col("n_samples").cast("long").alias("n_samples"), "mu_x", "sxx", "maf"))


_REPAIR = """old AS (SELECT chr, gidx, CASE WHEN gidx % 7 = 0 THEN 0 ELSE sxx END AS sxx_old, CASE WHEN gidx % 11 = 0 THEN 0 ELSE maf END AS maf_old, sxx AS sxx_new, maf AS maf_new FROM st),
rp AS (SELECT *, CASE WHEN sxx_new = 0 AND sxx_old = 0 THEN 0 ELSE abs(sxx_new - sxx_old) / greatest(abs(sxx_new), 1e-12) END AS rel FROM old)"""


@query(ctes("g", "st", more=_REPAIR) + "SELECT chr, count(*) AS n_variants, count(*) FILTER (rel > 1e-3 OR (maf_old = 0 AND maf_new > 0)) AS n_repaired, count(*) FILTER (sxx_old < 1e-6 AND sxx_new > 1) AS n_sxx_zeroed, round(max(rel), 6) + 0.0 AS max_rel_change FROM rp GROUP BY chr")
def repair_summary(s, d):
    g = fx.genotypes(s, d)
    st = stats.variant_stats(g)
    stale = st.withColumn("sxx", F.when(F.col("gidx") % 7 == 0, 0.0).otherwise(F.col("sxx"))).withColumn("maf", F.when(F.col("gidx") % 11 == 0, 0.0).otherwise(F.col("maf")))
    return rnd(subset.repair_summary(subset.repair_report(g, stale)))


# association
def _gwas_sql(test: str, extra: str = "", select: str | None = None) -> str:
    se = "sqrt(greatest(syy - b * b * sxx, 1e-20) / ((n - 2) * sxx))" if test == "wald" else "sqrt(syy / ((n - 1) * sxx))"
    body = f"""yc AS (SELECT sample_idx, y_sig - avg(y_sig) OVER () AS yc FROM sig),
yy AS (SELECT sum(yc * yc) AS syy, count(*) AS n FROM yc),
num AS (SELECT chr, gidx, sum(CASE WHEN d IS NOT NULL THEN (d - mu_x) * yc END) AS num FROM g JOIN st USING (chr, gidx) JOIN yc USING (sample_idx) GROUP BY chr, gidx),
b AS (SELECT chr, gidx, num / greatest(sxx, 1e-20) AS b, sxx, maf, syy, n FROM num JOIN st USING (chr, gidx), yy WHERE maf >= 0.2),
se AS (SELECT *, {se} AS se FROM b), z AS (SELECT *, b / se AS z FROM se)"""
    cols = select or f"chr, gidx, {r_('b', 'BETA')}, {r_('se', 'SE')}, {r_('z', 'Z')}, {r_(p_from_z_sql('z'), 'P', 8)}, {r_('maf', 'MAF')}"
    return ctes("g", "st", "ph", "sig", *(["an"] if "an" in extra else []), more=body) + f"SELECT {cols} FROM z {extra}"


def _scan(s, d, test="wald"):
    return assoc.linear_gwas(fx.genotypes(s, d), assoc.residual_phenotype(fx.phenotypes_sig(s, d), y_col="y_sig"), test, maf_min=0.2)


@query(_gwas_sql("wald"))
def gwas_wald(s, d):
    return rnd(rnd(_scan(s, d), 6, "BETA", "SE", "Z", "MAF"), 8, "P")


@query(_gwas_sql("score"))
def gwas_score(s, d):
    return rnd(rnd(_scan(s, d, "score"), 6, "BETA", "SE", "Z", "MAF"), 8, "P")


@query(_gwas_sql("wald"))
def gwas_packed(s, d):
    """The same scan over packed rows, without a shuffle of genotypes."""
    n = s.read.parquet(f"{d}/embeddings.parquet").agg(F.max("vec_id") + 1).first()[0]
    yc = assoc.residual_phenotype(fx.phenotypes_sig(s, d), y_col="y_sig")
    got = packed.linear_gwas(packed.pack_variants(fx.genotypes(s, d), n), yc, n, maf_min=0.2)
    return rnd(rnd(got, 6, "BETA", "SE", "Z", "MAF"), 8, "P")


@query(_gwas_sql("wald", "LEFT JOIN an USING (gidx)", f"z.chr AS chr, an.CHR AS \"CHROM\", POS, ID, REF, ALT, gidx, {r_('z', 'Z')}"))
def gwas_annotated(s, d):
    a = assoc.annotate(_scan(s, d).withColumn("c", F.col("chr")), fx.annotation(s, d))
    return rnd(a.select(F.col("c").alias("chr"), F.col("CHR").alias("CHROM"), "POS", "ID", "REF", "ALT", "gidx", "Z"))


@query(_gwas_sql("wald", "", f"round(median(z * z) / 0.4549364, 5) + 0.0 AS lambda_gc, round(avg(z * z), 5) + 0.0 AS mean_chi2, count(*) AS n"))
def lambda_gc(s, d):
    return rnd(assoc.lambda_gc(_scan(s, d), z_col="Z"), 5)


@query(ctes("g", "ph", more="a AS (SELECT chr, gidx, avg(d) AS mu, count(*) AS n, sum(coalesce(d, 0) * y_bin) AS cs FROM g JOIN ph USING (sample_idx) GROUP BY 1, 2), m AS (SELECT *, 2 * least(mu / 2, 1 - mu / 2) * n AS mac FROM a)") + f"SELECT chr, gidx, {r_('mac', 'MAC')}, {r_('cs', 'MAC_CASE')}, {r_('mac - cs', 'MAC_CTRL')} FROM m")
def allele_counts(s, d):
    return rnd(assoc.allele_counts(fx.genotypes(s, d), fx.phenotypes(s, d)))


def _null(s, d):
    """A null model with a known linear predictor per chromosome."""
    p = fx.phenotypes(s, d)
    chrs = s.range(1, 9).select(F.col("id").cast("int").alias("chr"))
    return p.join(F.broadcast(chrs)).select("sample_idx", "chr", F.col("y_bin").cast("double").alias("y"), ((F.col("age") - 60) / 50 + 0.1 * F.col("sex") + 0.02 * F.col("chr")).alias("eta"))


@query(
    ctes("g", "ph", more="""nu AS (SELECT sample_idx, c::INT AS chr, y_bin::DOUBLE AS y, (age - 60) / 50 + 0.1 * sex + 0.02 * c AS eta FROM ph, range(1, 9) t(c)),
nw AS (SELECT sample_idx, chr, y - 1 / (1 + exp(-eta)) AS r, greatest(1 / (1 + exp(-eta)) * (1 - 1 / (1 + exp(-eta))), 1e-12) AS w FROM nu),
a AS (SELECT chr, gidx, sum(w) AS sw, sum(r) AS sr, sum(coalesce(d, 0) * w) AS gw, sum(coalesce(d, 0) * coalesce(d, 0) * w) AS ggw, sum(coalesce(d, 0) * r) AS gr FROM g JOIN nw USING (sample_idx, chr) GROUP BY 1, 2),
u AS (SELECT chr, gidx, gr - gw / sw * sr AS u, greatest(ggw - gw * gw / sw, 1e-18) AS v FROM a)""")
    + f"SELECT chr, gidx, {r_('u', 'U')}, {r_('v', 'V')}, {r_('u / v', 'BETA')}, {r_('1 / sqrt(v)', 'SE')}, {r_('u / sqrt(v)', 'Z')}, {r_(p_from_z_sql('(u / sqrt(v))'), 'P_NORM')} FROM u"
)
def binary_score(s, d):
    return rnd(assoc.binary_score(fx.genotypes(s, d), _null(s, d)).select("chr", "gidx", "U", "V", "BETA", "SE", "Z", "P_NORM"))


@query()
def gwas_binary_spa(s, d):
    return assoc.binary_gwas(fx.genotypes(s, d), _null(s, d))


@query(ctes("ss") + f"SELECT gidx, {r_(chi2_isf_sql('P'), 'chi2', 5)} FROM ss WHERE P > 0 AND P < 1")
def chi2_from_p(s, d):
    return rnd(fx.sumstats(s, d).where("P > 0 and P < 1").select("gidx", chi2_isf_col(F.col("P")).alias("chi2")), 5)


# scores and cohort
@query(ctes("g", "st", "w") + f"SELECT sample_idx, {r_('sum(beta * (coalesce(d, 0) - mu_x))', 'score')} FROM g JOIN w USING (gidx) JOIN st USING (gidx) GROUP BY sample_idx")
def score_centred(s, d):
    return rnd(score.score(fx.genotypes(s, d), fx.weights(s, d)))


@query(ctes("g", "st", "w") + f"SELECT sample_idx, {r_('sum(beta * (coalesce(d, mu_x) - mu_x))', 'score')} FROM g JOIN w USING (gidx) JOIN st USING (gidx) GROUP BY sample_idx")
def score_imputed(s, d):
    return rnd(score.score(fx.genotypes(s, d), fx.weights(s, d), missing="mean"))


@query(ctes("g", "w") + f"SELECT sample_idx, {r_('sum(beta * coalesce(d, 0))', 'score')} FROM g JOIN w USING (gidx) GROUP BY sample_idx")
def score_raw(s, d):
    return rnd(score.score(fx.genotypes(s, d), fx.weights(s, d), center=False))


@query(ctes("g", "st", "w") + f"SELECT sample_idx, {r_('sum(beta * (coalesce(d, 0) - mu_x))', 'score')} FROM g JOIN w USING (gidx) JOIN st USING (gidx) GROUP BY sample_idx")
def score_packed(s, d):
    n = s.read.parquet(f"{d}/embeddings.parquet").agg(F.max("vec_id") + 1).first()[0]
    return rnd(packed.score(packed.pack_variants(fx.genotypes(s, d), n), fx.weights(s, d), n))


@query(
    ctes("ph", more="""m AS (SELECT avg(y) AS my, avg(age) AS ma, avg(sex) AS ms, covar_pop(age, y) AS cay, covar_pop(sex, y) AS csy, var_pop(age) AS vaa, var_pop(sex) AS vss, covar_pop(age, sex) AS cas FROM ph),
b AS (SELECT my, ma, ms, (cay * vss - csy * cas) / (vaa * vss - cas * cas) AS ba, (csy * vaa - cay * cas) / (vaa * vss - cas * cas) AS bs FROM m)""")
    + f"SELECT sample_idx, {r_('y - (my + ba * (age - ma) + bs * (sex - ms))', 'y_train')}, y AS y_original, {r_('my + ba * (age - ma) + bs * (sex - ms)', 'y_hat')} FROM ph, b"
)
def cohort_residuals(s, d):
    r, _ = cohort.residualise(fx.phenotypes(s, d), "y", ["age", "sex"])
    return rnd(r.select("sample_idx", "y_train", "y_original", "y_hat"), 6, "y_train", "y_hat")


@query(ctes("ph") + "SELECT sample_idx, CASE WHEN sample_idx % 10 = 9 THEN NULL WHEN y_bin = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM ph")
def recode_binary(s, d):
    coded = F.when(F.col("sample_idx") % 10 == 9, -9).otherwise(F.col("y_bin") + 1)
    return cohort.recode_binary(fx.phenotypes(s, d).select("sample_idx", coded.alias("y")))[0]


@query(ctes("ph") + "SELECT sample_idx, CASE WHEN sample_idx % 6 <> 0 AND sample_idx % 4 <> 0 THEN age END AS age, CASE WHEN sample_idx % 6 <> 0 AND sample_idx % 4 <> 0 THEN sex END AS sex FROM ph")
def load_covariates(s, d):
    p = fx.phenotypes(s, d)
    phe = p.where("sample_idx % 6 <> 0").select("fid", "age", F.when(F.col("sample_idx") % 4 != 0, F.col("sex")).alias("sex"))
    return cohort.load_covariates(p.select("sample_idx", "fid"), phe, ["age", "sex"]).drop("fid")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS \"row\" FROM orders")
def rank_in_order(s, d):
    return cohort.rank_in_order(s.read.parquet(f"{d}/orders.parquet").select("o_orderkey"), "o_orderkey")


# screening
_UNI = """yc AS (SELECT sample_idx, y_sig AS y, y_sig - avg(y_sig) OVER () AS yc, avg(y_sig) OVER () AS ybar FROM sig),
yy AS (SELECT sum(yc * yc) AS syy, count(*) AS n, any_value(ybar) AS ybar FROM yc),
pos AS (SELECT *, row_number() OVER (PARTITION BY chr ORDER BY gidx) - 1 AS vidx FROM st),
lam AS (SELECT chr, quantile_cont(sxx, 0.05) AS lam FROM pos WHERE maf >= 0.2 AND sxx > 0 GROUP BY chr),
num AS (SELECT chr, gidx, sum((coalesce(d, 0) - mu_x) * yc) AS num FROM g JOIN st USING (chr, gidx) JOIN yc USING (sample_idx) GROUP BY 1, 2),
un AS (SELECT chr, gidx, vidx, mu_x, sxx, maf, sxx + lam AS den, num / greatest(sxx + lam, 1e-20) AS beta, ybar - num / greatest(sxx + lam, 1e-20) * mu_x AS alpha, n, syy FROM pos JOIN lam USING (chr) JOIN num USING (chr, gidx), yy WHERE maf >= 0.2 AND sxx > 0)"""
_STRENGTH = {"r2_se": "beta * beta * maf * (1 - maf) * n * sxx / syy", "r2": "beta * beta * sxx / syy", "beta_abs": "abs(beta)", "z_abs": "abs(beta) * sqrt(n * sxx / syy)", "chi2": "beta * beta * n * sxx / syy"}


def _uni(s, d):
    g = fx.genotypes(s, d)
    return screen.univariate(g, fx.phenotypes_sig(s, d), stats.variant_stats(g), maf_min=0.2, y_col="y_sig")


@query(ctes("g", "st", "ph", "sig", more=_UNI) + f"SELECT chr, {r_('lam', 'lam')} FROM lam")
def ridge_quantile(s, d):
    return rnd(screen.ridge_quantile(stats.variant_stats(fx.genotypes(s, d)), maf_min=0.2))


@query(ctes("g", "st", "ph", "sig", more=_UNI) + f"SELECT chr, gidx, vidx, {r_('den', 'den')}, {r_('beta', 'beta')}, {r_('alpha', 'alpha')} FROM un")
def screen_univariate(s, d):
    return rnd(_uni(s, d).select("chr", "gidx", "vidx", "den", "beta", "alpha"))


def _strength_query(name: str) -> None:
    @query(ctes("g", "st", "ph", "sig", more=_UNI) + f"SELECT chr, gidx, {r_(_STRENGTH[name], 'strength')} FROM un", name=f"strength_{name}")
    def q(s, d):
        return rnd(screen.with_strength(_uni(s, d), name).select("chr", "gidx", "strength"))


for _n in strength_names():
    if _n in _STRENGTH:
        _strength_query(_n)

_TOP = _UNI + f""",
win AS (SELECT *, {_STRENGTH['r2_se']} AS strength, CAST(floor((row_number() OVER (PARTITION BY chr ORDER BY vidx) - 1) / 4) + 1 AS INT) AS "window" FROM un),
tk AS (SELECT *, row_number() OVER (PARTITION BY chr, "window" ORDER BY strength DESC, vidx) AS rank FROM win)"""


@query(ctes("g", "st", "ph", "sig", more=_TOP) + f"SELECT chr, \"window\", gidx, rank::INT AS rank, {r_('strength', 'strength')} FROM tk WHERE rank <= 2")
def window_topk(s, d):
    return rnd(screen.window_top(screen.with_strength(_uni(s, d)), 4, k=2).select("chr", "window", "gidx", "rank", "strength"))


@query(
    ctes("g", "st", "ph", "sig", more=_TOP + """,
lo AS (SELECT chr, gidx, sample_idx, y, coalesce(d, 0) - mu_x AS xc, den, alpha, beta, mu_x, n FROM g JOIN (SELECT * FROM tk WHERE rank <= 2) USING (chr, gidx) JOIN yc USING (sample_idx))""".replace("JOIN (SELECT * FROM tk", "JOIN (SELECT chr, gidx, mu_x, den, alpha, beta, n, rank FROM tk"))
    + f"SELECT chr, gidx, sample_idx, y, {r_('y - (y - (alpha + beta * mu_x + beta * xc)) / (1 - (1.0::DOUBLE / n + xc * xc / greatest(den, 1e-20)))', 'loo')} FROM lo"
)
def loo_predictions(s, d):
    c = screen.window_top(screen.with_strength(_uni(s, d)), 4, k=2)
    return rnd(screen.loo_predictions(fx.genotypes(s, d), fx.phenotypes_sig(s, d), c, "y_sig"), 6, "loo")


@query()
def screen_lasso(s, d):
    return screen.screen(fx.genotypes(s, d), fx.phenotypes_sig(s, d), window_size=8, maf_min=0.1, y_col="y_sig")


# joint model and LOCO
@query()
def joint_lasso(s, d):
    g, p = fx.genotypes(s, d), fx.phenotypes_sig(s, d)
    return lasso.joint_lasso(g, g.select("chr", "gidx").distinct(), p, 0.1, "y_sig", ["age", "sex"]).table(s)


@query()
def loco_ols(s, d):
    g, p = fx.genotypes(s, d), fx.phenotypes_sig(s, d)
    fit = lasso.joint_lasso(g, g.select("chr", "gidx").distinct(), p, 0.1, "y_sig", ["age", "sex"])
    return lasso.loco_ols(g, fit, p, ["age", "sex"])


@query(
    ctes("g", "st", "w", more="c AS (SELECT gidx, chr, beta, mu_x AS mean FROM w JOIN st USING (gidx)), pt AS (SELECT sample_idx, g.chr AS chr, sum(beta * (coalesce(d, 0) - mean)) AS part FROM g JOIN c USING (gidx) GROUP BY 1, 2)")
    + f"SELECT sample_idx, chr, {r_('sum(part) OVER (PARTITION BY sample_idx) - part + 4.5', 'yhat')} FROM pt"
)
def loco_masked(s, d):
    g = fx.genotypes(s, d)
    c = fx.weights(s, d).join(stats.variant_stats(g).select("gidx", "chr", F.col("mu_x").alias("mean")), "gidx")
    return rnd(lasso.loco_masked(g, c, 4.5))


# loci
_CLUMP = """hit AS (SELECT CHR, POS, gidx, ID, P FROM ss WHERE P < 5e-8),
lst AS (SELECT CHR, list({'p': P, 'pos': POS, 'g': gidx} ORDER BY P, POS, gidx) AS l FROM hit GROUP BY CHR),
rec AS (SELECT CHR, l[1] AS top, list_filter(l, lambda x: abs(x.pos - l[1].pos) > 1000000) AS l FROM lst UNION ALL
  SELECT CHR, l[1], list_filter(l, lambda x: abs(x.pos - l[1].pos) > 1000000) FROM rec WHERE len(l) > 0),
lead AS (SELECT CHR, top.pos AS POS, top.g AS gidx, top.p AS P FROM rec)"""


def _flank(kb: int) -> str:
    return f"""fl AS (SELECT l.CHR, l.gidx AS lead_gidx, l.POS AS lead_pos, l.P AS lead_p, greatest(l.POS - {kb * 1000}, 0) AS start_bp, l.POS + {kb * 1000} AS end_bp,
  (SELECT count(*) FROM hit h WHERE h.CHR = l.CHR AND h.POS BETWEEN greatest(l.POS - {kb * 1000}, 0) AND l.POS + {kb * 1000}) AS n_gws_variants FROM lead l)"""


_MERGE = """mb AS (SELECT *, max(end_bp) OVER (PARTITION BY CHR ORDER BY start_bp, lead_pos, lead_gidx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bef FROM fl),
mg AS (SELECT *, sum(CASE WHEN bef IS NULL OR start_bp > bef THEN 1 ELSE 0 END) OVER (PARTITION BY CHR ORDER BY start_bp, lead_pos, lead_gidx) AS grp FROM mb),
mr AS (SELECT CHR, min(start_bp) AS start_bp, max(end_bp) AS end_bp, sum(n_gws_variants)::BIGINT AS n_gws_variants, (list({'p': lead_p, 'pos': lead_pos, 'g': lead_gidx} ORDER BY lead_p, lead_pos, lead_gidx))[1] AS b FROM mg GROUP BY CHR, grp),
lm AS (SELECT CHR, b.g AS lead_gidx, b.pos AS lead_pos, b.p AS lead_p, start_bp, end_bp, n_gws_variants FROM mr)"""
_HLA_AT = (6, 100_000_000, 140_000_000)
_HLA_SQL = f"""ht AS (SELECT *, CHR = {_HLA_AT[0]} AND start_bp <= {_HLA_AT[2]} AND end_bp >= {_HLA_AT[1]} AS is_hla FROM lm),
hc AS (SELECT CHR, min(start_bp) AS start_bp, max(end_bp) AS end_bp, sum(n_gws_variants)::BIGINT AS n_gws_variants, bool_or(is_hla) AS is_hla, (list({{'p': lead_p, 'pos': lead_pos, 'g': lead_gidx}} ORDER BY lead_p, lead_pos, lead_gidx))[1] AS b FROM ht GROUP BY CHR, CASE WHEN is_hla THEN 'hla' ELSE lead_gidx::VARCHAR END),
lh AS (SELECT CHR, b.g AS lead_gidx, b.pos AS lead_pos, b.p AS lead_p, start_bp, end_bp, n_gws_variants, is_hla FROM hc)"""


def _hits(s, d):
    return loci.significant(fx.sumstats(s, d))


@query(ctes("ss", more=_CLUMP) + "SELECT CHR, POS, gidx FROM lead")
def clump_leads(s, d):
    return loci.clump(_hits(s, d)).select("CHR", "POS", "gidx")


@query(ctes("ss", more=_CLUMP + ",\n" + _flank(500)) + "SELECT CHR, lead_gidx, lead_pos, start_bp, end_bp, n_gws_variants FROM fl")
def locus_flanks(s, d):
    h = _hits(s, d)
    return loci.flank(loci.clump(h), h).select("CHR", "lead_gidx", "lead_pos", "start_bp", "end_bp", "n_gws_variants")


@query(ctes("ss", more=",\n".join([_CLUMP, _flank(5000), _MERGE])) + "SELECT CHR, lead_gidx, lead_pos, start_bp, end_bp, n_gws_variants FROM lm")
def locus_merge(s, d):
    h = _hits(s, d)
    return loci.merge_overlapping(loci.flank(loci.clump(h), h, 5000)).select("CHR", "lead_gidx", "lead_pos", "start_bp", "end_bp", "n_gws_variants")


@query(ctes("ss", more=",\n".join([_CLUMP, _flank(5000), _MERGE, _HLA_SQL])) + "SELECT row_number() OVER (ORDER BY CHR, start_bp, lead_gidx)::INT AS locus_id, CHR, start_bp, end_bp, (end_bp - start_bp) / 1000.0::DOUBLE AS size_kb, lead_gidx, lead_pos, n_gws_variants, is_hla FROM lh")
def define_loci(s, d):
    return loci.define_loci(fx.sumstats(s, d), window_kb=5000, hla=_HLA_AT).drop("lead_id", "lead_p")


@query(ctes("ss", more=",\n".join([_CLUMP, _flank(500), _MERGE])) + "SELECT row_number() OVER (ORDER BY CHR, start_bp, lead_gidx)::INT AS locus_id, CHR, lead_gidx, lead_pos FROM (SELECT * FROM lm ORDER BY lead_p, CHR, start_bp LIMIT 20)")
def loci_capped(s, d):
    return loci.define_loci(fx.sumstats(s, d), hla=None, max_loci=20).select("locus_id", "CHR", "lead_gidx", "lead_pos")


_LOCI = "lc(locus_id, CHR, start_bp, end_bp) AS (VALUES (1, 1, 1000000, 2500000), (2, 6, 1400000, 3800000), (3, 3, 0, 900000), (4, 1, 2000000, 2000000))"


def _toy_loci(s):
    return s.createDataFrame([(1, 1, 1_000_000, 2_500_000), (2, 6, 1_400_000, 3_800_000), (3, 3, 0, 900_000), (4, 1, 2_000_000, 2_000_000)], "locus_id int, CHR int, start_bp long, end_bp long")


@query(ctes("g", "an", more=_LOCI) + "SELECT locus_id, gidx, an.CHR AS CHR, POS FROM an JOIN lc ON an.CHR = lc.CHR AND POS BETWEEN start_bp AND end_bp")
def locus_variants(s, d):
    return loci.locus_variants(fx.annotation(s, d), _toy_loci(s)).select("locus_id", "gidx", "CHR", "POS")


# fine-mapping columns
_FM = """fm AS (SELECT CAST(1 + user_id % 40 AS INT) AS locus_id, event_id AS gidx, (event_id * 37 % 100) / 100.0::DOUBLE AS sel_freq, (event_id * 53 % 97) / 97.0::DOUBLE AS susie_pip, CASE WHEN event_id % 11 < 2 THEN 1 ELSE 0 END AS in_susie_cs, value / 1e4 AS h2_contribution FROM events)"""
_CONS = _FM + """,
f1 AS (SELECT *, CASE WHEN sel_freq >= 0.6 AND in_susie_cs = 1 THEN 1 ELSE 0 END AS in_CCS FROM fm),
f2 AS (SELECT *, CASE WHEN in_CCS = 1 THEN susie_pip * sel_freq ELSE 0 END AS prod FROM f1),
f3 AS (SELECT *, sum(prod) OVER (PARTITION BY locus_id) AS concordance, sum(in_CCS) OVER (PARTITION BY locus_id) AS k FROM f2),
f4 AS (SELECT *, CASE WHEN concordance > 0 THEN prod / concordance ELSE 0 END AS ppip FROM f3),
f5 AS (SELECT *, max(ppip) OVER (PARTITION BY locus_id) AS top FROM f4),
f6 AS (SELECT *, CASE WHEN k > 0 AND k <= 3 AND top > 0.5 AND concordance > 0.3 THEN 'Resolved' WHEN k > 0 AND k <= 10 AND concordance > 0.1 THEN 'Narrowed' ELSE 'Unresolved' END AS locus_status FROM f5)"""


def _fm(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    return e.select((1 + F.col("user_id") % 40).cast("int").alias("locus_id"), F.col("event_id").alias("gidx"), ((F.col("event_id") * 37 % 100) / 100.0).alias("sel_freq"), ((F.col("event_id") * 53 % 97) / 97.0).alias("susie_pip"), F.when(F.col("event_id") % 11 < 2, 1).otherwise(0).alias("in_susie_cs"), (F.col("value") / 1e4).alias("h2_contribution"))


@query(ctes(more=_CONS) + f"SELECT locus_id, gidx, in_CCS, {r_('concordance', 'concordance')}, {r_('ppip', 'consensus_pPIP')}, locus_status FROM f6")
def consensus(s, d):
    return rnd(finemap.consensus(_fm(s, d)).select("locus_id", "gidx", "in_CCS", "concordance", "consensus_pPIP", "locus_status"))


@query(ctes(more=_CONS) + f"SELECT locus_id, count(*) AS n_variants, count(*) FILTER (susie_pip > 0.5) AS n_pip50, {r_('max(susie_pip)', 'max_susie_pip')}, {r_('max(sel_freq)', 'max_sel_freq')}, sum(in_susie_cs)::BIGINT AS n_susie_cs, sum(in_CCS)::BIGINT AS n_ccs, {r_('sum(h2_contribution)', 'h2')}, {r_('max(concordance)', 'concordance')}, any_value(locus_status) AS locus_status FROM f6 GROUP BY locus_id")
def locus_summary(s, d):
    return rnd(finemap.summarise(finemap.consensus(_fm(s, d))).drop("lead_gidx"))


_AW = """aw AS (SELECT CAST(1 + user_id % 40 AS INT) AS locus_id, event_id AS gidx, CASE WHEN event_id % 13 <> 0 THEN abs(value - 20) / 7 END AS zz FROM events),
am AS (SELECT *, median(zz) OVER (PARTITION BY locus_id) AS med FROM aw)"""


@query(ctes(more=_AW) + f"SELECT locus_id, gidx, {r_('greatest(least(med / greatest(coalesce(zz, med), 1e-6), 5), 0.2)', 'weight')} FROM am")
def adaptive_weights(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select((1 + F.col("user_id") % 40).cast("int").alias("locus_id"), F.col("event_id").alias("gidx"), F.when(F.col("event_id") % 13 != 0, (F.col("value") - 20) / 7).alias("Z"))
    return rnd(finemap.adaptive_weights(e).select("locus_id", "gidx", "weight"))


_AL = "al AS (SELECT CAST(1 + user_id % 40 AS INT) AS locus_id, CAST(event_id % 3 AS INT) AS effect, event_id AS gidx, value FROM events), an2 AS (SELECT locus_id, effect, gidx, value / sum(value) OVER (PARTITION BY locus_id, effect) AS alpha FROM al)"


@query(ctes(more=_AL) + "SELECT locus_id, effect, gidx, round(sum(alpha) OVER (PARTITION BY locus_id, effect ORDER BY alpha DESC, gidx) - alpha, 9) < 0.95 AS in_cs FROM an2")
def credible_prefix(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select((1 + F.col("user_id") % 40).cast("int").alias("locus_id"), (F.col("event_id") % 3).cast("int").alias("effect"), F.col("event_id").alias("gidx"), "value")
    a = e.withColumn("alpha", F.col("value") / F.sum("value").over(W.partitionBy("locus_id", "effect")))
    return finemap.credible_prefix(a).select("locus_id", "effect", "gidx", "in_cs")


def _packed_sig(s, d):
    n = s.read.parquet(f"{d}/embeddings.parquet").agg(F.max("vec_id") + 1).first()[0]
    return packed.pack_variants(fx.genotypes(s, d), n), fx.phenotypes_sig(s, d).select("sample_idx", F.col("y_sig").alias("y")), n


def _sig_loci(s):
    return s.createDataFrame([(1, 1, 1_000_000, 4_000_000), (2, 6, 1_000_000, 4_000_000)], "locus_id int, CHR int, start_bp long, end_bp long")


@query()
def finemap_susie(s, d):
    v, p, n = _packed_sig(s, d)
    return finemap.finemap(v, _sig_loci(s), fx.annotation(s, d), p, n, tier=1)[0]


@query()
def finemap_consensus(s, d):
    v, p, n = _packed_sig(s, d)
    return finemap.finemap(v, _sig_loci(s), fx.annotation(s, d), p, n)[0]


# relatedness and LD
@query(ctes("g") + f"SELECT a.chr AS chr, a.gidx AS gidx_a, b.gidx AS gidx_b, count(*) AS n, {r_('corr(a.d, b.d) ** 2', 'r2')} FROM g a JOIN g b ON a.sample_idx = b.sample_idx AND a.chr = b.chr AND a.gidx < b.gidx AND b.gidx - a.gidx <= 10 WHERE a.d IS NOT NULL AND b.d IS NOT NULL GROUP BY 1, 2, 3")
def ld_r2(s, d):
    return rnd(ld.ld_r2(fx.genotypes(s, d)))


@query(ctes("g") + "SELECT a.gidx AS gidx_a, b.gidx AS gidx_b, sum(coalesce(a.d, 0) * coalesce(b.d, 0)) AS xtx FROM g a JOIN g b ON a.sample_idx = b.sample_idx AND a.gidx <= b.gidx GROUP BY 1, 2")
def gram(s, d):
    return ld.gram(fx.genotypes(s, d))


_ZS = "zs AS (SELECT sample_idx, gidx, coalesce((d - mu_x) / sqrt(2 * (mu_x / 2) * (1 - mu_x / 2)), 0) AS z FROM g JOIN st USING (chr, gidx) WHERE maf > 0)"


@query(ctes("g", "st", more=_ZS) + f"SELECT a.sample_idx AS sample_a, b.sample_idx AS sample_b, {r_('sum(a.z * b.z) / (SELECT count(DISTINCT gidx) FROM zs)', 'grm')} FROM zs a JOIN zs b ON a.gidx = b.gidx AND a.sample_idx <= b.sample_idx GROUP BY 1, 2")
def grm(s, d):
    """Relationships among all samples."""
    return ld.grm_blocked(fx.genotypes(s, d), digits=6)


@query(ctes("g", more="k AS (SELECT a.sample_idx AS sample_a, b.sample_idx AS sample_b, count(*) FILTER (a.d = 1 AND b.d = 1) AS hh, count(*) FILTER (abs(a.d - b.d) = 2) AS opp, count(*) FILTER (a.d = 1) AS ha, count(*) FILTER (b.d = 1) AS hb FROM g a JOIN g b ON a.gidx = b.gidx AND a.sample_idx < b.sample_idx WHERE a.d IS NOT NULL AND b.d IS NOT NULL GROUP BY 1, 2)") + f"SELECT sample_a, sample_b, {r_('CASE WHEN least(ha, hb) > 0 THEN (hh - 2 * opp) / (2.0::DOUBLE * least(ha, hb)) + 0.5 - 0.25 * (ha + hb) / least(ha, hb) END', 'kinship')} FROM k")
def king(s, d):
    """Kinship of all pairs of samples."""
    return ld.king_blocked(fx.genotypes(s, d), digits=6)


@query()
def pca(s, d):
    return ld.pca(fx.genotypes(s, d), k=3)[0]


_PRUNE = """r2 AS (SELECT a.chr AS chr, a.gidx AS a, b.gidx AS b FROM g a JOIN g b ON a.sample_idx = b.sample_idx AND a.chr = b.chr AND a.gidx < b.gidx AND b.gidx - a.gidx <= 10 WHERE a.d IS NOT NULL AND b.d IS NOT NULL GROUP BY 1, 2, 3 HAVING corr(a.d, b.d) ** 2 >= 0.005),
nd AS (SELECT chr, list(gidx ORDER BY maf DESC, gidx) AS v FROM st GROUP BY chr),
pr AS (SELECT chr, list({'a': a, 'b': b}) AS p FROM r2 GROUP BY chr),
gr AS (SELECT chr, v, p, 1 AS i, []::BIGINT[] AS kept FROM nd LEFT JOIN pr USING (chr) UNION ALL
  SELECT chr, v, p, i + 1, CASE WHEN coalesce(len(list_filter(p, lambda x: (x.a = v[i] AND list_contains(kept, x.b)) OR (x.b = v[i] AND list_contains(kept, x.a)))), 0) = 0 THEN list_append(kept, v[i]) ELSE kept END FROM gr WHERE i <= len(v))"""


@query(ctes("g", "st", more=_PRUNE) + "SELECT chr, unnest(kept) AS gidx FROM gr WHERE i = len(v) + 1")
def ld_clump(s, d):
    g = fx.genotypes(s, d)
    return ld.ld_prune(ld.ld_r2(g), stats.variant_stats(g), 0.005)


# plots
@query(ctes("ss") + f"SELECT gidx, row_number() OVER (ORDER BY P, gidx) AS rank, {r_('-log10(P)', 'observed')}, {r_('-log10(row_number() OVER (ORDER BY P, gidx) / (count(*) OVER () + 1.0::DOUBLE))', 'expected')} FROM ss WHERE P > 0 AND P <= 1")
def qq_data(s, d):
    return rnd(plotdata.qq(fx.sumstats(s, d)))


@query(ctes("ss", more="mf AS (SELECT *, (gidx % 50) / 100.0::DOUBLE AS maf FROM ss WHERE P > 0 AND P <= 1), lb AS (SELECT *, CASE WHEN maf < 0.01 THEN '0-0.01' WHEN maf < 0.05 THEN '0.01-0.05' ELSE '0.05-0.5' END AS stratum FROM mf), bg AS (SELECT stratum FROM lb GROUP BY 1 HAVING count(*) >= 100)") + f"SELECT stratum, gidx, row_number() OVER (PARTITION BY stratum ORDER BY P, gidx) AS rank, {r_('-log10(P)', 'observed')}, {r_('-log10(row_number() OVER (PARTITION BY stratum ORDER BY P, gidx) / (count(*) OVER (PARTITION BY stratum) + 1.0::DOUBLE))', 'expected')} FROM lb WHERE stratum IN (SELECT stratum FROM bg)")
def qq_strata(s, d):
    return rnd(plotdata.qq_strata(fx.sumstats(s, d).withColumn("MAF", (F.col("gidx") % 50) / 100.0)))


@query(ctes("ss", more="m AS (SELECT CHR, max(POS) AS mx FROM ss GROUP BY CHR)") + 'SELECT CHR, coalesce(sum(mx) OVER (ORDER BY CHR ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM m')
def manhattan_offsets(s, d):
    return plotdata.offsets(fx.sumstats(s, d))


@query(ctes("ss", more="p AS (SELECT *, -log10(P) AS lp FROM ss WHERE P > 0 AND P <= 1), m AS (SELECT CHR, max(POS) AS mx FROM p GROUP BY CHR), o AS (SELECT CHR, coalesce(sum(mx) OVER (ORDER BY CHR ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM m)") + f"SELECT gidx, CHR, POS + off AS x, {r_('lp', 'logp')}, {r_('CASE WHEN lp > 7 THEN 7 + 10 * (log10(lp) - log10(7)) ELSE lp END', 'y')} FROM p JOIN o USING (CHR)")
def manhattan_full(s, d):
    """Every point (share 1) with the transformed axis; the default plot keeps a hashed hundredth of the weak ones."""
    return rnd(plotdata.manhattan(fx.sumstats(s, d), share=1.0, break_at=7.0))


@query(ctes("ss", more="p AS (SELECT *, -log10(P) AS lp FROM ss WHERE P > 0 AND P <= 1), k AS (SELECT * FROM p WHERE lp >= 3 OR ('0x' || substr(md5('42:' || gidx::VARCHAR), 1, 8))::BIGINT % 1000000 < 10000), m AS (SELECT CHR, max(POS) AS mx FROM k GROUP BY CHR), o AS (SELECT CHR, coalesce(sum(mx) OVER (ORDER BY CHR ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM m)") + f"SELECT gidx, CHR, POS + off AS x, {r_('lp', 'logp')}, {r_('CASE WHEN lp > 10 THEN 10 + 10 * (log10(lp) - log10(10)) ELSE lp END', 'y')} FROM k JOIN o USING (CHR)")
def manhattan(s, d):
    return rnd(plotdata.manhattan(fx.sumstats(s, d)))


# PRS
def _split(c):
    return F.when(c % 5 < 3, "train").when(c % 5 == 3, "val").otherwise("test")


def _prs_data(s, d):
    p = fx.phenotypes_sig(s, d)
    splits = p.select("fid", _split(F.col("sample_idx")).alias("split"))
    return prs.build_splits(p.select("sample_idx", "fid"), splits, p.select("fid", F.col("y_sig").alias("y"), "age", "sex"), ["age", "sex"])


@query(ctes("ph", more="sp AS (SELECT fid, sample_idx, CASE WHEN sample_idx % 5 < 3 THEN 'train' WHEN sample_idx % 5 = 3 THEN 'val' ELSE 'test' END AS split FROM ph)") + "SELECT split, count(*) AS nominal, count(*) FILTER (sample_idx % 7 <> 0) AS in_cohort, round(100.0 * count(*) FILTER (sample_idx % 7 <> 0) / count(*), 6) + 0.0 AS pct FROM sp GROUP BY split")
def split_coverage(s, d):
    p = fx.phenotypes(s, d)
    return rnd(prs.split_coverage(p.select("fid", _split(F.col("sample_idx")).alias("split")), p.where("sample_idx % 7 <> 0")))


@query(ctes("g", "ph", "w", "st", more="sc AS (SELECT sample_idx, sum(beta * (coalesce(d, 0) - mu_x)) AS score FROM g JOIN w USING (gidx) JOIN st USING (gidx) GROUP BY 1)") + f"SELECT 0.0::DOUBLE AS r2_cov, {r_('regr_r2(y, score)', 'r2_full')}, {r_('regr_r2(y, score)', 'r2_increment')}, count(*) AS n FROM sc JOIN ph USING (sample_idx)")
def prs_r2(s, d):
    sc = score.score(fx.genotypes(s, d), fx.weights(s, d)).join(fx.phenotypes(s, d), "sample_idx")
    return rnd(prs.r2(sc))


@query(ctes("g", "ph", "w", "st", more="sc AS (SELECT sample_idx, round(sum(beta * (coalesce(d, 0) - mu_x)), 6) AS score FROM g JOIN w USING (gidx) JOIN st USING (gidx) GROUP BY 1), rk AS (SELECT y_bin, count(*) OVER (ORDER BY score RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r FROM sc JOIN ph USING (sample_idx))") + f"SELECT {r_('(sum(r) FILTER (y_bin = 1) - count(*) FILTER (y_bin = 1) * (count(*) FILTER (y_bin = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y_bin = 1) * count(*) FILTER (y_bin = 0))', 'auc')}, (count(*) FILTER (y_bin = 1))::BIGINT AS n_case, (count(*) FILTER (y_bin = 0))::BIGINT AS n_ctrl FROM rk")
def prs_auc(s, d):
    sc = rnd(score.score(fx.genotypes(s, d), fx.weights(s, d))).join(fx.phenotypes(s, d), "sample_idx")
    return rnd(prs.rank_auc(sc, "y_bin"))


@query()
def prs_pipeline(s, d):
    return prs.prs(fx.genotypes(s, d), _prs_data(s, d)[0], alphas=(0.05, 0.1, 0.3), covariates=["age", "sex"], window_size=64, maf_min=0.05).metrics


@query(ctes("g", "st", "ph", "sig", more=_TOP) + f"SELECT chr, gidx, {r_('strength', 'strength')} FROM tk ORDER BY strength DESC, chr, gidx LIMIT 10")
def candidates_capped(s, d):
    return rnd(screen.cap(screen.with_strength(_uni(s, d)), 10).select("chr", "gidx", "strength"))


@query(ctes("g", "st", "ph", "sig", more=_UNI + ", ch AS (SELECT *, CASE WHEN vidx < 4 THEN 0 ELSE 1 END AS chunk FROM un)") + "SELECT chr, chunk::INT AS chunk, count(*) AS n_variants FROM ch GROUP BY 1, 2")
def screening_chunks(s, d):
    """Variants of each chromosome's chunks at the edges n * i // k, after the screen's filter."""
    (_, b), _ = screen.chunk_edges(8, 2)
    u = _uni(s, d).withColumn("chunk", F.when(F.col("vidx") < b, 0).otherwise(1))
    return u.groupBy("chr", "chunk").agg(F.count(F.lit(1)).alias("n_variants"))


@query(ctes("g", "st", more="z AS (SELECT sample_idx, d, mu_x FROM g JOIN st USING (chr, gidx) WHERE gidx < 8)") + f"SELECT sample_idx, 1 AS pc, {r_('sum((coalesce(d, mu_x) - mu_x) * 0.25)', 'score')} FROM z GROUP BY sample_idx")
def pc_project(s, d):
    """Scores on given loadings (a constant quarter on eight variants)."""
    g = fx.genotypes(s, d)
    load = stats.variant_stats(g).where("gidx < 8").select("gidx", F.lit(1).alias("pc"), F.lit(0.25).alias("loading"), "mu_x")
    return rnd(ld.pc_project(g, load))


@query(ctes("g", more="o AS (SELECT sample_idx, row_number() OVER (ORDER BY sample_idx DESC) - 1 AS new_idx FROM (SELECT DISTINCT sample_idx FROM g))") + "SELECT new_idx AS sample_idx, chr, gidx, d::TINYINT AS dosage FROM g JOIN o USING (sample_idx)")
def reindexed_samples(s, d):
    """All samples gathered in reverse order."""
    g = fx.genotypes(s, d)
    order = g.select("sample_idx").distinct().select("sample_idx", (F.row_number().over(W.orderBy(F.desc("sample_idx"))) - 1).cast("long").alias("new_idx"))
    return subset.reindex_samples(g, order).select("sample_idx", "chr", "gidx", "dosage")


@query(ctes("ss") + "SELECT CHR, POS, gidx FROM ss WHERE P < 5e-8")
def significant_hits(s, d):
    return loci.significant(fx.sumstats(s, d)).select("CHR", "POS", "gidx")


@query(ctes("g", "st") + "SELECT chr, gidx FROM st WHERE maf >= 0.2 AND sxx > 0")
def screen_filter(s, d):
    st = stats.variant_stats(fx.genotypes(s, d))
    return st.where((F.col("maf") >= 0.2) & (F.col("sxx") > 0)).select("chr", "gidx")


from varloom import registry_io  # noqa: E402, F401 - adds its queries to the same tables
