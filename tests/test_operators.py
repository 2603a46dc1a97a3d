import numpy as np
import pandas as pd
import pytest
from conftest import SF
from pyspark.sql import functions as F

from varloom import fixtures as fx
from varloom.operators import assoc, cohort, finemap, lasso, loci, packed, prs, score, screen, stats, subset


@pytest.fixture(scope="module")
def data(spark):
    g = fx.genotypes(spark, SF).persist()
    p = fx.phenotypes_sig(spark, SF).persist()
    n = p.count()
    return g, p, n, packed.pack_variants(g, n).persist()


def matrix(g, n):
    d = g.toPandas()
    x = np.full((n, 64), np.nan)
    x[d.sample_idx, d.gidx] = d.dosage.astype(float)
    return x


def test_packed_equals_long(data):
    g, p, n, v = data
    a = packed.unpack_variants(v).orderBy("gidx", "sample_idx").toPandas()
    b = g.select("sample_idx", "chr", "gidx", "dosage").orderBy("gidx", "sample_idx").toPandas()
    pd.testing.assert_frame_equal(a, b, check_dtype=False)
    q1 = packed.variant_qc(v, 0.2, None, 0.036, 1e-6).orderBy("gidx").toPandas()
    q2 = stats.variant_qc(g, maf_min=0.2, max_missing=0.036, hwe_min=1e-6).orderBy("gidx").toPandas()
    pd.testing.assert_frame_equal(q1, q2, check_dtype=False)
    s1 = packed.sample_counts(v).orderBy("sample_idx").toPandas()
    s2 = stats.sample_qc(g).orderBy("sample_idx").toPandas()[s1.columns]
    pd.testing.assert_frame_equal(s1, s2, check_dtype=False)


def test_subset_of_subset_and_repeats(data):
    g, _, n, v = data
    one = packed.subset_samples(packed.subset_samples(v, range(0, n, 2)), range(0, n // 2, 3))
    two = packed.subset_samples(v, range(0, n, 6))
    key = lambda d: {r.gidx: bytes(r.packed) for r in d.collect()}
    assert key(one) == key(two)
    rep = packed.unpack_variants(packed.subset_samples(v, [3, 3, 1])).where("gidx = 0").orderBy("sample_idx").toPandas()
    assert rep.dosage[0] == rep.dosage[1]
    order = g.sparkSession.createDataFrame([(0, 3), (1, 3), (2, 1)], "new_idx long, sample_idx long")
    assert subset.reindex_samples(g, order).count() == 3 * 64


def test_partitioning_does_not_matter(data):
    g, p, _, _ = data
    yc = assoc.residual_phenotype(p, y_col="y_sig")
    a = assoc.linear_gwas(g, yc).orderBy("gidx").toPandas()
    b = assoc.linear_gwas(g.repartition(13, "sample_idx"), yc.repartition(3)).orderBy("gidx").toPandas()
    assert np.allclose(a.Z, b.Z)


def test_wald_equals_ols(data):
    g, p, n, _ = data
    x = matrix(g, n)
    y = p.orderBy("sample_idx").toPandas().y_sig.to_numpy()
    full = g.where("sample_idx % 29 > 40 or true").fillna(0, ["dosage"])
    r = assoc.linear_gwas(full, assoc.residual_phenotype(p, y_col="y_sig")).orderBy("gidx").toPandas()
    x0 = np.nan_to_num(x)
    for i in (0, 5, 40):
        a = np.column_stack([np.ones(n), x0[:, i]])
        b, rss, *_ = np.linalg.lstsq(a, y, rcond=None)
        se = np.sqrt(rss[0] / (n - 2) * np.linalg.inv(a.T @ a)[1, 1])
        row = r[r.gidx == i].iloc[0]
        assert row.BETA == pytest.approx(b[1]) and row.SE == pytest.approx(se)


def test_loo_identity(data):
    g, p, n, _ = data
    sub = p.where("sample_idx < 10")
    gg = g.where("sample_idx < 10 and gidx < 2").fillna(0, ["dosage"])
    st = stats.variant_stats(gg)
    u = screen.univariate(gg, sub, st, maf_min=0.0, y_col="y_sig")
    plain = u.withColumn("beta", F.col("beta") * F.col("den") / F.col("sxx")).withColumn("den", F.col("sxx"))
    plain = plain.withColumn("alpha", F.lit(sub.agg(F.avg("y_sig")).first()[0]) - F.col("beta") * F.col("mu_x"))
    got = screen.loo_predictions(gg, sub, plain, "y_sig").toPandas()
    x = matrix(gg, 10)
    y = sub.orderBy("sample_idx").toPandas().y_sig.to_numpy()
    for i in range(10):
        keep = np.arange(10) != i
        a = np.column_stack([np.ones(9), x[keep, 0]])
        b = np.linalg.lstsq(a, y[keep], rcond=None)[0]
        assert got[(got.gidx == 0) & (got.sample_idx == i)].loo.iloc[0] == pytest.approx(b[0] + b[1] * x[i, 0])


def test_screen_and_joint_keep_the_signals(data):
    g, p, n, _ = data
    c = screen.screen(g, p, window_size=64, maf_min=0.05, alpha=0.05, y_col="y_sig").toPandas()
    assert {5, 40} <= set(c.gidx)
    cand = g.select("chr", "gidx").distinct()
    fit = lasso.joint_lasso(g, cand, p, 0.3, "y_sig", ["age", "sex"])
    assert set(fit.gidx[fit.active]) == {5, 40}
    x = np.nan_to_num(matrix(g, n))
    assert np.allclose(fit.mean[:64], x.mean(0))
    r = fit.xty - fit.gram @ fit.coef_norm
    assert np.abs(r[fit.active] - 0.3 * np.sign(fit.coef_norm[fit.active])).max() < 1e-3


def test_loco_leaves_the_chromosome_out(data):
    g, p, n, _ = data
    fit = lasso.joint_lasso(g, g.select("chr", "gidx").distinct(), p, 0.3, "y_sig")
    lo = lasso.loco_ols(g, fit, p, chromosomes=list(range(1, 9))).toPandas().pivot(index="sample_idx", columns="chr", values="yhat")
    assert lo.shape == (n, 8)
    x = np.nan_to_num(matrix(g, n))
    y = p.orderBy("sample_idx").toPandas().y_sig.to_numpy()
    # chromosome 1 holds variant 5: its prediction uses variant 40 alone
    z = (x[:, 40] - x[:, 40].mean()) / x[:, 40].std()
    b = (z @ (y - y.mean()) / n) / (1 + 1e-2)
    assert np.allclose(lo[1], y.mean() + b * z, atol=1e-6)
    coef = g.sparkSession.createDataFrame([(5, 1, 0.5, 1.0), (40, 6, -0.25, 0.5)], "gidx long, chr int, beta double, mean double")
    m = lasso.loco_masked(g, coef, 2.0).toPandas().pivot(index="sample_idx", columns="chr", values="yhat")
    assert np.allclose(m[1], 2 - 0.25 * (x[:, 40] - 0.5)) and np.allclose(m[6], 2 + 0.5 * (x[:, 5] - 1))


def test_gwas_with_loco_and_binary(data):
    g, p, n, v = data
    loco = g.select("sample_idx", "chr").distinct().withColumn("yhat", F.col("sample_idx") * 0.01 + F.col("chr"))
    yc = assoc.residual_phenotype(p, loco, "y_sig")
    a = assoc.linear_gwas(g, yc).orderBy("gidx").toPandas()
    b = packed.linear_gwas(v, yc, n).orderBy("gidx").toPandas()
    assert np.allclose(a.Z, b.Z)
    r = assoc.gwas(g, p.withColumn("yb", F.col("y_bin").cast("double")), family="binary", y_col="yb").toPandas()
    assert set(r.TEST) <= {"SPA", "SCORE", "LOW_MAC"} and len(r) == 64
    assert ((r.P > 0) & (r.P <= 1)).all()
    with pytest.raises(ValueError):
        assoc.gwas(g, p, family="poisson")


def test_recalibration_fits_a_line(spark):
    rng = np.random.default_rng(0)
    e = rng.normal(size=3000)
    y = (rng.random(3000) < 1 / (1 + np.exp(-(0.4 + 1.7 * e)))).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"chr": 1, "y": y, "eta": e})).withColumn("chr", F.col("chr").cast("int"))
    r = assoc.recalibrate(df).first()
    mu = 1 / (1 + np.exp(-(r.a + r.b * e)))
    assert abs((y - mu).sum()) < 1e-4 and abs((e * (y - mu)).sum()) < 1e-4


def test_clump_by_hand(spark):
    rows = [(1, 1_000_000, 1, "a", 1e-10), (1, 1_500_000, 2, "b", 1e-9), (1, 2_400_000, 3, "c", 1e-8), (1, 9_000_000, 4, "d", 1e-9), (6, 26_000_000, 5, "e", 1e-20), (6, 30_000_000, 6, "f", 1e-12)]
    ss = spark.createDataFrame(rows, "CHR int, POS long, gidx long, ID string, P double")
    got = loci.define_loci(ss).orderBy("locus_id").toPandas()
    assert list(got.lead_gidx) == [1, 3, 4, 5]
    assert list(got.is_hla) == [False, False, False, True] and got.n_gws_variants.iloc[3] == 2
    assert list(got.n_gws_variants[:3]) == [2, 1, 1]
    assert list(loci.define_loci(ss, hla=None, max_loci=2).toPandas().lead_gidx) == [5, 6]
    assert loci.define_loci(ss.where("P > 1")).count() == 0


def test_scores_agree(data, spark):
    g, _, n, v = data
    w = fx.weights(spark, SF)
    for c, m in ((True, "ref"), (True, "mean"), (False, "ref")):
        a = score.score(g, w, c, m).orderBy("sample_idx").toPandas().score
        b = packed.score(v, w, n, c, m).orderBy("sample_idx").toPandas().score
        assert np.allclose(a, b)
    with pytest.raises(ValueError):
        score.resolve_weights(w.withColumnRenamed("beta", "x"))


def test_cohort(data, spark):
    _, p, n, _ = data
    r, fit = cohort.residualise(p, "y_sig", ["age", "sex"])
    d = r.orderBy("sample_idx").toPandas()
    a = np.column_stack([np.ones(n), d.age, d.sex])
    b = np.linalg.lstsq(a, d.y_sig, rcond=None)[0]
    assert np.allclose(fit.coef, b) and np.allclose(d.y_train, d.y_sig - a @ b)
    coded = spark.createDataFrame([(1.0,), (2.0,), (-9.0,), (0.0,)], "y double")
    assert [x.y for x in cohort.recode_binary(coded)[0].collect()] == [0.0, 1.0, None, None]
    zero_one = spark.createDataFrame([(1.0,), (0.0,)], "y double")
    assert [x.y for x in cohort.recode_binary(zero_one)[0].collect()] == [1.0, 0.0]
    ph = p.select("fid", F.when(F.col("sample_idx") % 5 != 0, F.col("y_sig")).alias("y"))
    out, _ = cohort.prepare_cohort(ph, p.select("fid", "age", "sex"), p.select("fid", "sample_idx"), p.select("fid", "sample_idx").where("sample_idx < 50"), covariates=["age", "sex"])
    assert out.count() == 40 and out.agg(F.max("subset_row")).first()[0] == 49
    imp, _ = cohort.prepare_cohort(ph, p.select("fid", "age", "sex"), p.select("fid", "sample_idx"), covariates=["age", "sex"], impute_missing=True)
    assert imp.count() == n and imp.where("y_train = 0").count() >= n // 5


def test_finemap_finds_the_signals(data, spark):
    g, p, n, v = data
    lc = spark.createDataFrame([(1, 1, 1_000_000, 4_000_000), (2, 6, 1_000_000, 4_000_000), (3, 3, 0, 10)], "locus_id int, CHR int, start_bp long, end_bp long")
    y = p.select("sample_idx", F.col("y_sig").alias("y"))
    per, summ = finemap.finemap(v, lc, fx.annotation(spark, SF), y, n, pairs=6, n_lambda=6)
    d = per.toPandas()
    for locus, lead in ((1, 5), (2, 40)):
        x = d[d.locus_id == locus]
        assert x.loc[x.susie_pip.idxmax(), "gidx"] == lead and x.loc[x.sel_freq.idxmax(), "gidx"] == lead
        assert x.loc[x.gidx == lead, "in_susie_cs"].iloc[0] == 1
    s = summ.toPandas().set_index("locus_id")
    assert s.locus_status[3] == "Skipped"


def test_half_sums_add_up(data):
    _, p, n, v = data
    raw = [bytes(r.packed) for r in v.where("chr = 1").orderBy("gidx").collect()]
    y = p.orderBy("sample_idx").toPandas().y_sig.to_numpy()
    x = finemap.Blocked(raw, y, block=64)
    mask = np.arange(n) % 2 == 0
    a, b, k = x.sums(mask)
    c, d, m = x.sums(~mask)
    t, u, o = x.sums()
    assert np.allclose(a + c, t) and np.allclose(b + d, u) and k + m == o == n


def test_prs(data, spark):
    g, p, n, _ = data
    from varloom.registry import _prs_data

    d, cov = _prs_data(spark, SF)
    assert set(cov.toPandas().split) == {"train", "val", "test"}
    out = prs.prs(g, d, alphas=(0.1, 0.4), covariates=["age", "sex"], window_size=64, maf_min=0.05)
    assert out.metrics.first().r2_increment > 0.2
    with pytest.raises(RuntimeError):
        prs.select_alpha(out.sweep.where("false"))
    with pytest.raises(ValueError):
        prs.check_disjoint(spark.createDataFrame([("train", "a"), ("test", "a")], "split string, fid string"))
    a, b = prs.auc(d.join(out.scores, "sample_idx").withColumn("yb", (F.col("y") > 4).cast("double")), "yb", "score", ["age"])
    assert b > a


def test_chunks():
    assert screen.chunk_edges(10, 3) == [(0, 3), (3, 6), (6, 10)] and screen.chunk_edges(1, 4) == [(0, 1)]
