"""Packed binary scans, logistic AUC, windowed LD and labelled plots against the long forms or direct solutions."""

import numpy as np
from conftest import SF
from pyspark.sql import functions as F

from varloom import fixtures as fx
from varloom.operators import assoc, ld, packed, plotdata, prs
from varloom.operators.linalg import logistic
from varloom.registry import _null


def test_binary_scan_of_both_forms(spark):
    g, null = fx.genotypes(spark, SF), _null(spark, SF)
    n = g.agg(F.max("sample_idx")).first()[0] + 1
    a = assoc.binary_gwas(g, null, min_mac=5, spa_p=0.6, spa_sd=0.1).toPandas().sort_values("gidx").reset_index(drop=True)
    b = packed.binary_gwas(packed.pack_variants(g, n), null, n, min_mac=5, spa_p=0.6, spa_sd=0.1).toPandas().sort_values("gidx").reset_index(drop=True)
    assert list(a.TEST) == list(b.TEST) and {"SPA", "SCORE"} <= set(a.TEST)
    for c in ("BETA", "SE", "Z", "P", "MAF", "P_NORM", "MAC", "MAC_CASE", "MAC_CTRL"):
        assert np.allclose(a[c], b[c], rtol=1e-7, equal_nan=True), c


def test_packed_sums_leave_out_samples_without_a_null(spark):
    g, null = fx.genotypes(spark, SF), _null(spark, SF).where("sample_idx % 3 <> 1")
    n = g.agg(F.max("sample_idx")).first()[0] + 1
    a, b = (x.toPandas().sort_values("gidx").reset_index(drop=True) for x in (assoc.binary_score(g, null), assoc.score_columns(packed.binary_sums(packed.pack_variants(g, n), null, n))))
    assert all(np.allclose(a[c], b[c]) for c in ("U", "V", "Z", "MAF", "MAC", "MAC_CASE"))


def test_logistic_auc_by_aggregation(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 2))
    y = (r.random(400) < 1 / (1 + np.exp(-(0.4 + x @ [1.0, -0.5])))).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y, strict=True)] + [(None, 1.0, 1.0)], "age double, score double, y double")
    cov, full = prs.auc(df, covariates=["age"])

    def direct(cols):
        z = (x[:, cols] - x[:, cols].mean(0)) / x[:, cols].std(0)
        a = np.column_stack([np.ones(400), z])
        s = a @ logistic(a, y)
        return np.mean((s[y == 1][:, None] > s[y == 0]) + 0.5 * (s[y == 1][:, None] == s[y == 0]))

    assert abs(cov - direct([0])) < 1e-9 and abs(full - direct([0, 1])) < 1e-9
    assert prs.auc(df)[0] == 0.5


def test_windows_meet_by_bins(spark):
    g = fx.genotypes(spark, SF).where("sample_idx < 40")
    every = {(r.gidx_a, r.gidx_b): r.xtx for r in ld.gram(g).collect()}
    for window in (0, 1, 3, 100):
        got = {(r.gidx_a, r.gidx_b): r.xtx for r in ld.gram(g, window).collect()}
        assert got == {k: v for k, v in every.items() if k[1] - k[0] <= window}


def test_manhattan_of_many_inputs(spark):
    ss = fx.sumstats(spark, SF)
    both = ss.withColumn("trait", F.lit("a")).unionByName(ss.where("gidx % 2 = 0").withColumn("trait", F.lit("b")))
    got = plotdata.manhattan(both, by=("trait",))
    for t, part in (("a", ss), ("b", ss.where("gidx % 2 = 0"))):
        want = plotdata.manhattan(part)
        assert sorted(got.where(F.col("trait") == t).drop("trait").collect()) == sorted(want.collect())


def test_scores_are_made_once(spark):
    """Both fits of r2 and all penalties of a sweep read scores that are made once."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(100).selectExpr("double(id) as y", "double(id % 7) as score", "double(id % 3) as age").mapInArrow(count, "y double, score double, age double")
    assert prs.r2(df, covariates=["age"]).first().n == 100 and seen.value == 100
