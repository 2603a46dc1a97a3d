"""Queries over whole tables against brute force."""

import inspect

import numpy as np
import pytest
from conftest import SF

from varloom import fixtures as fx
from varloom.operators import finemap, lasso, ld, packed, prs, screen
from varloom.plans import config
from varloom.registry import QUERIES


def test_relatedness_of_all_samples(spark):
    g = fx.genotypes(spark, SF).toPandas()
    x = g.pivot(index="sample_idx", columns="gidx", values="dosage").to_numpy(dtype=float)
    n = len(x)
    mu = np.nanmean(x, 0)
    z = np.nan_to_num((x - mu) / np.sqrt(mu * (1 - mu / 2)))
    got = QUERIES["grm"](spark, SF).toPandas()
    assert len(got) == n * (n + 1) // 2 and got.sample_b.max() == n - 1
    assert np.allclose(got.grm, (z @ z.T / x.shape[1])[got.sample_a, got.sample_b], atol=2e-6)
    got = QUERIES["king"](spark, SF).toPandas()
    assert len(got) == n * (n - 1) // 2
    for a, b, k in got[["sample_a", "sample_b", "kinship"]].iloc[::997].itertuples(index=False):
        u, v = x[int(a)], x[int(b)]
        ok = ~np.isnan(u) & ~np.isnan(v)
        u, v = u[ok], v[ok]
        ha, hb = (u == 1).sum(), (v == 1).sum()
        want = (((u == 1) & (v == 1)).sum() - 2 * (abs(u - v) == 2).sum()) / (2 * min(ha, hb)) + 0.5 - 0.25 * (ha + hb) / min(ha, hb)
        assert abs(k - want) < 2e-6
    # small blocks and chunks give the pair join's results
    few = fx.genotypes(spark, SF).where("sample_idx < 30 and gidx < 20")
    for whole, pairs in ((ld.grm_blocked, ld.grm), (ld.king_blocked, ld.king)):
        rows = [sorted((r[0], r[1], None if r[2] is None else round(r[2], 9)) for r in df.collect()) for df in (whole(few, 8, 7), pairs(few))]
        assert [r[:2] for r in rows[0]] == [r[:2] for r in rows[1]] and np.allclose(*[[np.nan if r[2] is None else r[2] for r in x] for x in rows], equal_nan=True)


def test_candidates_are_not_cut_silently(spark, monkeypatch):
    j = config.DEFAULTS["joint_lasso"]
    cand = spark.range(8003).selectExpr("1 as chr", "id as gidx", "double(id) as strength")
    assert screen.cap(cand, j["max_snps"]).count() == 8003
    assert inspect.signature(prs.prs).parameters["max_snps"].default == 44_000
    g, ph = fx.genotypes(spark, SF), fx.phenotypes_sig(spark, SF)
    with pytest.raises(ValueError, match="more than 8000"):
        lasso.joint_lasso(g, cand, ph, y_col="y_sig", max_features=j["max_features"])
    few = g.select("chr", "gidx").distinct()
    one = lasso.joint_lasso(g, few, ph, y_col="y_sig", covariates=["age"])
    monkeypatch.setattr(lasso, "SLAB_BYTES", 8 * 65 * 7)  # seven rows a slab
    cut = lasso.joint_lasso(g, few, ph, y_col="y_sig", covariates=["age"])
    assert one.n == cut.n == 500 and np.allclose(one.gram, cut.gram) and np.allclose(one.coef_norm, cut.coef_norm)


def test_a_locus_of_over_2000_variants_is_fine_mapped(spark):
    assert config.DEFAULTS["finemapping"]["max_variants"] == 15_000
    p, n = 2001, 40
    d = np.random.default_rng(4).integers(0, 3, (p, n))
    g = spark.createDataFrame([(s, 1, v, int(d[v, s])) for v in range(p) for s in range(n)], "sample_idx long, chr int, gidx long, dosage byte")
    y = spark.createDataFrame([(s, float(3 * d[7, s] + s % 2)) for s in range(n)], "sample_idx long, y double")
    ann = spark.range(p).selectExpr("id as gidx", "1 as CHR", "1000 + id as POS")
    loci = spark.createDataFrame([(1, 1, 0, 10_000)], "locus_id int, CHR int, start_bp long, end_bp long")
    per, summary = finemap.finemap(packed.pack_variants(g, n), loci, ann, y, n, tier=1)
    assert per.count() == p and per.orderBy("susie_pip", ascending=False).first().gidx == 7
    assert [r.locus_status != "Skipped" for r in summary.collect()] == [True]


def test_hits_and_samples_are_whole(spark):
    ss = fx.sumstats(spark, SF).toPandas()
    hits = ss[ss.P < 5e-8]
    got = QUERIES["significant_hits"](spark, SF).toPandas()
    assert sorted(got.gidx) == sorted(hits.gidx) and set(got.CHR) == set(hits.CHR) and got.CHR.nunique() > 2
    g = fx.genotypes(spark, SF).toPandas()
    top = g.sample_idx.max()
    got = QUERIES["reindexed_samples"](spark, SF).toPandas()
    got["sample_idx"] = top - got.sample_idx
    key = ["sample_idx", "chr", "gidx"]
    assert got.sort_values(key).reset_index(drop=True).equals(g[got.columns].sort_values(key).reset_index(drop=True).astype(got.dtypes))


def test_consensus_runs_the_operator_defaults(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(finemap, "finemap", lambda *a, **k: seen.append(k) or (None, None))
    QUERIES["finemap_consensus"](spark, SF)
    assert not {"pairs", "n_lambda"} & set(seen[0])
    monkeypatch.undo()
    d = inspect.signature(finemap.finemap).parameters
    assert (d["pairs"].default, d["n_lambda"].default) == (50, 20)
    assert QUERIES["finemap_consensus"](spark, SF).where("sel_freq > 0").count() > 0


def test_pairs_of_samples_are_not_shuffled(spark, monkeypatch):
    """A pair's row comes straight from its tile; odd calls, missing rows and rounding are as in the pair join."""
    g = fx.genotypes(spark, SF).where("sample_idx < 40 and gidx < 20")
    odd = g.where("not (sample_idx % 7 = 3 and gidx > 4) and not (sample_idx = 12 and gidx < 15)").selectExpr("sample_idx", "chr", "gidx", "case when sample_idx = 9 and gidx = 2 then 7 else dosage end as dosage")
    half = odd.selectExpr("sample_idx", "chr", "gidx", "case when sample_idx = 5 then dosage / 4 else dosage end as dosage")
    monkeypatch.setattr(ld, "STRIP", 20)
    for whole, pairs, data in ((ld.grm_blocked, ld.grm, odd), (ld.king_blocked, ld.king, odd), (ld.grm_blocked, ld.grm, half)):
        made = whole(data, 8, 7)
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan and "FlatMapGroups" not in plan
        rows = [sorted((r[0], r[1], np.nan if r[2] is None else r[2]) for r in df.collect()) for df in (made, pairs(data))]
        assert [r[:2] for r in rows[0]] == [r[:2] for r in rows[1]] and np.allclose(*[[r[2] for r in x] for x in rows], equal_nan=True)
    # 0.4765625 is a half at six digits: SQL rounds it away from zero
    ones = spark.createDataFrame([(s, 1, v, 1 if v < 32 or s else 0) for s in range(2) for v in range(35)], "sample_idx long, chr int, gidx long, dosage int")
    exact, cut = (ld.king_blocked(ones, digits=k).first().kinship for k in (None, 6))
    assert (exact, cut) == (0.4765625, 0.476563)
