from conftest import SF

from varloom import fixtures as fx
from varloom.plans import api, workflow


def test_short_names(spark):
    g, p = fx.genotypes(spark, SF), fx.phenotypes_sig(spark, SF)
    assert api.spark_info(spark)["version"] == spark.version
    a = api.glm(g, p, y_col="y_sig", annotation=fx.annotation(spark, SF)).toPandas()
    assert a.loc[a.P.idxmin(), "gidx"] == 5 and {"CHR", "POS", "ID", "REF", "ALT", "BETA", "SE", "Z", "P", "MAF"} <= set(a.columns)
    assert api.linear_regression_rows(g, p, y_col="y_sig").count() == 64
    assert api.clump(fx.sumstats(spark, SF)).count() > 0


def test_scan_pipeline(spark):
    g, p = fx.genotypes(spark, SF), fx.phenotypes_sig(spark, SF)
    r = workflow.scan_pipeline(g, p, ["age", "sex"], joint_alpha=0.2, window_size=64, maf_min=0.05, y_col="y_sig").toPandas()
    assert set(r.sort_values("P").gidx[:2]) == {5, 40} and len(r) == 64
