"""The data behind QQ and Manhattan plots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from varloom.functions.special import MIN_P
from varloom.operators.assoc import lambda_gc

STRATA = ((0.0, 0.01), (0.01, 0.05), (0.05, 0.5000001))


def valid_p(sumstats: DataFrame) -> DataFrame:
    return sumstats.where((F.col("P") > 0) & (F.col("P") <= 1) & ~F.isnan("P"))


def qq(sumstats: DataFrame, by: tuple[str, ...] = (), key: str = "gidx") -> DataFrame:
    """observed and expected -log10 P: expected is -log10(rank / (n + 1)).

    Ranks are two-level: rows fall in bins of -log10 P, bins are counted and summed, and a window ranks inside
    a bin. No task sees the whole genome.
    """
    s = valid_p(sumstats).withColumn("observed", -F.log10(F.greatest("P", F.lit(MIN_P))))
    s = s.withColumn("_bin", F.floor(F.col("observed") * 512))
    c = s.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_c"))
    c = c.withColumn("_base", F.coalesce(F.sum("_c").over(W.partitionBy(*by).orderBy(F.desc("_bin")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    c = c.withColumn("_n", F.sum("_c").over(W.partitionBy(*by))).drop("_c")
    j = s.join(F.broadcast(c), [*by, "_bin"])
    rank = F.col("_base") + F.row_number().over(W.partitionBy(*by, "_bin").orderBy("P", key))
    return j.withColumn("rank", rank).select(*by, key, "rank", "observed", (-F.log10(F.col("rank") / (F.col("_n") + 1))).alias("expected"))


def qq_strata(sumstats: DataFrame, strata=STRATA, least: int = 100) -> DataFrame:
    """QQ data per frequency stratum [lo, hi) with at least ``least`` variants."""
    lab = F.lit(None).cast("string")
    for lo, hi in strata:
        lab = F.when((F.col("MAF") >= lo) & (F.col("MAF") < hi), f"{lo:g}-{min(hi, 0.5):g}").otherwise(lab)
    s = valid_p(sumstats).withColumn("stratum", lab).where("stratum is not null")
    big = s.groupBy("stratum").count().where(F.col("count") >= least).select("stratum")
    return qq(s.join(F.broadcast(big), "stratum"), ("stratum",))


def qq_summary(sumstats: DataFrame) -> DataFrame:
    return lambda_gc(valid_p(sumstats), z_col="Z" if "Z" in sumstats.columns else None)


def decimate(sumstats: DataFrame, keep_above: float = 3.0, share: float = 0.01, seed: int = 42) -> DataFrame:
    """All points from -log10 P = keep_above on, and a share of the rest by hash of the variant (reruns agree)."""
    s = valid_p(sumstats).withColumn("logp", -F.log10(F.greatest("P", F.lit(MIN_P))))
    return s.where((F.col("logp") >= keep_above) | (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("gidx").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % 1_000_000 < int(share * 1_000_000)))


def offsets(points: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """CHR, offset: the running sum of the largest position of the chromosomes before it, for each label of ``by``."""
    m = points.groupBy(*by, "CHR").agg(F.max("POS").alias("chr_max"))
    w = W.partitionBy(*by).orderBy("CHR").rowsBetween(W.unboundedPreceding, -1)
    return m.select(*by, "CHR", F.coalesce(F.sum("chr_max").over(w), F.lit(0)).alias("offset"))


def loglog(y, b: float):
    """The axis transform: y above b becomes b + 10 (log10 y - log10 b)."""
    return F.when(y > b, b + 10 * (F.log10(y) - F.log10(F.lit(b)))).otherwise(y)


def manhattan(sumstats: DataFrame, keep_above: float = 3.0, share: float = 0.01, seed: int = 42, break_at: float = 10.0, by: tuple[str, ...] = ()) -> DataFrame:
    """gidx, CHR, x (cumulative position), logp, y (transformed); ``by`` names label columns for many inputs at once."""
    pts = decimate(sumstats.withColumn("CHR", F.expr("try_cast(CHR AS INT)")).where("CHR is not null"), keep_above, share, seed)
    j = pts.join(F.broadcast(offsets(pts, by)), [*by, "CHR"])
    return j.select(*by, "gidx", "CHR", (F.col("POS") + F.col("offset")).alias("x"), "logp", loglog(F.col("logp"), break_at).alias("y"))
