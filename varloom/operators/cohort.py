"""Cohort preparation: recoding, covariate residuals by normal equations, cohort joins."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from varloom.session import kept


@dataclass
class Fit:
    """An ordinary least-squares fit with intercept."""

    coef: np.ndarray  # intercept first
    r2: float
    n: int
    names: list[str] = field(default_factory=list)
    mean: np.ndarray | None = None
    sd: np.ndarray | None = None

    def column(self) -> Column:
        out = F.lit(float(self.coef[0]))
        for b, c in zip(self.coef[1:], self.names, strict=True):
            out = out + F.lit(float(b)) * F.col(c)
        return out


def recode_binary(df: DataFrame, y_col: str = "y", force: bool = False) -> tuple[DataFrame, bool]:
    """1/2 coding to 0/1 where every value is one of 0, 1, 2, -9 and a 2 occurs; -9 is missing in any case."""
    y = F.col(y_col)
    s = df.where(y.isNotNull() & ~F.isnan(y.cast("double"))).agg(F.coalesce(F.bool_and(y.isin(0, 1, 2, -9)), F.lit(True)).alias("coded"), F.coalesce(F.bool_or(y == 2), F.lit(False)).alias("two")).first()
    present = F.when(y == -9, None).otherwise(y.cast("double"))
    if (s.coded or force) and s.two:
        return df.withColumn(y_col, F.when(y == 2, 1.0).when(y == 1, 0.0).when(y == -9, None)), True
    return df.withColumn(y_col, present), bool(s.coded or force)


def complete(df: DataFrame, cols: list[str]) -> Column:
    """Whether all columns are present and finite."""
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return ok


def least_squares(df: DataFrame, y_col: str, x_cols: list[str]) -> Fit:
    """OLS with intercept: one aggregation of cross-products, a (k + 1)-square solve on the driver."""
    rows = df.where(complete(df, [y_col, *x_cols]))
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in x_cols], F.col(y_col).cast("double")]
    k = len(cols)
    sums = rows.agg(*[F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    m = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = sums[f"s{i}_{j}"] or 0.0
    n = int(m[0, 0])
    xtx, xty, yy = m[:-1, :-1], m[:-1, -1], m[-1, -1]
    coef = np.linalg.lstsq(xtx, xty, rcond=None)[0]
    tss = yy - m[0, -1] ** 2 / max(n, 1)
    rss = yy - 2 * coef @ xty + coef @ xtx @ coef
    mean = m[0, 1:-1] / max(n, 1)
    sd = np.sqrt(np.maximum(np.diag(m)[1:-1] / max(n, 1) - mean**2, 0))
    return Fit(coef, 1 - rss / tss if tss > 0 else 0.0, n, list(x_cols), mean, np.where(sd == 0, 1, sd))


def residualise(df: DataFrame, y_col: str, covariates: list[str], fit: Fit | None = None, impute_missing: bool = False) -> tuple[DataFrame, Fit]:
    """Adds y_hat, y_train (residual) and y_original; rows without phenotype go, or get residual 0."""
    fit = fit or least_squares(df, y_col, covariates)
    present = complete(df, [y_col])
    out = df.where(complete(df, covariates)).withColumn("y_hat", fit.column())
    y = F.col(y_col).cast("double")
    if not impute_missing:
        out = out.where(present)
    return out.withColumn("y_train", F.when(present, y - F.col("y_hat")).otherwise(0.0)).withColumn("y_original", F.when(present, y).otherwise(F.col("y_hat"))), fit


def prepare_cohort(phenotype: DataFrame, master: DataFrame, psam: DataFrame, base: DataFrame | None = None, y_col: str = "y", covariates: list[str] = (), binary: bool = False, impute_missing: bool = False) -> tuple[DataFrame, Fit]:
    """phenotype(fid, y) with master(fid, covariates) and psam(fid, sample_idx): semi-joined to the base
    cohort, recoded, residualised. Columns: sample_idx, fid, y_train, y_original, y_hat, subset_row."""
    ph = phenotype.select("fid", y_col)
    if base is not None:
        ph = ph.join(base.select("fid"), "fid", "left_semi")
    ph, _ = recode_binary(ph, y_col, binary)
    j = ph.join(psam.select("fid", "sample_idx"), "fid").join(master.select("fid", *covariates), "fid")
    out, fit = residualise(j, y_col, list(covariates), impute_missing=impute_missing)
    out = out.select("sample_idx", "fid", "y_train", "y_original", "y_hat")
    if base is not None and "sample_idx" in base.columns:
        rows = base.select("fid", F.col("sample_idx").alias("_b"))
        rows = rows.withColumn("subset_row", F.row_number().over(W.orderBy("_b")) - 1).drop("_b")
        out = out.join(rows, "fid")
    return out, fit


def load_covariates(order: DataFrame, phe: DataFrame, cols: list[str]) -> DataFrame:
    """Covariates in cohort order; a row with any null covariate has all of them null."""
    j = order.join(phe.select("fid", *cols), "fid", "left")
    ok = complete(j, cols)
    return j.select(*order.columns, *[F.when(ok, F.col(c)).alias(c) for c in cols])


def rank_in_order(df: DataFrame, order_col: str | list[str], name: str = "row") -> DataFrame:
    """Dense 0-based ranks by one or more columns, without one global sort in a task: rows are range-partitioned,
    counted per range, and ranked inside it."""
    order = [order_col] if isinstance(order_col, str) else list(order_col)
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # written once: ranges that are sampled anew after a lost executor could disagree with the counts
    r = kept(df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()), "ranks")
    sizes = {x["_p"]: x["count"] for x in r.groupBy("_p").count().collect()}
    base, at = [], 0
    for p in sorted(sizes):
        base.append((p, at))
        at += sizes[p]
    starts = spark.createDataFrame(base or [(0, 0)], "_p int, _base long")
    out = r.withColumn("_i", F.row_number().over(W.partitionBy("_p").orderBy(*order)) - 1).join(F.broadcast(starts), "_p")
    return out.withColumn(name, F.col("_base") + F.col("_i")).drop("_p", "_i", "_base")
