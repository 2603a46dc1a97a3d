"""Genotypes, phenotypes, summary statistics and weights derived from the driver's tables, in Spark and DuckDB.

The tables hold no genotypes; these views turn embeddings into dosages, labels into phenotypes and events
into summary statistics by fixed arithmetic, so that both engines compute on the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.session import read


def genotypes(spark: SparkSession, d: str) -> DataFrame:
    """sample_idx, chr, gidx, dosage (null where missing): 64 variants on 8 chromosomes."""
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("sample_idx"), F.posexplode("embedding").alias("g", "e"))
    x, g, s = F.col("e").cast("double"), F.col("g").cast("long"), F.col("sample_idx")
    dose = F.when((s * 31 + g * 17) % 29 == 0, None).when(x < -0.06 + 0.004 * (g % 32), 0).when(x < 0.06 + 0.006 * (g % 32), 1).otherwise(2)
    return e.select("sample_idx", (1 + F.floor(g / 8)).cast("int").alias("chr"), g.alias("gidx"), dose.cast("tinyint").alias("dosage"))


def annotation(spark: SparkSession, d: str) -> DataFrame:
    g = F.col("gidx")
    return genotypes(spark, d).select("gidx", "chr").distinct().select("gidx", F.col("chr").alias("CHR"), (1_000_000 + (g % 8) * 400_000).cast("long").alias("POS"), F.concat(F.lit("v"), g.cast("string")).alias("ID"), F.lit("A").alias("REF"), F.lit("G").alias("ALT"))


def phenotypes(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("sample_idx"), F.concat(F.lit("f"), F.col("vec_id").cast("string")).alias("fid"), F.col("label").cast("double").alias("y"), F.when(F.col("label") >= 5, 1).otherwise(0).alias("y_bin"), (40 + F.col("vec_id") % 40).cast("double").alias("age"), (F.col("vec_id") % 2).cast("double").alias("sex"))


def phenotypes_sig(spark: SparkSession, d: str) -> DataFrame:
    """phenotypes with y_sig: signals planted at variants 5 and 40."""
    g = genotypes(spark, d).where(F.col("gidx").isin(5, 40))
    pick = lambda k: F.coalesce(F.max(F.when(F.col("gidx") == k, F.col("dosage"))), F.lit(0))
    s = g.groupBy("sample_idx").agg((3.0 * pick(5) - 2.5 * pick(40)).alias("add"))
    return phenotypes(spark, d).join(s, "sample_idx").withColumn("y_sig", F.col("y") + F.col("add")).drop("add")


def sumstats(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    sec = F.unix_timestamp("ts") - 1704067200
    return e.select(F.col("event_id").alias("gidx"), (1 + F.col("user_id") % 22).cast("int").alias("CHR"), (sec * 100).cast("long").alias("POS"), F.col("event_id").cast("string").alias("ID"), F.pow(F.lit(10.0), -F.col("value") / 25.0).alias("P"))


def carriers(spark: SparkSession, d: str) -> DataFrame:
    """Sparse genotypes that grow with the tables: only carriers have rows."""
    li = read(spark, d, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("sample_idx"), (F.col("l_partkey") % 200).alias("gidx")).agg(F.least(F.count(F.lit(1)), F.lit(2)).cast("int").alias("dosage"))


def weights(spark: SparkSession, d: str) -> DataFrame:
    g = F.col("gidx")
    return genotypes(spark, d).select("gidx").distinct().where(g % 3 == 0).select("gidx", ((((g * 37) % 19) - 9) / F.lit(10.0)).alias("beta"))


# ---------------------------------------------------------------- DuckDB
SQL = {
    "g": """raw AS (SELECT vec_id AS sample_idx, unnest(range(len(embedding))) AS gidx, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
g AS (SELECT sample_idx, CAST(gidx AS BIGINT) AS gidx, CAST(1 + floor(gidx / 8) AS INT) AS chr, CAST(CASE WHEN (sample_idx * 31 + gidx * 17) % 29 = 0 THEN NULL WHEN x < -0.06 + 0.004 * (gidx % 32) THEN 0 WHEN x < 0.06 + 0.006 * (gidx % 32) THEN 1 ELSE 2 END AS DOUBLE) AS d FROM raw)""",
    "st": """st AS (SELECT chr, gidx, count(*) AS n_samples, count(d) AS n_called, coalesce(avg(d), 0) AS mu_x, coalesce(var_pop(d) * count(d), 0) AS sxx, CASE WHEN count(d) > 0 THEN least(avg(d) / 2, 1 - avg(d) / 2) ELSE 0 END AS maf FROM g GROUP BY chr, gidx)""",
    "ph": """ph AS (SELECT vec_id AS sample_idx, concat('f', vec_id::VARCHAR) AS fid, CAST(label AS DOUBLE) AS y, CASE WHEN label >= 5 THEN 1 ELSE 0 END AS y_bin, CAST(40 + vec_id % 40 AS DOUBLE) AS age, CAST(vec_id % 2 AS DOUBLE) AS sex FROM embeddings)""",
    "sig": """sig AS (SELECT p.sample_idx, p.y + 3.0::DOUBLE * coalesce(max(CASE WHEN gidx = 5 THEN d END), 0) - 2.5::DOUBLE * coalesce(max(CASE WHEN gidx = 40 THEN d END), 0) AS y_sig FROM ph p JOIN g ON p.sample_idx = g.sample_idx GROUP BY p.sample_idx, p.y)""",
    "ss": """ss AS (SELECT event_id AS gidx, CAST(1 + user_id % 22 AS INT) AS CHR, CAST(floor(epoch(ts) - 1704067200) * 100 AS BIGINT) AS POS, CAST(event_id AS VARCHAR) AS ID, power(CAST(10 AS DOUBLE), -value / 25.0) AS P FROM events)""",
    "w": """w AS (SELECT gidx, ((gidx * 37) % 19 - 9) / CAST(10 AS DOUBLE) AS beta FROM (SELECT DISTINCT gidx FROM g) WHERE gidx % 3 = 0)""",
    "an": """an AS (SELECT DISTINCT gidx, chr AS CHR, CAST(1000000 + (gidx % 8) * 400000 AS BIGINT) AS POS, concat('v', gidx::VARCHAR) AS ID, 'A' AS REF, 'G' AS ALT FROM g)""",
    "cr": """cr AS (SELECT l_orderkey AS sample_idx, l_partkey % 200 AS gidx, least(count(*), 2) AS dosage FROM lineitem GROUP BY 1, 2)""",
}


def ctes(*names: str, more: str = "") -> str:
    """WITH clause of the named fixtures, in an order that resolves them, and further CTE text."""
    order = [k for k in SQL if k in names]
    return "WITH RECURSIVE " + ",\n".join([SQL[k] for k in order] + ([more.strip().rstrip(",")] if more else [])) + "\n"
