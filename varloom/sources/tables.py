"""Small readers and writers: weights, phenotype and sample tables, result sinks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varloom.operators.score import resolve_weights

NULLS = ("NA", "NaN", "nan", "", "-9")


def read_weights(spark: SparkSession, source) -> DataFrame:
    """(gidx, beta) from a DataFrame, a dict, or a file (.parquet, .feather, .npz, .tsv[.gz], .csv)."""
    if isinstance(source, DataFrame):
        return resolve_weights(source)
    if isinstance(source, dict):
        return spark.createDataFrame([(int(k), float(v)) for k, v in source.items()], "gidx long, beta double")
    p = str(source)
    if p.endswith(".npz"):
        z = np.load(p)
        name = next(c for c in ("beta", "BETA", "weight", "WEIGHT") if c in z)
        return spark.createDataFrame([(int(a), float(b)) for a, b in zip(z["gidx"], z[name], strict=True)], "gidx long, beta double")
    return resolve_weights(read_table(spark, p))


def read_table(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    if path.endswith(".feather"):
        import pyarrow.feather as feather

        return spark.createDataFrame(feather.read_table(path).to_pandas())
    if path.endswith((".tsv", ".tsv.gz", ".txt", ".csv", ".csv.gz")):
        r = spark.read.option("header", True).option("sep", "," if ".csv" in path else "\t")
        return r.schema(schema).csv(path) if schema else r.option("inferSchema", True).csv(path)
    return spark.read.parquet(path)


def write_table(df: DataFrame, path: str, single: bool = False) -> None:
    """By extension: .tsv[.gz] and .csv[.gz] folders, else Parquet. One part file only when asked for."""
    out = df.coalesce(1) if single else df
    gz = path.endswith(".gz")
    if ".tsv" in path or ".csv" in path:
        w = out.write.mode("overwrite").option("header", True).option("sep", "," if ".csv" in path else "\t").option("nullValue", "NA")
        (w.option("compression", "gzip") if gz else w).csv(path)
    else:
        out.write.mode("overwrite").parquet(path)


def read_phenotypes(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """(fid, columns as doubles) of a master table whose id column is FID or #FID; NA, NaN, empty and -9 are null."""
    raw = spark.read.option("header", True).option("sep", "\t").csv(path)
    names = {c.lstrip("#").lower(): c for c in raw.columns}
    num = lambda c: F.when(~F.coalesce(F.col(f"`{names[c.lower()]}`"), F.lit("")).isin(*NULLS), F.expr(f"try_cast(`{names[c.lower()]}` AS DOUBLE)")).alias(c)
    missing = [c for c in ("fid", *columns) if c.lower() not in names]
    if missing:
        raise ValueError(f"{path}: no column {missing}")
    return raw.select(F.col(f"`{names['fid']}`").alias("fid"), *[num(c) for c in columns])


def read_psam(spark: SparkSession, path: str, id_column: str = "FID") -> DataFrame:
    """(sample_idx, fid): the row order is the genotype order, so the file is numbered as it stands on the driver."""
    with open(path) as f:
        lines = [x.rstrip("\n") for x in f if x.strip() and not x.startswith("##")]
    if lines and lines[0].startswith("#"):
        head = lines[0].lstrip("#").split()
        at = head.index(id_column) if id_column in head else 0
        lines = lines[1:]
    else:
        at = 0
    return spark.createDataFrame([(i, x.split()[at]) for i, x in enumerate(lines)], "sample_idx long, fid string")


def read_keep(spark: SparkSession, path: str) -> DataFrame:
    """(fid): the first word of each line."""
    return spark.read.text(path).select(F.split(F.trim("value"), r"\s+")[0].alias("fid")).where("fid <> ''").distinct()


def read_indices(spark: SparkSession, source, key: str | None = None) -> DataFrame:
    """(new_idx, sample_idx) in the given order, from a DataFrame, a sequence, an .npy file, or (npz file, key)."""
    if isinstance(source, DataFrame):
        return source
    if isinstance(source, tuple):
        source, key = source
    if isinstance(source, str):
        z = np.load(source)
        source = z[key] if key else z
    return spark.createDataFrame([(i, int(x)) for i, x in enumerate(source)], "new_idx long, sample_idx long")


def read_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Screening candidates of all chromosome folders or files below a folder, with their chromosome."""
    df = spark.read.option("recursiveFileLookup", "true").parquet(folder)
    if "chr" in df.columns:
        return df
    return df.withColumn("chr", F.regexp_extract(F.input_file_name(), r"chr=?(\d+)", 1).cast("int"))


def read_batch(spark: SparkSession, path: str) -> list[dict]:
    """A phenotype list: TSV with name, file, type (any case)."""
    raw = spark.read.option("header", True).option("sep", "\t").csv(path)
    low = raw.select(*[F.col(c).alias(c.lower()) for c in raw.columns])
    return [r.asDict() for r in low.select("name", "file", "type").collect()]


def union_results(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
