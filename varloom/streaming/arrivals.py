"""Statistics of chromosome files as they arrive: a file stream of packed variants with an upsert sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.operators import packed


def arriving_variants(spark: SparkSession, folder: str, max_files: int = 16) -> DataFrame:
    """A stream over Parquet files of packed variants in a folder."""
    return spark.readStream.schema(packed.SCHEMA).option("maxFilesPerTrigger", max_files).parquet(folder)


def qc_stream(stream: DataFrame, out: str, checkpoint: str, available_now: bool = True, **bounds):
    """Quality control of each arriving batch, appended to ``out``; batches are idempotent by their id."""

    def sink(batch: DataFrame, epoch: int) -> None:
        packed.variant_qc(batch, **bounds).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    w = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The newest row of each variant over all batches."""
    a = spark.read.parquet(out)
    return a.groupBy("chr", "gidx").agg(F.max_by(F.struct(*[c for c in a.columns if c not in ("chr", "gidx")]), "epoch").alias("r")).select("chr", "gidx", "r.*")
