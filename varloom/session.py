"""Session helpers: a tuned local session and shipping the package to executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
PACKAGE_DIR = os.path.dirname(os.path.abspath(__file__))


def local_session(cpus: int = 8, app: str = "varloom", shuffle_partitions: int | None = None) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, once per Spark context.

    The zip goes out through Spark's own file server, so executors need neither a
    shared home folder nor an installed copy.
    """
    sc = spark.sparkContext
    if spark.conf.get(_BATCH) == "67108864b":  # Spark's default: batches this large live twice, in the JVM and in the worker
        spark.conf.set(_BATCH, str(8 << 20))
    if getattr(sc, "_varloom_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="varloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "varloom_pkg.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(PACKAGE_DIR):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(PACKAGE_DIR)))
    sc.addPyFile(path)
    sc._varloom_shipped = True


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name that all executors see: below spark.checkpoint.dir, or on a local master a temporary folder.

    It is a mounted path (sources that are Python code open files themselves), removed when the driver ends.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="varloom-scratch-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    path = f"{str(root).removeprefix('file://').removeprefix('file:').rstrip('/')}/varloom-{name}-{uuid.uuid4().hex[:12]}"
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def kept(df: DataFrame, name: str) -> DataFrame:
    """Written once to the shared folder and read back: what uses it twice computes it once, also after a lost executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str):
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
