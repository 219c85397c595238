"""What the engine needs of a session."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: With this setting a query's shuffle files go when the query has ended, not when the driver's heap fills up.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

ROOT = str(Path(__file__).resolve().parent.parent)


def share_package(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package from where the driver has it, whatever folder they start in.

    On a cluster whose machines have no such folder, ship the package with --py-files or install it there.
    """
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in have:
        env["PYTHONPATH"] = ":".join([*have, ROOT])
    return spark


def _shared_folder(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="clauseflow-"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """df written once to spark.checkpoint.dir, so that what it took (calls of models, say) isn't done again. Where that is
    unset, in a folder of our own in local mode, and an error on a cluster."""
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df written once as Parquet, in the folder of `cut_lineage`, and read from there by everything that needs it; deleted
    when the application ends. Columns that a reader doesn't ask for aren't read."""
    spark = df.sparkSession
    _shared_folder(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    atexit.register(_delete, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the JVM may be gone already
        return
