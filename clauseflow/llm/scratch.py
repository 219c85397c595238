"""Shared-folder tables that cut lineage, and session settings the operators rely on."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from clauseflow.session import share_package

from . import wordhash

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

#: Arrow batches towards Python end at this many bytes, so very long texts don't pile up in one batch.
ARROW_BATCH_BYTES = 8 << 20

#: With this setting a query's shuffle files go when the query has ended, not when the driver's heap fills up.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_made: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a folder of our own in local
    mode, and an error on a cluster, whose machines share no temporary folder."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not set_dir:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="clauseflow-"))
        set_dir = spark.sparkContext.getCheckpointDir()
    return set_dir.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends if not before."""
    if not _made:
        atexit.register(_sweep)
    path = f"{shared_folder(spark)}/clauseflow/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _sweep() -> None:
    for path, spark in _made.items():
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: later jobs start from these files, also after executors are lost."""
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._clauseflow_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that `materialize` made and that no result reads any more."""
    for t in tables:
        path = getattr(t, "_clauseflow_path", None)
        if path in _made:
            _delete(_made.pop(path), path)


def tune(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, and let workers import this package."""
    share_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def lean(run: Run) -> Run:
    """run, for mapInArrow, in a worker that gives back what it has freed: now and then, and when a task ends. Spark keeps workers
    for later tasks of all kinds, and what they hold adds to the executor's memory."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(_released(batches))
        finally:
            _give_back()

    return task


def _released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = 0
    for b in batches:
        size += b.nbytes
        yield b
        if size >= ARROW_BATCH_BYTES:
            pa.default_memory_pool().release_unused()
            size = 0


def _give_back() -> None:
    wordhash.forget_powers()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def plus(schema: StructType, ddl: str) -> StructType:
    """A new schema with the fields of ddl at the end (StructType.add would change the schema it is called on)."""
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])
