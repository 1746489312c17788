"""Session building, the shared folder of a cluster, and lineage cuts that survive a lost executor."""

from __future__ import annotations

import gc
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "lumenfold", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE, UTC and Arrow; on a cluster leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the session's checkpoint folder.

    Where neither is set, a local session gets a temporary one; on a cluster that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lumenfold-"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for a written table, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/lumenfold/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(where)  # only what exists can be marked for deletion
    files.deleteOnExit(where)
    return path


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 1000) -> str:
    """At most so many rows in an Arrow batch from now on: long texts then take less memory beside the heap.

    Batches are made when a plan runs, so the setting has to last until then. Gives the setting before, to be
    put back.
    """
    before = spark.conf.get(BATCH_ROWS)
    if int(before) not in range(1, rows + 1):
        spark.conf.set(BATCH_ROWS, str(rows))
    return before


def discard(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more, in whatever file system it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def put_file(spark: SparkSession, path: str, content: bytes) -> None:
    """A small file from the driver, in whatever file system the path names."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, False)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint: the rows live in the shared folder, so no executor's loss loses them."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def release(spark: SparkSession) -> None:
    """Have the driver forget plans that nothing refers to any more, so that executors delete their shuffle files.

    Spark does so when the driver's heap is collected, which a small driver of a long job seldom does by itself.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, unless they find it by PYTHONPATH or by the folder they start in.

    Python functions take note of what was sent when they are made, so this comes before the first operator.
    """
    root = Path(__file__).resolve().parent.parent
    sc = spark.sparkContext
    known = {Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p} | {Path.cwd()}
    if root not in known and sc.applicationId not in _SHIPPED:
        made = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="lumenfold-"), "lumenfold"), "zip", root, "lumenfold")
        sc.addPyFile(made)
    _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
