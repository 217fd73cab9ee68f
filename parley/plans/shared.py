"""Tables that cut lineage, kept in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Bytes of the Arrow batches that Python workers get: rows of whole texts would else fill some 64 MB, in the worker and beside the JVM's heap.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: The scopes that are open, each with the tables written inside it.
_scopes: list[list[str]] = []


def work_folder(spark: SparkSession) -> str:
    """The session's folder for intermediate tables: ``spark.checkpoint.dir`` if the cluster names one.

    Only where it is unset and everything runs in one local process (tests, a laptop) a temporary folder is made and
    remembered in the session; on a cluster that is an error, as executors don't share the driver's folders.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="parley-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/parley-{spark.sparkContext.applicationId}"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside gives Python workers batches of BATCH_BYTES, or of one row if it is longer; the session's setting comes back."""
    was = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, str(BATCH_BYTES))
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(_BATCH)
        else:
            spark.conf.set(_BATCH, was)


def materialize(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the work folder and read it back.

    Later stages start from the files, so a lost executor costs a re-read and never a recomputation, and an
    expensive or order-dependent plan is evaluated exactly once. Inside ``scratch`` the table goes with its scope;
    with ``keep`` it goes with the scope around that one, or stays if there is none.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{uuid.uuid4().hex}"
    scopes = _scopes[:-1] if keep else _scopes
    if scopes:
        scopes[-1].append(path)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """A scope for tables of intermediate steps: they are deleted as soon as what is kept of them has been written."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _delete(spark, path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, file: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def release(spark: SparkSession) -> None:
    """Delete every intermediate table of this application. Call it once no result is read any more."""
    _delete(spark, work_folder(spark))
