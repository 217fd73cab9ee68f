"""Versions of a table with a manifest of checksums: written aside, verified, then made visible by one rename; old ones go."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.plans.shared import exists


def _fs(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def listed(spark: SparkSession, root: str) -> list[str]:
    """The versions under ``root``, oldest first."""
    fs, path = _fs(spark, root)
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(n for n in names if n.startswith("v-"))


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """(file, bytes, sha256) of the data files of a version, read by all tasks."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{folder}/data")
    return files.select(F.substring_index("path", "/", -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def damaged(spark: SparkSession, folder: str) -> DataFrame:
    """(file, fault) of a version's files that are missing, changed or not in its manifest; none if it is whole."""
    manifest = spark.read.parquet(f"{folder}/manifest").withColumnsRenamed({"bytes": "b", "sha256": "s"})
    both = manifest.join(checksums(spark, folder), "file", "full")
    fault = F.when(F.col("sha256").isNull(), "missing").when(F.col("s").isNull(), "unknown").when((F.col("b") != F.col("bytes")) | (F.col("s") != F.col("sha256")), "changed")
    return both.select("file", fault.alias("fault")).filter("fault IS NOT NULL")


def publish(df: DataFrame, root: str, keep: int = 5) -> str:
    """Write ``df`` as the next version under ``root`` and return its folder; the last ``keep`` versions stay.

    The files and a manifest of their checksums are written aside, read again and compared, and their rows counted
    against the rows written. Only then one rename shows the version, so a reader sees all of it or nothing; a writer
    that dies leaves a hidden folder.
    """
    spark = df.sparkSession
    aside = f"{root}/_{uuid.uuid4().hex}"
    df.write.parquet(f"{aside}/data")
    checksums(spark, aside).write.parquet(f"{aside}/manifest")
    written = spark.read.schema(df.schema).parquet(f"{aside}/data")
    written.write.format("noop").mode("overwrite").save()  # every page is read
    if not damaged(spark, aside).isEmpty():
        raise OSError(f"{aside} is not what was written")
    old = listed(spark, root)
    name = f"v-{int(old[-1][2:]) + 1 if old else 1:08d}"
    fs, path = _fs(spark, aside)
    if not fs.rename(path, _fs(spark, f"{root}/{name}")[1]):
        raise OSError(f"{root}/{name} could not be made")
    for gone in [*old, name][: -keep or None]:
        fs.delete(_fs(spark, f"{root}/{gone}")[1], True)
    return f"{root}/{name}"


def read(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """A version, the last one if none is named; one with a damaged file is refused."""
    names = listed(spark, root)
    name = version or (names[-1] if names else None)
    if name is None or not exists(spark, f"{root}/{name}/manifest/_SUCCESS"):
        raise FileNotFoundError(f"no version {name or ''} under {root}")
    if found := damaged(spark, f"{root}/{name}").limit(10).collect():
        raise OSError(f"{root}/{name}: " + ", ".join(f"{r.file} {r.fault}" for r in found))
    return spark.read.parquet(f"{root}/{name}/data")
