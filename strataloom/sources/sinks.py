"""Versioned tables: every commit is a new folder, checked against the version that it was prepared from."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class StaleVersion(RuntimeError):
    """Another commit came between prepare and commit."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def latest(spark: SparkSession, path: str) -> int:
    """The newest finished version; 0 if there is none. Folders without _SUCCESS are left over from failures."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return 0
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    done = [int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit() and fs.exists(hadoop(f"{path}/{n}/_SUCCESS"))]
    return max(done, default=0)


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    return spark.read.parquet(f"{path}/v={latest(spark, path) if version is None else version}")


def commit(df: DataFrame, path: str, prepared_from: int) -> int:
    """Write df as the version after prepared_from; StaleVersion if that is no longer the newest.

    The version is claimed by creating a file that must not exist, which one of two commits can do, on file systems
    and object stores alike; only its owner writes the version's folder, and readers take a version as there once its
    _SUCCESS is. A claim is given up when the write fails, so that the version can be tried again.
    """
    spark, version = df.sparkSession, prepared_from + 1
    if latest(spark, path) != prepared_from:
        raise StaleVersion(f"{path} is past version {prepared_from}")
    claim, fs = _fs(spark, f"{path}/_claims/v={version}")
    try:
        fs.create(claim, False).close()
    except Py4JJavaError as e:
        if fs.exists(claim):
            raise StaleVersion(f"{path} got version {version} meanwhile") from e
        raise
    try:
        df.write.mode("overwrite").parquet(f"{path}/v={version}")
    except BaseException:
        fs.delete(claim, False)
        raise
    return version
