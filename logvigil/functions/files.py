"""Files of the session's file systems (whatever scheme a path names)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder; False where there was none."""
    fs, p = _fs(spark, path)
    return fs.delete(p, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Sorted names in a folder; none where there is no such folder."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def move(spark: SparkSession, source: str, target: str) -> bool:
    """Rename; False if the target exists or the source does not."""
    fs, a = _fs(spark, source)
    _, b = _fs(spark, target)
    return not fs.exists(b) and fs.rename(a, b)
