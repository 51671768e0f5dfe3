"""Listing of folders on any file system that the cluster reads (local, HDFS, object stores)."""

from __future__ import annotations

from pyspark.sql import SparkSession


def children(spark: SparkSession, path: str) -> list[tuple[str, bool]]:
    """(name, is a folder) of what a folder holds, by name; nothing where it does not exist."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(context._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    return sorted((s.getPath().getName(), s.isDirectory()) for s in files.listStatus(place))


def rename(spark: SparkSession, path: str, target: str) -> None:
    """Moves a file or folder within its file system."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path
    files = place(path).getFileSystem(context._jsc.hadoopConfiguration())
    if not files.rename(place(path), place(target)):
        raise OSError(f"{path} cannot become {target}")
