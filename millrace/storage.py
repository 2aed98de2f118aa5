"""Existence and removal of directories in whatever file system a path names."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _located(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _located(spark, path)
    return fs.exists(target)


def complete(spark: SparkSession, path: str) -> bool:
    """True for a directory a Spark write has finished."""
    return exists(spark, f"{path}/_SUCCESS")


def remove(spark: SparkSession, path: str) -> bool:
    fs, target = _located(spark, path)
    return fs.exists(target) and fs.delete(target, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none if there is no such folder."""
    fs, target = _located(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(target)] if fs.exists(target) else []


def rename(spark: SparkSession, path: str, to: str) -> bool:
    fs, source = _located(spark, path)
    return fs.rename(source, spark._jvm.org.apache.hadoop.fs.Path(to))


def join(spark: SparkSession, paths: list[str], to: str) -> None:
    """Make one file ``to`` of the files ``paths``, in their order, which may be gone then.

    The file system does it: a change of names where files are lists of blocks (HDFS), a copy on a local disk.
    One that can do neither refuses, and nothing is made.
    """
    fs, target = _located(spark, to)
    path = spark._jvm.org.apache.hadoop.fs.Path
    full = [p for p in map(path, paths) if fs.getFileStatus(p).getLen()]
    local = fs.getScheme() == "file"
    if local:
        # Checksums of local files do not join, and a local target is written anew.
        fs = fs.getRawFileSystem()
        fs.create(target).close()
    elif not fs.rename(full.pop(0), target):
        raise OSError(f"cannot make {to}")
    if full:
        listed = spark.sparkContext._gateway.new_array(path, len(full))
        for i, p in enumerate(full):
            listed[i] = p
        fs.concat(target, listed)
