"""The folder that driver and executors share, and work tables in it."""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or, where that is unset and driver and executors are one process, a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _LOCAL.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="gridloom-"))


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; every run gets its own."""
    return f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read back: what is computed once stays as it is when tasks or executors are lost."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_of(spark: SparkSession, path: str):
    """(file system, path) of Hadoop's."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = path_of(spark, path)
    return fs.exists(p)


def listed(spark: SparkSession, path: str) -> list[str]:
    """The names of what lies in a folder; none where there is no folder."""
    fs, p = path_of(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete files or folders that nothing reads any more."""
    if paths:
        named, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()  # each step to the JVM counts with many files
        for p in map(named, paths):
            p.getFileSystem(conf).delete(p, True)


def renamed(spark: SparkSession, old: str, new: str, *more: str) -> None:
    """Give a file or folder its final name in one step (on object stores, where that is a copy, in as many as there are files); more: further pairs, one after the other."""
    named, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    pairs = [old, new, *more]
    for a, b in zip(pairs[::2], pairs[1::2], strict=True):
        p = named(a)
        if not p.getFileSystem(conf).rename(p, named(b)):
            raise OSError(f"could not rename {a} to {b}")


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """(store, path in it) for a task that opens a file by its address: a mounted folder, or any store that pyarrow knows."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)
