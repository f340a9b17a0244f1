"""The folder that driver and executors share, and what of it follows from the state of an input."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it knows it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. A local session without one gets a temporary folder; on a cluster, whose
    machines wouldn't share it, that is an error."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quarry-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def _files(spark: SparkSession, path: str) -> Iterator[str]:
    fs, at = file_system(spark, path)
    found = fs.listFiles(at, True)
    while found.hasNext():
        f = found.next()
        yield f"{f.getPath()} {f.getLen()} {f.getModificationTime()}"


def snapshot(spark: SparkSession, *paths: str) -> str:
    """A digest of the names, sizes and times of all files below the paths."""
    names = sorted(name for p in paths for name in _files(spark, p))
    return hashlib.sha256("\n".join(names).encode()).hexdigest()[:24]
