"""The folder that driver and executors share, and tables that are kept for several jobs."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir. Where that is unset, as in tests, one of this machine, and on one machine only."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that the driver and the executors share")
        top = tempfile.mkdtemp(prefix="eventloom-")
        spark.sparkContext.setCheckpointDir(top)
    path = f"{top.rstrip('/')}/{uuid.uuid4().hex}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    fs.deleteOnExit(folder)
    return path


@contextlib.contextmanager
def holding() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Gives a function by which a table is computed once for all jobs within, and kept on the executors' disks until the end.

    A table that its owner has persisted stays so.
    """
    own: list[DataFrame] = []

    def hold(df: DataFrame) -> DataFrame:
        if df.storageLevel == StorageLevel.NONE:
            own.append(df.persist(StorageLevel.DISK_ONLY))
        return df

    try:
        yield hold
    finally:
        for df in reversed(own):
            df.unpersist()
