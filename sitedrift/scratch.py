"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only where it is unset, as in tests, a new local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        folder = sc.getCheckpointDir()
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    if "://" in folder:
        return folder
    return f"file://{folder.removeprefix('file:')}"


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage ends there and lost executors don't matter."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def version(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of a table's files: another if the table is written anew."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(p)))


_KEPT: dict[tuple, str] = {}


def kept(spark: SparkSession, name: str, sources: list[str], write: Callable[[str], None]) -> str:
    """A folder that write has filled from these tables: the same one within an application, as long as the tables' files
    are what they were and the folder is still there."""
    key = (spark.sparkContext.applicationId, name, *((path, version(spark, path)) for path in sources))
    folder = _KEPT.get(key)
    if folder is None or not exists(spark, folder):
        folder = fresh_folder(spark, name)
        write(folder)
        _KEPT[key] = folder
    return folder
