"""Registration of queries, and tables fed to them as streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bindings import duck
from ..scratch import fresh_folder, partitions, stored
from ..streaming import jobs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with DuckDB SQL over the bindings if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = duck(sql)
        return f

    return add


def as_stream(df: DataFrame, spark: SparkSession, name: str, keys: list[str], time: Column, slices: int = 4):
    """(stream, folder): df written as files and read as a stream of several micro-batches.

    Slices of about equal size are cut by time (a number) and written one after the other. All rows of a key in a slice are
    in one file, and files are read from the oldest on, so a key's rows come in order of slices whatever files
    make a batch.
    """
    folder, parts = fresh_folder(spark, name), partitions(spark)
    rows = stored(df.withColumn("_time", time.cast("double")), name)
    bounds = sorted(set(rows.approxQuantile("_time", [k / slices for k in range(1, slices)], 0.01)))
    number = reduce(lambda n, b: n + (F.col("_time") > b).cast("int"), bounds, F.lit(0))
    for k in range(len(bounds) + 1):
        rows.where(number == k).drop("_time").repartition(parts, *keys).write.mode("append").parquet(f"{folder}/in")
    return jobs.file_stream(spark, f"{folder}/in", df.schema, files=parts), folder
