"""Tables kept in buckets, of which a batch reads and writes only those it touches.

A bucket is a whole number made of a row's columns: a hash of its key, or the quarter of a moment. Below a table's folder lie
versions of buckets, v=<batch>/bucket=<k>, and a manifest that names the last version of each bucket. A version's
folder is written first, then one manifest file, so readers see a whole batch or none of it. A batch that is repeated
starts from the versions before it and writes its own again, so it changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import exists

BUCKETS = 64
MANIFEST = "batch_id long, bucket int, n long"


def by_hash(keys: list[str], buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def by_quarter(moment: str) -> Column:
    """Quarters since the year 0; 0 for none."""
    return F.coalesce(F.year(moment) * 4 + F.quarter(moment), F.lit(0)).cast("int")


def touched(rows: DataFrame, bucket: Column) -> list[int]:
    """The buckets that rows fall in: as many numbers as there are buckets at most."""
    return sorted(r[0] for r in rows.select(bucket).distinct().collect())


def versions(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """bucket, batch_id, n of the last version of each bucket, or of the last before a batch; None if there is no table."""
    if not exists(spark, f"{path}/_manifest"):
        return None
    rows = spark.read.schema(MANIFEST).json(f"{path}/_manifest")
    rows = rows if before is None else rows.where(F.col("batch_id") < before)
    return rows.groupBy("bucket").agg(F.max("batch_id").alias("batch_id"), F.max_by("n", "batch_id").alias("n"))


def read_buckets(spark: SparkSession, path: str, schema, only: Iterable[int] | None = None, before: int | None = None) -> DataFrame:
    """The table's rows, of all or only some buckets, with the columns of schema."""
    found = versions(spark, path, before)
    empty = spark.createDataFrame([], schema)
    if found is None:
        return empty
    live = found.where("n > 0")
    live = live if only is None else live.where(F.col("bucket").isin(list(only)))
    paths = [f"{path}/v={r['batch_id']}/bucket={r['bucket']}" for r in live.collect()]
    return spark.read.schema(empty.schema).parquet(*paths) if paths else empty


def write_buckets(rows: DataFrame, path: str, bucket: Column, batch_id: int, only: list[int]) -> None:
    """A new version of the buckets of only, which rows hold whole; a bucket without rows is empty from then on. Rows are
    dealt by bucket, so a bucket is one file."""
    if not only:
        return
    spark = rows.sparkSession
    folder = f"{path}/v={batch_id}"
    named = rows.withColumn("bucket", bucket).repartition(len(only), "bucket")
    named.write.mode("overwrite").partitionBy("bucket").parquet(folder)
    asked = spark.createDataFrame([(k,) for k in only], "bucket int")
    sizes = spark.read.schema("bucket int").parquet(folder).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    manifest = asked.join(F.broadcast(sizes), "bucket", "left")
    manifest = manifest.select(F.lit(batch_id).cast("long").alias("batch_id"), "bucket", F.coalesce("n", F.lit(0)).alias("n"))
    manifest.coalesce(1).write.mode("append").json(f"{path}/_manifest")


def forget(spark: SparkSession, path: str) -> None:
    """Removes the folders of versions that no bucket is read from any more. Batches can't be repeated from then on, and readers
    of older versions must be done."""
    found = versions(spark, path)
    if found is None:
        return
    live = {f"v={r[0]}" for r in found.where("n > 0").select("batch_id").distinct().collect()}
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    for entry in fs.listStatus(root):
        name = entry.getPath().getName()
        if name.startswith("v=") and name not in live:
            fs.delete(entry.getPath(), True)
