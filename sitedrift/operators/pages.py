"""Pages of large tables by a stored order: an offset reads the ranges that it lies in, and nothing is sorted but those.

An index is the table's rows dealt into ranges of the order's columns, a folder for each, and a small table of how many rows
of each group each range holds and how many come before them. A page's rows, the total and the next page's offset come
from one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a range aimed at.
RANGE_ROWS = 20_000
MOST_ROWS, MOST_OFFSET = 200, 200_000


def checked(limit: int, offset: int) -> None:
    if not (1 <= limit <= MOST_ROWS and 0 <= offset <= MOST_OFFSET):
        raise ValueError(f"limit must be 1..{MOST_ROWS}, offset 0..{MOST_OFFSET}")


def write_index(df: DataFrame, path: str, order: list[Column], group: str | None = None, range_rows: int = RANGE_ROWS) -> None:
    """Writes df below path, dealt by order. Pages are of the whole table, or of one value of group."""
    spark = df.sparkSession
    n = max(1, -(-df.count() // range_rows))
    ranged = df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id())
    ranged.sortWithinPartitions(*order).write.mode("overwrite").partitionBy("_range").parquet(f"{path}/rows")
    kept = spark.read.schema(ranged.schema).parquet(f"{path}/rows")
    key = F.col(group).cast("string") if group else F.lit("")
    sizes = kept.groupBy(key.alias("group"), "_range").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("group").orderBy("_range")
    sizes = sizes.withColumn("before", F.sum("n").over(w) - F.col("n"))
    sizes.repartitionByRange(max(1, n // 1000), "group").sortWithinPartitions("group", "_range").write.mode("overwrite").parquet(f"{path}/ranges")


def read_page(
    spark: SparkSession, path: str, schema, order: list[Column], limit: int, offset: int = 0, group: str | None = None, value: str = ""
) -> DataFrame:
    """Rows offset .. offset + limit in this order, with total and next_offset (null on the last page).

    The ranges of the page are looked up first; their rows are all that is read and sorted.
    """
    checked(limit, offset)
    ranges = spark.read.parquet(f"{path}/ranges").where(F.col("group") == value)
    total = ranges.agg(F.sum("n")).first()[0] or 0
    # neighbours, as many as a page of limit rows can meet
    met = ranges.where((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset)).orderBy("_range").collect()
    empty = spark.createDataFrame([], schema)
    rows = empty
    if met:
        parts = [f"{path}/rows/_range={r['_range']}" for r in met]
        rows = spark.read.schema(empty.schema).parquet(*parts)
        rows = rows if group is None else rows.where(F.col(group).cast("string") == value)
        rows = rows.orderBy(*order).offset(offset - met[0]["before"]).limit(limit)
    after = offset + limit if total > offset + limit else None
    return rows.withColumns({"total": F.lit(total).cast("long"), "next_offset": F.lit(after).cast("int")})
