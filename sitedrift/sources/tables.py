"""Reading and writing the monitor's tables: fixed schemas, idempotent appends, versioned state."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.payloads import number_text
from ..functions.web import MAX_FILE_BYTES, inflate
from ..scratch import exists

#: Fixed schemas of the monitor's tables.
SCHEMAS = {
    "competitor_group": "id string, owner_user_id string, name string, description string, membership_version int,"
    " created_at timestamp, updated_at timestamp",
    "account_membership": "ownerUserId string, memberUserId string, createdAt timestamp",
    "crawl_run": "id string, target_id string, trigger string, scope_version int, origin_baseline_run_id string,"
    " execution_status string, completeness string, adoption_status string, attempt int, available_at timestamp,"
    " created_at timestamp, finished_at timestamp, observed_at timestamp, result string, error string",
    "crawl_run_attempt": "run_id string, attempt int, started_at timestamp, finished_at timestamp, status string, error string",
    "site_url": "website_id string, scope_version int, normalized_url_hash string, url string, status string,"
    " first_seen_at timestamp, last_seen_at timestamp, first_missing_run_id string, first_missing_observed_at timestamp,"
    " last_missing_run_id string, missing_confirmations int, removed_at timestamp",
    "url_event": "id string, website_id string, scope_version int, normalized_url_hash string, url string, run_id string,"
    " kind string, observed_at timestamp",
    "removal_candidate": "id string, target_id string, scope_version int, origin_baseline_run_id string,"
    " candidate_run_id string, status string, reason string, missing_set_hash string, original_missing_count int,"
    " pending_count int, recovered_count int, removed_count int, observed_at timestamp, expires_at timestamp,"
    " next_confirmation_at timestamp, confirmation_attempts int, last_confirmation_run_id string",
    "candidate_missing_url": "candidate_id string, normalized_url_hash string, url string, resolution string",
    "snapshot": "id string, websiteId string, kind string, targetUrl string, payload string, hash string, createdAt timestamp",
    "alert": "id string, websiteId string, targetId string, kind string, title string, details string, read boolean,"
    " suppressed boolean, suppressionReason string, createdAt timestamp",
}


def schema_of(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


CORRUPT = "_corrupt_record"


def _check_columns(name: str, have: list[str], want: list[str]) -> None:
    if set(have) != set(want) or len(have) != len(want):
        raise ValueError(f"{name}: missing {sorted(set(want) - set(have))}, unknown {sorted(set(have) - set(want))}")


def read_table(spark: SparkSession, path: str, name: str, fmt: str = "parquet") -> DataFrame:
    """A table with its fixed schema; files with other columns, or Parquet columns of another type, are refused. Rows of
    csv and json files that don't fit the schema are left out: read_checked returns them beside the others."""
    return read_checked(spark, path, name, fmt)[0]


def read_checked(spark: SparkSession, path: str, name: str, fmt: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """(rows that fit the table's schema, texts of those that don't as column record) of parquet, csv (with a header) or
    json files.

    Names of Parquet files and of the first csv header are checked before anything is read, those of each further header
    when its file is. A csv or json record is set aside if a value isn't of its column's type, if it has too few or too many
    fields or one of another name, or isn't a record at all. All that takes one pass.
    """
    want = schema_of(name)
    if fmt == "parquet":
        have = spark.read.parquet(path).schema
        _check_columns(name, have.names, want.names)
        other = [f"{f.name} {have[f.name].dataType.simpleString()}" for f in want if have[f.name].dataType != f.dataType]
        if other:
            raise ValueError(f"{name}: of another type: {', '.join(other)}")
        return spark.read.schema(want).parquet(path), spark.createDataFrame([], "record string")
    full = T.StructType([*want.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    if fmt == "csv":
        _check_columns(name, spark.read.csv(path, header=True).columns, want.names)
        rows = spark.read.schema(full).csv(path, header=True, enforceSchema=False, escape='"', **options)
        # tied to all columns: a reader that parses some of them only sees some of the faults
        rows = rows.withColumn("_record", F.when(F.pmod(F.hash(*want.names), F.lit(2)) < 2, F.col(CORRUPT)))
    elif fmt == "json":
        lines = spark.read.text(path).where(F.trim("value") != "")
        rows = lines.select("value", F.from_json("value", full, options).alias("r")).select(
            *(F.col(f"r.{c}").alias(c) for c in want.names),
            F.when(F.col(f"r.{CORRUPT}").isNotNull() | (F.size(F.array_except(F.json_object_keys("value"), F.lit(want.names))) > 0), F.col("value")).alias("_record"),
        )
    else:
        raise ValueError(f"{fmt} isn't one of parquet, csv, json")
    return rows.where(F.col("_record").isNull()).select(*want.names), rows.where(F.col("_record").isNotNull()).select(F.col("_record").alias("record"))


def read_sitemap_files(spark: SparkSession, path: str, max_file_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """path, length, body, error of the files below a folder, plain, gzipped or gzipped twice.

    error: RESOURCE_LIMIT of files larger than allowed (or than Spark's reader takes), which are listed but never read, and
    of those that inflate to more; DECOMPRESSION_ERROR of broken ones. Their body is null.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    most = min(max_file_bytes, int(spark.conf.get("spark.sql.sources.binaryFile.maxLength", str(2**31 - 1))))
    # the reader is told this filter, and opens no file that fails it
    small = files.where(F.col("length") <= most).select("path", "length", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [inflate(raw, max_file_bytes) for raw in b.column(2).to_pylist()]
            columns = [pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["path", "length", "body", "error"])

    read = small.mapInArrow(run, "path string, length long, body binary, error string")
    large = files.where(F.col("length") > most).select(
        "path", "length", F.lit(None).cast("binary").alias("body"), F.lit("RESOURCE_LIMIT").alias("error")
    )
    return read.unionByName(large)


def new_rows(new: DataFrame, existing: DataFrame, key: str = "id") -> DataFrame:
    """Rows of new whose key is new, one for each key."""
    return new.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def write_events(events: DataFrame, path: str) -> None:
    """Appends events by day; an event id already there is skipped, so a repeated batch changes nothing.

    An id names its run and with it its moment, so it can only lie among the events of its own day: ids are compared with
    those of the batch's days, whose folders alone are read.
    """
    # ids and hashes are hexadecimal, which only an entropy coder makes smaller
    new_events(events, path).write.mode("append").option("compression", "zstd").partitionBy("observed_date").parquet(path)


def new_events(events: DataFrame, path: str) -> DataFrame:
    """The events, with their day, whose id isn't among those below path; one for each id."""
    spark = events.sparkSession
    day = F.to_date("observed_at")
    # the first of each id by a window, which sorts once and leaves rows dealt by id for the join; dropDuplicates sorts twice
    again = F.lag(F.lit(True)).over(Window.partitionBy("id").orderBy("observed_at"))
    rows = events.withColumns({"observed_date": day, "_again": again}).where("_again IS NULL").drop("_again")
    if exists(spark, path):
        stored_ids = T.StructType([*events.select("id").schema.fields, T.StructField("observed_date", T.DateType())])
        days = events.select(day.alias("observed_date")).distinct()
        # joined with a small table of days, a scan reads their partitions only
        there = spark.read.schema(stored_ids).parquet(path).join(F.broadcast(days), "observed_date", "left_semi")
        rows = rows.join(there.select("id"), "id", "left_anti")
    return rows


def write_state(df: DataFrame, path: str, batch_id: int) -> None:
    """Publishes a version of a state table: its folder first, then the pointer that readers follow."""
    df.write.mode("overwrite").parquet(f"{path}/v={batch_id}")
    pointer = df.sparkSession.range(1).select(F.lit(batch_id).cast("long").alias("batch_id"), F.lit(path).alias("path"))
    pointer.coalesce(1).write.mode("append").json(f"{path}/_pointer")


def read_state(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The last published version, or the last before a batch, so that a repeated batch starts from the same one; None
    if there is none."""
    if not exists(spark, f"{path}/_pointer"):
        return None
    versions = spark.read.schema("batch_id long, path string").json(f"{path}/_pointer")
    if before is not None:
        versions = versions.where(F.col("batch_id") < before)
    last = versions.agg(F.max("batch_id")).first()[0]
    return None if last is None else spark.read.parquet(f"{path}/v={last}")


def append_revisions(new: DataFrame, path: str) -> None:
    """Immutable revisions: only ids that aren't there yet."""
    spark = new.sparkSession
    rows = new_rows(new, spark.read.schema(new.select("id").schema).parquet(path)) if exists(spark, path) else new.dropDuplicates(["id"])
    rows.write.mode("append").parquet(path)


def price_csv_rows(points: DataFrame) -> DataFrame:
    """timestamp_iso, price, currency of plottable points as text."""
    at = F.date_format(F.col("createdAt").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return points.where("is_product_page AND price IS NOT NULL").select(
        at.alias("timestamp_iso"), number_text(F.col("price")).alias("price"), F.coalesce("currency", F.lit("")).alias("currency")
    )


def export_price_csv(points: DataFrame, path: str) -> None:
    """Every field quoted, quotes inside doubled."""
    price_csv_rows(points).write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')
