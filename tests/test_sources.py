"""Tables and files read and written: what is refused, set aside, left unread or written once."""

import datetime
import gzip

import pytest
from pyspark.sql import functions as F

from sitedrift.sources import tables


def write(tmp_path, **files):
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    return f"file://{tmp_path}"


NAMES = "ownerUserId,memberUserId,createdAt"


def test_broken_rows_of_json_are_set_aside(spark, tmp_path):
    good = '{"ownerUserId":"a","memberUserId":"b","createdAt":"2024-01-01T00:00:00Z"}'
    bad = ['{"ownerUserId":"c","memberUserId":"d","createdAt":"soon"}', '{"ownerUserId":"e","other":1}', '{"ownerUserId":"f"', "text"]
    path = write(tmp_path, a="\n".join([good, *bad[:2], ""]), b="\n".join([*bad[2:], '{"ownerUserId":"g"}']))
    rows, aside = tables.read_checked(spark, path, "account_membership", "json")
    assert sorted(r.ownerUserId for r in rows.collect()) == ["a", "g"]
    assert {r.record for r in aside.collect()} == set(bad)
    assert tables.read_table(spark, path, "account_membership", "json").count() == 2


def test_broken_rows_of_csv_are_set_aside(spark, tmp_path):
    bad = ["c,d,soon", "e", "f,g,2024-01-01T00:00:00Z,more"]
    path = write(tmp_path, a="\n".join([NAMES, '"a,""x""",b,2024-01-01T00:00:00Z', *bad]), b=f"{NAMES}\nh,i,\n")
    rows, aside = tables.read_checked(spark, path, "account_membership", "csv")
    assert sorted((r.ownerUserId, r.createdAt is None) for r in rows.collect()) == [('a,"x"', False), ("h", True)]
    assert sorted(r.record for r in aside.collect()) == sorted(bad)


def test_files_with_other_columns_are_refused(spark, tmp_path):
    for k, head in enumerate(("ownerUserId,memberUserId", f"{NAMES},more", "ownerUserId,memberUserId,other")):
        folder = tmp_path / str(k)
        folder.mkdir()
        with pytest.raises(ValueError, match="account_membership"):
            tables.read_table(spark, write(folder, a=f"{head}\na,b,c\n"), "account_membership", "csv")
    later = tmp_path / "later"
    later.mkdir()
    path = write(later, a=f"{NAMES}\na,b,\n", b="ownerUserId,createdAt,memberUserId\nc,,d\n")
    with pytest.raises(Exception, match="(?i)header"):
        tables.read_table(spark, path, "account_membership", "csv").collect()
    typed = f"file://{tmp_path}/typed"
    spark.createDataFrame([("a", "b", "c")], "ownerUserId string, memberUserId string, createdAt string").write.parquet(typed)
    with pytest.raises(ValueError, match="createdAt string"):
        tables.read_table(spark, typed, "account_membership")
    with pytest.raises(ValueError, match="orc"):
        tables.read_table(spark, typed, "account_membership", "orc")


def test_large_files_are_not_read(spark, tmp_path):
    (tmp_path / "small.xml").write_bytes(b"<urlset/>")
    (tmp_path / "large.xml").write_bytes(b"x" * 2000)
    (tmp_path / "packed.xml").write_bytes(gzip.compress(b"y" * 2000))
    (tmp_path / "broken.xml").write_bytes(gzip.compress(b"z" * 400)[:-9])
    key = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(key, "1000")
    try:
        for most in (500, 52_428_800):
            got = tables.read_sitemap_files(spark, f"file://{tmp_path}", most).collect()
            errors = {r.path.rsplit("/", 1)[1]: r.error for r in got}
            packed = "RESOURCE_LIMIT" if most == 500 else None
            assert errors == {"small.xml": None, "large.xml": "RESOURCE_LIMIT", "packed.xml": packed, "broken.xml": "DECOMPRESSION_ERROR"}
            assert {r.length for r in got if r.path.endswith("large.xml")} == {2000}
    finally:
        spark.conf.unset(key)


def test_events_are_compared_with_their_days_only(spark, tmp_path):
    path, at = f"file://{tmp_path}/events", datetime.datetime(2024, 1, 1)
    rows = [(f"r{k}:h:added", at + datetime.timedelta(hours=12 * k), k) for k in range(6)]
    df = spark.createDataFrame(rows, "id string, observed_at timestamp, n int")
    tables.write_events(df.where("n < 3"), path)
    tables.write_events(df.where("n > 1").unionAll(df.where("n = 5")), path)
    tables.write_events(df, path)
    got = spark.read.parquet(path)
    assert sorted((r.id, r.n) for r in got.collect()) == sorted((i, n) for i, _, n in rows)
    assert got.where(F.col("observed_date") == F.to_date("observed_at")).count() == 6


def test_new_events_are_dealt_and_sorted_once(spark, tmp_path):
    path, at = f"file://{tmp_path}/events", datetime.datetime(2024, 1, 1)
    rows = [(f"r{k % 5}", at + datetime.timedelta(days=k % 3), k) for k in range(12)]
    df = spark.createDataFrame(rows, "id string, observed_at timestamp, n int")
    tables.write_events(df.where("n = 0"), path)
    new = tables.new_events(df, path)
    # an id that is there, on whatever of the batch's days, isn't written again
    assert sorted(r.id for r in new.collect()) == ["r1", "r2", "r3", "r4"]
    plan = new._jdf.queryExecution().optimizedPlan().toString() + new._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate [id" not in plan and "SortAggregate" not in plan


def test_price_csv_is_quoted(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 10)
    points = spark.createDataFrame(
        [(at, 9.5, 'E"UR', True), (at, 9.0, None, True), (at, None, "EUR", True), (at, 9.0, "EUR", False)],
        "createdAt timestamp, price double, currency string, is_product_page boolean",
    )
    tables.export_price_csv(points.coalesce(1), f"file://{tmp_path}/csv")
    (part,) = (tmp_path / "csv").glob("part-*.csv")
    assert part.read_text().splitlines() == [
        '"timestamp_iso","price","currency"', '"2024-01-01T10:00:00.000Z","9.5","E""UR"', '"2024-01-01T10:00:00.000Z","9",""',
    ]


def test_text_files_are_as_many_as_the_sessions_partitions(spark):
    from sitedrift import registry

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        files = registry.queries()["s1_read_table"](spark, "/root/testdata/sf0.001").inputFiles()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len({f.rsplit("/", 2)[1] for f in files if "/csv/" in f}) == 9
