"""Every registered query outside the optional subpackage runs on the smallest tables and equals its DuckDB SQL."""

import datetime
import glob
import math
import os

import duckdb
import pytest

from sitedrift import registry
from sitedrift.functions.web import lcs_segments

SF = "/root/testdata/sf0.001"
#: Without SQL; held against plain versions below.
NO_SQL = {"x13_token_diff"}


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - NO_SQL))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(plain(v) for v in r)) for r in df.select(*columns).collect())
    found = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in columns)) for r in found.fetchall())
    assert got == want


def test_every_query_has_sql_or_a_plain_version():
    assert set(registry.queries()) - set(registry.oracle_sql()) == NO_SQL


def test_token_diff_query_equals_the_plain_rule(spark):
    rows = registry.queries()["x13_token_diff"](spark, SF).collect()
    assert len(rows) > 50
    for r in rows:
        old, new = ("".join(x[1:] for x in side) for side in (r.removed, r.added))
        left, right = lcs_segments(old, new)
        mark = lambda s: [("*" if f else "=") + t for t, f in s]
        assert (r.removed, r.added) == (mark(left), mark(right))
        assert all(r.removed) and "".join(x[1:] for x in r.removed if x[0] == "=") == "".join(x[1:] for x in r.added if x[0] == "=")


def test_sitemap_files_are_written_by_several_tasks(spark):
    """s3_read_sitemap_files: many small files are little data, and would be dealt to one task."""
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    old = set(glob.glob(f"{shared}/s3-*"))
    registry.queries()["s3_read_sitemap_files"](spark, SF)
    (folder,) = set(glob.glob(f"{shared}/s3-*")) - old
    assert len({os.path.basename(f)[:10] for f in glob.glob(f"{folder}/plain/*/part-*")}) > 1
