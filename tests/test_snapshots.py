"""Line diffs of texts of any length against plain lists."""

import json
import random
import time

import duckdb
from pyspark.sql import functions as F

from sitedrift import registry
from sitedrift.operators import snapshots
from sitedrift.plans import alerts
from sitedrift.streaming import jobs


def plain(before, after, most):
    a, b = after.split("\n"), before.split("\n")
    new, gone = [x for x in a if x not in set(b)], [x for x in b if x not in set(a)]
    cut = lambda x: x[:157] + "…" if len(x) > 160 else x
    part = lambda rows, sign: [f"{sign} {cut(x)}" for x in rows[:most]]
    return "\n".join(part(new, "+") + part(gone, "-")), len(new), len(gone)


def diffs(spark, pairs, most):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id long, before string, after string")
    return {r.id: tuple(r.d) for r in snapshots.line_diffs(rows, most).collect()}


def test_short_and_long_texts_diff_alike(spark, monkeypatch):
    rng = random.Random(3)
    text = lambda: "\n".join(rng.choice(["", "a", "b", "c" * 170, "d e", "f"] + [str(rng.randrange(30))]) for _ in range(rng.randrange(12)))
    pairs = [(text(), text()) for _ in range(60)] + [("", ""), ("a", "a"), ("", "a\na"), ("x\n" * 300, "x\n" * 299 + "y\ny")]
    want = {most: {i: plain(a, b, most) for i, (a, b) in enumerate(pairs)} for most in (3, 40)}
    for most, expected in want.items():
        assert diffs(spark, pairs, most) == expected
    monkeypatch.setattr(snapshots, "SHORT", 0)
    for most, expected in want.items():
        assert diffs(spark, pairs, most) == expected
    assert diffs(spark, [("a", "b")], 3) == {0: ("+ b\n- a", 1, 1)}


def test_time_is_linear_in_lines(spark):
    """Two texts of 40,000 lines, half of them in common: a search in arrays would take about a minute and a half."""
    before, after = ("\n".join(f"{k if k % 2 else side} line {k}" for k in range(40_000)) for side in ("old", "new"))
    diffs(spark, [(before[:5_000], after[:5_000])], 3)
    began = time.perf_counter()
    got = diffs(spark, [(before, after)], 3)
    assert got[0][1:] == (20_000, 20_000) and got[0][0].startswith("+ new line 0\n+ new line 2\n+ new line 4\n- old line 0")
    assert time.perf_counter() - began < 20


def test_prices_that_share_moment_and_id_are_in_a_fixed_order(spark, tmp_path):
    """In whatever order rows come, by windows and by a stream."""
    rows = [(1, "p", 10, price, currency, page) for price, currency, page in [(5.0, "EUR", True), (None, "EUR", True), (5.0, None, False), (7.0, "USD", True), (5.0, None, True)]]
    got = []
    for k, mine in enumerate((rows, rows[::-1])):
        df = spark.createDataFrame(mine, "id long, page string, taken long, price double, currency string, is_product_page boolean").coalesce(1)
        series = df.withColumn("createdAt", F.timestamp_seconds("taken"))
        df.write.parquet(f"{tmp_path}/{k}/in")
        stream = jobs.stream_price_changes(jobs.file_stream(spark, f"{tmp_path}/{k}/in", df.schema))
        found = (snapshots.price_changes(series), snapshots.price_series(series).select("point", "price", "currency"), jobs.run_to_table(stream, f"{tmp_path}/{k}"))
        got.append([sorted(map(repr, x.collect())) for x in found])
    assert got[0] == got[1] and [len(x) for x in got[0]] == [3, 5, 3]


def test_alerts_count_prices_that_share_their_id_once(spark, tmp_path):
    """An alert for each change, as the SQL has them, where several prices of a page have the same day and id."""
    sf = "/root/testdata/sf0.001"
    spark.read.parquet(f"{sf}/documents.parquet").limit(5).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    # each row three times, so that their order is no matter
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_linestatus = 'O' AND l_linenumber < 7").orderBy("l_orderkey", "l_linenumber", "l_partkey").limit(40)
    rows.unionAll(rows).unionAll(rows).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = registry.queries()["p8_detect_alerts"](spark, str(tmp_path)).where("kind = 'PRODUCT_PRICE'")
    con = duckdb.connect()
    for name in ("documents", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(f"SELECT snapshot_id, title FROM ({registry.oracle_sql()['p8_detect_alerts']}) WHERE kind = 'PRODUCT_PRICE'").fetchall()
    assert sorted((r.snapshot_id, r.title) for r in got.collect()) == sorted(want)


def _alerts(spark, snaps):
    snap = spark.createDataFrame(snaps, "id string, websiteId string, kind string, targetUrl string, payload string, taken int").withColumn("hash", F.sha2("payload", 256))
    watched = [("l", "w", "SITEMAP_LINKS", None, None), ("c", "w", "PAGE_CONTENT", None, "p"), ("d", "w", "PRODUCT_PRICE", None, "p")]
    target = spark.createDataFrame(watched, "id string, websiteId string, kind string, linkScope string, pageUrl string")
    website = spark.createDataFrame([("w", "w.example.com")], "id string, domain string")
    return alerts.detect_alerts(snap, target, website)


def test_short_and_long_snapshots_alert_alike(spark, monkeypatch):
    rng = random.Random(5)
    urls = lambda n: json.dumps([f"u/{rng.randrange(30)}" for _ in range(n)] + [None] * (n % 2))
    snaps = [(f"s{k}", "w", "SITEMAP", None, rng.choice([urls(rng.randrange(9)), urls(150), "no list", None]), k) for k in range(14)]
    snaps += [(f"m{k}", "w", "MARKDOWN", "p", rng.choice(["a\nb", "b\n" * 700, "a", "", None]), k) for k in range(14)]
    snaps += [(f"p{k}", "w", "PRODUCT", "p", f'{{"is_product_page":true,"productName":"{"P" * rng.choice([1, 1_200])}","price":{rng.randrange(3)}}}', k) for k in range(14)]
    want = sorted(map(repr, _alerts(spark, snaps).collect()))
    assert len(want) > 15
    monkeypatch.setattr(alerts, "CARRIED", 0)
    monkeypatch.setattr(alerts, "SHORT", 0)
    assert sorted(map(repr, _alerts(spark, snaps).collect())) == want


def test_short_payloads_are_not_joined_by_their_ids(spark):
    """Three prices with one id make two changes."""
    prices = [("p", "w", "PRODUCT", "p", f'{{"is_product_page":true,"price":{9 - k}}}', k) for k in range(3)]
    assert sorted(r.title for r in _alerts(spark, prices).collect()) == ["Price change: p (8 → 7)", "Price change: p (9 → 8)"]
