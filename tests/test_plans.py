"""Bulk plans, table sources and the expiry stream on small literal tables."""

import datetime

import pytest
from pyspark.sql import functions as F

from sitedrift.operators.inventory import replay_url_lifecycle
from sitedrift.operators import pages, views
from sitedrift.plans import alerts, scan, upkeep
from sitedrift.sources import tables
from sitedrift.streaming import jobs
from tests.test_inventory import T0, frames

HOUR = datetime.timedelta(hours=1)
DAY = datetime.timedelta(days=1)


def test_approval_applies_the_candidates_run(spark):
    obs, runs = frames(spark, {"t": [("r0", T0, {"a", "b", "c", "d"}), ("r1", T0 + HOUR, {"a"})]})
    state, _ = replay_url_lifecycle(obs.where("run_id = 'r0'"), runs.where("run_id = 'r0'"))
    columns = "id string, target_id string, scope_version int, status string, origin_baseline_run_id string, candidate_run_id string, observed_at timestamp, expires_at timestamp"
    cand = spark.createDataFrame(
        [
            ("c1", "t", 1, "pending", "r0", "r1", T0 + HOUR, T0 + DAY),
            ("c2", "t", 2, "pending", "r0", "r1", T0 + HOUR, T0 + DAY),
            ("c3", "t", 1, "confirmed", "r9", "r1", T0, T0),
        ],
        columns,
    )
    target = spark.createDataFrame([("t", "wt", 1, "r0")], "id string, website_id string, scope_version int, baseline_run_id string")
    asked = spark.createDataFrame([("c1",), ("c2",), ("c3",), ("cx",)], "candidate_id string")
    outcomes, new, events = upkeep.approve_candidates(asked, cand, target, state, obs, F.lit(T0 + 2 * HOUR).cast("timestamp"))
    assert {r.candidate_id: (r.status, r.changed, r.error) for r in outcomes.collect()} == {
        "c1": ("adopted", True, None),
        "c2": (None, False, "CANDIDATE_STALE"),
        "c3": ("confirmed", False, None),
        "cx": (None, False, "CANDIDATE_NOT_FOUND"),
    }
    assert {r.url: r.status for r in new.collect()} == {"a": "active", "b": "pending_removed", "c": "pending_removed", "d": "pending_removed"}
    assert events.count() == 0


def test_retention_keeps_what_is_referenced(spark):
    now = T0 + 365 * DAY
    run = lambda i, days: (i, "succeeded", now - days * DAY, "{}", None)
    runs = spark.createDataFrame([run("base", 200), run("cand", 200), run("old", 200), run("new", 2)], "id string, execution_status string, finished_at timestamp, result string, error string")
    target = spark.createDataFrame([("t", 2, "base")], "id string, scope_version int, baseline_run_id string")
    cand = spark.createDataFrame([("pending", "cand", None, None)], "status string, candidate_run_id string, origin_baseline_run_id string, last_confirmation_run_id string")
    attempts = spark.createDataFrame([(r, 1, "e") for r in ("base", "old")], "run_id string, attempt int, error string")
    sources = spark.createDataFrame([(r, 1, "u", f"rev_{r}", now - 100 * DAY) for r in ("base", "old")], "run_id string, attempt int, source_url string, revision_id string, created_at timestamp")
    cache = spark.createDataFrame([("t", 1, "u", "rev_x"), ("t", 2, "u", "rev_y")], "target_id string, scope_version int, source_url string, revision_id string")
    revs = spark.createDataFrame([(f"rev_{k}", now - 40 * DAY) for k in ("base", "old", "x", "y")], "id string, created_at timestamp")
    out = upkeep.retention(target, cand, runs, attempts, sources, cache, revs, F.lit(now).cast("timestamp"))
    assert {r.id: r.result for r in out["runs"].collect()} == {"base": "{}", "cand": "{}", "old": None, "new": "{}"}
    assert {r.run_id: r.error for r in out["attempts"].collect()} == {"base": "e", "old": None}
    assert [r.run_id for r in out["sources"].collect()] == ["base"]
    assert [r.scope_version for r in out["cache"].collect()] == [2]
    assert {r.id for r in out["revisions"].collect()} == {"rev_base", "rev_y"}


def test_stored_retention_repeats(spark, tmp_path):
    """What goes and what stays is that of the frames; a batch that is repeated and a later one change nothing more, and only
    old buckets are written."""
    now, old = T0 + 365 * DAY, T0 - 300 * DAY
    ids = ["base", "cand", "old", "new"]
    at = {"base": old, "cand": old, "old": old, "new": now - DAY}
    runs = spark.createDataFrame([(i, "succeeded", "{}", "e", at[i]) for i in ids], upkeep.RETAINED["runs"][0])
    attempts = spark.createDataFrame([(i, 1, "e", at[i]) for i in ids], upkeep.RETAINED["attempts"][0])
    sources = spark.createDataFrame([(i, 1, "u", f"rev_{i}", at[i]) for i in ids], upkeep.RETAINED["sources"][0])
    cache = spark.createDataFrame([("t", 1, "u", "rev_x"), ("t", 2, "u", "rev_y")], upkeep.RETAINED["cache"][0])
    revisions = spark.createDataFrame([(f"rev_{i}", old) for i in ("base", "cand", "old", "new", "x", "y")], upkeep.RETAINED["revisions"][0])
    target = spark.createDataFrame([("t", 2, "base")], "id string, scope_version int, baseline_run_id string")
    cand = spark.createDataFrame([("pending", "cand", None, None)], "status string, candidate_run_id string, origin_baseline_run_id string, last_confirmation_run_id string")
    frames_ = {"sources": sources, "cache": cache, "runs": runs, "attempts": attempts, "revisions": revisions}
    want = upkeep.retention(target, cand, runs, attempts, sources, cache, revisions, F.lit(now).cast("timestamp"))
    want = {k: sorted(map(repr, v.select(*frames_[k].columns).collect())) for k, v in want.items()}
    folder = f"file://{tmp_path}/tables"
    upkeep.store_retained(frames_, folder)
    written = [upkeep.retain_stored(spark, folder, target, cand, now, batch) for batch in (1, 1, 2)]
    got = {k: sorted(map(repr, v.collect())) for k, v in upkeep.read_retained(spark, folder).items()}
    assert got == want
    assert written[0] == written[1] and all(len(v) == 1 for v in written[0].values()) and not any(written[2].values())


def test_pages_read_their_ranges(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    df = spark.range(5_000).select((F.col("id") * 7919 % 5_000).alias("k"), F.concat(F.lit("g"), F.col("id") % 3).alias("g"))
    order = [F.col("k")]
    rows = sorted((r.k, r.g) for r in df.collect())
    pages.write_index(df, path, order, range_rows=300)
    for offset in (0, 299, 300, 4_990, 5_000, 150_000):
        page = pages.read_page(spark, path, df.schema, order, 20, offset)
        got = page.collect()
        assert [(r.k, r.g) for r in got] == rows[offset : offset + 20]
        assert all((r.total, r.next_offset) == (5_000, offset + 20 if offset + 20 < 5_000 else None) for r in got)
        assert len(page.inputFiles()) <= 2
    pages.write_index(df, f"{path}-g", [F.col("g"), F.col("k")], "g", range_rows=300)
    own = [r for r in rows if r[1] == "g1"]
    for offset in (0, 1_600, 1_700):
        got = pages.read_page(spark, f"{path}-g", df.schema, order, 100, offset, "g", "g1").collect()
        assert [(r.k, r.g) for r in got] == own[offset : offset + 100] and all(r.total == len(own) for r in got)
    assert pages.read_page(spark, f"{path}-g", df.schema, order, 10, 0, "g", "none").count() == 0
    for limit, offset in ((0, 0), (201, 0), (1, -1), (1, 200_001)):
        with pytest.raises(ValueError, match="limit"):
            pages.read_page(spark, path, df.schema, order, limit, offset)


def test_alerts_of_all_kinds(spark):
    """First snapshots never alert; a page that two targets watch alerts both; scopes keep link alerts back; links keep their order."""
    product = lambda price, page=True: f'{{"is_product_page":{str(page).lower()},"productName":"P","price":{price},"currency":"EUR"}}'
    snaps = [
        ("s1", "w", "SITEMAP", None, '["u/b","u/a"]', 1), ("s2", "w", "SITEMAP", None, '["u/z","u/b","u/c"]', 2), ("s3", "w", "SITEMAP", None, '["u/z","u/b","u/c"]', 3),
        ("m1", "w", "MARKDOWN", "p", "a\nb", 1), ("m2", "w", "MARKDOWN", "p", "a\nc\nc", 2), ("m3", "w", "MARKDOWN", "q", "x", 3),
        ("p1", "w", "PRODUCT", "p", product(9), 1), ("p2", "w", "PRODUCT", "p", product(8.5), 2), ("p3", "w", "PRODUCT", "p", product(7, False), 3), ("p4", "w", "PRODUCT", "p", product(6), 4),
    ]
    snap = spark.createDataFrame(snaps, "id string, websiteId string, kind string, targetUrl string, payload string, taken int").withColumn("hash", F.sha2("payload", 256))
    target = spark.createDataFrame(
        [("l1", "w", "SITEMAP_LINKS", "NEW", None), ("l2", "w", "SITEMAP_LINKS", None, None), ("c1", "w", "PAGE_CONTENT", None, "p"), ("c2", "w", "PAGE_CONTENT", None, "p"), ("d1", "w", "PRODUCT_PRICE", None, "p")],
        "id string, websiteId string, kind string, linkScope string, pageUrl string",
    )
    website = spark.createDataFrame([("w", "w.example.com")], "id string, domain string")
    got = {(r.snapshot_id, r.targetId, r.kind, r.title, r.details) for r in alerts.detect_alerts(snap, target, website).collect()}
    content = '{"pageUrl":"p","diffPreview":"+ c\\n+ c\\n- b","totalAdded":2,"totalRemoved":1}'
    assert got == {
        ("s2", "l1", "NEW_LINK", "2 new links on w.example.com", '{"added":["u/z","u/c"]}'), ("s2", "l2", "NEW_LINK", "2 new links on w.example.com", '{"added":["u/z","u/c"]}'),
        ("s2", "l2", "REMOVED_LINK", "1 link removed from w.example.com", '{"removed":["u/a"]}'),
        ("m2", "c1", "PAGE_CONTENT", "Content changed on p", content), ("m2", "c2", "PAGE_CONTENT", "Content changed on p", content),
        ("p2", "d1", "PRODUCT_PRICE", "Price change: P (EUR 9 → EUR 8.5)", '{"pageUrl":"p","productName":"P","previousPrice":9,"previousCurrency":"EUR","newPrice":8.5,"newCurrency":"EUR"}'),
    }
    assert alerts.detect_alerts(snap.limit(0), target, website).count() == 0


def test_tables_refuse_other_columns(spark, tmp_path):
    path = str(tmp_path / "m")
    spark.createDataFrame([("a", "b", T0)], "ownerUserId string, memberUserId string, createdAt timestamp").write.parquet(path)
    assert tables.read_table(spark, path, "account_membership").count() == 1
    with pytest.raises(ValueError, match="unknown"):
        tables.read_table(spark, path, "competitor_group")


def test_source_graphs(spark):
    chain = lambda run, n, start=0: [(run, f"n{i}", f"n{i + 1}") for i in range(start, start + n)]
    edges = [("d", "n0", "b"), ("d", "n0", "c"), ("d", "b", "c"), ("x", "n0", "b"), ("x", "b", "n0"), ("self", "n0", "n0")]
    # a cycle of three among 26 files
    edges += [("wide", "n0", f"w{i}") for i in range(24)] + [("wide", "w0", "y"), ("wide", "y", "w1"), ("wide", "w1", "w0")]
    # ten levels are allowed, eleven are not, nor is a cycle behind them seen
    edges += chain("ten", 10) + chain("eleven", 11) + chain("behind", 12) + [("behind", "n12", "n11")]
    # near every source, but with one long way
    edges += chain("long", 12) + [("long", "n0", f"n{i}") for i in range(2, 13)]
    edges += [("many", "n0", f"m{i}") for i in range(500)] + [("many", "m0", "n0")]
    edges = spark.createDataFrame(edges, "run_id string, parent string, child string")
    roots = edges.select("run_id", F.lit("n0").alias("source")).distinct()
    depths = scan.source_depths(roots, edges)
    assert {(r.source, r.nearest, r.depth) for r in depths.where("run_id = 'd'").collect()} == {("n0", 0, 0), ("b", 1, 1), ("c", 1, 2)}
    assert {r.run_id: r.error for r in scan.graph_issues(edges, depths).collect()} == {
        "x": "SOURCE_CYCLE", "self": "SOURCE_CYCLE", "wide": "SOURCE_CYCLE", "eleven": "RESOURCE_LIMIT",
        "behind": "RESOURCE_LIMIT", "long": "RESOURCE_LIMIT", "many": "RESOURCE_LIMIT",
    }


def test_pending_candidates_expire_in_event_time(spark, tmp_path):
    rows = [("p", "pending", T0, T0 + HOUR), ("q", "pending", T0, T0 + 100 * DAY), ("a", "adopted", T0, T0 + HOUR)]
    schema = "id string, status string, updated_at timestamp, expires_at timestamp, target_id string, scope_version int"
    for k, part in enumerate((rows, [("z", "adopted", T0 + 2 * DAY, T0 + 3 * DAY)], [("z", "adopted", T0 + 3 * DAY, T0 + 3 * DAY)])):
        part = [(*r, f"t{r[0]}", 1) for r in part]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.file_stream(spark, str(tmp_path / "in"), schema, files=1)
    got = jobs.run_to_table(jobs.stream_candidate_expiry(stream), str(tmp_path / "out")).distinct()
    assert {(r.id, r.status) for r in got.collect()} == {("p", "expired"), ("a", "adopted"), ("z", "adopted")}


def test_rules_read_candidates_that_are_decided_once(spark):
    """q1_check_rules: five rules read the candidates; none of them folds the histories again."""
    from sitedrift import registry

    plan = registry.queries()["q1_check_rules"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan


def test_sites_without_a_list_get_all_destinations_in_all_tasks(spark):
    lists = [None, "not json", "[]", '["d1","d1",null,"d5"]', '["d2","gone"]']
    rows = [(f"w{k}", "u1" if k % 2 else "u0", lists[k % 5]) for k in range(200)]
    website = spark.createDataFrame(rows, "id string, userId string, notificationDestinationIds string").coalesce(1)
    owned = [(f"d{k}", f"u{k % 2}") for k in range(150)]
    destinations = spark.createDataFrame(owned, "id string, userId string")
    found = views.filter_destinations(website, destinations)
    listed = {0: None, 1: None, 2: (), 3: ("d1", "d5"), 4: ("d2", "gone")}
    want = sorted((w, d) for k, (w, u, _) in enumerate(rows) for d, o in owned if o == u and (listed[k % 5] is None or d in listed[k % 5]))
    assert sorted(map(tuple, found.collect())) == want
    # one file of sites is worked on by more than one task
    pairs = found.withColumn("task", F.spark_partition_id())
    assert pairs.groupBy("task").count().where("count > 500").count() > 1


def test_pairs_of_sites_and_destinations_are_small_on_disk(spark, tmp_path, monkeypatch):
    """j13_filter_destinations: a few destinations are repeated for many sites, so files hold much less than a byte for a pair."""
    monkeypatch.setattr(views, "SITE_GROUPS", 4, raising=False)
    website = spark.range(500).selectExpr("concat('w', id) AS id", "cast(id % 5 AS string) AS userId", "cast(NULL AS string) AS notificationDestinationIds")
    destinations = spark.range(20_005).selectExpr("concat('dst_', id) AS id", "cast(id % 5 AS string) AS userId")
    views.filter_destinations(website, destinations).write.parquet(f"{tmp_path}/pairs")
    assert spark.read.parquet(f"{tmp_path}/pairs").distinct().count() == 500 * 4_001
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 500 * 4_001 / 2
