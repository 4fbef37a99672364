"""Queries of candidates, gates, monitor summaries, scan reports, caches, and the keyed streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..bindings import table
from ..functions import payloads as pa
from ..operators import adopt
from ..operators import inventory as inv
from ..operators import snapshots as sn
from ..operators import summaries as su
from ..operators import views as vi
from ..plans import scan, upkeep
from ..sources import buckets
from ..sources import tables as src
from ..streaming import jobs
from ..scratch import fresh_folder as work_folder
from .base import as_stream, query
from .inventory import GAPS
from .scalars import LINES
from .views import CANDIDATES, INV, MOMENT, OPEN, OPEN_AND_LAST, as_of, candidates_of, facts, named, target_of

@query("WITH " + CANDIDATES + f"SELECT id, status FROM cand WHERE {OPEN}")
def f12_open_candidates(spark, sf_dir):
    return vi.open_candidates(candidates_of(spark, sf_dir), as_of()).select("id", "status")


@query(
    "WITH " + CANDIDATES + f"""SELECT id FROM {{target}} WHERE id IN (SELECT target_id FROM cand
WHERE scope_version = 1 AND {OPEN} AND next_confirmation_at <= {MOMENT})"""
)
def f11_due_confirmations(spark, sf_dir):
    return vi.due_confirmations(target_of(spark, sf_dir), candidates_of(spark, sf_dir), as_of()).select("id")


@query(
    "WITH " + CANDIDATES + f"""SELECT c.id, CASE
  WHEN c.status = 'pending' AND (c.scope_version IS DISTINCT FROM t.scope_version OR c.origin_baseline_run_id IS DISTINCT FROM t.baseline_run_id) THEN 'stale'
  WHEN c.status = 'adopted' AND c.scope_version IS DISTINCT FROM t.scope_version THEN 'stale'
  WHEN c.status = 'pending' AND c.expires_at <= {MOMENT} THEN 'expired' ELSE c.status END AS status
FROM cand c LEFT JOIN {{target}} t ON t.id = c.target_id"""
)
def p5_close_candidates(spark, sf_dir):
    out = adopt.close_candidates(candidates_of(spark, sf_dir), target_of(spark, sf_dir), as_of())
    return out.select("id", "status")


@query(
    "WITH " + CANDIDATES + """SELECT c.id FROM cand c JOIN {target} t ON t.id = c.target_id WHERE t.archived_at IS NULL
AND c.scope_version = t.scope_version AND c.origin_baseline_run_id IS NOT DISTINCT FROM t.baseline_run_id"""
)
def f13_fresh_runs(spark, sf_dir):
    return adopt.fresh_runs(candidates_of(spark, sf_dir), target_of(spark, sf_dir)).select("id")


@query(
    """SELECT id, n % 4 IN (0, 1, 3) AS new_links, n % 4 IN (0, 2, 3) AS removed_links FROM {target}"""
)
@named("target")
def f14_link_scope_emits(target):
    k = F.col("n") % 4
    scope = F.when(k == 0, "BOTH").when(k == 1, "NEW").when(k == 2, "REMOVED")
    return target.select(
        "id", vi.link_scope_emits(scope, "new").alias("new_links"), vi.link_scope_emits(scope, "removed").alias("removed_links")
    )


@query(
    INV
    + ", "
    + OPEN_AND_LAST.strip()
    + f""", d1 AS (SELECT website_id, count(*) FILTER (kind = 'added') AS n_added, count(*) FILTER (kind = 'removed') AS n_removed,
  count(*) FILTER (kind = 'reappeared') AS n_reappeared FROM ev WHERE observed_at >= {MOMENT} - INTERVAL 1 DAY GROUP BY 1),
z AS (SELECT concat('t_', target_id) AS target_id, scope_version AS scope FROM {{run}} UNION SELECT id, scope_version FROM {{target}}),
scopes AS (SELECT target_id, string_agg(scope::INT::VARCHAR, ',' ORDER BY scope DESC) AS scopes FROM z GROUP BY 1)
SELECT t.id, t.websiteId, t.scope_version, t.enabled, t.archived_at, t.checkIntervalHours, t.baseline_run_id, t.nextCheckDueAt, t.lastError,
  t.include_path AS include_paths, t.exclude_path AS exclude_paths,
  coalesce(c.total, 0) AS total, coalesce(c.current, 0) AS current, coalesce(c.pending, 0) AS pending,
  coalesce(c.removed, 0) AS removed, coalesce(d1.n_added, 0) AS n_added, coalesce(d1.n_removed, 0) AS n_removed,
  coalesce(d1.n_reappeared, 0) AS n_reappeared, coalesce(o1.n, 0) AS open_candidates, r1.last_success_at, r1.active_run, scopes.scopes
FROM {{target}} t LEFT JOIN c ON c.website_id = t.websiteId LEFT JOIN d1 ON d1.website_id = t.websiteId
LEFT JOIN o1 ON o1.target_id = t.id LEFT JOIN r1 ON r1.target_id = t.id LEFT JOIN scopes ON scopes.target_id = t.id""".replace("{{", "{").replace("}}", "}")
)
def a3_monitor_summaries(spark, sf_dir):
    site_url, events = facts(spark, sf_dir)
    runs = table(spark, sf_dir, "run").withColumn("target_id", F.concat(F.lit("t_"), "target_id"))
    runs = runs.withColumn("scope_version", F.col("scope_version").cast("int"))
    out = su.monitor_summaries(target_of(spark, sf_dir), site_url, events, runs, candidates_of(spark, sf_dir), as_of())
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    lists = ("scopes", "include_paths", "exclude_paths")
    return out.select(*(joined(c) if c in lists else F.col(c) for c in out.columns))


@query("SELECT target_id AS run_id, count(*) AS attempts, count(*) FILTER (execution_status = 'succeeded') AS n_succeeded, count(*) FILTER (execution_status = 'failed') AS n_failed FROM {run} GROUP BY 1")
@named("run")
def a22_attempt_history(run):
    attempts = run.select(F.col("target_id").alias("run_id"), F.col("execution_status").alias("status"))
    return su.attempt_history(attempts, ("succeeded", "failed"))


@query(
    """WITH s AS (SELECT target_id AS run_id, id, execution_status, id::BIGINT % 7 = 0 AS broken, id::BIGINT AS n, o.url_count FROM {run} o)
SELECT run_id, count(*) FILTER (NOT broken AND execution_status = 'succeeded') AS n_fetched,
  count(*) FILTER (NOT broken AND execution_status = 'failed') AS n_not_modified, count(*) FILTER (broken) AS n_failed,
  sum(coalesce(url_count, 0))::BIGINT AS bytes, CASE WHEN count(*) FILTER (broken) = 0 THEN 'complete'
  WHEN count(*) FILTER (NOT broken AND execution_status IN ('succeeded', 'failed')) > 0 THEN 'partial' ELSE 'unusable' END AS completeness,
  arg_min(id, (n % 4) * 1000000000000 + n) FILTER (broken) AS first_issue, bool_and(n % 2 = 0 OR n % 3 = 0) FILTER (broken) AS all_retryable,
  max(CASE WHEN n % 5 > 0 THEN n % 5 * 1000 END)::BIGINT AS retry_after_ms,
  count(DISTINCT n % 100) FILTER (n % 3 <> 0) AS observed, count(DISTINCT n % 100) FILTER (n % 3 = 0) AS out_of_scope FROM s GROUP BY 1"""
)
@named("run")
def a19_scan_report(run):
    n = F.col("id").cast("long")
    broken = n % 7 == 0
    sources = run.select(
        F.col("target_id").alias("run_id"), F.lpad("id", 12, "0").alias("source_url"), (n % 4).alias("depth"),
        F.when(broken, "failed").when(F.col("execution_status") == "succeeded", "fetched")
        .when(F.col("execution_status") == "failed", "not_modified").otherwise("skipped").alias("status"),
        F.col("url_count").alias("bytes"), F.when(broken, F.col("id")).alias("error"), ((n % 2 == 0) | (n % 3 == 0)).alias("retryable"),
        F.when(n % 5 > 0, n % 5 * 1000).alias("retry_after_ms"),
    )
    urls = run.select(F.col("target_id").alias("run_id"), (n % 100).alias("url"), (n % 3 != 0).alias("in_scope"))
    return su.scan_report(sources, urls).withColumn("bytes", F.col("bytes").cast("long"))


@query(
    GAPS
    + """, st AS (SELECT target_id, url, CASE WHEN confirmed_seq IS NOT NULL THEN 'removed' WHEN first_missing_at IS NOT NULL THEN 'pending'
  ELSE 'recovered' END AS r FROM g WHERE next_seq IS NULL),
k AS (SELECT target_id, count(*) FILTER (r = 'pending') AS p, count(*) FILTER (r = 'removed') AS x, count(*) FILTER (r = 'recovered') AS v
  FROM st GROUP BY 1)
SELECT target_id AS candidate_id, p AS pending_count, x AS removed_count, v AS recovered_count,
  CASE WHEN p > 0 THEN 'adopted' WHEN x > 0 THEN 'confirmed' ELSE 'rejected' END AS status FROM k"""
)
def j10_a11_candidate_counts(spark, sf_dir):
    state, _ = inv.replay_url_lifecycle(table(spark, sf_dir, "obs"), table(spark, sf_dir, "runs"))
    held = state.select(F.col("target_id").alias("candidate_id"), "url", "url_hash")
    cand = state.select(F.col("target_id").alias("id"), "target_id", "scope_version").distinct().withColumn("status", F.lit("adopted"))
    out = adopt.candidate_counts(adopt.candidate_resolution(cand, held, state), as_of())
    return out.drop("next_confirmation_at")


@query(
    LINES
    + """, k AS (SELECT id, len(a) AS n_a, len(r) AS n_r, list_transform(a[1:40], lambda x: CASE WHEN length(x) > 160 THEN concat(substr(x, 1, 157), '…') ELSE x END) AS a,
  list_transform(r[1:40], lambda x: CASE WHEN length(x) > 160 THEN concat(substr(x, 1, 157), '…') ELSE x END) AS r FROM d),
w AS (SELECT id, n_a, n_r, concat_ws(chr(10), CASE WHEN n_a > 0 THEN concat('+ ', array_to_string(a, concat(chr(10), '+ '))) END,
  CASE WHEN n_r > 0 THEN concat('- ', array_to_string(r, concat(chr(10), '- '))) END) AS preview FROM k)
SELECT id, sha256(CASE WHEN preview = '' THEN '(no line-level diff available)' ELSE concat('Total lines added: ', n_a, ', removed: ', n_r,
  chr(10), chr(10), preview) END) AS text_hash FROM w"""
)
@named("snap_hashed")
def x11_diff_for_prompt(snap):
    return sn.prompts(snap).select("id", F.sha2("text", 256).alias("text_hash"))


@query(
    """SELECT id AS site, CASE WHEN n % 3 = 0 AND n % 7 <> 0 THEN list_sort(['https://r' || n || '/1.xml', 'https://r' || n || '/2.xml'])
  WHEN n % 3 = 1 AND n % 2 = 0 AND n % 5 <> 0 THEN ['https://c' || n || '/sitemap.xml', 'https://c' || n || '/sitemap_index.xml']
  WHEN n % 3 = 1 THEN ['https://c' || n || '/sitemap.xml'] ELSE [] END AS roots,
  n % 5 <> 0 AND NOT (n % 3 = 0 AND n % 7 = 0) AS complete FROM {target}"""
)
@named("target")
def p13_discover_roots(target):
    """Sites of all kinds by number: roots in robots.txt, some of it HTML; conventional files; failing and absent ones."""
    k, n = F.col("n") % 3, F.col("n").cast("string")
    host = lambda c: F.concat(F.lit(f"https://{c}"), n)
    text = F.concat(F.lit("User-agent: *\nSitemap: "), host("r"), F.lit("/2.xml\n sitemap: "), host("r"), F.lit("/1.xml # old\nsitemap: "), host("r"), F.lit("/3.xml and more"))

    def probe(path, status, body, kind):
        return F.struct(
            F.concat(host("c"), F.lit(path)).alias("url"), status.alias("status"), body.cast("string").alias("body"), kind.cast("string").alias("kind")
        )

    html = F.lit("<!doctype html><p>Sitemap: https://x/")
    robots = probe("/robots.txt", F.when(k == 0, 200).when(F.col("n") % 5 == 0, 503).otherwise(404), F.when(F.col("n") % 7 == 0, html).otherwise(text), F.lit(None))
    usual = probe("/sitemap.xml", F.when(k == 1, 200).otherwise(410), F.lit(None), F.when(k == 1, "urlset"))
    index = probe("/sitemap_index.xml", F.when(F.col("n") % 5 == 0, 500).otherwise(200), F.lit(None), F.when((k == 1) & (F.col("n") % 2 == 0), "index"))
    probes = target.select(F.col("id").alias("site"), F.explode(F.array(robots, usual, index)).alias("p")).select("site", "p.*")
    return scan.discover_roots(probes)


#: The files of every run's graph beside its number and the run before it; each fifth run wasn't scanned.
GRAPHS = """WITH n AS (SELECT *, row_number() OVER w - 1 AS seq, lag(run_id) OVER w AS previous FROM {runs} WINDOW w AS (PARTITION BY target_id ORDER BY observed_at, run_id)),
f AS (SELECT DISTINCT target_id, run_id, concat('https://s', target_id, '/m', ('0x' || substr(url_hash, 1, 4))::BIGINT % 3, '.xml') AS source_url FROM {obs_hashed})
"""


def _graphs(spark, sf_dir):
    obs = table(spark, sf_dir, "obs_hashed")
    shard = F.pmod(F.conv(F.substring("url_hash", 1, 4), 16, 10).cast("int"), F.lit(3))
    files = obs.select("target_id", "run_id", F.concat(F.lit("https://s"), "target_id", F.lit("/m"), shard, F.lit(".xml")).alias("source_url")).distinct()
    w = Window.partitionBy("target_id", "scope_version").orderBy("observed_at", "run_id")
    runs = inv.numbered_runs(table(spark, sf_dir, "runs")).select("target_id", "run_id", "seq", F.lag("run_id").over(w).alias("previous"))
    return files, runs


@query(
    GRAPHS
    + """SELECT n.run_id AS target_id, source_url, n.run_id AS revision_id FROM f JOIN n USING (target_id, run_id) WHERE seq > 0 AND seq % 5 <> 0
UNION ALL SELECT n.run_id, source_url, n.previous FROM f JOIN n ON n.target_id = f.target_id AND n.previous = f.run_id WHERE seq % 5 = 0"""
)
def p14_update_source_cache(spark, sf_dir):
    """Every run's cache after it, from that of the run before: changed files replaced, retired ones gone, those of runs
    that weren't scanned kept."""
    files, runs = _graphs(spark, sf_dir)
    later = runs.where("previous IS NOT NULL")
    columns = lambda run, revision: [
        F.col(run).alias("target_id"), F.lit(1).alias("scope_version"), "source_url", F.col("source_url").alias("final_url"),
        F.lit(None).cast("string").alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.col(revision).alias("revision_id"),
    ]
    before = files.withColumnRenamed("run_id", "previous").join(later, ["target_id", "previous"])
    cache = before.select(*columns("run_id", "previous"))
    fetched = files.join(later.where("seq % 5 <> 0"), ["target_id", "run_id"]).select(*columns("run_id", "run_id"))
    live = fetched.select("target_id", "scope_version", "source_url")
    return scan.update_source_cache(cache, fetched, live, live.limit(0)).select("target_id", "source_url", "revision_id")


@query(
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY observed_at, run_id) - 1 AS seq FROM {runs}),
s AS (SELECT run_id, seq, list_sort(list(url)) AS u FROM n JOIN {obs} USING (target_id, run_id) GROUP BY ALL)
SELECT run_id AS target_id, CASE WHEN NOT bad THEN 'urlset' END AS kind, CASE WHEN NOT bad THEN array_to_string(u, ' ') END AS locations,
  CASE WHEN bad THEN 'INVALID_304' END AS error FROM (SELECT *, seq % 3 = 0 OR seq % 4 = 1 OR seq % 5 = 2 AS bad FROM s)"""
)
def j17_resolve_not_modified(spark, sf_dir):
    """Every run's URLs as a cached file that hasn't changed: some were fetched from elsewhere, some revisions are missing,
    and some aren't what their hash says."""
    runs = inv.numbered_runs(table(spark, sf_dir, "runs")).select("run_id", "seq")
    sets = table(spark, sf_dir, "obs").groupBy("run_id").agg(F.array_sort(F.collect_list("url")).alias("locations")).join(runs, "run_id")
    # sizes of their own, so that no two runs share a revision
    size, kind, seq = F.crc32("run_id"), F.lit("urlset"), F.col("seq")
    rows = sets.select(
        F.col("run_id").alias("target_id"), F.lit(1).alias("scope_version"), F.lit("https://x/s.xml").alias("source_url"), "seq", "locations",
        kind.alias("kind"), size.alias("body_bytes"), pa.revision_id(kind, F.col("locations"), size).alias("revision_id"),
    )
    key = ["target_id", "scope_version", "source_url"]
    files = rows.select(*key, F.lit("https://x/s.xml").alias("final_url"))
    cache = rows.select(*key, F.when(seq % 3 == 0, "https://elsewhere/").otherwise("https://x/s.xml").alias("final_url"), "revision_id")
    revisions = rows.where(seq % 4 != 1).select(
        F.col("revision_id").alias("id"), "kind", F.when(seq % 5 == 2, F.concat("locations", F.array(F.lit("https://x/more")))).otherwise(F.col("locations")).alias("locations"),
        "body_bytes",
    ).dropDuplicates(["id"])
    out = scan.resolve_not_modified(files, cache, revisions)
    return out.select("target_id", "kind", F.array_join("locations", " ").alias("locations"), "error")


@query(INV + "SELECT id, website_id, kind, observed_at, strftime(observed_at, '%Y-%m-%d') AS observed_date FROM ev0")
def s4_write_events(spark, sf_dir):
    """Events written twice, in overlapping parts, are there once."""
    events = facts(spark, sf_dir)[1]
    path = f"{work_folder(spark, 's4')}/events"
    src.write_events(events.where("kind <> 'added'"), path)
    src.write_events(events, path)
    return spark.read.parquet(path).select("id", "website_id", "kind", "observed_at", F.col("observed_date").cast("string"))


@query("SELECT id, n % 4 AS version FROM {target}")
def s5_write_state(spark, sf_dir):
    """Of several published versions the reader gets the last."""
    rows, path = table(spark, sf_dir, "target").select("id", (F.col("n") % 4).alias("version")), f"{work_folder(spark, 's5')}/state"
    for batch in (0, 1, 1):
        src.write_state(rows if batch else rows.withColumn("version", F.lit(-1).cast("long")), path, batch)
    return src.read_state(spark, path)


@query("SELECT id, n, CASE WHEN n % 7 = 3 THEN 'changed' ELSE 'kept' END AS state FROM {target} WHERE n % 7 <> 5")
def s5_state_in_buckets(spark, sf_dir):
    """A table in buckets by n % 7: batches change one bucket, empty another, and come again."""
    rows, path = table(spark, sf_dir, "target").select("id", "n", F.lit("kept").alias("state")), f"{work_folder(spark, 's5')}/state"
    bucket = (F.col("n") % 7).cast("int")
    buckets.write_buckets(rows, path, bucket, 0, list(range(7)))
    for batch in (1, 1):
        old = buckets.read_buckets(spark, path, rows.schema, [3, 5], batch)
        buckets.write_buckets(old.where(bucket == 3).withColumn("state", F.lit("changed")), path, bucket, batch, [3, 5])
    return buckets.read_buckets(spark, path, rows.schema)


@query("SELECT DISTINCT run_id AS id FROM {obs}")
def s6_append_revisions(spark, sf_dir):
    runs = table(spark, sf_dir, "runs").select(F.col("run_id").alias("id"))
    path = f"{work_folder(spark, 's6')}/revisions"
    src.append_revisions(runs.where(F.length("id") % 2 == 0), path)
    src.append_revisions(runs, path)
    return spark.read.parquet(path)


@query(GAPS + "SELECT e.website_id, url, kind, n.run_id FROM events e JOIN n ON n.target_id = e.target_id AND n.seq = e.at")
def r2_stream_url_lifecycle(spark, sf_dir):
    """Observations as they are, each run with a row for its end: absences are found by the stream."""
    columns = ("website_id", "scope_version", "run_id", "observed_at", "url", "url_hash")
    obs, none = table(spark, sf_dir, "obs_hashed").select(*columns), F.lit(None).cast("string")
    ends = table(spark, sf_dir, "runs").select(*columns[:4], none.alias("url"), none.alias("url_hash"))
    stream, folder = as_stream(obs.unionByName(ends), spark, "r2", ["website_id"], F.unix_seconds("observed_at"))
    out = jobs.run_to_table(jobs.stream_url_lifecycle(stream, buckets=4), folder, provider=jobs.ROCKSDB)
    return out.select("website_id", "url", "kind", "run_id")
