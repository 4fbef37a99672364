"""Queries of operators.views and operators.summaries over the catalogue bindings."""

from __future__ import annotations

import functools
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..bindings import table
from ..operators import inventory as inv
from ..operators import pages
from ..operators import summaries as su
from ..operators import views as vi
from ..scratch import fresh_folder, kept
from .base import query
from .inventory import GAPS

AS_OF = "1997-06-01 00:00:00"
MOMENT = f"TIMESTAMP '{AS_OF}'"
DAYS = 400
INV = (
    GAPS
    + f""", s0 AS (SELECT concat('web_', website_id) AS website_id, url,
  CASE WHEN confirmed_seq IS NOT NULL THEN 'removed' WHEN first_missing_at IS NOT NULL THEN 'pending_removed' ELSE 'active' END AS status
  FROM g WHERE next_seq IS NULL),
ev0 AS (SELECT concat('web_', e.website_id) AS website_id, e.url, e.kind, n.observed_at, concat(n.run_id, ':', e.url_hash, ':', e.kind) AS id
  FROM events e JOIN n ON n.target_id = e.target_id AND n.seq = e.at),
s AS (SELECT s0.*, regexp_replace(split_part(url, '?', 1), '^[a-z]+://[^/]+', '') AS path, t.* FROM s0 JOIN {{target}} t ON t.websiteId = s0.website_id),
v AS (SELECT * FROM s WHERE (include_path = '' OR starts_with(path, include_path)) AND NOT (exclude_path <> '' AND starts_with(path, exclude_path))),
ev AS (SELECT ev0.*, include_path, exclude_path FROM ev0 JOIN {{target}} t ON t.websiteId = ev0.website_id
  WHERE (include_path = '' OR starts_with(regexp_replace(url, '^[a-z]+://[^/]+', ''), include_path))
    AND NOT (exclude_path <> '' AND starts_with(regexp_replace(url, '^[a-z]+://[^/]+', ''), exclude_path))),
c AS (SELECT website_id, count(*) AS total, count(*) FILTER (status <> 'removed') AS current,
  count(*) FILTER (status = 'pending_removed') AS pending, count(*) FILTER (status = 'removed') AS removed FROM v GROUP BY 1),
d AS (SELECT website_id, count(*) FILTER (kind = 'added') AS n_added, count(*) FILTER (kind = 'removed') AS n_removed,
  count(*) FILTER (kind = 'reappeared') AS n_reappeared FROM ev
  WHERE observed_at BETWEEN {MOMENT} - INTERVAL {DAYS} DAY AND {MOMENT} GROUP BY 1)
"""
).replace("{{", "{").replace("}}", "}")


def target_of(spark, sf_dir):
    rule = lambda c: F.when(F.col(c) != "", F.array(c)).otherwise(F.array().cast("array<string>"))
    t = table(spark, sf_dir, "target")
    return t.withColumns({"include_paths": rule("include_path"), "exclude_paths": rule("exclude_path")})


def facts(spark, sf_dir):
    """site_url and url_event of the catalogue's websites, replayed and written once for an application and its tables.

    Views and summaries read what a scan left behind, they don't replay it: events lie in order of time, so a window
    reaches the scan as a filter and skips most of each file, and each view reads only its columns.
    """

    def write(folder):
        inv.write_lifecycle(table(spark, sf_dir, "obs"), table(spark, sf_dir, "runs"), folder)

    folder = kept(spark, "inventory", [f"{sf_dir}/lineitem.parquet"], write)
    state, events = (df.withColumn("website_id", F.concat(F.lit("web_"), "website_id")) for df in inv.read_lifecycle(spark, folder))
    return state.withColumnRenamed("url_hash", "normalized_url_hash"), events


def as_of():
    return F.lit(AS_OF).cast("timestamp")


def named(*names):
    """Passes the bindings of these names."""

    def wrap(f):
        @functools.wraps(f)
        def run(spark, sf_dir):
            return f(*(target_of(spark, sf_dir) if n == "target" else table(spark, sf_dir, n) for n in names))

        return run

    return wrap


@query(INV + "SELECT website_id, url, status FROM v WHERE status = 'removed' AND contains(lower(url), '/p/1')")
def f4_inventory_view(spark, sf_dir):
    rows = vi.inventory_view(facts(spark, sf_dir)[0], target_of(spark, sf_dir), status="removed", q="/P/1")
    return rows.select("website_id", "url", "status")


@query(INV + "SELECT website_id, url, kind, id FROM ev WHERE kind = 'reappeared'")
def f5_event_view(spark, sf_dir):
    rows = vi.event_view(facts(spark, sf_dir)[1], target_of(spark, sf_dir), kind="reappeared")
    return rows.select("website_id", "url", "kind", "id")


@query(INV + f"SELECT id, kind FROM ev0 WHERE observed_at BETWEEN {MOMENT} - INTERVAL 60 DAY AND {MOMENT}")
def j8_events_in_window(spark, sf_dir):
    return vi.events_in_window(facts(spark, sf_dir)[1], as_of(), 60).select("id", "kind")


@query(INV + "SELECT * FROM c")
def a1_inventory_counts(spark, sf_dir):
    return su.inventory_counts(target_of(spark, sf_dir), facts(spark, sf_dir)[0])


@query(INV + "SELECT * FROM d")
def a2_event_counts(spark, sf_dir):
    return su.event_counts(target_of(spark, sf_dir), facts(spark, sf_dir)[1], as_of(), DAYS)


#: Candidates made of runs: one each, by number.
CANDIDATES = """
cand AS (SELECT id, concat('t_', target_id) AS target_id, 1 + id::BIGINT % 2 AS scope_version,
  CASE id::BIGINT % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'adopted' ELSE 'confirmed' END AS status, observed_at,
  observed_at + to_days((id::BIGINT % 400)::INT) AS expires_at, observed_at + to_hours((id::BIGINT % 30)::BIGINT) AS next_confirmation_at,
  CASE WHEN id::BIGINT % 5 <> 0 THEN concat('t_', target_id, '-base') END AS origin_baseline_run_id FROM {run})
"""


def candidates_of(spark, sf_dir):
    n, at = F.col("id").cast("long"), F.col("observed_at").cast("timestamp")
    status = F.when(n % 3 == 0, "pending").when(n % 3 == 1, "adopted").otherwise("confirmed")
    target = F.concat(F.lit("t_"), "target_id")
    return table(spark, sf_dir, "run").select(
        "id", target.alias("target_id"), (n % 2 + 1).cast("int").alias("scope_version"), status.alias("status"),
        at.alias("observed_at"), F.timestamp_seconds(F.unix_seconds(at) + n % 400 * 86400).alias("expires_at"),
        F.timestamp_seconds(F.unix_seconds(at) + n % 30 * 3600).alias("next_confirmation_at"),
        F.when(n % 5 != 0, F.concat(target, F.lit("-base"))).alias("origin_baseline_run_id"),
    )


OPEN = f"(status = 'adopted' OR (status = 'pending' AND expires_at > {MOMENT}))"
#: Open candidates and the last success of each monitor at its scope, and its active run.
OPEN_AND_LAST = (
    CANDIDATES
    + f""", o1 AS (SELECT target_id, count(*) AS n FROM cand WHERE scope_version = 1 AND {OPEN} GROUP BY 1),
r1 AS (SELECT concat('t_', target_id) AS target_id, max(observed_at) FILTER (scope_version = 1 AND execution_status = 'succeeded'
  AND completeness = 'complete') AS last_success_at, max(execution_status) FILTER (execution_status IN ('queued', 'running')) AS active_run FROM {{run}} GROUP BY 1)
"""
)


GROUP_ROWS = (
    INV
    + ", "
    + OPEN_AND_LAST.strip()
    + """, gw AS (SELECT g2.id AS group_id, w.id, w.name, w.domain, t.id AS target_id, t.archived_at, r1.last_success_at, coalesce(o1.n, 0) AS open_candidates,
  CASE WHEN t.id IS NULL THEN 'No monitor' WHEN t.archived_at IS NOT NULL THEN 'Archived' WHEN NOT t.enabled THEN 'Paused'
    WHEN r1.active_run IS NOT NULL THEN r1.active_run WHEN t.lastError IS NOT NULL THEN 'failed'
    WHEN t.baseline_run_id IS NULL THEN 'Awaiting baseline' ELSE 'active' END AS status,
  t.baseline_run_id IS NOT NULL AS has_baseline, coalesce(c.current, 0) AS current, coalesce(c.pending, 0) AS pending,
  coalesce(c.removed, 0) AS removed, coalesce(d.n_added, 0) AS n_added, coalesce(d.n_removed, 0) AS n_removed,
  coalesce(d.n_reappeared, 0) AS n_reappeared
  FROM {groups} g2 JOIN {website} w ON w.competitor_group_id = g2.id AND w.userId = g2.owner_user_id
  LEFT JOIN {target} t ON t.websiteId = w.id LEFT JOIN r1 ON r1.target_id = t.id LEFT JOIN o1 ON o1.target_id = t.id
  LEFT JOIN c ON c.website_id = w.id LEFT JOIN d ON d.website_id = w.id)
"""
)


def _group_rows(spark, sf_dir):
    site_url, events = facts(spark, sf_dir)
    get = lambda n: table(spark, sf_dir, n)
    runs = get("run").withColumn("target_id", F.concat(F.lit("t_"), "target_id"))
    return su.group_websites(
        get("groups"), get("website"), target_of(spark, sf_dir), site_url, events, runs, candidates_of(spark, sf_dir), as_of(), DAYS, True
    )


@query(GROUP_ROWS + "SELECT * FROM gw")
def a6_group_websites(spark, sf_dir):
    return _group_rows(spark, sf_dir)


@query(
    GROUP_ROWS
    + """SELECT g2.id AS group_id, any_value(g2.name) AS group_name, count(gw.id) AS websites,
  count(*) FILTER (has_baseline) AS baseline_websites, (sum(current) FILTER (has_baseline))::BIGINT AS current,
  coalesce(sum(pending) FILTER (has_baseline), 0)::BIGINT AS pending, coalesce(sum(removed) FILTER (has_baseline), 0)::BIGINT AS removed,
  coalesce(sum(n_added), 0)::BIGINT AS n_added, coalesce(sum(n_removed), 0)::BIGINT AS n_removed,
  coalesce(sum(n_reappeared), 0)::BIGINT AS n_reappeared, coalesce(sum(open_candidates), 0)::BIGINT AS open_candidates,
  max(last_success_at) AS latest_scan_at
FROM {groups} g2 LEFT JOIN gw ON gw.group_id = g2.id GROUP BY g2.id"""
)
def a7_group_overviews(spark, sf_dir):
    return su.group_overviews(table(spark, sf_dir, "groups"), _group_rows(spark, sf_dir))


@query(GROUP_ROWS + "SELECT group_id, status, count(*) AS n FROM gw GROUP BY ALL")
def a8_status_counts(spark, sf_dir):
    maps = su.status_counts(_group_rows(spark, sf_dir))
    return maps.select("group_id", F.explode("status_counts").alias("status", "n"))


@query(
    GROUP_ROWS
    + "SELECT group_id, id, row_number() OVER (PARTITION BY group_id ORDER BY n_added + n_removed + n_reappeared DESC, id)::INT AS rank FROM gw"
)
def w6_rank_websites(spark, sf_dir):
    return su.rank_websites(_group_rows(spark, sf_dir)).select("group_id", "id", "rank")


@query(
    GROUP_ROWS
    + f"""SELECT w.competitor_group_id AS group_id, ev.website_id, ev.id, ev.kind FROM ev JOIN {{website}} w ON w.id = ev.website_id
JOIN {{groups}} g2 ON w.competitor_group_id = g2.id AND w.userId = g2.owner_user_id
WHERE observed_at BETWEEN {MOMENT} - INTERVAL {DAYS} DAY AND {MOMENT} AND (observed_at, ev.id) < (TIMESTAMP '1997-04-01', '9')
ORDER BY observed_at DESC, ev.id DESC LIMIT 51"""
)
def p11_group_event_feed(spark, sf_dir):
    import datetime

    get = lambda n: table(spark, sf_dir, n)
    page = vi.group_event_feed(
        get("groups"), get("website"), target_of(spark, sf_dir), facts(spark, sf_dir)[1], as_of(), DAYS, 50,
        before=(datetime.datetime(1997, 4, 1), "9"),
    )
    return page.select("group_id", "website_id", "id", "kind")


@query("SELECT w.id, t.id AS t_id FROM {website} w LEFT JOIN {target} t ON t.websiteId = w.id")
@named("website", "target")
def j1_website_monitors(website, target):
    return vi.website_monitors(website, target).select("id", "t_id")


@query(
    """SELECT w.id, v.viewer FROM {website} w JOIN (SELECT userId AS o, userId AS viewer FROM {website}
UNION SELECT ownerUserId, memberUserId FROM {membership}) v ON v.o = w.userId"""
)
@named("website", "membership")
def j2_visible_to(website, membership):
    return vi.visible_to(website.select("id", "userId"), "userId", membership).select("id", "viewer")


@query("SELECT g.id AS group_id, w.id FROM {groups} g JOIN {website} w ON w.competitor_group_id = g.id AND w.userId = g.owner_user_id")
@named("groups", "website")
def j3_group_members(groups, website):
    return vi.group_members(groups, website).select("group_id", "id")


@query(
    """SELECT w.id FROM {website} w LEFT JOIN {target} t ON t.websiteId = w.id
WHERE t.archived_at IS NULL AND w.competitor_group_id IS NULL AND contains(lower(concat(w.name, ' ', w.domain)), '5')"""
)
@named("website", "target")
def f9_website_list(website, target):
    return vi.website_list(website, target, "ungrouped", "5").select("id")


@query(
    "SELECT id FROM {target} WHERE enabled AND archived_at IS NULL AND (nextCheckDueAt IS NULL OR nextCheckDueAt <= TIMESTAMP '2024-01-01')"
)
@named("target")
def f10_due_targets(target):
    return vi.due_targets(target, F.lit("2024-01-01").cast("timestamp")).select("id")


@query(
    """SELECT id FROM {target} WHERE enabled AND archived_at IS NULL AND (nextCheckDueAt IS NULL OR nextCheckDueAt <= TIMESTAMP '2024-01-01')
ORDER BY nextCheckDueAt NULLS FIRST, id LIMIT 100"""
)
@named("target")
def t5_due_order(target):
    return vi.due_order(vi.due_targets(target, F.lit("2024-01-01").cast("timestamp"))).select("id")


@query("SELECT id, target_id FROM {run} WHERE execution_status IN ('queued', 'running')")
@named("run")
def a5_active_run(runs):
    live = su.active_run(runs)
    queued = F.col("execution_status").isin("queued", "running")
    return runs.where(queued).join(live, "target_id").select("id", "target_id")


@query(
    """SELECT target_id, scope_version, max(observed_at) AS last_success_at FROM {run}
WHERE execution_status = 'succeeded' AND completeness = 'complete' GROUP BY ALL"""
)
@named("run")
def a4_last_success(runs):
    return su.last_success(runs)


@query(
    """SELECT target_id, list_sort(list(DISTINCT scope_version), 'DESC') AS scopes FROM (SELECT concat('t_', target_id) AS target_id,
scope_version FROM {run} UNION ALL SELECT id, 1 FROM {target}) GROUP BY 1"""
)
@named("target", "run")
def a16_scopes_of_target(target, runs):
    runs = runs.withColumn("target_id", F.concat(F.lit("t_"), "target_id"))
    return su.scopes_of_target(target, runs.withColumn("scope_version", F.col("scope_version").cast("int"))).select(
        "target_id", F.transform("scopes", lambda x: x.cast("long")).alias("scopes")
    )


@query("SELECT target_id, trigger_kind, execution_status, count(*) AS n FROM {run} GROUP BY CUBE (1, 2, 3)")
@named("run")
def a18_run_status_histogram(runs):
    return su.run_status_histogram(runs)


@query("SELECT id, scope_version, url_count::BIGINT AS url_count FROM {run} WHERE scope_version = 2")
@named("run")
def a17_run_listing(runs):
    urls = F.when(
        F.col("url_count").isNotNull(),
        F.transform(F.sequence(F.lit(1), F.greatest("url_count", F.lit(1))), lambda i: F.concat(F.lit("u"), i)),
    )
    urls = F.when(F.col("url_count") == 0, F.array().cast("array<string>")).otherwise(urls)
    result = F.when(urls.isNotNull(), F.to_json(F.struct(urls.alias("urls"))))
    listed = su.run_listing(runs.withColumn("result", result).drop("url_count"), 2)
    return listed.select("id", "scope_version", F.col("url_count").cast("long").alias("url_count"))


@query(
    """SELECT w.userId, count(t.id) AS in_use, count(t.id) + 1 <= 150 AS allowed FROM {website} w
LEFT JOIN (SELECT * FROM {target} WHERE enabled AND archived_at IS NULL) t ON t.websiteId = w.id GROUP BY 1"""
)
@named("target", "website")
def a10_monitor_quota(target, website):
    return su.monitor_quota(target, website, 150)


@query(
    """SELECT w.id AS websiteId, count(a.id) AS unread FROM {website} w LEFT JOIN (SELECT * FROM {alert} WHERE NOT is_read) a
ON a.websiteId = w.id GROUP BY 1"""
)
@named("alert", "website")
def a9_unread_counts(alert, website):
    return su.unread_counts(alert, website)


@query(
    """WITH a AS (SELECT websiteId, count(*) FILTER (NOT is_read) AS unread FROM {alert} GROUP BY 1)
SELECT t.websiteId, max(nextCheckDueAt) AS last_at, count(*) FILTER (enabled) AS n_enabled, coalesce(any_value(a.unread), 0) AS unread,
  CASE WHEN coalesce(any_value(a.unread), 0) > 0 THEN 'changes' WHEN count(*) FILTER (enabled) = 0 THEN 'paused' ELSE 'quiet' END AS label
FROM {target} t LEFT JOIN a USING (websiteId) GROUP BY 1"""
)
@named("target", "alert")
def a21_website_chip(target, alert):
    return su.website_chip(target, alert)


@query(
    """SELECT a.id, w.name AS website_name FROM {alert} a JOIN {website} w ON w.id = a.websiteId
ORDER BY a.createdAt DESC, a.id DESC LIMIT 100"""
)
@named("alert", "website")
def t3_latest_alerts(alert, website):
    return vi.latest_alerts(alert, website).select("id", "website_name")


@query(
    """WITH s AS (SELECT *, row_number() OVER (PARTITION BY websiteId ORDER BY createdAt DESC, id DESC) AS k FROM {alert}),
r AS (SELECT id, targetId, row_number() OVER (PARTITION BY websiteId, targetId ORDER BY createdAt DESC, id DESC)::INT AS rank
  FROM s WHERE k <= 100) SELECT * FROM r WHERE rank <= 4"""
)
@named("alert")
def w7_recent_alerts_per_target(alert):
    return vi.recent_alerts_per_target(alert, 4).select("id", "targetId", "rank")


@query(
    """WITH g AS (SELECT id, name FROM {groups} WHERE contains(lower(name), 'a'))
SELECT id, name, (SELECT count(*) FROM g) AS total, CASE WHEN (SELECT count(*) FROM g) > 13 THEN 13 END::INT AS next_offset FROM g ORDER BY name, id LIMIT 10 OFFSET 3"""
)
@named("groups")
def t4_group_listing(groups):
    return vi.group_listing(groups, "A", 10, 3).select("id", "name", "total", "next_offset")


#: Offsets of the pages of fifty that are read: the first, one in between, and deep ones that some tables don't reach.
OFFSETS = (0, 100, 1_150, 11_930, 199_800)


@query(
    INV
    + f""", o AS (SELECT website_id, url, status, row_number() OVER (ORDER BY sha256(url), website_id) - 1 AS k, count(*) OVER () AS total FROM s0)
SELECT page, website_id, url, status, total, CASE WHEN total > page + 50 THEN page + 50 END::INT AS next_offset
FROM o JOIN (SELECT unnest({list(OFFSETS)})::INT AS page) ON k >= page AND k < page + 50"""
)
def t1_page_offset(spark, sf_dir):
    """Pages of the whole inventory in order of hash, each from the ranges it lies in."""
    path, order = fresh_folder(spark, "t1"), [F.col("normalized_url_hash"), F.col("website_id")]
    rows = facts(spark, sf_dir)[0].select("website_id", "url", "status", "normalized_url_hash")
    pages.write_index(rows, path, order, range_rows=500)
    read = lambda k: pages.read_page(spark, path, rows.schema, order, 50, k).withColumn("page", F.lit(k))
    return reduce(DataFrame.unionByName, map(read, OFFSETS)).drop("normalized_url_hash")


@query(INV + "SELECT id, kind FROM ev0 WHERE (observed_at, id) < (TIMESTAMP '1996-01-01', '9') ORDER BY observed_at DESC, id DESC LIMIT 101")
def t2_page_keyset(spark, sf_dir):
    import datetime

    return vi.page_keyset(facts(spark, sf_dir)[1], 100, (datetime.datetime(1996, 1, 1), "9")).select("id", "kind")


@query(
    """SELECT w.id AS website_id, d.id AS destination_id FROM {website} w JOIN {destination} d ON d.userId = w.userId
WHERE coalesce(notificationDestinationIds, 'x') IN ('x', 'not json') OR contains(notificationDestinationIds, concat('"', d.id, '"'))"""
)
@named("website", "destination")
def j13_filter_destinations(website, destination):
    return vi.filter_destinations(website, destination)


ROUTED = """
routed AS (SELECT a.*, d.id AS destination_id, d.channel, w.domain FROM {alert} a JOIN {target} t ON t.id = a.targetId AND t.externalNotify
  JOIN {website} w ON w.id = a.websiteId JOIN {destination} d ON d.id = t.notificationDestinationId AND d.userId = w.userId
  WHERE NOT a.suppressed)
"""


@query("WITH " + ROUTED + "SELECT id, destination_id, channel FROM routed")
@named("alert", "target", "website", "destination")
def j12_route_alerts(alert, target, website, destination):
    return vi.route_alerts(alert, target, website, destination).select("id", "destination_id", "channel")


@query(
    """SELECT g.id AS group_id, sha256(concat_ws(';', g.membership_version::VARCHAR, string_agg(concat_ws('|', w.domain,
  coalesce(w.notificationDestinationIds, '')), ';' ORDER BY w.id))) AS fingerprint
FROM {groups} g JOIN {website} w ON w.competitor_group_id = g.id AND w.userId = g.owner_user_id GROUP BY g.id, g.membership_version"""
)
@named("groups", "website")
def a15_config_fingerprint(groups, website):
    return su.config_fingerprint(groups, vi.group_members(groups, website), ["domain", "notificationDestinationIds"])


@query(
    """SELECT page, min(createdAt) AS first_at, max(createdAt) AS last_at, min(price) AS min_price, max(price) AS max_price,
  count(*) AS points, count(DISTINCT currency) AS currencies,
  CASE count(DISTINCT currency) WHEN 0 THEN 'none' WHEN 1 THEN 'single' ELSE 'mixed' END AS currency_class
FROM {price} WHERE is_product_page AND price IS NOT NULL GROUP BY 1"""
)
@named("price")
def a20_price_extents(price):
    from ..operators.snapshots import plottable_points

    return su.price_extents(plottable_points(price))


@query(
    """SELECT id FROM {run} r WHERE NOT EXISTS (SELECT 1 FROM {run} b WHERE b.adoption_status = 'baseline' AND b.id = r.id)
AND id NOT IN (SELECT id FROM {run} WHERE execution_status = 'queued')"""
)
@named("run")
def j14_unreferenced(run):
    used = [run.where("adoption_status = 'baseline'").select("id"), run.where("execution_status = 'queued'").select("id")]
    return vi.unreferenced(run, "id", used).select("id")
