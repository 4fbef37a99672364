"""Filtered, joined and paged views of inventories, events, runs, candidates and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.urls import contains_text, host_of, path_filter
from ..scratch import partitions
from .pages import checked, read_page, write_index

SITEMAP = "SITEMAP_LINKS"


def website_monitors(website: DataFrame, target: DataFrame) -> DataFrame:
    """Each website with its sitemap monitor, if it has one (columns prefixed t_)."""
    t = target.where(F.col("kind") == SITEMAP)
    t = t.select(*(F.col(c).alias(f"t_{c}") for c in t.columns))
    return website.join(t, F.col("id") == F.col("t_websiteId"), "left")


def visible_to(df: DataFrame, owner: str, memberships: DataFrame) -> DataFrame:
    """All (viewer, row) pairs: owners see their rows, members those of the owner."""
    owners = df.select(F.col(owner).alias("_owner"), F.col(owner).alias("viewer")).distinct()
    members = memberships.select(F.col("ownerUserId").alias("_owner"), F.col("memberUserId").alias("viewer"))
    pairs = owners.unionAll(members).distinct()
    return df.join(pairs, df[owner] == pairs["_owner"]).drop("_owner")


def group_members(groups: DataFrame, website: DataFrame) -> DataFrame:
    """(group_id, website columns) of the websites of a group that have its owner."""
    g = groups.select(F.col("id").alias("group_id"), F.col("owner_user_id").alias("_owner"))
    return website.join(
        g, (website["competitor_group_id"] == g["group_id"]) & (website["userId"] == g["_owner"])
    ).drop("_owner")


def website_list(
    website: DataFrame, target: DataFrame, group: str | None = None, search: str = "", show_archived: bool = False
) -> DataFrame:
    """Websites with their monitor's state. group: None for all, 'ungrouped', or an id."""
    out = website_monitors(website, target)
    if not show_archived:
        out = out.where(F.col("t_archived_at").isNull())
    if group == "ungrouped":
        out = out.where(F.col("competitor_group_id").isNull())
    elif group is not None:
        out = out.where(F.col("competitor_group_id") == group)
    return out.where(contains_text(F.concat("name", F.lit(" "), "domain"), search))


def _of_scope(df: DataFrame, target: DataFrame, scope: int | None) -> DataFrame:
    t = target.select(
        F.col("websiteId").alias("website_id"), F.lit(scope).cast("int").alias("scope_version") if scope else F.col("scope_version"),
        "include_paths", "exclude_paths",
    )
    joined = df.join(t, ["website_id", "scope_version"])
    return joined.where(path_filter(F.col("url"), F.col("include_paths"), F.col("exclude_paths"))).drop(
        "include_paths", "exclude_paths"
    )


def inventory_view(
    site_url: DataFrame, target: DataFrame, status: str | None = None, q: str = "", scope: int | None = None
) -> DataFrame:
    """URLs at the target's current scope (or the given one) that its path rules and the search let through."""
    rows = site_url.where(F.col("status") == status) if status else site_url
    return _of_scope(rows.where(contains_text(F.col("url"), q)), target, scope)


def event_view(
    events: DataFrame, target: DataFrame, kind: str | None = None, q: str = "", scope: int | None = None
) -> DataFrame:
    rows = events.where(F.col("kind") == kind) if kind else events
    return _of_scope(rows.where(contains_text(F.col("url"), q)), target, scope)


def split_in_scope(urls: DataFrame, hosts: Column, url: str = "url") -> DataFrame:
    """Adds in_scope: the URL's host is one of hosts."""
    return urls.withColumn("in_scope", F.coalesce(F.array_contains(hosts, host_of(F.col(url))), F.lit(False)))


def due_targets(target: DataFrame, now: Column) -> DataFrame:
    due = F.col("nextCheckDueAt").isNull() | (F.col("nextCheckDueAt") <= now)
    return target.where((F.col("kind") == SITEMAP) & F.col("enabled") & F.col("archived_at").isNull() & due)


def due_order(due: DataFrame, n: int = 100) -> DataFrame:
    """The n most urgent: never checked first, then the earliest due, ties by id."""
    return due.orderBy(F.col("nextCheckDueAt").asc_nulls_first(), "id").limit(n)


def open_candidates(candidates: DataFrame, now: Column) -> DataFrame:
    return candidates.where(
        F.col("status").isin("pending", "adopted") & ((F.col("status") == "adopted") | (F.col("expires_at") > now))
    )


def due_confirmations(target: DataFrame, candidates: DataFrame, now: Column) -> DataFrame:
    """Distinct targets with an open candidate at their scope whose next confirmation is due."""
    live = open_candidates(candidates, now).where(F.col("next_confirmation_at") <= now)
    keys = live.select(F.col("target_id").alias("id"), "scope_version").distinct()
    return target.join(keys, ["id", "scope_version"], "left_semi")


def link_scope_emits(scope: Column, variant: str) -> Column:
    return F.coalesce(scope, F.lit("BOTH")).isin("BOTH", variant.upper())


def events_in_window(events: DataFrame, as_of: Column, days: int, upper: bool = True) -> DataFrame:
    """Events of the days before as_of, both ends included; without upper, later ones too."""
    at = F.col("observed_at")
    inside = at >= as_of - F.expr(f"INTERVAL {days} DAYS")
    return events.where(inside & (at <= as_of) if upper else inside)


def page_offset(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows offset .. offset + limit in this order, with total and next_offset (null on the last page), of a small table or the
    result of a filter: it sorts up to the page's end and counts all. Large tables are paged by pages.read_page."""
    checked(limit, offset)
    page = df.orderBy(*order).offset(offset).limit(limit)
    n = df.agg(F.count(F.lit(1)).alias("total"))
    n = n.withColumn("next_offset", F.when(F.col("total") > offset + limit, F.lit(offset + limit)).cast("int"))
    # one row
    return page.crossJoin(F.broadcast(n))


def write_candidate_urls(missing: DataFrame, path: str) -> None:
    """The missing URLs of all candidates (candidate_id, normalized_url_hash, url, resolution), indexed by candidate and hash."""
    write_index(missing, path, [F.col("candidate_id"), F.col("normalized_url_hash")], "candidate_id")


def candidate_urls_page(spark: SparkSession, path: str, schema, candidate_id: str, limit: int, offset: int = 0) -> DataFrame:
    """url, resolution, total, next_offset of a page of a candidate's missing URLs, in order of their hash."""
    page = read_page(spark, path, schema, [F.col("normalized_url_hash")], limit, offset, "candidate_id", candidate_id)
    return page.select("url", "resolution", "total", "next_offset")


def page_keyset(events: DataFrame, limit: int, before: tuple | None = None) -> DataFrame:
    """The newest limit + 1 events before the cursor (observed_at, id); the extra one tells that there are more."""
    if before:
        at, ident = F.lit(before[0]), F.lit(before[1])
        events = events.where((F.col("observed_at") < at) | ((F.col("observed_at") == at) & (F.col("id") < ident)))
    return events.orderBy(F.desc("observed_at"), F.desc("id")).limit(limit + 1)


def group_event_feed(
    groups: DataFrame, website: DataFrame, target: DataFrame, events: DataFrame, as_of: Column, days: int,
    limit: int, before: tuple | None = None, kind: str | None = None,
) -> DataFrame:
    """A page of the group members' events in a window, newest first."""
    members = group_members(groups, website).select("group_id", F.col("id").alias("website_id"))
    rows = event_view(events_in_window(events, as_of, days), target, kind)
    return page_keyset(rows.join(members, "website_id"), limit, before)


def latest_alerts(alert: DataFrame, website: DataFrame, n: int = 100) -> DataFrame:
    w = website.select(F.col("id").alias("websiteId"), F.col("name").alias("website_name"), F.col("domain").alias("website_domain"))
    return alert.join(w, "websiteId").orderBy(F.desc("createdAt"), F.desc("id")).limit(n)


def recent_alerts_per_target(alert: DataFrame, n: int, of_site: int = 100) -> DataFrame:
    """The newest n alerts of each target among the newest of_site of its website."""
    newest = [F.desc("createdAt"), F.desc("id")]
    site = F.row_number().over(Window.partitionBy("websiteId").orderBy(*newest))
    own = F.row_number().over(Window.partitionBy("websiteId", "targetId").orderBy(*newest))
    return alert.withColumn("_site", site).where(F.col("_site") <= of_site).withColumn("rank", own).where(
        F.col("rank") <= n
    ).drop("_site")


def group_listing(groups: DataFrame, q: str = "", limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the groups by name, with total and next_offset."""
    return page_offset(groups.where(contains_text(F.col("name"), q)), [F.col("name"), F.col("id")], limit, offset)


#: Blocks that an owner's destinations are dealt to and groups that an owner's sites are dealt to, so that none is gathered as a
#: whole, and the destinations of a block that are written side by side (a multiple of 8, as Parquet packs eight values together).
BLOCKS, SITE_GROUPS, BESIDE = 16, 512, 64


def filter_destinations(website: DataFrame, destinations: DataFrame) -> DataFrame:
    """(website_id, destination_id): the site's listed destinations of its owner; no readable list means all.

    Sites without a list make nearly all rows, so they are dealt to all tasks, however few files hold them, and joined with
    blocks of destinations; listed destinations are found by their id. A few destinations are repeated for each site of a
    group before the next few come, so that files of the pairs hold short repeating sequences, which compress to little.
    """
    ids = F.from_json("notificationDestinationIds", "array<string>")
    w = website.select(F.col("id").alias("website_id"), F.col("userId").alias("_owner"), ids.alias("_ids"))
    bucket = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    d = destinations.select(F.col("id").alias("destination_id"), F.col("userId").alias("_owner"))
    blocks = d.groupBy("_owner", bucket("destination_id", BLOCKS).alias("_block")).agg(F.collect_list("destination_id").alias("_all"))
    few = F.transform(F.sequence(F.lit(0), F.floor((F.size("_all") - 1) / BESIDE).cast("int")), lambda k: F.slice("_all", k * BESIDE + 1, BESIDE))
    blocks = blocks.select("_owner", F.explode(few).alias("_few"))
    sites = w.where("_ids IS NULL").withColumn("_group", bucket("website_id", SITE_GROUPS))
    sites = sites.repartition(partitions(website.sparkSession), "_owner", "_group").groupBy("_owner", "_group").agg(F.collect_list("website_id").alias("_sites"))
    pairs = sites.join(F.broadcast(blocks), "_owner").select(F.explode("_sites").alias("website_id"), "_few")
    whole = pairs.select("website_id", F.explode("_few").alias("destination_id"))
    listed = w.where("_ids IS NOT NULL").select("website_id", "_owner", F.explode(F.array_distinct("_ids")).alias("destination_id"))
    return whole.unionByName(listed.join(d, ["destination_id", "_owner"]).select("website_id", "destination_id"))


def route_alerts(alert: DataFrame, target: DataFrame, website: DataFrame, destinations: DataFrame) -> DataFrame:
    """Unsuppressed alerts of targets that notify, with the target's destination if the site's owner has it."""
    t = target.where("externalNotify").select(
        F.col("id").alias("targetId"), F.col("notificationDestinationId").alias("destination_id")
    )
    w = website.select(F.col("id").alias("websiteId"), F.col("userId").alias("_owner"), "domain")
    d = destinations.select(F.col("id").alias("destination_id"), F.col("userId").alias("_owner"), "channel")
    live = alert.where(~F.col("suppressed"))
    return live.join(t, "targetId").join(w, "websiteId").join(d, ["destination_id", "_owner"]).drop("_owner")


def unreferenced(rows: DataFrame, column: str, references: list[DataFrame]) -> DataFrame:
    """Rows whose id none of the one-column reference tables holds."""
    used = references[0].toDF(column)
    for r in references[1:]:
        used = used.unionAll(r.toDF(column))
    return rows.join(used.where(F.col(column).isNotNull()).distinct(), column, "left_anti")


def retired_sources(previous: DataFrame, live: DataFrame, scans: DataFrame) -> DataFrame:
    """Sources of a target's last complete graph that its new, complete graph no longer names."""
    complete = scans.where("completeness = 'complete'").select("target_id")
    gone = previous.join(live.select("target_id", "source_url"), ["target_id", "source_url"], "left_anti")
    return gone.join(complete, "target_id", "left_semi")
