"""Counts and roll-ups of inventories, events, runs and alerts, per monitor, website and group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timing import website_status
from .views import event_view, events_in_window, group_members, inventory_view, open_candidates, website_monitors

KINDS = ("added", "removed", "reappeared")


def inventory_counts(target: DataFrame, site_url: DataFrame) -> DataFrame:
    """website_id, total, current (all but removed), pending, removed at the current scope under the path rules."""
    status = F.col("status")
    return inventory_view(site_url, target).groupBy("website_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(status != "removed").alias("current"),
        F.count_if(status == "pending_removed").alias("pending"),
        F.count_if(status == "removed").alias("removed"),
    )


def event_counts(target: DataFrame, events: DataFrame, as_of: Column, days: int, upper: bool = True) -> DataFrame:
    """website_id and the number of events of each kind (n_added, ...) in the window."""
    rows = event_view(events_in_window(events, as_of, days, upper), target)
    return rows.groupBy("website_id").agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS))


def last_success(runs: DataFrame) -> DataFrame:
    """target_id, scope_version, latest observation of a complete success."""
    done = runs.where("execution_status = 'succeeded' AND completeness = 'complete'")
    return done.groupBy("target_id", "scope_version").agg(F.max("observed_at").alias("last_success_at"))


def active_run(runs: DataFrame) -> DataFrame:
    """target_id, status of its queued or running run."""
    live = runs.where(F.col("execution_status").isin("queued", "running"))
    return live.groupBy("target_id").agg(F.max("execution_status").alias("active_run"))


def scopes_of_target(target: DataFrame, runs: DataFrame) -> DataFrame:
    """target_id, scopes: those of its history and the current one, latest first."""
    both = runs.select("target_id", "scope_version").unionAll(target.select(F.col("id").alias("target_id"), "scope_version"))
    return both.groupBy("target_id").agg(F.sort_array(F.collect_set("scope_version"), asc=False).alias("scopes"))


def run_listing(runs: DataFrame, scope: int | None = None) -> DataFrame:
    """Runs with the number of their URLs, null where a run has no set."""
    rows = runs.where(F.col("scope_version") == scope) if scope is not None else runs
    urls = F.from_json("result", "struct<urls: array<string>>")["urls"]
    return rows.withColumn("url_count", F.when(urls.isNotNull(), F.size(urls))).drop("result")


def run_status_histogram(runs: DataFrame) -> DataFrame:
    """n runs by target, trigger and execution status, with all sub-totals (null: all)."""
    return runs.cube("target_id", "trigger_kind", "execution_status").agg(F.count(F.lit(1)).alias("n"))


def attempt_history(attempts: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """run_id, attempts, and a column of counts for each status."""
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in statuses]
    return attempts.groupBy("run_id").agg(F.count(F.lit(1)).alias("attempts"), *counts)


def monitor_quota(
    target: DataFrame, website: DataFrame, limit: int | None, adding: int = 1, excluded: str | None = None
) -> DataFrame:
    """userId, in_use (enabled unarchived monitors), allowed: whether so many more fit."""
    t = target.where(F.col("enabled") & F.col("archived_at").isNull())
    if excluded:
        t = t.where(F.col("id") != excluded)
    owners = website.select(F.col("id").alias("websiteId"), "userId")
    used = owners.join(t.select("websiteId", F.lit(1).alias("_on")), "websiteId", "left")
    n = used.groupBy("userId").agg(F.count("_on").alias("in_use"))
    return n.withColumn("allowed", F.lit(True) if limit is None else F.col("in_use") + adding <= limit)


def unread_counts(alert: DataFrame, website: DataFrame) -> DataFrame:
    """websiteId, unread: unread alerts, 0 where there is none."""
    n = alert.groupBy("websiteId").agg(F.count_if(~F.col("is_read")).alias("unread"))
    sites = website.select(F.col("id").alias("websiteId"))
    return sites.join(n, "websiteId", "left").fillna(0, ["unread"])


def website_chip(target: DataFrame, alert: DataFrame) -> DataFrame:
    """websiteId, last due moment, enabled monitors, unread alerts and the chip's label."""
    t = target.groupBy("websiteId").agg(
        F.max("nextCheckDueAt").alias("last_at"), F.count_if(F.col("enabled")).alias("n_enabled")
    )
    a = alert.groupBy("websiteId").agg(F.count_if(~F.col("is_read")).alias("unread"))
    out = t.join(a, "websiteId", "left").fillna(0, ["unread"])
    label = F.when(F.col("unread") > 0, "changes").when(F.col("n_enabled") == 0, "paused").otherwise("quiet")
    return out.withColumn("label", label)


#: Configuration that a summary shows.
CONFIGURED = (
    "id", "websiteId", "enabled", "archived_at", "checkIntervalHours", "scope_version", "filter_version", "baseline_run_id",
    "nextCheckDueAt", "sitemap_roots", "allowed_page_hosts", "include_paths", "exclude_paths", "lastError",
)


def open_counts(candidates: DataFrame, as_of: Column) -> DataFrame:
    """target_id, scope_version, open_candidates."""
    return open_candidates(candidates, as_of).groupBy("target_id", "scope_version").agg(F.count(F.lit(1)).alias("open_candidates"))


def monitor_summaries(
    target: DataFrame, site_url: DataFrame, events: DataFrame, runs: DataFrame, candidates: DataFrame, as_of: Column
) -> DataFrame:
    """One row per monitor: its configuration, its counts, the last day's events, last success, active run, open candidates, and
    the scopes of its history, latest first."""
    out = target.select(*(c for c in CONFIGURED if c in target.columns))
    counts = inventory_counts(target, site_url).withColumnRenamed("website_id", "websiteId")
    recent = event_counts(target, events, as_of, 1, upper=False).withColumnRenamed("website_id", "websiteId")
    success = last_success(runs).withColumnRenamed("target_id", "id")
    open_n = open_counts(candidates, as_of).withColumnRenamed("target_id", "id")
    scopes = scopes_of_target(target, runs).withColumnRenamed("target_id", "id")
    out = out.join(counts, "websiteId", "left").join(recent, "websiteId", "left")
    out = out.join(success, ["id", "scope_version"], "left").join(open_n, ["id", "scope_version"], "left")
    out = out.join(active_run(runs).withColumnRenamed("target_id", "id"), "id", "left").join(scopes, "id", "left")
    return out.fillna(0, ["total", "current", "pending", "removed", *(f"n_{k}" for k in KINDS), "open_candidates"])


def group_websites(
    groups: DataFrame, website: DataFrame, target: DataFrame, site_url: DataFrame, events: DataFrame, runs: DataFrame,
    candidates: DataFrame, as_of: Column, days: int, include_archived: bool = False,
) -> DataFrame:
    """One row per member website of a group: counts, events in the window, its status, and of its monitor the open candidates
    and the last success at its scope."""
    members = group_members(groups, website)
    rows = website_monitors(members, target)
    if not include_archived:
        rows = rows.where(F.col("t_archived_at").isNull())
    run = active_run(runs).withColumnRenamed("target_id", "t_id")
    counts = inventory_counts(target, site_url).withColumnRenamed("website_id", "id")
    recent = event_counts(target, events, as_of, days).withColumnRenamed("website_id", "id")
    of_monitor = lambda df: df.withColumnsRenamed({"target_id": "t_id", "scope_version": "t_scope_version"})
    rows = rows.join(run, "t_id", "left").join(counts, "id", "left").join(recent, "id", "left")
    for part in (of_monitor(last_success(runs)), of_monitor(open_counts(candidates, as_of))):
        rows = rows.join(part, ["t_id", "t_scope_version"], "left")
    status = website_status(
        F.col("t_id"), F.col("t_archived_at"), F.col("t_enabled"), F.col("active_run"), F.col("t_lastError"),
        F.col("t_baseline_run_id"),
    )
    return rows.select(
        "group_id", "id", "name", "domain", F.col("t_id").alias("target_id"), F.col("t_archived_at").alias("archived_at"), "last_success_at",
        status.alias("status"), F.col("t_baseline_run_id").isNotNull().alias("has_baseline"),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("current", "pending", "removed", *(f"n_{k}" for k in KINDS), "open_candidates")),
    )


def group_overviews(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """Groups with their websites' roll-up (rows of group_websites): URL counts over websites with a baseline only,
    current null if none has one; events, open candidates and the latest scan over all; groups without websites appear."""
    base = F.col("has_baseline")
    agg = rows.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("websites"),
        F.count_if(base).alias("baseline_websites"),
        F.sum(F.when(base, F.col("current"))).alias("current"),
        F.sum(F.when(base, F.col("pending"))).alias("pending"),
        F.sum(F.when(base, F.col("removed"))).alias("removed"),
        *(F.sum(f"n_{k}").alias(f"n_{k}") for k in KINDS),
        F.sum("open_candidates").alias("open_candidates"),
        F.max("last_success_at").alias("latest_scan_at"),
    )
    out = groups.select(F.col("id").alias("group_id"), F.col("name").alias("group_name")).join(agg, "group_id", "left")
    return out.fillna(0, ["websites", "baseline_websites", "pending", "removed", *(f"n_{k}" for k in KINDS), "open_candidates"])


def status_counts(rows: DataFrame) -> DataFrame:
    """group_id, status, n, and per group the same as a map."""
    n = rows.groupBy("group_id", "status").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("group_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("status_counts")
    )


def rank_websites(rows: DataFrame, by_activity: bool = True) -> DataFrame:
    """Rank of the websites in their group: by events, most first, or by name; ties by id."""
    total = sum((F.col(f"n_{k}") for k in KINDS[1:]), F.col(f"n_{KINDS[0]}"))
    order = [total.desc(), F.col("id")] if by_activity else [F.col("name"), F.col("id")]
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("group_id").orderBy(*order)))


def config_fingerprint(groups: DataFrame, members: DataFrame, config: list[str]) -> DataFrame:
    """group_id, fingerprint of the members' configuration in order of id and the membership version."""
    row = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in config))
    agg = members.groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("id", row.alias("row")))).alias("rows"))
    text = F.concat_ws(";", F.col("membership_version").cast("string"), F.array_join(F.col("rows.row"), ";"))
    g = groups.select(F.col("id").alias("group_id"), "membership_version")
    return g.join(agg, "group_id").select("group_id", F.sha2(text, 256).alias("fingerprint"))


def price_extents(points: DataFrame, key: str = "page") -> DataFrame:
    """Per page: time and price extents, number of points, and the class of its currencies (none, single, mixed)."""
    c = F.nullif(F.trim("currency"), F.lit(""))
    out = points.groupBy(key).agg(
        F.min("createdAt").alias("first_at"), F.max("createdAt").alias("last_at"), F.min("price").alias("min_price"),
        F.max("price").alias("max_price"), F.count(F.lit(1)).alias("points"), F.count_distinct(c).alias("currencies"),
    )
    kind = F.when(F.col("currencies") == 0, "none").when(F.col("currencies") == 1, "single").otherwise("mixed")
    return out.withColumn("currency_class", kind)


def scan_report(sources: DataFrame, urls: DataFrame) -> DataFrame:
    """Per run: sources by outcome, bytes, distinct URLs in and out of scope, first issue, and whether all issues can
    be retried, with the longest wait asked for. completeness: complete without issues, else partial or unusable."""
    ok = F.col("status").isin("fetched", "not_modified")
    s = sources.groupBy("run_id").agg(
        *(F.count_if(F.col("status") == k).alias(f"n_{k}") for k in ("fetched", "not_modified", "failed")),
        F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes"),
        F.min_by("error", F.when(F.col("error").isNotNull(), F.struct("depth", "source_url"))).alias("first_issue"),
        F.every(F.when(F.col("error").isNotNull(), F.coalesce("retryable", F.lit(False)))).alias("all_retryable"),
        F.max("retry_after_ms").alias("retry_after_ms"),
        F.count_if(ok & F.col("error").isNull()).alias("_good"),
        F.count("error").alias("_issues"),
    )
    u = urls.groupBy("run_id").agg(
        F.count_distinct(F.when(F.col("in_scope"), F.col("url"))).alias("observed"),
        F.count_distinct(F.when(~F.col("in_scope"), F.col("url"))).alias("out_of_scope"),
    )
    kind = F.when(F.col("_issues") == 0, "complete").when(F.col("_good") > 0, "partial").otherwise("unusable")
    return s.join(u, "run_id", "left").fillna(0, ["observed", "out_of_scope"]).withColumn("completeness", kind).drop(
        "_good", "_issues"
    )
