"""Bulk changes of configuration and candidates, settling of runs, retention, and invariants."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timing import retry_delay_ms
from ..functions.urls import normalize_path_rules
from ..operators.adopt import SITE, apply_observation
from ..operators.inventory import same_missing_set
from ..sources.buckets import by_hash, by_quarter, read_buckets, touched, write_buckets

OPEN = ("pending", "adopted")


def _same(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)).eqNullSafe(F.array_sort(F.array_distinct(b)))


def change_scope(target: DataFrame, changes: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(targets, candidates) after changes (id, roots, hosts): a real difference bumps the scope, clears the baseline
    and makes open candidates stale; history stays."""
    joined = target.join(changes.select("id", F.col("roots").alias("_roots"), F.col("hosts").alias("_hosts"), F.lit(True).alias("_asked")), "id", "left")
    changed = F.coalesce("_asked", F.lit(False)) & ~(
        _same(F.col("sitemap_roots"), F.col("_roots")) & _same(F.col("allowed_page_hosts"), F.col("_hosts"))
    )
    joined = joined.withColumn("_changed", changed)
    moved = F.col("_changed")
    new = joined.withColumns(
        {
            "scope_version": F.col("scope_version") + moved.cast("int"),
            "baseline_run_id": F.when(~moved, F.col("baseline_run_id")),
            "sitemap_roots": F.when(moved, F.array_sort(F.array_distinct("_roots"))).otherwise(F.col("sitemap_roots")),
            "allowed_page_hosts": F.when(moved, F.array_sort(F.array_distinct("_hosts"))).otherwise(F.col("allowed_page_hosts")),
        }
    ).select(*target.columns)
    ids = joined.where("_changed").select(F.col("id").alias("target_id"), F.lit(True).alias("_moved"))
    stale = F.col("status").isin(*OPEN) & F.coalesce("_moved", F.lit(False))
    cand = candidates.join(ids, "target_id", "left").withColumn("status", F.when(stale, "stale").otherwise(F.col("status")))
    return new, cand.select(*candidates.columns)


def change_filters(target: DataFrame, changes: DataFrame) -> DataFrame:
    """Targets after changes (id, include, exclude; null keeps a side): the filter version grows only if the
    normalised rules differ; error where a rule is invalid, and then nothing changes."""
    inc, exc = normalize_path_rules(F.col("include")), normalize_path_rules(F.col("exclude"))
    asked = changes.select(
        "id", F.col("include").isNotNull().alias("_i"), F.col("exclude").isNotNull().alias("_e"),
        inc["rules"].alias("_inc"), exc["rules"].alias("_exc"),
        F.coalesce(F.when(F.col("include").isNotNull(), inc["error"]), F.when(F.col("exclude").isNotNull(), exc["error"])).alias("error"),
    )
    joined = target.join(asked, "id", "left")
    ok = F.col("error").isNull()
    new_i = F.when(ok & F.coalesce("_i", F.lit(False)), F.col("_inc")).otherwise(F.col("include_paths"))
    new_e = F.when(ok & F.coalesce("_e", F.lit(False)), F.col("_exc")).otherwise(F.col("exclude_paths"))
    differs = ~new_i.eqNullSafe(F.col("include_paths")) | ~new_e.eqNullSafe(F.col("exclude_paths"))
    return joined.select(
        *(F.col(c) for c in target.columns if c not in ("include_paths", "exclude_paths", "filter_version")),
        (F.col("filter_version") + differs.cast("int")).alias("filter_version"),
        new_i.alias("include_paths"), new_e.alias("exclude_paths"), "error",
    )


def approve_candidates(
    approvals: DataFrame, candidates: DataFrame, target: DataFrame, state: DataFrame, obs: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outcomes, state, events) of approvals (candidate_id): a valid pending candidate is adopted and its observation
    applied; adopted or confirmed ones stay; all others are CANDIDATE_STALE.

    obs: SITE, url, url_hash and run_id of the candidates' runs; target: id, website_id, scope_version, baseline_run_id.
    """
    t = target.select(F.col("id").alias("target_id"), "website_id", F.col("scope_version").alias("_scope"), F.col("baseline_run_id").alias("_base"))
    rows = approvals.join(candidates.withColumnRenamed("id", "candidate_id"), "candidate_id", "left").join(t, "target_id", "left")
    scope = F.col("scope_version") == F.col("_scope")
    done = F.col("status").isin("adopted", "confirmed")
    valid = (F.col("status") == "pending") & (F.col("expires_at") > now) & F.col("origin_baseline_run_id").eqNullSafe(F.col("_base"))
    rows = rows.withColumns(
        {
            "error": F.when(F.col("status").isNull(), "CANDIDATE_NOT_FOUND").when(~(scope & (done | valid)), "CANDIDATE_STALE"),
            "changed": F.coalesce(scope & valid, F.lit(False)),
        }
    )
    outcomes = rows.select(
        "candidate_id", F.when(F.col("changed"), "adopted").when(F.col("error").isNull(), F.col("status")).alias("status"),
        "changed", "error",
    )
    runs = rows.where("changed").select(*SITE, F.col("candidate_run_id").alias("run_id"), "observed_at", F.lit(False).alias("is_baseline"))
    seen = obs.join(runs.select("run_id"), "run_id", "left_semi")
    new, events = apply_observation(state, seen, runs)
    return outcomes, new, events


def confirm_candidates(candidates: DataFrame, held: DataFrame, missing: DataFrame, runs: DataFrame) -> DataFrame:
    """candidate_id, decision of pending candidates against a later complete run of their target, and what is left of them.

    held: candidate_id, url_hash of each candidate; missing: candidate_id, url_hash of the new run's missing set; runs:
    candidate_id, observed_at of the new run. Equal sets an hour apart confirm, sooner they stay; others are rejected, and
    what the new run has of them is recovered.
    """
    key = ["candidate_id"]
    later = runs.select("candidate_id", F.col("observed_at").alias("_later"))
    c = candidates.where("status = 'pending'").select(F.col("id").alias("candidate_id"), "observed_at")
    equal = same_missing_set(held, missing, key).withColumn("_equal", F.lit(True))
    some = held.unionByName(missing).select(*key).distinct().withColumn("_some", F.lit(True))
    both = held.join(missing.select(*key, "url_hash"), [*key, "url_hash"], "left_semi").groupBy(*key).agg(F.count(F.lit(1)).alias("still"))
    size = held.groupBy(*key).agg(F.count(F.lit(1)).alias("original_missing_count"))
    joined = c.join(later, "candidate_id")
    for part in (equal, some, size, both):
        joined = joined.join(part, "candidate_id", "left")
    joined = joined.fillna(0, ["original_missing_count", "still"])
    same = F.coalesce("_equal", F.lit(False)) | F.col("_some").isNull()
    decision = F.when(~same, "missing_set_changed").when(
        F.col("_later") >= F.col("observed_at") + F.expr("INTERVAL 1 HOUR"), "confirmed"
    ).otherwise("quarantined")
    joined = joined.withColumn("decision", decision)
    confirmed = F.col("decision") == "confirmed"
    return joined.select(
        "candidate_id", "decision", "original_missing_count", F.when(confirmed, 0).otherwise(F.col("still")).cast("long").alias("pending_count"),
        (F.col("original_missing_count") - F.col("still")).alias("recovered_count"),
        F.when(confirmed, F.col("still")).otherwise(0).cast("long").alias("removed_count"),
    )


def settle_runs(reports: DataFrame, now: Column) -> DataFrame:
    """Finished attempts (run_id, attempt, completeness, stale, all_retryable, retry_after_ms, first_error) with their
    execution, adoption and attempt status, and when they may run again."""
    failed = F.col("completeness") != "complete"
    delay = retry_delay_ms(F.coalesce("all_retryable", F.lit(False)), F.col("attempt"), F.col("retry_after_ms"))
    return reports.select(
        "run_id", "attempt",
        F.when(F.col("stale"), "cancelled").when(~failed, "succeeded").when(delay.isNull(), "failed").otherwise("queued").alias("execution_status"),
        F.when(F.col("stale"), "stale").otherwise("none").alias("adoption_status"),
        F.when(F.col("stale"), "discarded").when(failed, "failed").otherwise("succeeded").alias("attempt_status"),
        F.when(failed & ~F.col("stale"), F.timestamp_millis(F.unix_millis(now) + delay)).alias("available_at"),
        F.when(failed, F.coalesce("first_error", F.lit("INCOMPLETE"))).alias("error_code"),
    )


def protected_runs(target: DataFrame, candidates: DataFrame) -> DataFrame:
    """run_id of baselines and of the three runs each open candidate names."""
    live = candidates.where(F.col("status").isin(*OPEN))
    named = live.select(F.explode(F.array("candidate_run_id", "origin_baseline_run_id", "last_confirmation_run_id")).alias("run_id"))
    both = target.select(F.col("baseline_run_id").alias("run_id")).unionAll(named)
    return both.where(F.col("run_id").isNotNull()).distinct()


def retention(
    target: DataFrame, candidates: DataFrame, runs: DataFrame, attempts: DataFrame, sources: DataFrame,
    cache: DataFrame, revisions: DataFrame, now: Column,
) -> dict[str, DataFrame]:
    """The tables after retention. Inventory, events and run identities are never deleted."""
    keep = protected_runs(target, candidates)
    old = lambda column, days: F.col(column) < now - F.expr(f"INTERVAL {days} DAYS")
    scope = target.select(F.col("id").alias("target_id"), "scope_version")
    cache = cache.join(scope, ["target_id", "scope_version"], "left_semi")
    free = lambda df: df.join(keep, "run_id", "left_anti")
    gone = free(sources.where(old("created_at", 90))).select("run_id", "attempt", "source_url")
    sources = sources.join(gone, ["run_id", "attempt", "source_url"], "left_anti")
    done = runs.where(old("finished_at", 180) & ~F.col("execution_status").isin("queued", "running"))
    done = free(done.select(F.col("id").alias("run_id"))).withColumn("_old", F.lit(True))
    marked = runs.join(done.withColumnRenamed("run_id", "id"), "id", "left")
    blank = lambda df, cols: df.withColumns({c: F.when(F.col("_old").isNull(), F.col(c)) for c in cols}).drop("_old")
    finished = runs.where(old("finished_at", 180)).select(F.col("id").alias("run_id"))
    marked_attempts = attempts.join(free(finished).withColumn("_old", F.lit(True)), "run_id", "left")
    used = cache.select("revision_id").unionAll(sources.select("revision_id")).where(F.col("revision_id").isNotNull())
    stale = revisions.where(old("created_at", 30)).join(used.distinct(), F.col("id") == F.col("revision_id"), "left_anti")
    return {
        "cache": cache,
        "sources": sources,
        "runs": blank(marked, ["result", "error"]),
        "attempts": blank(marked_attempts, ["error"]),
        "revisions": revisions.join(stale.select("id"), "id", "left_anti"),
    }


#: Stored tables that retention changes: schema, the moment whose quarter is a row's bucket (none: by target), the days after
#: which a row may change, and the columns that are blanked (none: rows are removed).
RETAINED = {
    "sources": ("run_id string, attempt int, source_url string, revision_id string, created_at timestamp", "created_at", 90, ()),
    "cache": ("target_id string, scope_version int, source_url string, revision_id string", None, 0, ()),
    "runs": ("id string, execution_status string, result string, error string, finished_at timestamp", "finished_at", 180, ("result", "error")),
    "attempts": ("run_id string, attempt int, error string, finished_at timestamp", "finished_at", 180, ("error",)),
    "revisions": ("id string, created_at timestamp", "created_at", 30, ()),
}


def _bucket(moment: str | None) -> Column:
    return by_quarter(moment) if moment else by_hash(["target_id"])


def store_retained(tables: dict[str, DataFrame], folder: str, batch_id: int = 0) -> None:
    """Writes the tables of RETAINED below folder in buckets."""
    for name, df in tables.items():
        bucket = _bucket(RETAINED[name][1])
        write_buckets(df, f"{folder}/{name}", bucket, batch_id, touched(df, bucket))


def read_retained(spark: SparkSession, folder: str, before: int | None = None) -> dict[str, DataFrame]:
    return {name: read_buckets(spark, f"{folder}/{name}", schema, before=before) for name, (schema, *_) in RETAINED.items()}


def retain_stored(
    spark: SparkSession, folder: str, target: DataFrame, candidates: DataFrame, now: datetime.datetime, batch_id: int
) -> dict[str, list[int]]:
    """Removes and blanks what retention gives up in the stored tables, and returns the buckets that were rewritten.

    Only buckets are looked at whose quarter begins before the table's days, and of those only the ones are written in which
    something changes. New versions are made from the versions before batch_id, so a batch that is repeated writes the
    same, and a later one finds nothing to do.
    """
    before = read_retained(spark, folder, batch_id)
    after = retention(target, candidates, before["runs"], before["attempts"], before["sources"], before["cache"], before["revisions"], F.lit(now))
    written = {}
    for name, (_, moment, days, blanked) in RETAINED.items():
        bucket = _bucket(moment)
        last = now - datetime.timedelta(days=days)
        old = bucket <= last.year * 4 + (last.month + 2) // 3 if moment else F.lit(True)
        # what a bucket holds: its rows, or those with a value that may be blanked
        held = F.count(F.lit(1)) if not blanked else sum((F.count(c) for c in blanked[1:]), F.count(blanked[0]))
        size = lambda df, n: df.where(old).groupBy(bucket.alias("bucket")).agg(held.alias(n))  # noqa: E731, B023
        both = size(before[name], "n").join(size(after[name], "m"), "bucket", "left")
        only = sorted(r[0] for r in both.where(~F.col("n").eqNullSafe(F.coalesce("m", F.lit(0)))).select("bucket").collect())
        rows = after[name].where(bucket.isin(only)) if only else after[name]
        write_buckets(rows, f"{folder}/{name}", bucket, batch_id, only)
        written[name] = only
    return written


def check_invariants(
    site_url: DataFrame, candidates: DataFrame | None = None, runs: DataFrame | None = None, target: DataFrame | None = None,
    events: DataFrame | None = None,
) -> DataFrame:
    """rule, key, of every row that breaks a rule of the state tables. Rules between two tables are tested where both are given:
    scope_isolation (a URL or event beyond its target's scope, an event of a URL that its scope doesn't have),
    completeness_gate (an adopted run or a baseline that isn't a complete success), candidate_of_run (one whose run isn't
    there)."""
    s, none = F.col("status"), lambda c: F.col(c).isNull()
    no_evidence = none("first_missing_run_id") & none("first_missing_observed_at") & none("last_missing_run_id")
    evidence = ~none("first_missing_run_id") & ~none("first_missing_observed_at") & ~none("last_missing_run_id")
    n = F.col("missing_confirmations")
    sound = (
        ((s == "active") & (n == 0) & no_evidence & none("removed_at"))
        | ((s == "pending_removed") & (n == 1) & evidence & none("removed_at"))
        | ((s == "removed") & (n == 2) & evidence & ~none("removed_at"))
    )
    parts: list[DataFrame] = []

    def broken(rule: str, df: DataFrame, *key: str) -> None:
        parts.append(df.select(F.lit(rule).alias("rule"), F.concat_ws("/", *(F.col(c).cast("string") for c in key)).alias("key")))

    broken("site_url_evidence", site_url.where(~F.coalesce(sound, F.lit(False))), "website_id", "scope_version", "url")
    if candidates is not None:
        total = F.col("pending_count") + F.col("recovered_count") + F.col("removed_count")
        wrong = (F.col("original_missing_count") <= 0) | (F.col("original_missing_count") != total)
        broken("candidate_counts", candidates.where(wrong), "id")
        twice = candidates.where("status = 'pending'").groupBy("target_id", "scope_version").count().where("count > 1")
        broken("one_pending_candidate", twice, "target_id", "scope_version")
        if "expires_at" in candidates.columns:
            stay = F.col("expires_at") - F.col("observed_at")
            broken("candidate_expiry", candidates.where(~stay.between(F.expr("INTERVAL 72 HOURS"), F.expr("INTERVAL 14 DAYS"))), "id")
    if runs is not None:
        twice = runs.where(F.col("execution_status").isin("queued", "running")).groupBy("target_id").count().where("count > 1")
        broken("one_active_run", twice, "target_id")
        broken("attempt_range", runs.where(~F.col("attempt").between(0, 4)), "id")
        if "adoption_status" in runs.columns:
            whole = (F.col("execution_status") == "succeeded") & (F.col("completeness") == "complete")
            adopted = F.col("adoption_status").isin("baseline", "applied", "first_observation")
            broken("completeness_gate", runs.where(adopted & ~F.coalesce(whole, F.lit(False))), "id")
            if target is not None:
                based = target.where("baseline_run_id IS NOT NULL").select(F.col("id").alias("target"), F.col("baseline_run_id").alias("id"))
                broken("completeness_gate", based.join(runs.where(whole).select("id"), "id", "left_anti"), "target", "id")
        if candidates is not None and "candidate_run_id" in candidates.columns:
            broken("candidate_of_run", candidates.join(runs.select(F.col("id").alias("candidate_run_id")), "candidate_run_id", "left_anti"), "id")
    if target is not None:
        scopes = target.groupBy(F.col("websiteId").alias("website_id")).agg(F.max("scope_version").alias("_now"))
        beyond = lambda df: df.join(scopes, "website_id").where(F.col("scope_version") > F.col("_now"))
        broken("scope_isolation", beyond(site_url), "website_id", "scope_version", "url")
        if events is not None:
            broken("scope_isolation", beyond(events), "id")
    if events is not None:
        known = site_url.select("website_id", "scope_version", "url")
        broken("scope_isolation", events.join(known, ["website_id", "scope_version", "url"], "left_anti"), "id")
    return reduce(DataFrame.unionAll, parts)
