"""Observations of URL sets, their differences, and the lifecycle of each URL.

An observation row is (website_id, target_id, scope_version, run_id, observed_at, url, url_hash). Nothing here crosses
websites or scopes: both are part of every key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import partitions

HOUR = "INTERVAL 1 HOUR"
SITE = ["website_id", "scope_version"]
TARGET = ["target_id", "scope_version"]


def explode_run_urls(runs: DataFrame) -> DataFrame:
    """Distinct (target_id, scope_version, run_id, observed_at, url, url_hash) of complete runs' JSON results."""
    urls = F.from_json("result", "struct<urls: array<string>>")["urls"]
    rows = runs.where("completeness = 'complete'").select(
        "target_id", "scope_version", F.col("id").alias("run_id"), "observed_at", F.explode(urls).alias("url")
    )
    return dedupe_records(rows.where(F.col("url").isNotNull()).withColumn("url_hash", F.sha2("url", 256)))


def dedupe_records(obs: DataFrame) -> DataFrame:
    return obs.dropDuplicates(["target_id", "scope_version", "run_id", "url_hash"])


def union_site_urls(file_urls: DataFrame) -> DataFrame:
    """A site's set is the union of its files': moving a URL between files changes nothing."""
    return file_urls.select("target_id", "run_id", "url", "url_hash").dropDuplicates(["target_id", "run_id", "url_hash"])


def set_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of a that b lacks."""
    return a.select(*keys).distinct().join(b.select(*keys), keys, "left_anti")


def set_common(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).distinct().join(b.select(*keys), keys, "left_semi")


def added_urls(obs: DataFrame, site_url: DataFrame, keys: list[str] = SITE) -> DataFrame:
    """Observed URLs that the inventory lacks (added) or holds as removed (reappeared)."""
    known = site_url.select(*keys, F.col("normalized_url_hash").alias("url_hash"), "status")
    joined = obs.join(known, [*keys, "url_hash"], "left").where("status IS NULL OR status = 'removed'")
    kind = F.when(F.col("status").isNull(), "added").otherwise("reappeared")
    return joined.withColumn("kind", kind).drop("status")


def missing_urls(baseline: DataFrame, obs: DataFrame, keys: list[str] = TARGET) -> DataFrame:
    """Rows of the baseline whose URL the new run of the same key lacks."""
    return baseline.join(obs.select(*keys, "url_hash"), [*keys, "url_hash"], "left_anti")


def link_diff(prev: DataFrame, curr: DataFrame, keys: list[str]) -> DataFrame:
    """keys, url, change (added or removed) between two sets of each key."""
    a = prev.select(*keys, "url").distinct().withColumn("_old", F.lit(True))
    b = curr.select(*keys, "url").distinct().withColumn("_new", F.lit(True))
    both = a.join(b, [*keys, "url"], "full").where("_old IS NULL OR _new IS NULL")
    return both.select(*keys, "url", F.when(F.col("_old").isNull(), "added").otherwise("removed").alias("change"))


def missing_set_hash(urls: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_urls, set_hash of the distinct URLs of each key: the canonical digest, which names a set in stored candidates.
    It takes the sorted URLs of a key together; sets are compared by set_digest."""
    return urls.groupBy(*keys).agg(
        F.count_distinct("url").alias("n_urls"),
        F.sha2(F.to_json(F.array_sort(F.collect_set("url"))), 256).alias("set_hash"),
    )


DIGEST = ("n_urls", "digest_a", "digest_b")


def set_digest(urls: DataFrame, keys: list[str], url_hash: str | Column = "url_hash") -> DataFrame:
    """keys, n_urls, digest_a, digest_b of distinct rows: the count of URLs and the sums of two 60-bit parts of their hashes.

    Digests don't depend on order and add up, so tasks combine theirs first, no URLs are gathered, and the digest of a
    difference or a union of disjoint sets follows from those of its parts (see combined).
    """
    part = lambda at: F.conv(F.substring(url_hash, at, 15), 16, 10).cast("decimal(38,0)")
    return urls.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_urls"), F.sum(part(1)).alias("digest_a"), F.sum(part(16)).alias("digest_b"))


def combined(plus: DataFrame, minus: DataFrame, keys: list[str]) -> DataFrame:
    """Digests of plus less those of minus, which are parts of theirs: what a run misses is its baseline less what both have."""
    other = minus.select(*keys, *(F.col(c).alias(f"_{c}") for c in DIGEST))
    rest = lambda c: (F.col(c) - F.coalesce(f"_{c}", F.lit(0))).cast("long" if c == "n_urls" else "decimal(38,0)").alias(c)
    return plus.join(other, keys, "left").select(*keys, *map(rest, DIGEST))


def same_missing_set(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """keys whose two sets of (keys, url_hash) rows, neither empty, are equal: by digest, and for those by looking for a URL of
    a that b lacks. url_hash may be any text that names a URL, as the digest hashes it: URLs of a site shrink when they are
    shuffled, hashes don't."""
    digest = lambda df: set_digest(df, keys, F.sha2("url_hash", 256))
    alike = digest(a).join(digest(b), [*keys, *DIGEST]).select(*keys)
    outside = a.join(alike, keys, "left_semi").join(b.select(*keys, "url_hash"), [*keys, "url_hash"], "left_anti")
    return alike.join(outside.select(*keys).distinct(), keys, "left_anti")


def recovered_candidate_urls(missing: DataFrame, obs: DataFrame, keys: list[str] = TARGET) -> DataFrame:
    """The missing URLs of a candidate that the observation of the same key has again."""
    return missing.join(obs.select(*keys, "url_hash"), [*keys, "url_hash"], "left_semi")


def numbered_runs(runs: DataFrame) -> DataFrame:
    """Runs of each target and scope numbered by time from 0."""
    w = Window.partitionBy("target_id", "scope_version").orderBy("observed_at", "run_id")
    return runs.withColumn("seq", (F.row_number().over(w) - 1).cast("int"))


def successors(runs: DataFrame) -> DataFrame:
    """Runs of each target and scope with seq and what comes after: the next run (first_missing_run_id, first_missing_at), and
    the first run at least an hour after that one (confirmed_seq, confirmed_run_id, confirmed_at, and of runs with is_baseline
    confirmed_is_baseline); null where there is none.

    A run and the moment an hour after it are two marks on a line of time; read from its end, the last run met before a
    moment is the first one after it. So this takes one sort of the runs, and no run meets another.
    """
    numbered = numbered_runs(runs)
    moment = F.unix_micros("observed_at")
    marked = ["is_baseline"] if "is_baseline" in runs.columns else []
    run = F.struct("seq", "run_id", "observed_at", *marked)
    marks = numbered.select(*TARGET, "seq", moment.alias("_at"), F.lit(0).alias("_probe"), run.alias("_run"))
    none = F.lit(None).cast(marks.schema["_run"].dataType)
    probes = numbered.select(*TARGET, "seq", (moment + 3_600_000_000).alias("_at"), F.lit(1).alias("_probe"), none.alias("_run"))
    backwards = Window.partitionBy(*TARGET).orderBy(F.desc("_at"), "_probe", F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
    later = marks.unionByName(probes).withColumn("_later", F.last("_run", ignorenulls=True).over(backwards)).where("_probe = 1")
    # what a run is for the one before it
    missing = numbered.join(later.select(*TARGET, "seq", "_later"), [*TARGET, "seq"]).select(
        *TARGET, (F.col("seq") - 1).alias("seq"), F.col("run_id").alias("first_missing_run_id"), F.col("observed_at").alias("first_missing_at"),
        F.col("_later.seq").alias("confirmed_seq"), F.col("_later.run_id").alias("confirmed_run_id"), F.col("_later.observed_at").alias("confirmed_at"),
        *(F.col(f"_later.{c}").alias(f"confirmed_{c}") for c in marked),
    )
    return numbered.join(missing, [*TARGET, "seq"], "left")


def url_gaps(obs: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per presence of a URL and what follows it.

    seq, at: of this presence; prev_seq, first_seen_at: of the one before and of the first; next_seq, next_run_id, next_at: of
    the next, null for the last; first_missing_run_id, first_missing_at and confirmed_seq, confirmed_run_id, confirmed_at
    describe the gap after it, null where there is none or no second look. What follows a run is a row of a small table
    (successors), so rows of URLs carry no lists of runs.

    Observations without a url_hash are told apart by their URL, and get the SHA-256 of it in the end: hashes don't shrink, and
    needn't move. Rows are dealt into as many partitions as the session has, never fewer: what is small when it is
    shuffled may be large when it is sorted.
    """
    hashed, n = "url_hash" in obs.columns, partitions(obs.sparkSession)
    name = ["url_hash"] if hashed else []
    after = successors(runs).withColumnRenamed("observed_at", "at").drop("website_id")
    seen = obs.select(*TARGET, "website_id", "run_id", "url", *name).repartition(n, *TARGET, "run_id").join(after, [*TARGET, "run_id"])
    key = [*TARGET, "url_hash" if hashed else "url"]
    seen = seen.repartition(n, *key)
    w = Window.partitionBy(*key).orderBy("seq")
    seen = seen.withColumns(
        {
            "prev_seq": F.lag("seq").over(w),
            "first_seen_at": F.first("at").over(w),
            "next_seq": F.lead("seq").over(w),
            "next_run_id": F.lead("run_id").over(w),
            "next_at": F.lead("at").over(w),
        }
    )
    gap = F.coalesce(F.col("next_seq") > F.col("seq") + 1, F.col("first_missing_at").isNotNull())
    sure = gap & F.coalesce(F.col("confirmed_seq") < F.col("next_seq"), F.col("confirmed_seq").isNotNull())
    of_gap = {c: F.when(gap, F.col(c)) for c in ("first_missing_run_id", "first_missing_at")}
    seen = seen.withColumns({**of_gap, **{c: F.when(sure, F.col(c)) for c in ("confirmed_seq", "confirmed_run_id", "confirmed_at")}})
    return seen if hashed else seen.withColumn("url_hash", F.sha2("url", 256))


def replay_url_lifecycle(obs: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state, events) after all adopted runs, in closed form: no loop over runs.

    A URL first seen after the baseline is added. A gap between two presences, or after the last, is a removal at the
    first run an hour or more after the first missing one; a presence after it is a reappearance, one without it a
    silent recovery.
    """
    g = url_gaps(obs, runs)
    events = g.select(*URL, F.explode(_events()).alias("e")).select(*URL, "e.*")
    events = events.withColumn("id", F.concat_ws(":", "run_id", "url_hash", "kind"))
    return g.where("next_seq IS NULL").select(*URL, *_state()), events


def write_lifecycle(obs: DataFrame, runs: DataFrame, folder: str) -> None:
    """Writes what replay_url_lifecycle gives, both tables in one pass (see read_lifecycle).

    A task's rows lie in order of time, so a reader who asks for a window skips the rest of each file. Ids and hashes follow
    from the other columns and aren't written where obs has no hashes.
    """
    hashed = "url_hash" in obs.columns
    keys = URL if hashed else URL[:-1]
    none = lambda c: F.lit(None).cast("string").alias(c)
    g = url_gaps(obs, runs)
    state = F.struct(none("kind"), none("run_id"), F.col("at").alias("observed_at"), F.struct(*_state()).alias("state"))
    of_event = lambda e: F.struct(e["kind"], e["run_id"], e["observed_at"], F.lit(None).cast(kind_of_state).alias("state"))
    kind_of_state = g.select(F.struct(*_state()).alias("s")).schema["s"].dataType
    both = F.concat(F.transform(_events(), of_event), F.array_compact(F.array(F.when(F.col("next_seq").isNull(), state))))
    rows = g.select(*keys, F.explode(both).alias("e")).select(*keys, "e.*", F.when(F.col("e.state").isNull(), "events").otherwise("state").alias("_table"))
    rows.sortWithinPartitions("_table", "observed_at").write.partitionBy("_table").parquet(folder)


def read_lifecycle(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(state, events) that write_lifecycle wrote."""
    rows = spark.read.parquet(folder)
    rows = rows if "url_hash" in rows.columns else rows.withColumn("url_hash", F.sha2("url", 256))
    events = rows.where("_table = 'events'").select(*URL, "kind", "run_id", "observed_at", F.concat_ws(":", "run_id", "url_hash", "kind").alias("id"))
    return rows.where("_table = 'state'").select(*URL, "state.*"), events


URL = ["website_id", "target_id", "scope_version", "url", "url_hash"]


def _events() -> Column:
    """The events of a row of url_gaps."""

    def event(kind: str, run: str, at: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.col(run).alias("run_id"), F.col(at).alias("observed_at"))

    sure = F.col("confirmed_seq").isNotNull()
    return F.array_compact(
        F.array(
            F.when(F.col("prev_seq").isNull() & (F.col("seq") > 0), event("added", "run_id", "at")),
            F.when(sure, event("removed", "confirmed_run_id", "confirmed_at")),
            F.when(sure & F.col("next_seq").isNotNull(), event("reappeared", "next_run_id", "next_at")),
        )
    )


def _state() -> list[Column]:
    """The state of a URL after the last of its rows of url_gaps."""
    sure, gone = F.col("confirmed_seq").isNotNull(), F.col("first_missing_at").isNotNull()
    return [
        F.when(sure, "removed").when(gone, "pending_removed").otherwise("active").alias("status"),
        "first_seen_at",
        F.col("at").alias("last_seen_at"),
        "first_missing_run_id",
        F.col("first_missing_at").alias("first_missing_observed_at"),
        F.coalesce("confirmed_run_id", "first_missing_run_id").alias("last_missing_run_id"),
        F.when(sure, 2).when(gone, 1).otherwise(0).alias("missing_confirmations"),
        F.col("confirmed_at").alias("removed_at"),
    ]


def confirm_second_missing(gaps: DataFrame) -> DataFrame:
    """Gaps with the first run at least an hour after their first missing one, if any (see url_gaps)."""
    return gaps.where("first_missing_at IS NOT NULL").select(
        "target_id", "scope_version", "url", "seq", "next_seq", "first_missing_at", F.col("confirmed_run_id").alias("confirming_run"), "confirmed_at"
    )


def run_deltas(obs: DataFrame, runs: DataFrame) -> DataFrame:
    """Size of each run's URL set beside the run before it."""
    sizes = obs.groupBy("target_id", "scope_version", "run_id").agg(F.count_distinct("url_hash").alias("n_urls"))
    w = Window.partitionBy("target_id", "scope_version").orderBy("observed_at", "run_id")
    joined = runs.select("target_id", "scope_version", "run_id", "observed_at").join(
        sizes, ["target_id", "scope_version", "run_id"], "left"
    )
    joined = joined.withColumn("n_urls", F.coalesce("n_urls", F.lit(0)))
    before = F.lag("n_urls").over(w)
    return joined.withColumns({"previous": before, "delta": F.col("n_urls") - before})


def baseline_timeline(runs: DataFrame) -> DataFrame:
    """The baseline in force at each run: the last adopted one before it, within its scope."""
    w = (
        Window.partitionBy("target_id", "scope_version")
        .orderBy("created_at", "id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    adopted = F.when(F.col("adoption_status").isin("baseline", "applied"), F.col("id"))
    return runs.withColumn("baseline_run_id", F.last(adopted, ignorenulls=True).over(w))


def table_fingerprint(df: DataFrame) -> DataFrame:
    """n_rows and an order-free digest of all rows: sums of two halves of each row's hash, combined per task first."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    half = lambda at: F.conv(F.substring(row, at, 8), 16, 10).cast("decimal(38,0)")
    return df.select(half(1).alias("a"), half(9).alias("b")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("a").cast("string").alias("digest_a"), F.sum("b").cast("string").alias("digest_b")
    )
