"""Structured Streaming forms of the monitor: adoption by micro-batch, keyed lifecycles, expiry, counts, changes."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import adopt
from ..operators.adopt import SITE
from ..operators.snapshots import PRICE_TIES
from ..scratch import stored
from ..sources.buckets import BUCKETS, by_hash, read_buckets, touched, write_buckets
from ..sources.tables import write_events


HELD = "website_id string, target_id string, scope_version int, run_id string, observed_at timestamp, url string, url_hash string"


def in_force(runs: DataFrame, scopes: DataFrame) -> DataFrame:
    """runs with scope_now, the scope of their target at their moment, and archived: by a table of versions (target_id,
    scope_version, valid_from, perhaps archived). An as-of join: both are marks on a target's line of time, and each run takes
    the last version before or at it. Null where there is none."""
    archived = F.col("archived") if "archived" in scopes.columns else F.lit(False)
    marks = scopes.select("target_id", F.col("valid_from").alias("_at"), F.struct("scope_version", archived.alias("archived")).alias("_version"))
    both = runs.withColumn("_at", F.col("observed_at")).withColumn("_run", F.lit(1))
    both = both.unionByName(marks.withColumn("_run", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy("target_id").orderBy("_at", "_run").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("_version", ignorenulls=True).over(w)
    found = both.withColumn("_last", last).where("_run = 1")
    return found.select(*runs.columns, F.col("_last.scope_version").alias("scope_now"), F.coalesce("_last.archived", F.lit(False)).alias("archived"))


def stream_adopt(
    obs: DataFrame, folder: str, checkpoint: str, least: int = 100, ratio: float = 0.3, ttl_hours: float = adopt.TTL_HOURS,
    scopes: DataFrame | None = None, buckets: int = BUCKETS,
) -> StreamingQuery:
    """Adopts complete observations (SITE, run_id, observed_at, url, url_hash, perhaps origin_baseline_run_id) as they come; a
    run that found no URL is one row with a null url_hash.

    Below folder, in buckets by SITE: state, heads (of each target the baseline, the open candidate and the moment of the
    last run) and held (the candidates' URLs); events, decisions; and stale: runs that change nothing, with a reason:
    late (not later than their target's last one), scope (their target's scope moved on, or it is archived, by scopes:
    see in_force) or baseline (that in force isn't the one they were made from). A micro-batch's runs are decided in order and
    applied in one pass (adopt.apply_runs); it reads and writes the buckets of its targets only. Bucket versions are by
    batch id, and events are appended by id, so a repeated batch is harmless.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        bucket = by_hash(SITE, buckets)
        only = touched(batch, bucket)
        old = lambda name, schema: read_buckets(spark, f"{folder}/{name}", schema, only, batch_id)
        put = lambda df, name: write_buckets(df, f"{folder}/{name}", bucket, batch_id, only)
        state = old("state", adopt.empty_state(batch).schema)
        heads, held = old("heads", HEADS), old("held", HELD)
        made_from = ["origin_baseline_run_id"] if "origin_baseline_run_id" in batch.columns else []
        runs = batch.select(*SITE, "run_id", "observed_at", *made_from).distinct().join(heads.select(*SITE, "last_at"), SITE, "left")
        reason = F.when(F.col("observed_at") <= F.col("last_at"), "late")
        if scopes is not None:
            runs = in_force(runs, scopes)
            moved = F.col("archived") | ~F.coalesce(F.col("scope_now") == F.col("scope_version"), F.lit(True))
            reason = F.when(moved, "scope").otherwise(reason)
        judged = stored(runs.withColumn("reason", reason), "judged")
        runs = stored(judged.where("reason IS NULL").select(*SITE, "run_id", "observed_at", *made_from), "runs")
        # refused runs are few and their table is broadcast then, so observations aren't dealt by run to be told apart
        refused = judged.where("reason IS NOT NULL").select(*SITE, "run_id").distinct()
        refused = stored(refused.join(runs.select(*SITE, "run_id"), [*SITE, "run_id"], "left_anti"), "refused")
        rows = batch.where("url_hash IS NOT NULL").join(refused, [*SITE, "run_id"], "left_anti")
        # the baseline's URLs are those last seen by it; one that found none is a row without a URL
        base = heads.where("baseline_run_id IS NOT NULL").select(*SITE, F.col("baseline_run_id").alias("run_id"), F.col("baseline_at").alias("observed_at"))
        there = state.select(*SITE, "url_hash", F.col("last_seen_at").alias("observed_at"))
        base = base.join(there, [*SITE, "observed_at"], "left").withColumn("role", F.lit("base"))
        open_ = heads.where("candidate_run_id IS NOT NULL").select(*SITE, F.col("candidate_run_id").alias("run_id"), F.col("candidate_at").alias("observed_at"))
        mine = open_.join(held.select(*SITE, "run_id", "url_hash"), [*SITE, "run_id"], "left").withColumn("role", F.lit("held"))
        decided = adopt.decide_history(rows, runs, least, ratio, ttl_hours, base.unionByName(mine))
        kinds = decided.schema
        decided.write.mode("overwrite").parquet(f"{folder}/decisions/b={batch_id}")
        decided = spark.read.schema(kinds).parquet(f"{folder}/decisions/b={batch_id}")
        stale = judged.where("reason IS NOT NULL").select(*SITE, "run_id", "observed_at", "reason")
        rebased = decided.where("decision = 'stale'").select(*SITE, "run_id", "observed_at", F.lit("baseline").alias("reason"))
        stale.unionByName(rebased).write.mode("overwrite").parquet(f"{folder}/stale/b={batch_id}")
        taken = adopt.adopted_runs(decided)
        both = rows.select(*held.columns).unionByName(held)
        new, events = adopt.apply_runs(state, both, taken, write=True)
        put(new, "state")
        write_events(events, f"{folder}/events")
        after = stored(_heads(heads, decided, runs), "heads")
        put(after, "heads")
        named = after.select(*SITE, F.col("candidate_run_id").alias("run_id")).where("run_id IS NOT NULL")
        put(both.join(named, [*SITE, "run_id"], "left_semi"), "held")

    return obs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


HEADS = (
    "website_id string, target_id string, scope_version int, baseline_run_id string, baseline_at timestamp,"
    " candidate_run_id string, candidate_at timestamp, last_at timestamp"
)


def _heads(heads: DataFrame, decided: DataFrame, runs: DataFrame) -> DataFrame:
    """The targets' heads after a batch: the last run that moved the baseline, and the candidate still open."""
    moved = F.col("decision").isin("baseline", "applied")
    at = F.struct("observed_at", "run_id")
    # a candidate that opened is still open unless its target's later runs met it otherwise than too soon
    opened = (F.col("decision") == "quarantined") & ~F.coalesce(F.col("outcome") == "quarantined", F.lit(False))
    last = decided.groupBy(*SITE).agg(
        F.max(F.when(moved, at)).alias("_base"),
        F.max(F.when(opened, at)).alias("_open"),
        F.max(F.when(F.col("outcome").isin("confirmed", "missing_set_changed", "expired"), F.col("observed_at"))).alias("_closed"),
        F.max("observed_at").alias("_last"),
    )
    both = heads.join(last, SITE, "full")
    fresh = F.col("_open.observed_at").isNotNull() & ~F.coalesce(F.col("_open.observed_at") < F.col("_closed"), F.lit(False))
    kept = F.col("_closed").isNull()
    choose = lambda new, old: F.when(fresh, F.col(new)).when(kept, F.col(old))
    return both.select(
        *SITE,
        F.coalesce("_base.run_id", "baseline_run_id").alias("baseline_run_id"),
        F.coalesce("_base.observed_at", "baseline_at").alias("baseline_at"),
        choose("_open.run_id", "candidate_run_id").alias("candidate_run_id"),
        choose("_open.observed_at", "candidate_at").alias("candidate_at"),
        F.greatest("_last", "last_at").alias("last_at"),
    )


#: Moments are microseconds.
LIFECYCLE = "website_id string, scope_version int, bucket int, url_hash string, kind string, url string, run_id string, at long"
HOUR_MICROS = 3_600_000_000
#: Buckets of sites and how many of their runs have ended; their URLs (_site: the number of the bucket in the lists before):
#: hash, status, first missing run and its moment (0: none), text; and those of runs without an end: run, hash, text.
URL_STATE = (
    "websites array<string>, scopes array<int>, buckets array<int>, ended array<long>,"
    " url_site array<int>, hashes array<string>, statuses array<string>, firsts array<string>, first_ats array<long>, urls array<string>,"
    " waiting_site array<int>, waiting_runs array<string>, waiting_hashes array<string>, waiting_urls array<string>"
)


class _Bucket:
    """A bucket of a site's URLs: n, how many runs have ended; urls, of each its status, the run that first missed it, that
    one's moment, and its text; seen, the URLs of runs whose end hasn't come yet."""

    def __init__(self, n: int = 0):
        self.n, self.urls, self.seen, self.ends = n, {}, {}, set()

    def apply(self) -> Iterator[tuple]:
        """The events of runs whose end has come: their URLs are present, and every other one of the bucket is absent."""
        urls = self.urls
        for at, run in sorted(self.ends):
            here = self.seen.pop(run, {})
            for h, url in here.items():
                status = urls[h][0] if h in urls else None
                kind = "reappeared" if status == "removed" else "added" if status is None and self.n else None
                urls[h] = ("active", "", 0, url)
                if kind:
                    yield h, kind, url, run, at
            for h in urls.keys() - here.keys():
                status, first, first_at, url = urls[h]
                if status == "active":
                    urls[h] = ("pending_removed", run, at, url)
                elif status == "pending_removed" and first != run and at - first_at >= HOUR_MICROS:
                    urls[h] = ("removed", first, first_at, url)
                    yield h, "removed", url, run, at
            self.n += 1


def _lifecycle(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The buckets of a shard. Their state comes and goes as one row, so neither a site nor a URL costs a call of its own."""
    found: dict[tuple, _Bucket] = {}
    if state.exists:
        columns = state.get
        for *site, n in zip(*columns[:4], strict=True):
            found[tuple(site)] = _Bucket(n)
        order = list(found.values())
        for k, h, *value in zip(*columns[4:10], strict=True):
            order[k].urls[h] = tuple(value)
        for k, run, h, url in zip(*columns[10:], strict=True):
            order[k].seen.setdefault(run, {})[h] = url
    for pdf in frames:
        rows = (pdf[c].tolist() for c in ("website_id", "scope_version", "bucket", "run_id", "at", "url", "url_hash"))
        for website, scope, bucket, run, at, url, h, end in zip(*rows, pdf["url_hash"].isna().tolist(), strict=True):
            mine = found.get((website, scope, bucket))
            if mine is None:
                mine = found[website, scope, bucket] = _Bucket()
            if end:
                mine.ends.add((at, run))
            else:
                mine.seen.setdefault(run, {})[h] = url
    out = [(*site, *event) for site, mine in found.items() for event in mine.apply()]
    turned = lambda rows, width: map(list, zip(*rows, strict=True)) if rows else ([] for _ in range(width))
    known = [(k, h, *value) for k, mine in enumerate(found.values()) for h, value in mine.urls.items()]
    waiting = [(k, run, h, url) for k, mine in enumerate(found.values()) for run, there in mine.seen.items() for h, url in there.items()]
    sites = [(*site, mine.n) for site, mine in found.items()]
    state.update((*turned(sites, 4), *turned(known, 6), *turned(waiting, 4)))
    if out:
        yield pd.DataFrame(out, columns=[c.split()[0] for c in LIFECYCLE.split(", ")])


#: A provider of state that keeps it on disk, for states larger than the executors' memory.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_url_lifecycle(obs: DataFrame, buckets: int = 16, shards: int = 1_024) -> DataFrame:
    """Events of a stream of observations (website_id, scope_version, run_id, observed_at, url, url_hash) as a scan gives them:
    the URLs that were there. A run ends with a row without a URL, which comes with its last rows or after them; that is
    when the URLs it doesn't have are found absent. Runs of a site end in order of time.

    The URLs of each site and scope are spread over buckets, and an end goes to every bucket. State is a row for each shard of
    all these buckets: a batch reads and writes the shards of its sites whole, in memory one at a time for a task, so more URLs
    than some hundred millions need more shards.
    """
    bucket = F.pmod(F.xxhash64("url_hash"), F.lit(buckets)).cast("int")
    ends = F.when(F.col("url_hash").isNull(), F.sequence(F.lit(0), F.lit(buckets - 1))).otherwise(F.array(bucket))
    rows = obs.select("website_id", "scope_version", F.explode(ends).alias("bucket"), "run_id", F.unix_micros("observed_at").alias("at"), "url", "url_hash")
    shard = F.pmod(F.xxhash64("website_id", "scope_version", "bucket"), F.lit(shards)).cast("int")
    events = rows.withColumn("shard", shard).groupBy("shard").applyInPandasWithState(
        _lifecycle, LIFECYCLE, URL_STATE, "append", GroupStateTimeout.NoTimeout
    )
    return events.select(*events.columns[:-1], F.timestamp_micros("at").alias("observed_at"))


def _close(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One target's candidates. State: ids, scopes and deadlines (milliseconds; -1 of adopted ones) of those still open."""
    open_ = dict(zip(state.get[0], zip(*state.get[1:], strict=True), strict=True)) if state.exists else {}
    out: list[tuple[str, str]] = []
    # ids by deadline and by scope, so that a row meets only the candidates it closes; a deadline that was replaced is passed over
    due = [(end, i) for i, (_, end) in open_.items() if end >= 0]
    heapq.heapify(due)
    by_scope: dict[int, set] = {}
    for i, (scope, _) in open_.items():
        by_scope.setdefault(scope, set()).add(i)

    def put(i: str, scope: int, end: int) -> None:
        drop(i)
        open_[i] = (scope, end)
        by_scope.setdefault(scope, set()).add(i)
        if end >= 0:
            heapq.heappush(due, (end, i))

    def drop(i: str) -> None:
        if (was := open_.pop(i, None)) is not None:
            by_scope[was[0]].discard(i)

    def until(moment: float) -> None:
        while due and due[0][0] <= moment:
            end, i = heapq.heappop(due)
            if i in open_ and open_[i][1] == end:
                drop(i)
                out.append((i, "expired"))

    if state.hasTimedOut:
        until(state.getCurrentWatermarkMs())
    else:
        for r in pd.concat(list(frames)).sort_values(["updated_at", "id"], na_position="first").itertuples():
            until(r.updated_at.timestamp() * 1000)
            if r.status is None:
                for scope in [s for s in by_scope if s != r.scope_version]:
                    for i in by_scope.pop(scope):
                        del open_[i]
                        out.append((i, "stale"))
            elif r.status == "pending":
                put(r.id, int(r.scope_version), int(r.expires_at.timestamp() * 1000))
            else:
                drop(r.id)
                out.append((r.id, r.status))
                if r.status == "adopted":
                    put(r.id, int(r.scope_version), -1)
    if open_:
        state.update((list(open_), [s for s, _ in open_.values()], [e for _, e in open_.values()]))
        ends = [e for _, e in open_.values() if e >= 0]
        if ends:
            state.setTimeoutTimestamp(max(min(ends), state.getCurrentWatermarkMs() + 1))
    elif state.exists:
        state.remove()
    yield pd.DataFrame(out, columns=["id", "status"])


def stream_candidate_expiry(candidates: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """id, status: pending candidates expire when event time passes their deadline, adopted ones never do, and both are stale
    when their target's scope moves on before that.

    candidates: target_id, id, status, scope_version, updated_at, expires_at; a change of scope is a row without id and status,
    with the new scope. Keyed by target, as a change closes all of a target's open candidates.
    """
    return candidates.withWatermark("updated_at", delay).groupBy("target_id").applyInPandasWithState(
        _close, "id string, status string", "ids array<string>, scopes array<int>, ends array<long>", "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def stream_event_counts(events: DataFrame, window: str = "1 day", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Events per website, kind and window, tumbling or sliding; rows later than delay are dropped by the watermark."""
    w = F.window("observed_at", window, slide) if slide else F.window("observed_at", window)
    counted = events.withWatermark("observed_at", delay).groupBy(w, "website_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), "website_id", "kind", "n")


def stream_dedupe_events(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event id once, however often it is delivered within the delay."""
    return events.withWatermark("observed_at", delay).dropDuplicatesWithinWatermark(["id"])


def _on_change(fields: tuple[str, ...], emits: Callable[[tuple, tuple], bool]):
    def fold(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        # rows that share moment and id are in order of what is compared, not of how they arrive
        rows = pd.concat(list(frames)).sort_values(["taken", "id", *fields], na_position="first")
        out = []
        for r in rows.itertuples():
            now = tuple(None if pd.isna(x) else x for x in (getattr(r, f) for f in fields))
            if last is not None and emits(last, now):
                out.append((*key, r.id))
            last = now
        state.update(last)
        yield pd.DataFrame(out, columns=["page", "id"])

    return fold


def stream_content_changes(snaps: DataFrame) -> DataFrame:
    """page, id of snapshots (page, id, taken, hash) whose hash differs from the page's last; none for the first."""
    fold = _on_change(("hash",), lambda a, b: a != b)
    return snaps.groupBy("page").applyInPandasWithState(
        fold, "page string, id long", "hash string", "append", GroupStateTimeout.NoTimeout
    )


def stream_price_changes(snaps: DataFrame) -> DataFrame:
    """page, id of product snapshots (page, id, taken, is_product_page, currency, price) whose price or currency
    differs from the last, both being product pages."""

    def emits(a: tuple, b: tuple) -> bool:
        return bool(a[0] and b[0]) and ((a[1] or "") != (b[1] or "") or a[2] != b[2])

    fold = _on_change(PRICE_TIES, emits)
    return snaps.groupBy("page").applyInPandasWithState(
        fold, "page string, id long", "is_product_page boolean, currency string, price double", "append",
        GroupStateTimeout.NoTimeout,
    )


def run_to_table(df: DataFrame, path: str, mode: str = "append", provider: str | None = None) -> DataFrame:
    """Runs a stream over what is there and returns what it wrote below path. provider: of the stream's state, if it isn't the
    session's."""
    if provider is not None:
        conf, name = df.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
        before = conf.get(name)
        conf.set(name, provider)
        try:
            return run_to_table(df, path, mode)
        finally:
            conf.set(name, before)
    q = df.writeStream.format("parquet").option("checkpointLocation", f"{path}/_checkpoint").outputMode(mode)
    q.trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/out")


def file_stream(spark: SparkSession, folder: str, schema, files: int = 4) -> DataFrame:
    """A stream over a folder of Parquet files, so many per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
