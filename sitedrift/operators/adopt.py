"""Adopting observations: the decision, the apply step, candidates, and whole histories by their changes."""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timing import candidate_expiry, suspicious
from ..scratch import partitions, stored
from .inventory import HOUR, numbered_runs, replay_url_lifecycle, successors

SITE = ["website_id", "target_id", "scope_version"]
STATE = [
    *SITE, "url", "url_hash", "status", "first_seen_at", "last_seen_at", "first_missing_run_id",
    "first_missing_observed_at", "last_missing_run_id", "missing_confirmations", "removed_at",
]


def decide(baseline: DataFrame, obs: DataFrame, runs: DataFrame, least: int = 100, ratio: float = 0.3) -> DataFrame:
    """runs (one per target and scope) with previous, missing and current counts and the decision.

    baseline: target_id, scope_version, url_hash of the run in force, an empty one as one row with a null url_hash. No
    row: there is no baseline and the run becomes it. A suspicious loss: quarantined.
    """
    key = ["target_id", "scope_version"]
    has = baseline.select(*key).distinct().withColumn("_has", F.lit(True))
    baseline, obs = baseline.where("url_hash IS NOT NULL"), obs.where("url_hash IS NOT NULL")
    both = (
        baseline.select(*key, "url_hash").distinct().withColumn("_b", F.lit(1))
        .join(obs.select(*key, "url_hash").distinct().withColumn("_o", F.lit(1)), [*key, "url_hash"], "full")
    )
    counts = both.groupBy(*key).agg(
        F.count("_b").alias("previous"),
        F.count_if(F.col("_o").isNull()).alias("missing"),
        F.count("_o").alias("current"),
    )
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("previous", "missing", "current")}
    out = runs.join(counts, key, "left").withColumns(zero).join(has, key, "left")
    return out.withColumn(
        "decision",
        F.when(F.col("_has").isNull(), "baseline")
        .when(suspicious(F.col("previous"), F.col("missing"), F.col("current"), least, ratio), "quarantined")
        .otherwise("applied"),
    ).drop("_has")


def apply_observation(state: DataFrame, obs: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new state, events) of one adopted run per target: a single full outer join of the state and the observation.

    runs: SITE, run_id, observed_at, is_baseline. Targets without a run keep their rows. Present URLs become active and
    lose their evidence; an absent active one is pending, a pending one removed if another run missed it an hour ago.
    """
    now = runs.select(*SITE, F.col("run_id").alias("_run"), F.col("observed_at").alias("_at"), "is_baseline")
    seen = obs.select(*SITE, "url_hash", F.col("url").alias("_url")).dropDuplicates([*SITE, "url_hash"])
    joined = state.join(seen, [*SITE, "url_hash"], "full").join(now, SITE, "left")
    here, known = F.col("_url").isNotNull(), F.col("status").isNotNull()
    ran = F.col("_run").isNotNull()
    missed = ran & ~here & (F.col("status") == "active")
    removed = (
        ran & ~here & (F.col("status") == "pending_removed") & (F.col("first_missing_run_id") != F.col("_run"))
        & (F.col("first_missing_observed_at") + F.expr(HOUR) <= F.col("_at"))
    )

    def evidence(column: str, value: Column) -> Column:
        return F.when(here, None).when(missed, value).otherwise(F.col(column))

    new = joined.select(
        *SITE,
        F.coalesce("url", "_url").alias("url"),
        "url_hash",
        F.when(here, "active").when(missed, "pending_removed").when(removed, "removed").otherwise(F.col("status")).alias("status"),
        F.when(known, F.col("first_seen_at")).otherwise(F.col("_at")).alias("first_seen_at"),
        F.when(here, F.col("_at")).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        evidence("first_missing_run_id", F.col("_run")).alias("first_missing_run_id"),
        evidence("first_missing_observed_at", F.col("_at")).alias("first_missing_observed_at"),
        F.when(here, None).when(missed | removed, F.col("_run")).otherwise(F.col("last_missing_run_id")).alias("last_missing_run_id"),
        F.when(here, 0).when(missed, 1).when(removed, 2).otherwise(F.col("missing_confirmations")).alias("missing_confirmations"),
        F.when(here, None).when(removed, F.col("_at")).otherwise(F.col("removed_at")).alias("removed_at"),
    )
    kind = (
        F.when(F.col("is_baseline"), None)
        .when(here & ~known, "added")
        .when(here & (F.col("status") == "removed"), "reappeared")
        .when(removed, "removed")
    )
    events = joined.withColumn("kind", kind).where(F.col("kind").isNotNull())
    events = events.select(
        *SITE, F.coalesce("url", "_url").alias("url"), "url_hash", "kind", F.col("_run").alias("run_id"),
        F.col("_at").alias("observed_at"), F.concat_ws(":", "_run", "url_hash", "kind").alias("id"),
    )
    return new, events


def adopt_observation(
    state: DataFrame, baseline: DataFrame, obs: DataFrame, runs: DataFrame, least: int = 100, ratio: float = 0.3
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new state, events, decisions) of one complete run per target; quarantined runs leave their rows alone."""
    decisions = decide(baseline, obs, runs, least, ratio)
    taken = decisions.where("decision <> 'quarantined'").withColumn("is_baseline", F.col("decision") == "baseline")
    rows = obs.join(taken.select(*SITE), SITE, "left_semi")
    new, events = apply_observation(state, rows, taken)
    return new, events, decisions


def apply_runs(state: DataFrame, obs: DataFrame, runs: DataFrame, write: bool = False) -> tuple[DataFrame, DataFrame]:
    """(new state, events) after any number of adopted runs per target, in order of time: what apply_observation gives run by run.

    In closed form: a URL's presences follow each other in a window, the first being its row of state, as if a run before all
    others had seen it. What becomes of a URL after a presence depends on the next one, on the run after it and on the first
    run an hour later (inventory.successors); so rows are as many as presences, and runs that a URL is absent from cost nothing.
    runs: SITE, run_id, observed_at, is_baseline; a run without observed URLs is an empty one, and observations of other runs are
    left out. write: for callers that use both tables, what they are made of is written first.
    """
    rows = _applied(state, obs, runs)
    rows = stored(rows, "applied") if write else rows
    new = rows.where("_s IS NOT NULL").select(*SITE, "url", "url_hash", *(F.col(f"_s.{c}").alias(c) for c in STATE[5:]))
    events = rows.select(*SITE, "url", "url_hash", F.explode("_e").alias("e")).select(*SITE, "url", "url_hash", "e.*")
    return new.select(*STATE), events.withColumn("id", F.concat_ws(":", "run_id", "url_hash", "kind"))


def _applied(state: DataFrame, obs: DataFrame, runs: DataFrame) -> DataFrame:
    """SITE, url, url_hash, _e, _s: the events of each presence, and of the last one the URL's new state."""
    n, pending = partitions(obs.sparkSession), "pending_removed"
    start = (F.min("observed_at") - F.expr("INTERVAL 1 DAY")).alias("observed_at")
    before = runs.groupBy(*SITE).agg(start).withColumns({"run_id": F.lit(""), "is_baseline": F.lit(False)})
    runs = runs.select(*SITE, "run_id", "observed_at", "is_baseline")
    after = stored(successors(runs.unionByName(before)).withColumnRenamed("observed_at", "at").drop("website_id"), "successors")
    key, now = ["target_id", "scope_version"], [c for c in after.columns if c not in ("target_id", "scope_version", "run_id")]
    seen = obs.where("url_hash IS NOT NULL").select(*SITE, "run_id", "url", "url_hash").repartition(n, *key, "run_id")
    seen = seen.join(after.where("run_id <> ''"), [*key, "run_id"])

    # the first run that a URL still pending is absent from an hour after it was first missed
    kept = state.where("status IS NOT NULL").select(*SITE, "url", "url_hash", F.struct(*STATE[5:]).alias("_old"))
    since = kept.where(F.col("_old.status") == pending).select(*key, F.col("_old.first_missing_run_id").alias("_run"), F.col("_old.first_missing_observed_at").alias("_since")).distinct()
    numbered = after.where("run_id <> ''").select(*key, F.struct("seq", F.col("run_id").alias("id"), "at", "is_baseline").alias("r"))
    late = (F.col("r.id") != F.col("_run")) & (F.col("_since") + F.expr(HOUR) <= F.col("r.at"))
    second = since.join(numbered, key).where(late).groupBy(*key, "_run", "_since").agg(F.min("r").alias("_second"))
    kept = kept.withColumns({"_run": F.when(F.col("_old.status") == pending, F.col("_old.first_missing_run_id")), "_since": F.when(F.col("_old.status") == pending, F.col("_old.first_missing_observed_at"))})
    kept = kept.join(second, [*key, "_run", "_since"], "left").join(after.where("run_id = ''").drop("run_id"), key, "left")
    again = F.col("_old.status") == pending
    confirmed = {"confirmed_seq": "seq", "confirmed_run_id": "id", "confirmed_at": "at", "confirmed_is_baseline": "is_baseline"}
    kept = kept.withColumns(
        {
            **{c: F.when(again, F.col(f"_second.{k}")).when(F.col("_old.status") == "active", F.col(c)) for c, k in confirmed.items()},
            "seq": F.lit(0), "at": F.col("_old.last_seen_at"), "run_id": F.lit(""), "is_baseline": F.lit(False),
        }
    )
    names = [*SITE, "url", "url_hash", "run_id", *now]
    rows = seen.select(*names).unionByName(kept.select(*names, "_old"), allowMissingColumns=True).repartition(n, *SITE, "url_hash")

    w = Window.partitionBy(*SITE, "url_hash").orderBy("seq")
    # a URL that a run has twice counts once
    rows = rows.withColumn("_twice", F.lag("seq").over(w).eqNullSafe(F.col("seq"))).where("NOT _twice")
    following = {"next_seq": "seq", "next_run_id": "run_id", "next_at": "at", "next_is_baseline": "is_baseline"}
    rows = rows.withColumns(
        {
            "prev_seq": F.lag("seq").over(w),
            "first_seen_at": F.first(F.coalesce("_old.first_seen_at", "at")).over(w),
            **{c: F.lead(k).over(w) for c, k in following.items()},
        }
    )
    was = F.coalesce("_old.status", F.lit("active"))
    gap = (was != "active") | F.coalesce(F.col("next_seq") > F.col("seq") + 1, F.col("first_missing_at").isNotNull())
    sure = gap & F.coalesce(F.col("confirmed_seq") < F.col("next_seq"), F.col("confirmed_seq").isNotNull())
    rows = rows.withColumns({"_was": was, "_gap": gap, "_sure": sure})
    sure, gap, gone = F.col("_sure"), F.col("_gap"), F.col("_sure") | (F.col("_was") == "removed")

    def event(condition: Column, kind: str, run: str, at: str) -> Column:
        return F.when(condition, F.struct(F.lit(kind).alias("kind"), F.col(run).alias("run_id"), F.col(at).alias("observed_at")))

    events = F.array_compact(
        F.array(
            event(F.col("prev_seq").isNull() & F.col("_old").isNull() & ~F.col("is_baseline"), "added", "run_id", "at"),
            event(sure & ~F.col("confirmed_is_baseline"), "removed", "confirmed_run_id", "confirmed_at"),
            event(gone & F.col("next_seq").isNotNull() & ~F.col("next_is_baseline"), "reappeared", "next_run_id", "next_at"),
        )
    )
    missed = gap & (F.col("_was") == "active")
    last = {
        "status": F.when(gone, "removed").when(gap, pending).otherwise("active"),
        "first_seen_at": F.col("first_seen_at"),
        "last_seen_at": F.col("at"),
        "first_missing_run_id": F.when(missed, F.col("first_missing_run_id")).otherwise(F.col("_old.first_missing_run_id")),
        "first_missing_observed_at": F.when(missed, F.col("first_missing_at")).otherwise(F.col("_old.first_missing_observed_at")),
        "last_missing_run_id": F.when(sure, F.col("confirmed_run_id")).when(missed, F.col("first_missing_run_id")).otherwise(F.col("_old.last_missing_run_id")),
        "missing_confirmations": F.when(sure, 2).when(missed, 1).otherwise(F.coalesce("_old.missing_confirmations", F.lit(0))),
        "removed_at": F.when(sure, F.col("confirmed_at")).otherwise(F.col("_old.removed_at")),
    }
    kinds = {f.name: f.dataType for f in state.select(*STATE[5:]).schema.fields}
    made = F.struct(*(last[c].cast(kinds[c]).alias(c) for c in STATE[5:]))
    return rows.select(*SITE, "url", "url_hash", events.alias("_e"), F.when(F.col("next_seq").isNull(), made).alias("_s"))


DECIDED = (
    "website_id string, target_id string, scope_version int, run_id string, observed_at timestamp, decision string,"
    " baseline_run_id string, candidate_run_id string, outcome string, candidate_status string, original_missing_count long,"
    " pending_count long, recovered_count long, removed_count long, expires_at timestamp, last_confirmation_run_id string"
)
#: Stands for any baseline, where runs don't tell theirs.
ANY = "*"
FIELDS = [tuple(f.split()) for f in DECIDED.split(", ")]
CANDIDATE = (
    "candidate_status", "original_missing_count", "pending_count", "recovered_count", "removed_count", "expires_at", "last_confirmation_run_id",
)
#: Hours after which an unconfirmed candidate expires: the shortest that a target's interval can give.
TTL_HOURS = 72.0


def with_expiry(runs: DataFrame, targets: DataFrame) -> DataFrame:
    """runs with expires_at, the end of a candidate that each of them would open: by the interval of its target
    (target_id, checkIntervalHours)."""
    hours = targets.select("target_id", F.col("checkIntervalHours").alias("_hours"))
    return runs.join(hours, "target_id", "left").withColumn("expires_at", candidate_expiry(F.col("observed_at"), F.col("_hours"))).drop("_hours")


def change_log(obs: DataFrame, runs: DataFrame) -> DataFrame:
    """SITE, seq, u, added: what each run after the first of its target has that the one before it lacks (added), or lacks.
    u: 64 bits of a URL's hash. runs: SITE, run_id, seq.

    One window over presences by URL. What stays is nowhere in the log, so it is as large as the changes are. Only those 64 bits
    move, and rows are dealt into the session's partitions, never fewer: they are small when shuffled and large when sorted.
    """
    n = partitions(obs.sparkSession)
    seen = obs.where("url_hash IS NOT NULL").select(*SITE, "run_id", F.xxhash64("url_hash").alias("u")).repartition(n, *SITE, "run_id")
    seen = seen.join(runs.select(*SITE, "run_id", "seq"), [*SITE, "run_id"]).repartition(n, *SITE, "u")
    w = Window.partitionBy(*SITE, "u").orderBy("seq")
    came = (F.col("seq") > 0) & F.coalesce(F.lag("seq").over(w) < F.col("seq") - 1, F.lit(True))
    went = F.coalesce(F.lead("seq").over(w) > F.col("seq") + 1, F.lit(True))
    marked = seen.select(*SITE, "seq", "u", came.alias("came"), went.alias("went")).where("came OR went")
    change = lambda seq, added: F.struct(seq.alias("seq"), F.lit(added).alias("added"))
    both = F.array_compact(F.array(F.when(F.col("came"), change(F.col("seq"), True)), F.when(F.col("went"), change(F.col("seq") + 1, False))))
    return marked.select(*SITE, "u", F.explode(both).alias("c")).select(*SITE, "c.seq", "u", "c.added")


def decide_history(
    obs: DataFrame, runs: DataFrame, least: int = 100, ratio: float = 0.3, ttl_hours: float = TTL_HOURS, prior: DataFrame | None = None
) -> DataFrame:
    """DECIDED rows, one for each run in order of time, where a quarantine may be confirmed by a later equal loss.

    baseline_run_id is the one in force when the run came. candidate_run_id and outcome: the candidate that was open then
    and what became of it: confirmed (decision of its own run turns to first_observation), quarantined (too soon),
    missing_set_changed, expired. A run that opened a candidate also tells how that ended (CANDIDATE, see
    candidate_rows). runs may have expires_at, the end of a candidate that the run would open; else ttl_hours count. They may
    have origin_baseline_run_id, the baseline they were made from: a run for which another one is in force by then is
    stale and changes nothing.
    prior: the sets (SITE, run_id, observed_at, role, url_hash, null if empty, perhaps expires_at) of the baseline and of
    the open candidate that targets already have (role base, held).

    Each run is compared with the one before it by the log of changes. Targets without a suspicious step and without an
    open candidate adopt every run, and are done as sets. The runs of the others are folded in order: a task reads the
    changes of one target's runs after the other's, not their sets, and the fold keeps counts and the URLs that differ from the
    baseline.
    """
    ends = "expires_at" if "expires_at" in runs.columns else None
    until = F.col(ends) if ends else F.timestamp_millis(F.unix_millis("observed_at") + F.lit(int(ttl_hours * 3_600_000)))
    made_from = F.col("origin_baseline_run_id") if "origin_baseline_run_id" in runs.columns else F.lit(ANY)
    asked = runs.select(*SITE, "run_id", "observed_at", until.alias("expires_at"), F.lit(False).alias("known"), made_from.alias("made_from"))
    rows = obs.select(*SITE, "run_id", "url_hash")
    held = None
    if prior is not None:
        prior = stored(prior.join(runs.select(*SITE).distinct(), SITE, "left_semi"), "prior")
        base = prior.where("role = 'base'")
        none = F.lit(None).cast("timestamp").alias("expires_at")
        asked = asked.unionByName(base.select(*SITE, "run_id", "observed_at", none, F.lit(True).alias("known"), F.lit(ANY).alias("made_from")).distinct())
        rows = rows.unionByName(base.select(*SITE, "run_id", "url_hash"))
        held = _held_losses(prior, until)
    numbered = stored(numbered_runs(asked), "numbered")
    changes = stored(change_log(rows, numbered), "changes")
    sizes = rows.where("url_hash IS NOT NULL").groupBy(*SITE, "run_id").agg(F.count(F.lit(1)).alias("n"))
    moved = changes.groupBy(*SITE, "seq").agg(F.count_if(~F.col("added")).alias("missing"))
    steps = numbered.join(sizes, [*SITE, "run_id"], "left").join(moved, [*SITE, "seq"], "left").fillna(0, ["n", "missing"])
    w = Window.partitionBy(*SITE).orderBy("seq")
    steps = steps.withColumns({"previous": F.lag("n").over(w), "before": F.lag("run_id").over(w)})
    odd = F.coalesce(suspicious(F.col("previous"), F.col("missing"), F.col("n"), least, ratio), F.lit(False))
    odd = odd | ~(F.coalesce(F.col("made_from") == ANY, F.lit(False)) | F.col("made_from").eqNullSafe(F.col("before")))
    steps = stored(steps.withColumn("odd", odd), "steps")
    slow = steps.where("odd").select(*SITE)
    slow = (slow if held is None else slow.unionAll(held.select(*SITE))).distinct()
    empty = [F.lit(None).cast(kind).alias(name) for name, kind in FIELDS[7:]]
    fast = steps.where("NOT known").join(slow, SITE, "left_anti").select(
        *SITE, "run_id", "observed_at", F.when(F.col("seq") == 0, "baseline").otherwise("applied").alias("decision"),
        F.col("before").alias("baseline_run_id"), *empty,
    )
    return fast.unionByName(_in_order(steps.join(slow, SITE, "left_semi"), changes, held, least, ratio))


def _held_losses(prior: DataFrame, until: Column) -> DataFrame:
    """SITE, held_run, held_at, held_until, held_lost: the open candidate of each target, and the hashes of what it misses of the
    baseline."""
    open_ = prior.where("role = 'held'")
    stay = F.col("expires_at") if "expires_at" in prior.columns else until
    head = open_.select(*SITE, F.col("run_id").alias("held_run"), F.col("observed_at").alias("held_at"), stay.alias("held_until")).distinct()
    base = prior.where("role = 'base' AND url_hash IS NOT NULL").select(*SITE, "url_hash")
    lost = base.join(head.select(*SITE), SITE, "left_semi").join(open_.select(*SITE, "url_hash"), [*SITE, "url_hash"], "left_anti")
    lost = lost.groupBy(*SITE).agg(F.collect_set(F.xxhash64("url_hash")).alias("held_lost"))
    return head.join(lost, SITE, "left")


def _in_order(steps: DataFrame, changes: DataFrame, held: DataFrame | None, least: int, ratio: float) -> DataFrame:
    """DECIDED rows of the runs of steps, folded by target."""
    of = lambda added: F.collect_list(F.when(F.col("added") == F.lit(added), F.col("u")))
    moved = changes.groupBy(*SITE, "seq").agg(of(True).alias("came"), of(False).alias("went"))
    rows = steps.select(*SITE, "run_id", "observed_at", "expires_at", "known", "made_from", "seq", "n").join(moved, [*SITE, "seq"], "left")
    if held is None:
        kinds = "struct<held_run: string, held_at: timestamp, held_until: timestamp, held_lost: array<bigint>>"
        rows = rows.select("*", F.lit(None).cast(kinds).alias("h")).select(*rows.columns, "h.*")
    else:
        rows = rows.join(held, SITE, "left")
    names = [*SITE, "run_id", "observed_at", "expires_at", "known", "made_from", "seq", "n", "came", "went", "held_run", "held_at", "held_until", "held_lost"]
    # by a hash of the target: dealt by its columns, as the join above, rows would stay in the join's partitions, and those are
    # merged where they are small, however long the folds in them take
    ordered = rows.select(*names).repartition(partitions(rows.sparkSession), F.xxhash64(*SITE)).sortWithinPartitions(*SITE, "seq")
    return ordered.mapInArrow(lambda batches: _fold_targets(batches, least, ratio), DECIDED)


#: Arrow types of DECIDED, and the rows of a batch of them.
ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "timestamp": pa.timestamp("us", "UTC")}
BATCH = 10_000


def _fold_targets(batches: Iterator[pa.RecordBatch], least: int, ratio: float) -> Iterator[pa.RecordBatch]:
    """The decisions on runs that come in order of target and seq: one target is at hand, and many make a batch."""
    runs = (r for b in batches for k in range(0, b.num_rows, 1_000) for r in b.slice(k, 1_000).to_pylist())
    done: list[dict] = []

    def batch() -> pa.RecordBatch:
        columns = [pa.array([row.get(name) for row in done], ARROW[kind]) for name, kind in FIELDS]
        done.clear()
        return pa.RecordBatch.from_arrays(columns, names=[name for name, _ in FIELDS])

    for site, mine in groupby(runs, key=lambda r: tuple(r[c] for c in SITE)):
        done += [dict(zip(SITE, site, strict=True), run_id=run, **row) for run, row in _fold_runs(mine, least, ratio).items()]
        if len(done) >= BATCH:
            yield batch()
    yield batch()


def _fold_runs(runs: Iterator[dict], least: int, ratio: float) -> dict[str, dict]:
    """The decisions on one target's runs. lost and gained: what the run at hand lacks of the baseline, and has beyond it."""
    made: dict[str, dict] = {}
    base, base_size = None, 0
    lost: set[int] = set()
    gained: set[int] = set()
    open_: dict | None = None

    def close(status: str, run: str | None, now: set[int]) -> None:
        """Of the candidate's URLs, those that the run at hand lacks too are pending, or removed with its confirmation."""
        nonlocal open_
        still = len(open_["lost"] & now)
        if (row := made.get(open_["run_id"])) is not None:
            row |= {
                "candidate_status": status, "last_confirmation_run_id": run, "recovered_count": len(open_["lost"]) - still,
                "pending_count": 0 if status == "confirmed" else still, "removed_count": still if status == "confirmed" else 0,
            }
        open_ = None

    for r in runs:
        run, at = r["run_id"], r["observed_at"]
        for u in r["went"] or ():
            gained.remove(u) if u in gained else lost.add(u)
        for u in r["came"] or ():
            lost.remove(u) if u in lost else gained.add(u)
        if r["made_from"] not in (ANY, base):
            made[run] = {"observed_at": at, "decision": "stale", "baseline_run_id": base}
            continue
        if base is None:
            base, base_size, lost, gained = run, r["n"], set(), set()
            if not r["known"]:
                made[run] = {"observed_at": at, "decision": "baseline"}
            elif r["held_run"] is not None:
                open_ = {"run_id": r["held_run"], "at": r["held_at"], "until": r["held_until"], "lost": set(r["held_lost"] or ())}
            continue
        row = made[run] = {"observed_at": at, "baseline_run_id": base, "candidate_run_id": open_ and open_["run_id"]}
        odd = base_size > 0 and (r["n"] == 0 or (len(lost) >= least and len(lost) / base_size >= ratio))
        if open_ and open_["until"] is not None and at >= open_["until"]:
            row["outcome"] = "expired"
            close("expired", None, open_["lost"])
        elif open_ and open_["lost"] != lost:
            row["outcome"] = "missing_set_changed"
            close("rejected", run, lost)
        elif open_:
            row["outcome"] = "confirmed" if at - open_["at"] >= datetime.timedelta(hours=1) else "quarantined"
        if row.get("outcome") == "confirmed":
            first = made.setdefault(open_["run_id"], {"observed_at": open_["at"], "baseline_run_id": base})
            first["decision"] = "first_observation"
            close("confirmed", run, lost)
            row["decision"] = "applied"
        elif row.get("outcome") == "quarantined":
            row["decision"] = "quarantined"
        elif odd:
            row["decision"] = "quarantined"
            open_ = {"run_id": run, "at": at, "until": r["expires_at"], "lost": set(lost)}
            row |= {
                "candidate_status": "pending", "original_missing_count": len(lost), "pending_count": len(lost), "recovered_count": 0,
                "removed_count": 0, "expires_at": r["expires_at"],
            }
        else:
            row["decision"] = "applied"
        if row["decision"] == "applied":
            base, base_size, lost, gained = run, r["n"], set(), set()
    return made


def candidate_rows(decisions: DataFrame) -> DataFrame:
    """removal_candidate rows of the runs that opened one: status pending, confirmed, rejected or expired, with counts of the
    URLs that are still missing, came back or were removed. A confirmed one was adopted with its own run and removed
    by the run that confirmed it, which misses the same URLs an hour later."""
    c = decisions.where("candidate_status IS NOT NULL")
    return c.select(
        "website_id", "target_id", "scope_version", F.col("run_id").alias("candidate_run_id"), F.col("baseline_run_id").alias("origin_baseline_run_id"),
        F.col("candidate_status").alias("status"), F.when(F.col("candidate_status") == "rejected", "missing_set_changed").alias("reason"),
        "original_missing_count", "pending_count", "recovered_count", "removed_count", "observed_at", "expires_at", "last_confirmation_run_id",
    )


def adopted_runs(decisions: DataFrame) -> DataFrame:
    """SITE, run_id, observed_at, is_baseline of the decided runs that change the inventory."""
    taken = decisions.where(F.col("decision").isin("baseline", "applied", "first_observation"))
    return taken.select(*SITE, "run_id", "observed_at", (F.col("decision") == "baseline").alias("is_baseline"))


def adopt_history(
    state: DataFrame, obs: DataFrame, runs: DataFrame, least: int = 100, ratio: float = 0.3, ttl_hours: float = TTL_HOURS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new state, events, decisions) of targets without a baseline: all their runs decided, then the adopted replayed in closed
    form. Rows of other targets stay as they are."""
    decisions = stored(decide_history(obs, runs, least, ratio, ttl_hours), "decisions")
    taken = adopted_runs(decisions)
    seen = obs.join(taken.select(*SITE, "run_id"), [*SITE, "run_id"], "left_semi").where("url_hash IS NOT NULL")
    new, events = replay_url_lifecycle(seen, taken)
    others = state.join(runs.select(*SITE).distinct(), SITE, "left_anti")
    return new.select(*STATE).unionByName(others.select(*STATE)), events, decisions


def empty_state(obs: DataFrame) -> DataFrame:
    """A state table without rows, its keys typed as in obs."""
    kinds = dict(obs.dtypes)
    keys = ", ".join(f"{c} {kinds[c]}" for c in SITE)
    rest = (
        "url string, url_hash string, status string, first_seen_at timestamp, last_seen_at timestamp,"
        " first_missing_run_id string, first_missing_observed_at timestamp, last_missing_run_id string,"
        " missing_confirmations int, removed_at timestamp"
    )
    return obs.sparkSession.createDataFrame([], f"{keys}, {rest}")


def candidate_resolution(candidates: DataFrame, missing: DataFrame, state: DataFrame) -> DataFrame:
    """Missing rows of adopted candidates with what the inventory says of them now."""
    held = candidates.where("status = 'adopted'").select(F.col("id").alias("candidate_id"), "target_id", "scope_version")
    now = state.select("target_id", "scope_version", "url_hash", F.col("status").alias("_now"))
    joined = missing.join(held, "candidate_id").join(now, ["target_id", "scope_version", "url_hash"], "left")
    resolution = (
        F.when(F.col("_now") == "removed", "removed").when(F.col("_now") == "active", "recovered").otherwise("pending")
    )
    return joined.withColumn("resolution", resolution).drop("_now")


def candidate_counts(resolution: DataFrame, now: Column) -> DataFrame:
    """Counts, status and next confirmation of each adopted candidate."""
    n = resolution.groupBy("candidate_id").agg(
        *(F.count_if(F.col("resolution") == r).alias(f"{r}_count") for r in ("pending", "removed", "recovered"))
    )
    pending = F.col("pending_count") > 0
    return n.withColumns(
        {
            "status": F.when(pending, "adopted").when(F.col("removed_count") > 0, "confirmed").otherwise("rejected"),
            "next_confirmation_at": F.when(pending, now + F.expr(HOUR)),
        }
    )


def close_candidates(candidates: DataFrame, targets: DataFrame, now: Column) -> DataFrame:
    """Pending candidates past their time expire; those whose scope or baseline moved on are stale; adopted ones are
    stale only when the scope changed."""
    t = targets.select(
        F.col("id").alias("target_id"), F.col("scope_version").alias("_scope"), F.col("baseline_run_id").alias("_base")
    )
    joined = candidates.join(t, "target_id", "left")
    moved = ~F.col("scope_version").eqNullSafe(F.col("_scope"))
    rebased = ~F.col("origin_baseline_run_id").eqNullSafe(F.col("_base"))
    status = (
        F.when((F.col("status") == "pending") & (moved | rebased), "stale")
        .when((F.col("status") == "adopted") & moved, "stale")
        .when((F.col("status") == "pending") & (F.col("expires_at") <= now), "expired")
        .otherwise(F.col("status"))
    )
    return joined.withColumn("status", status).drop("_scope", "_base")


def fresh_runs(runs: DataFrame, targets: DataFrame) -> DataFrame:
    """Runs whose target is unarchived and still at the run's scope and origin baseline."""
    t = targets.select(
        F.col("id").alias("target_id"), F.col("scope_version").alias("_scope"),
        F.col("baseline_run_id").alias("_base"), F.col("archived_at").alias("_archived"),
    )
    joined = runs.join(t, "target_id")
    same = F.col("origin_baseline_run_id").eqNullSafe(F.col("_base")) & (F.col("scope_version") == F.col("_scope"))
    return joined.where(same & F.col("_archived").isNull()).drop("_scope", "_base", "_archived")
