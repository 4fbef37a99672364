"""The closed-form replay, the apply step and a plain fold agree on random histories; decisions on known cases."""

import datetime
import random

from pyspark.sql import functions as F

from sitedrift.functions.timing import next_due_catch_up, suspicious
from sitedrift.operators import adopt
from sitedrift.operators import inventory as inv
from sitedrift.plans.upkeep import check_invariants
from sitedrift.scratch import stored
from sitedrift.sources import buckets
from sitedrift.streaming import jobs

T0 = datetime.datetime(2024, 1, 1)


def fold(runs):
    """runs: (run_id, at, set of urls) in order."""
    state, events = {}, set()
    for k, (run, at, urls) in enumerate(runs):
        for u in urls:
            if k and (u not in state or state[u][0] == "removed"):
                events.add((u, "added" if u not in state else "reappeared", run))
            state[u] = ("active", None, None)
        for u, (s, r0, t0) in list(state.items()):
            if u in urls:
                continue
            if s == "active":
                state[u] = ("pending_removed", run, at)
            elif s == "pending_removed" and r0 != run and at - t0 >= datetime.timedelta(hours=1):
                state[u] = ("removed", r0, t0)
                events.add((u, "removed", run))
    return {u: s[0] for u, s in state.items()}, events


def histories(n, seed=5):
    rng = random.Random(seed)
    out = {}
    for t in range(n):
        at, runs = T0, []
        for k in range(rng.randint(1, 7)):
            at += datetime.timedelta(seconds=rng.choice([1, 600, 3599, 3600, 7200]))
            runs.append((f"t{t}-{k}", at, {u for u in "abcde" if rng.random() < 0.6} or {"a"}))
        out[f"t{t}"] = runs
    return out


def frames(spark, hist):
    obs = [("w" + t, t, 1, r, at, u) for t, runs in hist.items() for r, at, urls in runs for u in sorted(urls)]
    run = [("w" + t, t, 1, r, at) for t, runs in hist.items() for r, at, _ in runs]
    site = "website_id string, target_id string, scope_version int, run_id string, observed_at timestamp"
    o = spark.createDataFrame(obs, site + ", url string").withColumn("url_hash", F.sha2("url", 256))
    return o, spark.createDataFrame(run, site)


def test_replay_steps_and_fold_agree(spark):
    hist = histories(25)
    obs, runs = frames(spark, hist)
    want_state, want_events = {}, set()
    for t, h in hist.items():
        s, e = fold(h)
        want_state |= {(t, u): x for u, x in s.items()}
        want_events |= {(t, *x) for x in e}
    marked = inv.numbered_runs(runs).withColumn("is_baseline", F.col("seq") == 0)

    def at_once(obs, runs):
        return adopt.apply_runs(adopt.empty_state(obs), obs, marked)

    def in_two_parts(obs, runs):
        state, early = adopt.apply_runs(adopt.empty_state(obs), obs, marked.where("seq < 2"))
        state, late = adopt.apply_runs(state, obs, marked.where("seq >= 2"))
        return state, early.unionByName(late)

    def one_by_one(obs, runs):
        state, made = adopt.empty_state(obs), None
        for k in range(7):
            now = marked.where(F.col("seq") == k)
            seen = obs.join(now.select("run_id"), "run_id", "left_semi")
            state, events = adopt.apply_observation(state.select(*adopt.STATE), seen, now)
            state, events = stored(state, "state"), stored(events, "events")
            made = events if made is None else made.unionByName(events)
        return state, made

    for form in (inv.replay_url_lifecycle, at_once, in_two_parts, one_by_one):
        state, events = form(obs, runs)
        assert {(r.target_id, r.url): r.status for r in state.collect()} == want_state
        assert {(r.target_id, r.url, r.kind, r.run_id) for r in events.collect()} == want_events
        assert check_invariants(state).count() == 0


def test_suspicious_thresholds(spark):
    cases = [(1, 1, 0, True), (0, 0, 0, False), (1000, 299, 701, False), (1000, 300, 700, True), (200, 99, 101, False)]
    rows = spark.createDataFrame(cases, "p int, m int, c int, want boolean")
    got = rows.where(suspicious(F.col("p"), F.col("m"), F.col("c")) == F.col("want")).count()
    assert got == len(cases)


HOUR = datetime.timedelta(hours=1)


def some(n, *more):
    return {f"u{i}" for i in range(n)} | set(more)


#: history: (run, hours after the first, URLs), what is decided, the removed URLs in the end, what became of candidates.
SCENARIOS = {
    "equal": ([(0, some(400)), (1, some(200)), (1.5, some(200, "new")), (2.5, some(200, "newer"))],
              ["baseline", "first_observation", "quarantined", "applied"], 200, [None, None, "quarantined", "confirmed"]),
    "changed": ([(0, some(400)), (1, some(200)), (3, some(201)), (5, some(201))],
                ["baseline", "quarantined", "first_observation", "applied"], 199, [None, None, "missing_set_changed", "confirmed"]),
    "below": ([(0, some(400)), (1, some(200)), (3, some(301))],
              ["baseline", "quarantined", "applied"], 0, [None, None, "missing_set_changed"]),
    "empty": ([(0, some(3)), (1, set()), (2, set())], ["baseline", "first_observation", "applied"], 3, [None, None, "confirmed"]),
    "expired": ([(0, some(3)), (1, set()), (80, set()), (81, set())],
                ["baseline", "quarantined", "first_observation", "applied"], 3, [None, None, "expired", "confirmed"]),
    "nothing": ([(0, set()), (1, some(2)), (2, some(2))], ["baseline", "applied", "applied"], 0, [None] * 3),
    "calm": ([(0, some(300)), (1, some(250)), (2, some(250)), (3, some(300))], ["baseline"] + ["applied"] * 3, 0, [None] * 4),
}


def scenario_frames(spark):
    hist = {t: [(f"{t}-{k}", T0 + h * HOUR, urls) for k, (h, urls) in enumerate(runs)] for t, (runs, *_) in SCENARIOS.items()}
    return hist, *frames(spark, hist)


def check_scenarios(state, decisions, events):
    found = {r.run_id: (r.decision, r.outcome) for r in decisions.collect()}
    removed = {r.target_id: r["count"] for r in state.where("status = 'removed'").groupBy("target_id").count().collect()}
    kinds = {(r.target_id, r.kind): r["count"] for r in events.groupBy("target_id", "kind").count().collect()}
    for t, (_, decided, gone, outcomes) in SCENARIOS.items():
        assert [found[f"{t}-{k}"] for k in range(len(decided))] == list(zip(decided, outcomes, strict=True)), t
        assert removed.get(t, 0) == gone, t
        # calm loses 50 and gets them back
        assert kinds.get((t, "removed"), 0) == (50 if t == "calm" else gone), t
    assert kinds["nothing", "added"] == 2 and kinds["equal", "added"] == 1 and kinds["calm", "reappeared"] == 50


def test_adoption_with_quarantine(spark):
    _, obs, runs = scenario_frames(spark)
    state, events, decisions = adopt.adopt_history(adopt.empty_state(obs), obs, runs)
    check_scenarios(state, decisions, events)


def test_adoption_by_micro_batches(spark, tmp_path):
    """The same, a run of each target at a time; a late run changes nothing."""
    hist, obs, runs = scenario_frames(spark)
    rows = runs.join(obs.select("run_id", "url", "url_hash"), "run_id", "left").select(*obs.columns)
    late = rows.where("run_id = 'calm-1'").withColumn("run_id", F.lit("late"))
    for k in range(4):
        part = rows.where(F.col("run_id").endswith(f"-{k}")).unionByName(late.limit(1 if k == 3 else 0))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.file_stream(spark, str(tmp_path / "in"), obs.schema, files=1)
    out = str(tmp_path / "out")
    jobs.stream_adopt(stream, out, str(tmp_path / "c")).awaitTermination()
    batches = sorted(p.name for p in (tmp_path / "out" / "decisions").iterdir())
    assert len(batches) == 4
    decided = {}
    for name in batches:
        decided |= {r.run_id: r for r in spark.read.parquet(f"{out}/decisions/{name}").collect()}
    decisions = spark.createDataFrame(
        [(i, r.decision, r.outcome) for i, r in decided.items()], "run_id string, decision string, outcome string"
    )
    # a first observation comes to be when its candidate is confirmed, and has its own row then
    decisions = decisions.withColumn("outcome", F.when(F.col("decision") != "first_observation", F.col("outcome")))
    events = spark.read.parquet(f"{out}/events")
    state = buckets.read_buckets(spark, f"{out}/state", closed_schema := adopt.empty_state(obs).schema)
    assert closed_schema.names == adopt.STATE
    found = {r.run_id: r.decision for r in decisions.collect()}
    assert "late" not in found
    assert [r.run_id for r in spark.read.parquet(f"{out}/stale/*").where("reason = 'late'").collect()] == ["late"]
    for t, (_, want, gone, _) in SCENARIOS.items():
        assert [found[f"{t}-{k}"] for k in range(len(want))] == want, t
        assert state.where((F.col("target_id") == t) & (F.col("status") == "removed")).count() == gone
    closed, made, _ = adopt.adopt_history(adopt.empty_state(obs), obs, runs)
    columns = [c for c in adopt.STATE if c != "website_id"]
    assert sorted(map(repr, state.select(*columns).collect())) == sorted(map(repr, closed.select(*columns).collect()))
    assert {r.id for r in events.collect()} == {r.id for r in made.collect()}


def test_one_run_with_its_baseline(spark):
    """decide and adopt_observation: a baseline that found nothing is still one."""
    _, obs, runs = scenario_frames(spark)
    base = obs.where("run_id IN ('equal-0', 'calm-0')").unionByName(
        runs.where("run_id = 'nothing-0'").withColumns({"url": F.lit(None).cast("string"), "url_hash": F.lit(None).cast("string")})
    )
    now = runs.where("run_id IN ('equal-1', 'calm-1', 'nothing-1', 'below-0')")
    state, _ = adopt.apply_runs(adopt.empty_state(obs), base, runs.where("run_id IN ('equal-0', 'calm-0')").withColumn("is_baseline", F.lit(True)))
    seen = obs.join(now.select("run_id"), "run_id", "left_semi")
    new, events, decisions = adopt.adopt_observation(state, base, seen, now)
    assert {r.run_id: (r.decision, r.previous, r.missing) for r in decisions.collect()} == {
        "equal-1": ("quarantined", 400, 200), "calm-1": ("applied", 300, 50), "nothing-1": ("applied", 0, 0), "below-0": ("baseline", 0, 0),
    }
    assert new.where("status = 'pending_removed'").count() == 50 and events.where("kind = 'added'").count() == 2


def test_cadence_catches_up(spark):
    now = datetime.datetime(2024, 1, 2)
    due = now - datetime.timedelta(hours=13)
    row = spark.createDataFrame([(due, now)], "due timestamp, now timestamp")
    got = row.select(next_due_catch_up(F.col("due"), F.lit(6), F.col("now"))).first()[0]
    assert got == due + datetime.timedelta(hours=18)


def plain_decisions(runs, least, ratio, ttl):
    """The rules over whole sets: {run: (decision, outcome)}, {candidate run: (status, original, pending, recovered, removed)}."""
    base, held, made, cands = None, None, {}, {}
    for run, at, urls in runs:
        if base is None:
            base, made[run] = urls, ("baseline", None)
            continue
        lost, outcome = base - urls, None
        if held and at - held[1] >= ttl:
            outcome, cands[held[0]], held = "expired", ("expired", len(held[2]), len(held[2]), 0, 0), None
        elif held and held[2] != lost:
            still = len(held[2] & lost)
            outcome, cands[held[0]], held = "missing_set_changed", ("rejected", len(held[2]), still, len(held[2]) - still, 0), None
        elif held:
            outcome = "confirmed" if at - held[1] >= HOUR else "quarantined"
        if outcome == "confirmed":
            made[held[0]] = ("first_observation", made[held[0]][1])
            cands[held[0]], held, base, made[run] = ("confirmed", len(lost), 0, 0, len(lost)), None, urls, ("applied", outcome)
        elif outcome == "quarantined":
            made[run] = ("quarantined", outcome)
        elif base and (not urls or (len(lost) >= least and len(lost) / len(base) >= ratio)):
            held, made[run] = (run, at, lost), ("quarantined", outcome)
            cands[run] = ("pending", len(lost), len(lost), 0, 0)
        else:
            base, made[run] = urls, ("applied", outcome)
    return made, cands


def random_histories(n, seed):
    rng = random.Random(seed)
    out = {}
    for t in range(n):
        at, runs, now = T0, [], {u for u in "abcdefghij" if rng.random() < 0.8}
        for k in range(rng.randint(2, 12)):
            at += datetime.timedelta(minutes=rng.choice([10, 59, 60, 61, 300, 2000]))
            now = rng.choice([now, now, {u for u in now if rng.random() < 0.6}, {u for u in "abcdefghij" if rng.random() < 0.8}, set()])
            runs.append((f"t{t}-{k}", at, set(now)))
        out[f"t{t}"] = runs
    return out


def test_decisions_by_changes_equal_those_by_sets(spark):
    """Log of changes and fold against whole sets, at once and with a prior baseline and candidate from the first runs."""
    hist, ttl = random_histories(60, 9), datetime.timedelta(hours=30)
    obs, runs = frames(spark, hist)
    want, cands = {}, {}
    for h in hist.values():
        made, found = plain_decisions(h, 2, 0.3, ttl)
        want, cands = want | made, cands | found
    decided = adopt.decide_history(obs, runs, 2, 0.3, 30)
    assert {r.run_id: (r.decision, r.outcome) for r in decided.collect()} == want
    rows = {r.candidate_run_id: (r.status, r.original_missing_count, r.pending_count, r.recovered_count, r.removed_count) for r in adopt.candidate_rows(decided).collect()}
    assert rows == cands and {c[0] for c in cands.values()} == {"pending", "confirmed", "rejected", "expired"}
    state, events, _ = adopt.adopt_history(adopt.empty_state(obs), obs, runs, 2, 0.3, 30)
    taken = adopt.adopted_runs(decided)
    other, made = adopt.apply_runs(adopt.empty_state(obs), obs.join(taken.select("run_id"), "run_id", "left_semi"), taken)
    assert sorted(map(repr, state.select(*adopt.STATE).collect())) == sorted(map(repr, other.select(*adopt.STATE).collect()))
    assert {r.id for r in events.collect()} == {r.id for r in made.collect()}


def test_expiry_is_the_targets_own(spark):
    hist = {t: [(f"{t}-{k}", T0 + h * HOUR, urls) for k, (h, urls) in enumerate([(0, some(3)), (1, set()), (100, set())])] for t in ("daily", "weekly")}
    obs, runs = frames(spark, hist)
    targets = spark.createDataFrame([("daily", 24.0), ("weekly", 168.0)], "target_id string, checkIntervalHours double")
    decided = adopt.decide_history(obs, adopt.with_expiry(runs, targets))
    got = {r.run_id: (r.decision, r.outcome) for r in decided.where("run_id LIKE '%-2'").collect()}
    assert got == {"daily-2": ("quarantined", "expired"), "weekly-2": ("applied", "confirmed")}
    ends = {r.target_id: r.expires_at for r in adopt.candidate_rows(decided).where("candidate_run_id LIKE '%-1'").collect()}
    assert ends == {"daily": T0 + 73 * HOUR, "weekly": T0 + HOUR + datetime.timedelta(days=14)}


def test_plans_carry_no_lists_of_runs(spark):
    """Neither the replay nor the log of changes gathers URLs or runs into arrays."""
    obs, runs = frames(spark, histories(3))
    state, events = inv.replay_url_lifecycle(obs, runs)
    log = adopt.change_log(obs, inv.numbered_runs(runs))
    for df in (state, events, log, inv.set_digest(obs, ["run_id"])):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "collect_" not in plan and "array_contains" not in plan


def test_digests_add_up(spark):
    obs, _ = frames(spark, histories(8))
    key = ["run_id"]
    some_of = obs.where("url IN ('a', 'c')")
    rest = {tuple(r) for r in inv.set_digest(obs.where("url NOT IN ('a', 'c')"), key).collect()}
    got = {tuple(r) for r in inv.combined(inv.set_digest(obs, key), inv.set_digest(some_of, key), key).where("n_urls > 0").collect()}
    assert got == rest
    moved = obs.where("url <> 'a'").unionByName(obs.where("url = 'a'"))
    assert inv.same_missing_set(obs, moved, key).count() == obs.select("run_id").distinct().count()
    less = inv.same_missing_set(obs, obs.where("url <> 'a'"), key)
    assert less.join(obs.where("url = 'a'"), "run_id", "left_semi").count() == 0


def test_urls_tell_observations_apart_where_there_are_no_hashes(spark):
    obs, runs = frames(spark, histories(12))
    rows = lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
    for with_hash, without in zip(inv.replay_url_lifecycle(obs, runs), inv.replay_url_lifecycle(obs.drop("url_hash"), runs), strict=True):
        assert rows(with_hash) == rows(without)


def test_the_replay_is_written_in_one_pass(spark, tmp_path):
    obs, runs = frames(spark, histories(12))
    rows = lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
    for k, o in enumerate((obs, obs.drop("url_hash"))):
        inv.write_lifecycle(o, runs, f"{tmp_path}/{k}")
        for read, made in zip(inv.read_lifecycle(spark, f"{tmp_path}/{k}"), inv.replay_url_lifecycle(obs, runs), strict=True):
            assert rows(read) == rows(made)


def test_gaps_are_dealt_into_the_sessions_partitions(spark):
    """However few bytes a shuffle writes, the rows it brings are sorted in as many tasks as the session asks for."""
    obs, runs = frames(spark, histories(12))
    assert inv.url_gaps(obs.drop("url_hash"), runs).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_targets_are_folded_one_after_the_other(spark):
    """The order's fold takes rows of many targets in batches that end anywhere, and gives what each target's rows alone give."""
    import pyarrow as pa

    names = ("run_id", "n", "went", "held_run", "held_at", "held_until", "held_lost")
    runs = []
    for t in range(7):
        for k in range(4):
            row = dict.fromkeys(names) | {"website_id": "w", "target_id": f"t{t}", "scope_version": 1, "seq": k, "known": False, "made_from": adopt.ANY}
            at = T0 + 2 * k * HOUR
            runs.append(row | {"run_id": f"t{t}-{k}", "observed_at": at, "expires_at": at + 72 * HOUR, "n": 2 if k == 2 and t % 2 else 4,
                               "went": [1, 2] if k == 2 and t % 2 else [], "came": [1, 2] if k == 3 and t % 2 else []})
    whole = pa.RecordBatch.from_pylist(runs)
    one = list(adopt._fold_targets(iter([whole]), 2, 0.3))
    cut = list(adopt._fold_targets((whole.slice(k, 3) for k in range(0, 28, 3)), 2, 0.3))
    assert sum(map(lambda b: b.to_pylist(), one), []) == sum(map(lambda b: b.to_pylist(), cut), [])
    decided = {r["run_id"]: r["decision"] for b in one for r in b.to_pylist()}
    assert decided["t1-2"] == "quarantined" and decided["t2-2"] == "applied" and len(decided) == 28


def test_folds_are_dealt_to_all_partitions(spark):
    """However small the targets with an open candidate are, one task doesn't fold them all."""
    targets = spark.range(40).selectExpr("concat('w', id) AS website_id", "concat('t', id) AS target_id", "1 AS scope_version")
    run = lambda name, hours, sets: targets.select("*", F.lit(name).alias("run_id"), F.lit(T0 + hours * HOUR).alias("observed_at"), F.explode(F.array(*map(F.lit, sets))).alias("url_hash"))
    prior = run("base", 0, "abcd").withColumn("role", F.lit("base")).unionByName(run("open", 1, "ab").withColumn("role", F.lit("held")))
    obs = run("next", 3, "ab")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        decided = adopt.decide_history(obs, obs.select(*adopt.SITE, "run_id", "observed_at").distinct(), 2, 0.3, 30, prior)
        found = decided.select("run_id", "outcome", F.spark_partition_id().alias("task")).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {r.run_id for r in found} == {"next", "open"} and {r.outcome for r in found if r.run_id == "next"} == {"confirmed"}
    assert len(found) == 80 and len({r.task for r in found}) > 2


def test_the_log_of_changes_moves_no_hashes(spark):
    obs, runs = frames(spark, histories(3))
    plan = adopt.change_log(obs, inv.numbered_runs(runs))._jdf.queryExecution().optimizedPlan().toString()
    assert all("url_hash" not in line for line in plan.splitlines() if "RepartitionByExpression" in line or "Window" in line)
    decided = adopt.decide_history(obs, runs)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in decided


def test_sets_are_compared_by_any_name_of_their_urls(spark):
    """URLs in place of their hashes: no hexadecimal digits, and the same long beginning."""
    rows = lambda key, urls: [(key, f"https://s.example.com/p/{u}") for u in urls]
    sets = lambda rows: spark.createDataFrame(rows, "run_id string, url_hash string")
    a, b = sets(rows("same", "xyz") + rows("other", "xy")), sets(rows("same", "zyx") + rows("other", "xz"))
    digests = {r.digest_a for r in inv.set_digest(a.unionAll(b), ["run_id"], F.sha2("url_hash", 256)).collect()}
    assert len(digests) == 2 and 0 not in digests
    assert [r.run_id for r in inv.same_missing_set(a, b, ["run_id"]).collect()] == ["same"]


def test_apply_runs_makes_rows_of_presences_alone(spark):
    """URLs that only other runs saw get no row, a URL that a run has twice counts once, and no step folds runs within rows."""
    hist = {"t0": [("t0-0", T0, {"a"}), ("t0-1", T0 + 2 * HOUR, {"b"}), ("t0-2", T0 + 4 * HOUR, {"c"})]}
    obs, runs = frames(spark, hist)
    marked = inv.numbered_runs(runs).withColumn("is_baseline", F.col("seq") == 0)
    state, events = adopt.apply_runs(adopt.empty_state(obs), obs.unionAll(obs), marked.where("seq < 2"))
    assert {(r.url, r.status, r.missing_confirmations) for r in state.collect()} == {("a", "pending_removed", 1), ("b", "active", 0)}
    state, events = adopt.apply_runs(stored(state, "state"), obs, marked.where("seq = 2"))
    assert {(r.url, r.status, r.first_missing_run_id) for r in state.collect()} == {("a", "removed", "t0-1"), ("b", "pending_removed", "t0-2"), ("c", "active", None)}
    assert {(r.url, r.kind, r.run_id) for r in events.collect()} == {("a", "removed", "t0-2"), ("c", "added", "t0-2")}
    assert "lambdafunction" not in state._jdf.queryExecution().optimizedPlan().toString()
