"""Streams over several micro-batches against batch forms; state in buckets."""

import datetime
import random

from pyspark.sql import functions as F

from sitedrift.operators import adopt
from sitedrift.operators import inventory as inv
from sitedrift.sources import buckets
from sitedrift.streaming import jobs

T0 = datetime.datetime(2024, 1, 1)
HOUR = datetime.timedelta(hours=1)
OBS = "website_id string, target_id string, scope_version int, run_id string, observed_at timestamp, url string"


def observations(spark, runs):
    """runs: (target, scope, run, hours, urls); a run without URLs is one row without a URL."""
    rows = [("w" + t, t, s, r, T0 + h * HOUR, u) for t, s, r, h, urls in runs for u in (sorted(urls) or [None])]
    return spark.createDataFrame(rows, OBS).withColumn("url_hash", F.sha2("url", 256))


def in_batches(spark, df, folder, batch):
    """A stream of df, one micro-batch for each value of the column batch."""
    for k in sorted(r[0] for r in df.select(batch).distinct().collect()):
        df.where(F.col(batch) == k).drop(batch).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return jobs.file_stream(spark, f"{folder}/in", df.drop(batch).schema, files=1)


def test_absences_are_found_by_the_stream(spark, tmp_path):
    """Rows of a run come in two batches, its end with the second; equals the replay."""
    rng, runs = random.Random(8), []
    for t in "abcde":
        h = 0.0
        for k in range(8):
            h += rng.choice([0.2, 0.9, 1.0, 3.0])
            runs.append((t, 1, f"{t}{k}", h, {u for u in "uvwxyz" if rng.random() < 0.6}))
    obs = observations(spark, runs)
    number = F.substring("run_id", 2, 1).cast("int")
    rows = obs.where("url IS NOT NULL").withColumn("batch", number + (F.ascii("url") % 2))
    ends = obs.select("website_id", "target_id", "scope_version", "run_id", "observed_at").distinct()
    ends = ends.withColumns({"url": F.lit(None).cast("string"), "url_hash": F.lit(None).cast("string"), "batch": number + 1})
    stream = in_batches(spark, rows.unionByName(ends), str(tmp_path), "batch")
    out = jobs.run_to_table(jobs.stream_url_lifecycle(stream, buckets=3), str(tmp_path), provider=jobs.ROCKSDB)
    got = sorted((r.website_id, r.url, r.kind, r.run_id) for r in out.collect())
    known = obs.select("website_id", "target_id", "scope_version", "run_id", "observed_at").distinct()
    _, events = inv.replay_url_lifecycle(obs.where("url IS NOT NULL"), known)
    assert got == sorted((r.website_id, r.url, r.kind, r.run_id) for r in events.collect()) and len(got) > 10


def test_stale_runs_change_nothing(spark, tmp_path):
    """Of an older scope, of an archived target, made from another baseline, or late: told apart, and otherwise as if not there."""
    a, b = {"1", "2", "3"}, {"1", "2", "4"}
    runs = [("t", 1, "t0", 0, a), ("t", 1, "t1", 2, b), ("t", 1, "t2", 12, a), ("t", 2, "t3", 13, b), ("t", 2, "t4", 15, a), ("u", 1, "u0", 0, a), ("u", 1, "u1", 20, b)]
    runs += [("v", 1, "v0", 0, a), ("v", 1, "v1", 2, b), ("v", 1, "v2", 4, a), ("v", 1, "v3", 6, b), ("v", 1, "v-late", 1, a)]
    origin = {"t1": "t0", "t4": "t3", "u1": "u0", "v1": "v0", "v2": "v0", "v3": "v1"}
    obs = observations(spark, runs)
    made_from = F.create_map(*(F.lit(x) for kv in origin.items() for x in kv))[F.col("run_id")]
    obs = obs.withColumn("origin_baseline_run_id", made_from).withColumn("batch", F.when(F.col("run_id") == "v-late", 9).otherwise(F.hour("observed_at") % 20))
    scopes = spark.createDataFrame(
        [("t", 1, T0 - HOUR, False), ("t", 2, T0 + 10 * HOUR, False), ("u", 1, T0 - HOUR, False), ("u", 1, T0 + 19 * HOUR, True)],
        "target_id string, scope_version int, valid_from timestamp, archived boolean",
    )
    out = str(tmp_path / "out")
    jobs.stream_adopt(in_batches(spark, obs, str(tmp_path), "batch"), out, str(tmp_path / "c"), scopes=scopes, buckets=4).awaitTermination()
    stale = spark.read.option("recursiveFileLookup", "true").parquet(f"{out}/stale")
    assert {(r.run_id, r.reason) for r in stale.collect()} == {("t2", "scope"), ("u1", "scope"), ("v2", "baseline"), ("v-late", "late")}
    good = [r for r in runs if r[2] not in ("t2", "u1", "v2", "v-late")]
    want = observations(spark, good)
    known = want.select("website_id", "target_id", "scope_version", "run_id", "observed_at").distinct()
    state, events, _ = adopt.adopt_history(adopt.empty_state(want), want, known)
    got = buckets.read_buckets(spark, f"{out}/state", adopt.empty_state(want).schema)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, state.select(*got.columns).collect()))
    assert {r.id for r in spark.read.parquet(f"{out}/events").collect()} == {r.id for r in events.collect()}


def test_a_batch_writes_the_buckets_it_touches(spark, tmp_path):
    path, bucket = f"file://{tmp_path}/table", buckets.by_hash(["k"], 8)
    schema = "k long, v string"
    first = spark.range(100).select(F.col("id").alias("k"), F.lit("old").alias("v"))
    buckets.write_buckets(first, path, bucket, 0, buckets.touched(first, bucket))
    change = spark.createDataFrame([(3, "new"), (500, "new")], schema)
    only = buckets.touched(change, bucket)

    def apply(batch):
        old = buckets.read_buckets(spark, path, schema, only, batch)
        rows = old.join(change.select("k"), "k", "left_anti").unionByName(change)
        buckets.write_buckets(rows, path, bucket, batch, only)
        return {r.k: r.v for r in buckets.read_buckets(spark, path, schema).collect()}

    want = {k: "old" for k in range(100)} | {3: "new", 500: "new"}
    assert apply(1) == want and apply(1) == want
    assert len(only) <= 2 and {p.name for p in (tmp_path / "table" / "v=1").iterdir() if p.is_dir()} == {f"bucket={k}" for k in only}
    # a batch that leaves nothing in its bucket
    buckets.write_buckets(change.limit(0), path, bucket, 2, only)
    left = {r.k for r in buckets.read_buckets(spark, path, schema).collect()}
    assert left == {r.k for r in first.where(~bucket.isin(only)).collect()} and len(left) < 100
    assert {r.k: r.v for r in buckets.read_buckets(spark, path, schema, before=2).collect()} == want
    buckets.forget(spark, path)
    assert {r.k for r in buckets.read_buckets(spark, path, schema).collect()} == left
    assert not (tmp_path / "table" / "v=1").exists()
    assert buckets.read_buckets(spark, f"{path}-none", schema).count() == 0


def test_candidates_close_once(spark, tmp_path):
    """Expired by the clock, stale by a change of scope before that, or as their row says."""
    at = lambda h: T0 + h * HOUR
    rows = [
        ("t", "a", "pending", 1, at(0), at(5), 0), ("t", "b", "pending", 1, at(1), at(50), 0), ("t", "c", "adopted", 1, at(2), None, 0),
        ("t", "d", "pending", 2, at(3), at(60), 0), ("t", None, None, 2, at(10), None, 1), ("u", "e", "pending", 1, at(0), at(30), 0),
        ("u", "e", "confirmed", 1, at(11), None, 1), ("u", "f", "pending", 1, at(11), at(13), 1), ("v", "z", "rejected", 1, at(100), None, 2),
        ("v", "y", "rejected", 1, at(101), None, 3),
    ]
    df = spark.createDataFrame(rows, "target_id string, id string, status string, scope_version int, updated_at timestamp, expires_at timestamp, batch int")
    stream = jobs.stream_candidate_expiry(in_batches(spark, df, str(tmp_path), "batch"))
    got = sorted((r.id, r.status) for r in jobs.run_to_table(stream, str(tmp_path)).collect())
    assert got == sorted([("a", "expired"), ("b", "stale"), ("c", "adopted"), ("c", "stale"), ("d", "expired"), ("e", "confirmed"), ("f", "expired"), ("z", "rejected"), ("y", "rejected")])


def test_closings_follow_the_candidates_not_their_square():
    """One target with 20,000 candidates, two thirds of them open for years."""
    import time

    import pandas as pd

    class State:
        exists = hasTimedOut = False
        getCurrentWatermarkMs = setTimeoutTimestamp = staticmethod(lambda *_: 0)

        def update(self, value):
            self.value = value

    n, kinds = 20_000, ("pending", "adopted", "confirmed")
    rows = [(f"c{k}", kinds[k % 3], 1 + k % 2, T0 + k * HOUR, T0 + (k + 24 * 4_000) * HOUR) for k in range(n)]
    rows.append((None, None, 2, T0 + n * HOUR, None))
    df = pd.DataFrame(rows, columns=["id", "status", "scope_version", "updated_at", "expires_at"])
    state, start = State(), time.time()
    (out,) = jobs._close(("t",), iter([df]), state)
    assert time.time() - start < 5
    opened = {k for k in range(n) if k % 3 < 2}
    assert set(out.id[out.status == "stale"]) == {f"c{k}" for k in opened if k % 2 == 0}
    assert set(state.value[0]) == {f"c{k}" for k in opened if k % 2 == 1}


def test_lifecycle_state_has_a_row_for_a_shard(spark, tmp_path):
    """However many sites there are; what they find is what the replay finds."""
    runs = [(f"s{t}", 1, f"s{t}-{k}", 2 * k, {u for u in "uvw" if (t + k + ord(u)) % 3}) for t in range(60) for k in range(3)]
    obs = observations(spark, runs)
    known = obs.select("website_id", "target_id", "scope_version", "run_id", "observed_at").distinct()
    none = F.lit(None).cast("string")
    rows = obs.unionByName(known.withColumns({"url": none, "url_hash": none}))
    stream = in_batches(spark, rows.withColumn("batch", F.hour("observed_at")), str(tmp_path), "batch")
    out = jobs.run_to_table(jobs.stream_url_lifecycle(stream, buckets=4, shards=8), str(tmp_path), provider=jobs.ROCKSDB)
    _, events = inv.replay_url_lifecycle(obs, known)
    assert sorted((r.url, r.kind, r.run_id) for r in out.collect()) == sorted((r.url, r.kind, r.run_id) for r in events.collect())
    assert spark.read.format("statestore").load(f"{tmp_path}/_checkpoint").count() == 8
