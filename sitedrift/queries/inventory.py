"""Queries of operators.inventory."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..bindings import table
from ..operators import adopt
from ..operators import inventory as inv
from ..plans import upkeep
from ..scratch import stored
from ..streaming import jobs
from .base import as_stream, query

GAPS = """
WITH n AS (
  SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY observed_at, run_id) - 1 AS seq FROM {runs}
), p AS (
  SELECT o.*, n.seq, lead(n.seq) OVER w AS next_seq, lag(n.seq) OVER w AS prev_seq
  FROM {obs_hashed} o JOIN n USING (target_id, run_id) WINDOW w AS (PARTITION BY o.target_id, o.url ORDER BY n.seq)
), last AS (SELECT target_id, count(*) AS n FROM n GROUP BY 1
), g AS (
  SELECT p.*, m.observed_at AS first_missing_at, m.run_id AS first_missing_run,
    (SELECT min(c.seq) FROM n c WHERE c.target_id = p.target_id AND c.seq > p.seq + 1 AND c.seq < coalesce(p.next_seq, last.n)
      AND c.observed_at >= m.observed_at + INTERVAL 1 HOUR) AS confirmed_seq
  FROM p JOIN last USING (target_id)
  LEFT JOIN n m ON m.target_id = p.target_id AND m.seq = p.seq + 1 AND p.seq + 1 < coalesce(p.next_seq, last.n)
), events AS (
  SELECT website_id, target_id, url, url_hash, 'added' AS kind, seq AS at FROM g WHERE prev_seq IS NULL AND seq > 0
  UNION ALL SELECT website_id, target_id, url, url_hash, 'removed', confirmed_seq FROM g WHERE confirmed_seq IS NOT NULL
  UNION ALL SELECT website_id, target_id, url, url_hash, 'reappeared', next_seq FROM g
    WHERE confirmed_seq IS NOT NULL AND next_seq IS NOT NULL
)
"""


def _obs(spark, sf_dir, name="obs_hashed"):
    return table(spark, sf_dir, name), table(spark, sf_dir, "runs")


@query(GAPS + "SELECT website_id, kind, count(*) AS n_events FROM events GROUP BY ALL")
def w5_replay_event_counts(spark, sf_dir):
    _, events = inv.replay_url_lifecycle(*_obs(spark, sf_dir, "obs"))
    return events.groupBy("website_id", "kind").agg(F.count(F.lit(1)).alias("n_events"))


@query(
    GAPS
    + """SELECT e.website_id, e.url, e.kind, n.run_id, concat(n.run_id, ':', e.url_hash, ':', e.kind) AS id
FROM events e JOIN n ON n.target_id = e.target_id AND n.seq = e.at"""
)
def x39_replayed_events(spark, sf_dir):
    _, events = inv.replay_url_lifecycle(*_obs(spark, sf_dir, "obs"))
    return events.select("website_id", "url", "kind", "run_id", "id")


STATE_SQL = (
    GAPS
    + """SELECT g.website_id, g.url,
  CASE WHEN confirmed_seq IS NOT NULL THEN 'removed' WHEN first_missing_at IS NOT NULL THEN 'pending_removed' ELSE 'active' END AS status,
  f.observed_at AS first_seen_at, l.observed_at AS last_seen_at, first_missing_run AS first_missing_run_id,
  coalesce(c.run_id, first_missing_run) AS last_missing_run_id, c.observed_at AS removed_at,
  CASE WHEN confirmed_seq IS NOT NULL THEN 2 WHEN first_missing_at IS NOT NULL THEN 1 ELSE 0 END AS missing_confirmations
FROM g JOIN (SELECT target_id, url, min(observed_at) AS observed_at FROM {obs} GROUP BY ALL) f USING (target_id, url)
JOIN n l ON l.target_id = g.target_id AND l.seq = g.seq
LEFT JOIN n c ON c.target_id = g.target_id AND c.seq = g.confirmed_seq
WHERE g.next_seq IS NULL"""
)
STATE_COLUMNS = (
    "website_id", "url", "status", "first_seen_at", "last_seen_at", "first_missing_run_id", "last_missing_run_id",
    "removed_at", "missing_confirmations",
)


@query(STATE_SQL)
def w5_replay_state(spark, sf_dir):
    state, _ = inv.replay_url_lifecycle(*_obs(spark, sf_dir, "obs"))
    return state.select(*STATE_COLUMNS)


@query(
    GAPS
    + """SELECT target_id, url, g.seq::INT AS seq, next_seq::INT AS next_seq, first_missing_at, c.run_id AS confirming_run,
  c.observed_at AS confirmed_at
FROM g LEFT JOIN n c USING (target_id) WHERE first_missing_at IS NOT NULL AND c.seq = g.confirmed_seq
UNION ALL SELECT target_id, url, seq::INT, next_seq::INT, first_missing_at, NULL, NULL FROM g
WHERE first_missing_at IS NOT NULL AND confirmed_seq IS NULL"""
)
def j7_confirm_second_missing(spark, sf_dir):
    return inv.confirm_second_missing(inv.url_gaps(*_obs(spark, sf_dir, "obs"))).drop("scope_version")


@query(
    """WITH s AS (SELECT target_id, run_id, observed_at, count(*) AS n FROM {obs} GROUP BY ALL)
SELECT target_id, run_id, n AS n_urls, lag(n) OVER w AS previous, n - lag(n) OVER w AS delta
FROM s WINDOW w AS (PARTITION BY target_id ORDER BY observed_at, run_id)"""
)
def w10_run_deltas(spark, sf_dir):
    return inv.run_deltas(*_obs(spark, sf_dir)).select("target_id", "run_id", "n_urls", "previous", "delta")


@query(
    """SELECT id, target_id, scope_version, last_value(CASE WHEN adoption_status IN ('baseline', 'applied') THEN id END IGNORE NULLS)
  OVER (PARTITION BY target_id, scope_version ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  AS baseline_run_id FROM {run}"""
)
def w9_baseline_timeline(spark, sf_dir):
    return inv.baseline_timeline(table(spark, sf_dir, "run")).select(
        "id", "target_id", "scope_version", "baseline_run_id"
    )


PAIR = ["target_id", "scope_version", "run_id"]


def pairs_of_runs(spark, sf_dir, hashed=True):
    """(before, after): the URLs of every run but the first, as run_id, and of the run before it, under the same run_id.
    url_hash is the URL itself where it isn't hashed."""
    obs, runs = _obs(spark, sf_dir, "obs_hashed" if hashed else "obs")
    obs = obs if hashed else obs.withColumn("url_hash", F.col("url"))
    w = Window.partitionBy("target_id", "scope_version").orderBy("observed_at", "run_id")
    runs = runs.select(*PAIR, F.lead("run_id").over(w).alias("next"), F.lag("run_id").over(w).alias("previous"))
    rows = obs.select(*PAIR, "url", "url_hash").join(runs, PAIR)
    before = rows.where("next IS NOT NULL").select("target_id", "scope_version", F.col("next").alias("run_id"), "url", "url_hash")
    return before, rows.where("previous IS NOT NULL").select(*PAIR, "url", "url_hash")


PAIRS = """
WITH n AS (SELECT *, row_number() OVER w - 1 AS seq, lead(run_id) OVER w AS next FROM {runs} WINDOW w AS (PARTITION BY target_id ORDER BY observed_at, run_id)),
a AS (SELECT o.target_id, n.next AS run_id, o.url, o.url_hash FROM {obs_hashed} o JOIN n USING (target_id, run_id) WHERE n.next IS NOT NULL),
b AS (SELECT o.target_id, o.run_id, o.url, o.url_hash FROM {obs_hashed} o JOIN n USING (target_id, run_id) WHERE seq > 0)
"""


@query(PAIRS + "SELECT target_id, run_id, url FROM a ANTI JOIN b USING (target_id, run_id, url)")
def j5_missing_urls(spark, sf_dir):
    """Every run against the one before it."""
    return inv.missing_urls(*pairs_of_runs(spark, sf_dir), PAIR).select("target_id", "run_id", "url")


@query(
    PAIRS
    + """SELECT target_id, run_id, url, CASE WHEN x.url_hash IS NULL THEN 'added' ELSE 'removed' END AS change
FROM (SELECT target_id, run_id, url, url_hash FROM a) x
FULL JOIN (SELECT target_id, run_id, url, url_hash AS h FROM b) y USING (target_id, run_id, url) WHERE x.url_hash IS NULL OR y.h IS NULL"""
)
def j6_link_diff(spark, sf_dir):
    return inv.link_diff(*pairs_of_runs(spark, sf_dir), ["target_id", "run_id"])


@query(PAIRS + "SELECT target_id, run_id, url FROM b EXCEPT SELECT target_id, run_id, url FROM a")
def u2_set_difference(spark, sf_dir):
    a, b = pairs_of_runs(spark, sf_dir)
    return inv.set_difference(b, a, ["target_id", "run_id", "url"])


@query(PAIRS + "SELECT target_id, run_id, url FROM b INTERSECT SELECT target_id, run_id, url FROM a")
def u3_set_common(spark, sf_dir):
    a, b = pairs_of_runs(spark, sf_dir)
    return inv.set_common(b, a, ["target_id", "run_id", "url"])


def _missing_and_next(spark, sf_dir):
    """(what each run misses of the one before it, under the run after it; what that one misses of the same one)."""
    runs = table(spark, sf_dir, "runs")
    a, b = pairs_of_runs(spark, sf_dir, hashed=False)
    w = Window.partitionBy("target_id", "scope_version").orderBy("observed_at", "run_id")
    runs = runs.select(*PAIR, F.lead("run_id").over(w).alias("next")).where("next IS NOT NULL")
    later = lambda df: df.join(runs, PAIR).drop("run_id").withColumnRenamed("next", "run_id")
    return later(inv.missing_urls(a, b, PAIR)), inv.missing_urls(later(a), b, PAIR)


NEXT_MISSING = (
    PAIRS
    + """, m AS (SELECT x.target_id, n.next AS run_id, x.url FROM (SELECT * FROM a ANTI JOIN b USING (target_id, run_id, url)) x
  JOIN n USING (target_id, run_id) WHERE n.next IS NOT NULL),
later AS (SELECT a.target_id, n.next AS run_id, a.url FROM a JOIN n USING (target_id, run_id) WHERE n.next IS NOT NULL)
"""
)


@query(
    PAIRS
    + """SELECT target_id, run_id, count(*) AS n_urls, sha256(to_json(list_sort(list(url)))::VARCHAR) AS set_hash
FROM (SELECT * FROM a ANTI JOIN b USING (target_id, run_id, url)) GROUP BY ALL"""
)
def a12_missing_set_hash(spark, sf_dir):
    """What every run misses of the one before it, by its canonical name."""
    missing = inv.missing_urls(*pairs_of_runs(spark, sf_dir), PAIR)
    return inv.missing_set_hash(missing, ["target_id", "run_id"])


def _digest_sql(rows: str) -> str:
    part = lambda at, name: f"sum(('0x' || substr(url_hash, {at}, 15))::BIGINT::HUGEINT)::VARCHAR AS {name}"
    return f"SELECT target_id, run_id, count(*) AS n_urls, {part(1, 'digest_a')}, {part(16, 'digest_b')} FROM {rows} GROUP BY ALL"


@query(
    PAIRS
    + f"""SELECT 'all' AS kind, * FROM ({_digest_sql("{obs_hashed}")})
UNION ALL SELECT 'missing', * FROM ({_digest_sql("(SELECT * FROM a ANTI JOIN b USING (target_id, run_id, url))")})"""
)
def a13_url_set_hash(spark, sf_dir):
    """Digests of every run's URLs, and of those it misses of the run before it: the digest of that one less the digest of what
    both have, from counts and sums alone."""
    key = ["target_id", "run_id"]
    obs, _ = _obs(spark, sf_dir)
    before, after = pairs_of_runs(spark, sf_dir)
    both = before.join(after.select(*PAIR, "url_hash"), [*PAIR, "url_hash"], "left_semi")
    missing = inv.combined(inv.set_digest(before, key), inv.set_digest(both, key), key).where("n_urls > 0")
    named = lambda df, kind: df.select(F.lit(kind).alias("kind"), *key, "n_urls", *(F.col(c).cast("string") for c in inv.DIGEST[1:]))
    return named(inv.set_digest(obs, key), "all").unionByName(named(missing, "missing"))


@query(NEXT_MISSING + "SELECT target_id, run_id, url FROM m SEMI JOIN b USING (target_id, run_id, url)")
def j16_recovered_candidate_urls(spark, sf_dir):
    """What each run missed and the next one has again."""
    missing, _ = _missing_and_next(spark, sf_dir)
    after = pairs_of_runs(spark, sf_dir, hashed=False)[1]
    return inv.recovered_candidate_urls(missing, after, PAIR).select("target_id", "run_id", "url")


@query(
    NEXT_MISSING
    + """, s AS (SELECT target_id, run_id, list_sort(list(DISTINCT url)) AS u FROM m GROUP BY ALL),
t AS (SELECT target_id, run_id, list_sort(list(DISTINCT url)) AS u FROM (SELECT * FROM later ANTI JOIN b USING (target_id, run_id, url)) GROUP BY ALL)
SELECT s.target_id, s.run_id FROM s JOIN t ON s.target_id = t.target_id AND s.run_id = t.run_id AND s.u = t.u"""
)
def j11_same_missing_set(spark, sf_dir):
    """Runs that miss the same URLs, at least one, of the run before last as the last run did."""
    first, second = _missing_and_next(spark, sf_dir)
    return inv.same_missing_set(first, second, ["target_id", "run_id"])


@query("SELECT DISTINCT target_id, run_id, url FROM {obs}")
def u1_union_site_urls(spark, sf_dir):
    obs = table(spark, sf_dir, "obs_hashed")
    files = obs.unionAll(obs.where(F.length("url") % 2 == 0))
    return inv.union_site_urls(files).select("target_id", "run_id", "url")


@query("SELECT DISTINCT target_id, run_id, url FROM {obs}")
def s2_explode_run_urls(spark, sf_dir):
    obs = table(spark, sf_dir, "obs")
    results = F.to_json(F.struct(F.collect_list("url").alias("urls"))).alias("result")
    runs = obs.unionAll(obs).groupBy("target_id", "scope_version", F.col("run_id").alias("id"), "observed_at").agg(results)
    rows = inv.explode_run_urls(runs.withColumn("completeness", F.lit("complete")))
    return rows.select("target_id", "run_id", "url")


@query(
    GAPS
    + """SELECT g.target_id, n.run_id, g.url, 'added' AS kind FROM g JOIN n USING (target_id, seq) WHERE prev_seq IS NULL
UNION ALL SELECT g.target_id, n.run_id, g.url, 'reappeared' FROM g JOIN n ON n.target_id = g.target_id AND n.seq = g.next_seq
WHERE confirmed_seq IS NOT NULL"""
)
def j4_added_urls(spark, sf_dir):
    """Every run against the inventory just before it, the first run's too."""
    obs, runs = _obs(spark, sf_dir)
    before = inv.url_gaps(obs, runs).where("next_seq IS NOT NULL").select(
        "website_id", "scope_version", F.col("next_run_id").alias("run_id"),
        F.col("url_hash").alias("normalized_url_hash"), F.when(F.col("confirmed_seq").isNotNull(), "removed").otherwise("active").alias("status"),
    )
    found = inv.added_urls(obs, before, ["website_id", "scope_version", "run_id"])
    return found.select("target_id", "run_id", "url", "kind")


@query("SELECT target_id, run_id, url, url_hash FROM {obs_hashed}")
def u4_dedupe_records(spark, sf_dir):
    """All observations, half of them twice."""
    obs = table(spark, sf_dir, "obs_hashed")
    again = obs.where(F.length("url") % 2 == 0)
    return inv.dedupe_records(obs.unionAll(again)).select("target_id", "run_id", "url", "url_hash")


@query(STATE_SQL)
def p2_adopt_step_by_step(spark, sf_dir):
    """All runs folded by the adoption rules in each URL's row: equals the closed form."""
    obs, runs = _obs(spark, sf_dir)
    marked = inv.numbered_runs(runs).withColumn("is_baseline", F.col("seq") == 0)
    state, _ = adopt.apply_runs(adopt.empty_state(obs), obs, marked)
    return state.select(*STATE_COLUMNS)


#: Quarantine thresholds and candidate life for sites of a dozen URLs scanned monthly.
LEAST, RATIO, TTL_DAYS = 3, 0.3, 70
SUSP = f"""
WITH RECURSIVE all_runs AS (
  SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY observed_at, run_id) - 1 AS seq FROM {{runs}}
), sets AS (
  SELECT r.website_id, r.target_id, r.run_id, r.seq, r.observed_at AS seen, list_sort(list(o.url)) AS u
  FROM all_runs r JOIN {{obs}} o USING (target_id, run_id) GROUP BY ALL
), fold AS (
  SELECT target_id, seq, run_id, seen, u AS base, NULL::VARCHAR AS base_run, run_id AS base_now, NULL::VARCHAR AS held_run,
    NULL::TIMESTAMP AS held_at, NULL::VARCHAR[] AS held, 'baseline' AS decision, NULL::VARCHAR AS met, NULL::VARCHAR AS outcome
  FROM sets WHERE seq = 0
  UNION ALL
  SELECT target_id, seq, run_id, seen, CASE WHEN decision = 'applied' THEN u ELSE base END, base_now,
    CASE WHEN decision = 'applied' THEN run_id ELSE base_now END,
    CASE WHEN decision = 'applied' THEN NULL WHEN outcome = 'quarantined' THEN held_run ELSE run_id END,
    CASE WHEN decision = 'applied' THEN NULL WHEN outcome = 'quarantined' THEN held_at ELSE seen END,
    CASE WHEN decision = 'applied' THEN NULL WHEN outcome = 'quarantined' THEN held ELSE m END,
    decision, held_run, outcome
  FROM (SELECT *, CASE WHEN outcome = 'confirmed' THEN 'applied' WHEN outcome = 'quarantined' THEN 'quarantined'
      WHEN len(base) > 0 AND len(m) >= {LEAST} AND len(m) / len(base) >= {RATIO} THEN 'quarantined' ELSE 'applied' END AS decision
    FROM (SELECT *, CASE WHEN held_run IS NULL THEN NULL WHEN seen >= held_at + INTERVAL {TTL_DAYS} DAY THEN 'expired'
        WHEN m <> held THEN 'missing_set_changed' WHEN seen >= held_at + INTERVAL 1 HOUR THEN 'confirmed' ELSE 'quarantined' END AS outcome
      FROM (SELECT s.*, f.base, f.base_now, f.held_run, f.held_at, f.held, list_filter(f.base, lambda x: NOT list_contains(s.u, x)) AS m
        FROM fold f JOIN sets s ON s.target_id = f.target_id AND s.seq = f.seq + 1)))
), decided AS (
  SELECT target_id, run_id, CASE WHEN run_id IN (SELECT met FROM fold WHERE outcome = 'confirmed') THEN 'first_observation' ELSE decision END AS decision,
    base_run AS baseline_run_id, met AS candidate_run_id, outcome FROM fold
)
"""
#: The closed form over the adopted runs alone.
ADOPTED = SUSP + "," + GAPS.strip().removeprefix("WITH ").replace(
    "FROM {runs}", "FROM {runs} WHERE run_id IN (SELECT run_id FROM decided WHERE decision <> 'quarantined')"
) + "\n"


def _adopted(spark, sf_dir):
    obs, runs = _obs(spark, sf_dir)
    return adopt.adopt_history(adopt.empty_state(obs), obs, runs, LEAST, RATIO, 24 * TTL_DAYS)


@query(SUSP + "SELECT * FROM decided")
def h5_adopt_sequence(spark, sf_dir):
    obs, runs = _obs(spark, sf_dir)
    decided = adopt.decide_history(obs, runs, LEAST, RATIO, 24 * TTL_DAYS)
    return decided.select("target_id", "run_id", "decision", "baseline_run_id", "candidate_run_id", "outcome")


@query(
    STATE_SQL.replace(GAPS, ADOPTED).replace("FROM {obs} GROUP BY ALL) f", "FROM {obs} WHERE run_id IN (SELECT run_id FROM n) GROUP BY ALL) f")
)
def p2_adopt_observation(spark, sf_dir):
    """All histories with quarantine: state after baselines, applied runs and confirmed candidates."""
    return _adopted(spark, sf_dir)[0].select(*STATE_COLUMNS)


@query(
    SUSP
    + """SELECT f.met AS candidate_id, f.run_id, f.outcome AS decision, len(c.held) AS original_missing_count,
  CASE f.outcome WHEN 'confirmed' THEN 0 ELSE len(list_intersect(c.held, x.m)) END AS pending_count,
  len(c.held) - len(list_intersect(c.held, x.m)) AS recovered_count, CASE f.outcome WHEN 'confirmed' THEN len(c.held) ELSE 0 END AS removed_count
FROM fold f JOIN fold c ON c.target_id = f.target_id AND c.run_id = f.met
JOIN (SELECT f2.run_id, list_filter(b.u, lambda y: NOT list_contains(s.u, y)) AS m FROM fold f2 JOIN sets s USING (run_id) JOIN sets b ON b.run_id = f2.base_run) x
  ON x.run_id = f.run_id
WHERE f.outcome IN ('confirmed', 'quarantined', 'missing_set_changed')"""
)
def p3_confirm_candidates(spark, sf_dir):
    """Every candidate against each later run that found it open, by their missing sets of the baseline in force."""
    obs, runs = _obs(spark, sf_dir)
    decided = stored(adopt.decide_history(obs, runs, LEAST, RATIO, 24 * TTL_DAYS), "decided")
    met = decided.where("outcome IS NOT NULL AND outcome <> 'expired'")
    met = met.select(F.concat_ws("|", "candidate_run_id", "run_id").alias("candidate_id"), "run_id", "observed_at", "candidate_run_id", "baseline_run_id")
    urls = obs.select("run_id", F.col("url").alias("url_hash"))
    of = lambda c: met.select("candidate_id", F.col(c).alias("run_id")).join(urls, "run_id").select("candidate_id", "url_hash")
    base = of("baseline_run_id")
    cand = met.select(F.col("candidate_run_id").alias("run_id"), F.col("candidate_id").alias("id")).join(runs.select("run_id", "observed_at"), "run_id")
    cand = cand.withColumn("status", F.lit("pending"))
    lost = lambda c: inv.set_difference(base, of(c), ["candidate_id", "url_hash"])
    out = upkeep.confirm_candidates(cand, lost("candidate_run_id"), lost("run_id"), met.select("candidate_id", "observed_at"))
    part = lambda k: F.split_part("candidate_id", F.lit("|"), F.lit(k))
    counts = [c for c in out.columns if c.endswith("_count")]
    return out.select(part(1).alias("candidate_id"), part(2).alias("run_id"), "decision", *counts)


#: Times of the runs pressed together: twenty hours for a month, so that candidates outlive some runs by their target's interval.
PRESSED = "TIMESTAMP '2024-01-01' + to_hours((20 * ((year(observed_at) - 1990) * 12 + month(observed_at)))::BIGINT)"
INTERVAL = "CASE target_id::BIGINT % 4 WHEN 0 THEN 6 WHEN 1 THEN 40 WHEN 2 THEN 60 ELSE 500 END"
#: SUSP over pressed times, with the expiry of each target's own interval.
OWN_EXPIRY = SUSP.replace(
    "SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY observed_at, run_id) - 1 AS seq FROM {runs}",
    f"SELECT website_id, target_id, run_id, {PRESSED} AS observed_at, row_number() OVER (PARTITION BY target_id ORDER BY observed_at, run_id) - 1 AS seq FROM {{runs}}",
).replace(f"INTERVAL {TTL_DAYS} DAY", f"to_hours(least(336, greatest(72, 3 * ({INTERVAL})))::BIGINT)")


CANDIDATE_ROWS = (
    OWN_EXPIRY
    + f""", met AS (SELECT f.*, list_filter(b.u, lambda y: NOT list_contains(s.u, y)) AS m FROM fold f JOIN sets s USING (run_id) JOIN sets b ON b.run_id = f.base_run),
ended AS (SELECT met AS run_id, outcome, run_id AS by_run, m FROM met WHERE outcome IN ('confirmed', 'expired', 'missing_set_changed')),
opened AS (SELECT * FROM fold WHERE held_run = run_id)
SELECT o.run_id AS candidate_run_id, o.base_run AS origin_baseline_run_id, o.seen AS observed_at,
  o.seen + to_hours(least(336, greatest(72, 3 * ({INTERVAL})))::BIGINT) AS expires_at,
  CASE e.outcome WHEN 'missing_set_changed' THEN 'rejected' ELSE coalesce(e.outcome, 'pending') END AS status,
  CASE e.outcome WHEN 'missing_set_changed' THEN e.outcome END AS reason, len(o.held) AS original_missing_count,
  CASE e.outcome WHEN 'confirmed' THEN 0 WHEN 'missing_set_changed' THEN len(list_intersect(o.held, e.m)) ELSE len(o.held) END AS pending_count,
  CASE e.outcome WHEN 'missing_set_changed' THEN len(o.held) - len(list_intersect(o.held, e.m)) ELSE 0 END AS recovered_count,
  CASE e.outcome WHEN 'confirmed' THEN len(o.held) ELSE 0 END AS removed_count,
  CASE WHEN e.outcome IN ('confirmed', 'missing_set_changed') THEN e.by_run END AS last_confirmation_run_id
FROM opened o LEFT JOIN ended e USING (run_id)""".replace("target_id::", "o.target_id::")
)


@query(CANDIDATE_ROWS)
def p3_candidate_rows(spark, sf_dir):
    """The candidates of all histories as rows, each target's expiring by its own interval (6, 40, 60 or 500 hours)."""
    return pressed_candidates(spark, sf_dir).drop("website_id", "target_id", "scope_version")


def pressed_candidates(spark, sf_dir):
    obs, runs = _obs(spark, sf_dir)
    n = F.col("target_id").cast("long") % 4
    targets = runs.select("target_id").distinct().withColumn("checkIntervalHours", F.when(n == 0, 6).when(n == 1, 40).when(n == 2, 60).otherwise(500))
    month = (F.year("observed_at") - 1990) * 12 + F.month("observed_at")
    pressed = F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01").cast("timestamp")) + month * 72_000)
    timed = adopt.with_expiry(runs.withColumn("observed_at", pressed), targets)
    return adopt.candidate_rows(adopt.decide_history(obs, timed, LEAST, RATIO))


#: Each third target's scope moves on in the middle of 1995. Each fourth month's runs after that still come with the old one.
MOVED = "target_id::BIGINT % 3 = 0 AND observed_at >= TIMESTAMP '1995-06-15'"
SCOPED = f"""
mine AS (SELECT *, {MOVED} AS moved, {MOVED} AND month(observed_at) % 4 = 0 AS stale FROM {{obs_hashed}}),
scoped_obs AS (SELECT website_id, concat(target_id, '/', CASE WHEN moved THEN 2 ELSE 1 END) AS target_id, run_id, observed_at, url, url_hash FROM mine WHERE NOT stale),
scoped_runs AS (SELECT DISTINCT website_id, target_id, run_id, observed_at FROM scoped_obs),
"""
IN_SCOPE = ADOPTED.replace("{obs_hashed}", "scoped_obs").replace("{obs}", "scoped_obs").replace("{runs}", "scoped_runs").replace("WITH RECURSIVE ", "WITH RECURSIVE " + SCOPED).replace(
    "target_id::", "split_part(target_id, '/', 1)::"
).replace("split_part(target_id, '/', 1)::BIGINT % 3 = 0", "target_id::BIGINT % 3 = 0")


@query(
    IN_SCOPE
    + """SELECT e.website_id, url, kind, n.run_id FROM events e JOIN n ON n.target_id = e.target_id AND n.seq = e.at
UNION ALL SELECT DISTINCT website_id, NULL, 'stale: scope', run_id FROM mine WHERE stale"""
)
def r1_stream_adopt(spark, sf_dir):
    """All runs, in micro-batches by time, with quarantine. Some targets' scope moves on: they start anew with a baseline, and
    runs that still come with the old scope are stale."""
    obs = table(spark, sf_dir, "obs_hashed").select(*adopt.SITE, "run_id", "observed_at", "url", "url_hash")
    third, since = F.col("target_id").cast("long") % 3 == 0, F.lit("1995-06-15").cast("timestamp")
    moved = third & (F.col("observed_at") >= since) & (F.month("observed_at") % 4 != 0)
    obs = obs.withColumn("scope_version", F.when(moved, 2).otherwise(1).cast("int"))
    targets = table(spark, sf_dir, "runs").select("target_id").distinct()
    first = targets.select("target_id", F.lit(1).alias("scope_version"), F.lit("1990-01-01").cast("timestamp").alias("valid_from"))
    scopes = stored(first.unionByName(targets.where(third).select("target_id", F.lit(2).alias("scope_version"), since.alias("valid_from"))), "scopes")
    stream, folder = as_stream(obs, spark, "r1", ["target_id"], F.unix_seconds("observed_at"))
    jobs.stream_adopt(stream, f"{folder}/out", f"{folder}/checkpoint", LEAST, RATIO, 24 * TTL_DAYS, scopes).awaitTermination()
    events = spark.read.parquet(f"{folder}/out/events").select("website_id", "url", "kind", "run_id")
    stale = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/out/stale")
    reason = F.concat(F.lit("stale: "), "reason").alias("kind")
    return events.unionByName(stale.select("website_id", F.lit(None).cast("string").alias("url"), reason, "run_id"))


@query(
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY observed_at, run_id) - 1 AS seq FROM {runs}),
p AS (SELECT o.target_id, o.url, n.seq FROM {obs} o JOIN n USING (target_id, run_id)),
c AS (SELECT target_id, seq, count(*) AS n FROM p GROUP BY ALL),
k AS (SELECT a.target_id, b.seq, count(*) AS n FROM p a JOIN p b ON a.target_id = b.target_id AND a.url = b.url AND b.seq = a.seq + 1
  GROUP BY ALL),
s AS (SELECT n.target_id, n.run_id, n.seq, coalesce(a.n, 0) AS previous, coalesce(a.n, 0) - coalesce(k.n, 0) AS missing,
  coalesce(c.n, 0) AS current FROM n LEFT JOIN c USING (target_id, seq)
  LEFT JOIN c a ON a.target_id = n.target_id AND a.seq = n.seq - 1 LEFT JOIN k ON k.target_id = n.target_id AND k.seq = n.seq)
SELECT target_id, max(CASE WHEN seq > 0 AND previous > 0 AND (current = 0 OR (missing >= 3 AND missing / previous >= 0.3))
  THEN 1 ELSE 0 END)::INT AS any_suspicious FROM s GROUP BY 1"""
)
def x26_suspicious_targets(spark, sf_dir):
    decided = adopt.decide_history(*_obs(spark, sf_dir), least=3, ratio=0.3)
    held = F.col("decision").isin("quarantined", "first_observation")
    return decided.groupBy("target_id").agg(F.max(held.cast("int")).alias("any_suspicious"))
