"""Queries of alerts from changes, candidate pages and approvals, retention, table and file sources, expiry."""

from __future__ import annotations

import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..bindings import table
from ..functions import payloads as pl
from ..functions import web
from ..operators import adopt
from ..operators import inventory as inv
from ..operators import snapshots as sn
from ..operators import views as vi
from ..plans import alerts, upkeep
from ..scratch import fresh_folder, partitions, stored
from ..sources import tables as src
from ..streaming import jobs
from .base import as_stream, query
from .inventory import PAIRS, pairs_of_runs
from .scalars import LINES, SERIES
from .views import CANDIDATES, candidates_of, named

LINK_SCOPE = "CASE target_id::BIGINT % 4 WHEN 0 THEN 'BOTH' WHEN 1 THEN 'NEW' WHEN 2 THEN 'REMOVED' END"


@query(
    PAIRS
    + f""", d AS (SELECT target_id, run_id, url, 'added' AS change FROM b ANTI JOIN a USING (target_id, run_id, url)
UNION ALL SELECT target_id, run_id, url, 'removed' FROM a ANTI JOIN b USING (target_id, run_id, url)),
e AS (SELECT target_id, run_id, change, count(*) AS n, list_sort(list(url)) AS urls FROM d
  WHERE coalesce({LINK_SCOPE}, 'BOTH') IN ('BOTH', CASE change WHEN 'added' THEN 'NEW' ELSE 'REMOVED' END) GROUP BY ALL)
SELECT run_id, CASE change WHEN 'added' THEN 'NEW_LINK' ELSE 'REMOVED_LINK' END AS kind,
  concat(n, CASE change WHEN 'added' THEN ' new link' ELSE ' link' END, CASE WHEN n <> 1 THEN 's' ELSE '' END,
    CASE change WHEN 'added' THEN ' on s' ELSE ' removed from s' END, target_id, '.example.com') AS title,
  concat('{{"', change, '":', to_json(urls[1:100])::VARCHAR, '}}') AS details FROM e"""
)
def p8_link_alerts(spark, sf_dir):
    """Alerts of every run against the one before it, within the scope of its target; a first run never alerts."""
    number = F.col("target_id").cast("long") % 4
    scope = F.when(number == 0, "BOTH").when(number == 1, "NEW").when(number == 2, "REMOVED")
    diff = inv.link_diff(*pairs_of_runs(spark, sf_dir), ["target_id", "run_id"])
    emits = F.when(F.col("change") == "added", vi.link_scope_emits(scope, "new")).otherwise(vi.link_scope_emits(scope, "removed"))
    domain = F.concat(F.lit("s"), "target_id", F.lit(".example.com"))
    return sn.link_alerts(diff.where(emits).withColumn("domain", domain))


CHANGED_PRICES = (
    "WITH " + SERIES + """, c AS (SELECT page::VARCHAR AS page, id, price, nullif(trim(currency), '') AS currency, previous_price, nullif(trim(previous_currency), '') AS previous_currency
FROM s WHERE is_product_page AND was_page AND (price IS DISTINCT FROM previous_price OR coalesce(currency, '') <> coalesce(previous_currency, ''))),
t AS (SELECT *, CASE WHEN price IS NULL THEN '—' ELSE concat_ws(' ', currency, price::BIGINT) END AS new,
  CASE WHEN previous_price IS NULL THEN '—' ELSE concat_ws(' ', previous_currency, previous_price::BIGINT) END AS old FROM c)
"""
)


def _price_changes(spark, sf_dir):
    return sn.price_changes(table(spark, sf_dir, "price").withColumn("page", F.col("page").cast("string")))


@query(
    CHANGED_PRICES
    + """SELECT id, 'PRODUCT_PRICE' AS kind, concat('Price change: ', page, ' (', old, ' → ', new, ')') AS title,
  concat('{"pageUrl":"', page, '","productName":null,"previousPrice":', coalesce(previous_price::BIGINT::VARCHAR, 'null'),
    ',"previousCurrency":', coalesce('"' || previous_currency || '"', 'null'), ',"newPrice":', coalesce(price::BIGINT::VARCHAR, 'null'),
    ',"newCurrency":', coalesce('"' || currency || '"', 'null'), '}') AS details FROM t"""
)
def p8_price_alerts(spark, sf_dir):
    return sn.price_alerts(_price_changes(spark, sf_dir))


@query(
    CHANGED_PRICES
    + """SELECT id, concat('Product: ', page, chr(10), 'Page: ', page, chr(10), 'Previous price: ', old, chr(10), 'New price: ', new, chr(10),
  'Alert title: ', 'Price change: ', page, ' (', old, ' → ', new, ')') AS text FROM t"""
)
def x34_price_texts(spark, sf_dir):
    changes, c = _price_changes(spark, sf_dir), F.col
    text = pl.price_change_text(
        F.lit(None).cast("string"), c("page"), c("previous_price"), c("previous_currency"), c("price"), c("currency"),
        sn.price_alert_title(c("page"), c("previous_price"), c("previous_currency"), c("price"), c("currency")),
    )
    return changes.select("id", text.alias("text"))


#: The alerts of the three kinds, over one table of snapshots: each has SQL of its own above.
DETECTED = (
    PAIRS.strip()
    + f""", ld AS (SELECT target_id, run_id, url, 'added' AS change FROM b ANTI JOIN a USING (target_id, run_id, url)
UNION ALL SELECT target_id, run_id, url, 'removed' FROM a ANTI JOIN b USING (target_id, run_id, url)),
le AS (SELECT target_id, run_id, change, count(*) AS n, list_sort(list(url)) AS urls FROM ld
  WHERE coalesce({LINK_SCOPE}, 'BOTH') IN ('BOTH', CASE change WHEN 'added' THEN 'NEW' ELSE 'REMOVED' END) GROUP BY ALL),
"""
    + LINES.strip().removeprefix("WITH ")
    + ", "
    + CHANGED_PRICES.strip().removeprefix("WITH ").replace("c AS (SELECT page::VARCHAR AS page, id,", "pc AS (SELECT page::VARCHAR AS page, createdAt, id,", 1).replace("FROM c)", "FROM pc)").replace("t AS (SELECT", "pt AS (SELECT", 1)
    + """
SELECT concat('run-', run_id) AS snapshot_id, CASE change WHEN 'added' THEN 'NEW_LINK' ELSE 'REMOVED_LINK' END AS kind,
  concat(n, CASE change WHEN 'added' THEN ' new link' ELSE ' link' END, CASE WHEN n <> 1 THEN 's' ELSE '' END,
    CASE change WHEN 'added' THEN ' on s' ELSE ' removed from s' END, target_id, '.example.com') AS title,
  concat('{"', change, '":', to_json(urls[1:100])::VARCHAR, '}') AS details FROM le
UNION ALL SELECT concat('text-', v.id), 'PAGE_CONTENT', concat('Content changed on ', s.targetUrl), concat('{"pageUrl":', to_json(s.targetUrl)::VARCHAR,
  ',"diffPreview":', to_json(preview)::VARCHAR, ',"totalAdded":', n_a, ',"totalRemoved":', n_r, '}') FROM v JOIN {snap} s ON s.id = v.id
UNION ALL SELECT concat('price-', page, '/', id, '/', strftime(createdAt, '%Y-%m-%d')), 'PRODUCT_PRICE', concat('Price change: ', page, ' (', old, ' → ', new, ')'),
  concat('{"pageUrl":"', page, '","productName":null,"previousPrice":', coalesce(previous_price::BIGINT::VARCHAR, 'null'),
    ',"previousCurrency":', coalesce('"' || previous_currency || '"', 'null'), ',"newPrice":', coalesce(price::BIGINT::VARCHAR, 'null'),
    ',"newCurrency":', coalesce('"' || currency || '"', 'null'), '}') FROM pt"""
)


@query(DETECTED)
def p8_detect_alerts(spark, sf_dir):
    """Link sets of all runs, all texts and all prices as one table of snapshots, and a target for each page."""
    none = F.lit(None).cast("string")
    obs = table(spark, sf_dir, "obs").groupBy("target_id", "run_id", "observed_at").agg(F.to_json(F.array_sort(F.collect_list("url"))).alias("payload"))
    obs = stored(obs, "runs")
    # ids of one moment are in order of their numbers, prices that share these too as elsewhere
    ties = ("boolean", "string", "double")
    moment = lambda t, n=None: F.struct(t.alias("taken"), *([F.lit(0).cast("long").alias("n"), *(F.lit(None).cast(k).alias(c) for c, k in zip(sn.PRICE_TIES, ties, strict=True))] if n is None else [n.alias("n"), *sn.PRICE_TIES])).alias("taken")
    links = obs.select(
        F.concat(F.lit("run-"), "run_id").alias("id"), F.col("target_id").alias("websiteId"), F.lit("SITEMAP").alias("kind"), none.alias("targetUrl"),
        "payload", moment(F.unix_seconds("observed_at")),
    )
    texts = table(spark, sf_dir, "snap").select(
        F.concat(F.lit("text-"), "id").alias("id"), F.concat(F.lit("t/"), "websiteId").alias("websiteId"), "kind", "targetUrl", "payload", moment(F.col("taken").cast("long")),
    )
    product = F.struct("is_product_page", F.lit(None).cast("string").alias("productName"), "price", "currency")
    prices = table(spark, sf_dir, "price").select(
        F.concat(F.lit("price-"), "page", F.lit("/"), "id", F.lit("/"), F.date_format("createdAt", "yyyy-MM-dd")).alias("id"), F.lit("shop").alias("websiteId"), F.lit("PRODUCT").alias("kind"), F.col("page").cast("string").alias("targetUrl"),
        F.to_json(product).alias("payload"), moment(F.unix_seconds(F.col("createdAt").cast("timestamp")), F.col("id")),
    )
    snap = links.unionByName(texts).unionByName(prices).withColumn("hash", F.sha2("payload", 256))
    sites = links.select("websiteId").distinct()
    number = F.col("websiteId").cast("long") % 4
    scope = F.when(number == 0, "BOTH").when(number == 1, "NEW").when(number == 2, "REMOVED")
    target = sites.select(F.concat(F.lit("l_"), "websiteId").alias("id"), "websiteId", F.lit("SITEMAP_LINKS").alias("kind"), scope.alias("linkScope"), none.alias("pageUrl"))
    for rows, kind in ((texts, "PAGE_CONTENT"), (prices, "PRODUCT_PRICE")):
        pages = rows.select("websiteId", "targetUrl").distinct()
        name = F.concat_ws("/", F.lit(kind), "websiteId", "targetUrl").alias("id")
        target = target.unionByName(pages.select(name, "websiteId", F.lit(kind).alias("kind"), none.alias("linkScope"), F.col("targetUrl").alias("pageUrl")))
    website = sites.select(F.col("websiteId").alias("id"), F.concat(F.lit("s"), "websiteId", F.lit(".example.com")).alias("domain"))
    return alerts.detect_alerts(snap, target, website).select("snapshot_id", "kind", "title", "details")


@query(
    LINES
    + """SELECT id, sha256(concat('Page: page ', id, chr(10), 'Lines added: ', n_a, ', removed: ', n_r, chr(10), chr(10), 'Diff:', chr(10),
  CASE WHEN trim(preview) = '' THEN '(diff preview unavailable)' ELSE trim(preview) END)) AS text_hash FROM v"""
)
@named("snap_hashed")
def x34_content_texts(snap):
    rows = sn.content_alerts(snap)
    text = pl.content_change_text(F.concat(F.lit("page "), "id"), F.col("preview"), F.col("totalAdded"), F.col("totalRemoved"))
    return rows.select("id", F.sha2(text, 256).alias("text_hash"))


MISSED = PAIRS + ", m AS (SELECT target_id, run_id, url, url_hash FROM a ANTI JOIN b USING (target_id, run_id, url))\n"


@query(
    MISSED
    + """, one AS (SELECT run_id, count(*) AS total FROM m GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
SELECT url, 'pending' AS resolution, total, CASE WHEN total > 5 THEN 5 END::INT AS next_offset FROM m JOIN one USING (run_id)
ORDER BY url_hash LIMIT 3 OFFSET 2"""
)
def t6_candidate_urls_page(spark, sf_dir):
    """The second page of the candidate that misses most, three to a page, with the total and the next page's offset."""
    missing = inv.missing_urls(*pairs_of_runs(spark, sf_dir, hashed=False), ["target_id", "scope_version", "run_id"]).select(
        F.col("run_id").alias("candidate_id"), F.col("url_hash").alias("url"), F.sha2("url_hash", 256).alias("normalized_url_hash"), F.lit("pending").alias("resolution")
    )
    most = missing.groupBy("candidate_id").count().orderBy(F.desc("count"), "candidate_id").first()
    path = fresh_folder(spark, "t6")
    vi.write_candidate_urls(missing, path)
    return vi.candidate_urls_page(spark, path, missing.schema, most.candidate_id if most else "", 3, 2)


@query(
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY target_id ORDER BY observed_at, run_id) - 1 AS seq FROM {runs}),
p AS (SELECT o.*, n.seq FROM {obs} o JOIN n USING (target_id, run_id) WHERE seq < 2),
c AS (SELECT target_id, run_id, target_id::BIGINT % 5 = 0 AS moved, target_id::BIGINT % 7 = 0 AS done, target_id::BIGINT % 11 = 0 AS late FROM n WHERE seq = 1),
k AS (SELECT x.target_id, count(*) AS n FROM p x WHERE seq = 0 AND NOT EXISTS (SELECT 1 FROM p y WHERE y.target_id = x.target_id AND y.seq = 1 AND y.url = x.url) GROUP BY 1)
SELECT run_id AS candidate_id, CASE WHEN NOT moved AND done THEN 'confirmed' WHEN NOT moved AND NOT late THEN 'adopted' END AS status,
  NOT moved AND NOT done AND NOT late AS changed, CASE WHEN moved OR (NOT done AND late) THEN 'CANDIDATE_STALE' END AS error,
  CASE WHEN moved OR done OR late THEN 0 ELSE coalesce(k.n, 0) END AS pending FROM c LEFT JOIN k USING (target_id)"""
)
def p4_approve_candidates(spark, sf_dir):
    """Each target's second run as a candidate against its first: some of another scope, confirmed before, or too late."""
    obs, runs = table(spark, sf_dir, "obs_hashed"), inv.numbered_runs(table(spark, sf_dir, "runs"))
    first, second = runs.where("seq = 0"), runs.where("seq = 1")
    seen = lambda r: obs.join(r.select("target_id", "run_id"), ["target_id", "run_id"], "left_semi")
    state, _ = adopt.apply_runs(adopt.empty_state(obs), seen(first), first.withColumn("is_baseline", F.lit(True)))
    n = F.col("target_id").cast("long")
    base = first.select("target_id", F.col("run_id").alias("origin_baseline_run_id"))
    cand = second.join(base, "target_id").select(
        F.col("run_id").alias("id"), "target_id", "scope_version", F.when(n % 7 == 0, "confirmed").otherwise("pending").alias("status"),
        "origin_baseline_run_id", F.col("run_id").alias("candidate_run_id"), "observed_at",
        F.when(n % 11 == 0, F.lit("1990-01-01").cast("timestamp")).otherwise(F.lit("2030-01-01").cast("timestamp")).alias("expires_at"),
    )
    target = first.select(F.col("target_id").alias("id"), "website_id", F.when(n % 5 == 0, 2).otherwise(1).alias("scope_version"), F.col("run_id").alias("baseline_run_id"))
    now = F.lit("2020-01-01").cast("timestamp")
    outcomes, new, _ = upkeep.approve_candidates(cand.select(F.col("id").alias("candidate_id")), cand, target, state, seen(second), now)
    pending = new.where("status = 'pending_removed'").groupBy("target_id").agg(F.count(F.lit(1)).alias("pending"))
    of = cand.select(F.col("id").alias("candidate_id"), "target_id").join(pending, "target_id", "left").drop("target_id")
    return outcomes.join(of, "candidate_id").fillna(0, ["pending"])


#: Tables for retention, out of runs by number.
KEPT = """r AS (SELECT id, id::BIGINT AS n, execution_status, created_at, target_id FROM {run}),
keep AS (SELECT id FROM r WHERE n % 50 = 0 OR n % 70 = 1),
s AS (SELECT r.*, created_at < TIMESTAMP '1998-01-01' - INTERVAL 90 DAY AND id NOT IN (SELECT id FROM keep) AS gone FROM r),
x AS (SELECT id, n, 1 + n % 2 = 1 AS live FROM r WHERE n % 3 = 0),
used AS (SELECT id FROM s WHERE NOT gone UNION SELECT id FROM x WHERE live)
"""


@query(
    "WITH " + KEPT + """SELECT 'sources' AS kept, id, true AS whole FROM s WHERE NOT gone
UNION ALL SELECT 'cache', id, true FROM x WHERE live
UNION ALL SELECT 'runs', id, created_at >= TIMESTAMP '1998-01-01' - INTERVAL 180 DAY OR id IN (SELECT id FROM keep) OR execution_status = 'queued' FROM r
UNION ALL SELECT 'attempts', id, created_at >= TIMESTAMP '1998-01-01' - INTERVAL 180 DAY OR id IN (SELECT id FROM keep) FROM r
UNION ALL SELECT 'revisions', id, true FROM r WHERE created_at >= TIMESTAMP '1998-01-01' - INTERVAL 30 DAY OR id IN (SELECT id FROM used)"""
)
@named("run")
def p12_retention(run):
    """What retention leaves of five stored tables on the first of 1998, done twice: every row that is still there, and whether its
    results and errors are."""
    spark = run.sparkSession
    target, cand, tables = _to_retain(run)
    folder = fresh_folder(spark, "p12")
    upkeep.store_retained(tables, folder)
    for batch in (1, 2):
        upkeep.retain_stored(spark, folder, target, cand, datetime.datetime(1998, 1, 1), batch)
    left = upkeep.read_retained(spark, folder)
    whole = {"runs": "result IS NOT NULL AND error IS NOT NULL", "attempts": "error IS NOT NULL"}
    ids = {"sources": "run_id", "cache": "revision_id", "runs": "id", "attempts": "run_id", "revisions": "id"}
    parts = [df.select(F.lit(k).alias("kept"), F.col(ids[k]).alias("id"), F.expr(whole.get(k, "true")).alias("whole")) for k, df in left.items()]
    return reduce(DataFrame.unionByName, parts)


def _to_retain(run):
    """(targets, candidates, the five tables) out of runs by number."""
    n, none = F.col("id").cast("long"), F.lit(None).cast("string")
    text, at = lambda v: F.lit(v).cast("string"), F.col("created_at").cast("timestamp")
    runs = run.select("id", "execution_status", at.alias("finished_at"), text("{}").alias("result"), text("e").alias("error"))
    attempts = run.select(F.col("id").alias("run_id"), F.lit(1).alias("attempt"), text("e").alias("error"))
    sources = run.select(F.col("id").alias("run_id"), F.lit(1).alias("attempt"), text("u").alias("source_url"), "id", at.alias("created_at"))
    sources = sources.withColumnRenamed("id", "revision_id")
    target = run.where(n % 50 == 0).select(F.col("id").alias("id"), F.lit(1).alias("scope_version"), F.col("id").alias("baseline_run_id"))
    # each cached source belongs to a target of its own; odd numbers are of an older scope
    cached = run.where(n % 3 == 0)
    cache = cached.select(F.concat(F.lit("c"), "id").alias("target_id"), (1 + n % 2).cast("int").alias("scope_version"), F.col("id").alias("revision_id"))
    target = target.unionByName(cached.select(F.concat(F.lit("c"), "id").alias("id"), F.lit(1).alias("scope_version"), none.alias("baseline_run_id")))
    cand = run.where(n % 70 == 1).select(F.lit("pending").alias("status"), F.col("id").alias("candidate_run_id"), none.alias("origin_baseline_run_id"), none.alias("last_confirmation_run_id"))
    cache = cache.withColumn("source_url", F.lit("u"))
    attempts = attempts.join(runs.select(F.col("id").alias("run_id"), "finished_at"), "run_id")
    revisions = run.select("id", at.alias("created_at"))
    return target, cand, {"sources": sources, "cache": cache, "runs": runs, "attempts": attempts, "revisions": revisions}


@query(
    """SELECT fmt, id::VARCHAR AS id, CASE WHEN id % 10 NOT IN (3, 4, 5) THEN websiteId END AS websiteId,
  CASE WHEN id % 10 NOT IN (3, 4, 5) THEN is_read END AS is_read, CASE WHEN id % 10 NOT IN (3, 4, 5) THEN createdAt::TIMESTAMP END AS createdAt,
  id % 10 NOT IN (3, 4, 5) AS sound FROM {alert}, (VALUES ('parquet'), ('json'), ('csv')) f(fmt) WHERE fmt <> 'parquet' OR id % 10 NOT IN (3, 4, 5)"""
)
def s1_read_table(spark, sf_dir):
    """All alerts as Parquet, json and csv. Of the text records one in ten has a value of another type, a further one a field
    too many or too few, and a third isn't a whole record: those come back as they are, the others with their types."""
    folder = fresh_folder(spark, "s1")
    names = src.schema_of("alert").names
    empty = {c: F.lit(None).cast("string") for c in ("details", "suppressionReason")}
    rows = table(spark, sf_dir, "alert").withColumnRenamed("is_read", "read").withColumns(empty)
    n = F.col("id") % 10
    rows = rows.withColumns({"n": n, "id": F.col("id").cast("string"), "createdAt": F.col("createdAt").cast("timestamp")})
    rows.where("n NOT IN (3, 4, 5)").select(*names).write.parquet(f"{folder}/parquet")
    loose = rows.withColumn("read", F.when(F.col("n") == 3, "maybe").otherwise(F.col("read").cast("string")))
    record = F.to_json(F.struct(*names))
    record = F.when(F.col("n") == 3, record).otherwise(F.regexp_replace(record, '"read":"(true|false)"', '"read":$1'))
    record = F.when(F.col("n") == 4, F.regexp_replace(record, "}$", ',"surplus":1}')).when(F.col("n") == 5, F.substring(record, 1, 30)).otherwise(record)
    loose.select(record.alias("value")).write.text(f"{folder}/json")
    texts = loose.withColumn("createdAt", F.date_format("createdAt", "yyyy-MM-dd'T'HH:mm:ss"))
    line = F.array_join(F.array(*(F.concat(F.lit('"'), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"')) for c in names)), ",")
    line = F.when(F.col("n") == 4, F.concat(line, F.lit(',"surplus"'))).when(F.col("n") == 5, F.substring(line, 1, 30)).otherwise(line)
    # a header for each file: the first of a partition's lines
    parts = partitions(spark)
    lines = texts.select(line.alias("value"), F.lit(1).alias("k")).repartition(parts).withColumn("p", F.spark_partition_id())
    heads = lines.select("p").distinct().select(F.lit(",".join(names)).alias("value"), F.lit(0).alias("k"), "p")
    both = lines.unionByName(heads).repartition(parts, "p").sortWithinPartitions("p", "k").withColumn("file", F.col("p"))
    both.select("value", "file").write.partitionBy("file").text(f"{folder}/csv")
    out = None
    for fmt in ("parquet", "json", "csv"):
        good, bad = src.read_checked(spark, folder + f"/{fmt}" + ("/*" if fmt == "csv" else ""), "alert", fmt)
        good = good.select("id", "websiteId", F.col("read").alias("is_read"), "createdAt", F.lit(True).alias("sound"))
        lost = bad.select(
            F.regexp_extract("record", '^[^0-9]*([0-9]+)', 1).alias("id"), F.lit(None).cast("string").alias("websiteId"),
            F.lit(None).cast("boolean").alias("is_read"), F.lit(None).cast("timestamp").alias("createdAt"), F.lit(False).alias("sound"),
        )
        both = good.unionByName(lost).withColumn("fmt", F.lit(fmt))
        out = both if out is None else out.unionByName(both)
    return out


@query(
    """SELECT target_id, url, CASE WHEN n > 11 THEN 'RESOURCE_LIMIT' END AS error FROM (
  SELECT DISTINCT target_id, CASE WHEN n <= 11 THEN url END AS url, n FROM (SELECT target_id, url, max(CASE WHEN url LIKE '%/11' THEN 12 ELSE 1 END)
    OVER (PARTITION BY target_id) * CASE WHEN target_id::BIGINT % 5 = 0 THEN 1 ELSE 0 END AS n FROM {obs}))"""
)
def s3_read_sitemap_files(spark, sf_dir):
    """A file of all URLs of each target, each second one gzipped, read back and parsed. Each fifth target that has the URL of
    number 11 gets a file blown up beyond the limit, which isn't read."""
    obs = table(spark, sf_dir, "obs")
    entries = F.transform(F.collect_set("url"), lambda u: F.concat(F.lit("<url><loc>"), u, F.lit("</loc></url>")))
    large = (F.col("target_id").cast("long") % 5 == 0) & F.array_contains(F.collect_set(F.split_part("url", F.lit("/p/"), F.lit(2))), "11")
    # of random digits, so that gzip can't make it small
    blown = F.when(large, F.array_join(F.transform(F.sequence(F.lit(1), F.lit(200)), lambda k: F.sha2(F.concat("target_id", k.cast("string")), 256)), ""))
    body = F.concat(F.lit("<urlset>"), F.array_join(entries, ""), F.lit("<!--"), F.coalesce(blown, F.lit("")), F.lit("--></urlset>"))
    files = obs.groupBy("target_id").agg(body.alias("body")).repartition(partitions(spark))
    folder, odd = fresh_folder(spark, "s3"), F.col("target_id").cast("long") % 2 == 1
    for name, half, kind in (("plain", ~odd, "none"), ("packed", odd, "gzip")):
        # a file for each target: tasks move their own into place, or the driver would move all of them one after the other
        out = files.where(half).write.partitionBy("target_id").option("compression", kind)
        out.option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(f"{folder}/{name}")
    found = src.read_sitemap_files(spark, folder, max_file_bytes=4_000)
    target = F.regexp_extract("path", "target_id=([0-9]+)/", 1)
    parsed = web.parse_sitemaps(found.select(target.alias("target_id"), F.lit("r").alias("run_id"), F.col("path").alias("source_url"), "body", "error"))
    return parsed.select("target_id", F.explode_outer("locations").alias("url"), "error")


@query(
    "WITH " + CANDIDATES + """, m AS (SELECT target_id, scope, moved_at FROM (SELECT DISTINCT target_id FROM cand) t,
  (VALUES (1, TIMESTAMP '1993-01-01'), (2, TIMESTAMP '1995-01-01'), (1, TIMESTAMP '1997-01-01')) v(scope, moved_at) WHERE length(target_id) % 2 = 0),
c AS (SELECT cand.*, (SELECT min(moved_at) FROM m WHERE m.target_id = cand.target_id AND m.scope <> cand.scope_version AND m.moved_at > cand.observed_at) AS moved_at FROM cand)
SELECT id, status FROM c WHERE status <> 'pending'
UNION ALL SELECT id, 'stale' FROM c WHERE status = 'adopted' AND moved_at IS NOT NULL
UNION ALL SELECT id, CASE WHEN moved_at < expires_at THEN 'stale' ELSE 'expired' END FROM c WHERE status = 'pending'"""
)
def r3_stream_candidate_expiry(spark, sf_dir):
    """All candidates as they come, and some targets' changes of scope, there and back; a row years later lets the time of the
    pending ones run out."""
    rows = candidates_of(spark, sf_dir).select("target_id", "id", "status", "scope_version", F.col("observed_at").alias("updated_at"), "expires_at")
    none = lambda kind: F.lit(None).cast(kind)
    moves = F.array(*(F.struct(F.lit(k).alias("scope"), F.lit(t).cast("timestamp").alias("at")) for k, t in ((1, "1993-01-01"), (2, "1995-01-01"), (1, "1997-01-01"))))
    moved = rows.select("target_id").distinct().where(F.length("target_id") % 2 == 0).select("target_id", F.explode(moves).alias("m"))
    moved = moved.select("target_id", none("string").alias("id"), none("string").alias("status"), F.col("m.scope").alias("scope_version"), F.col("m.at").alias("updated_at"), none("timestamp").alias("expires_at"))
    last = rows.agg(F.max("expires_at")).first()[0]
    closing = spark.range(1).select(
        F.lit("").alias("target_id"), F.lit("").alias("id"), F.lit("confirmed").alias("status"), F.lit(1).alias("scope_version"),
        (F.lit(last) + F.expr("INTERVAL 1 DAY")).alias("updated_at"), none("timestamp").alias("expires_at"),
    )
    stream, folder = as_stream(rows.unionByName(moved).unionByName(closing), spark, "r3", ["target_id"], F.unix_seconds("updated_at"))
    return jobs.run_to_table(jobs.stream_candidate_expiry(stream), folder).where("id <> ''")
