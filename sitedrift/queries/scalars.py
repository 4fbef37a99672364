"""Queries of the column functions and snapshot operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import payloads as pa
from ..functions import text as tx
from ..functions import timing as tm
from ..functions import urls as ur
from ..operators import snapshots as sn
from .base import query
from .views import named

PATH = "regexp_replace(split_part(url, '?', 1), '^[a-z]+://[^/]+', '')"
HOST = "lower(regexp_extract(trim(url), '^(?i)https?://(?:[^/?#@]*@)?([^/?#:@\\s]+)', 1))"


@query(f"SELECT page_id, sha256(url) AS url_hash, {PATH} AS path FROM pages")
@named("pages")
def x2_x3_url_hash_and_path(pages):
    return pages.select("page_id", ur.url_hash(F.col("url")).alias("url_hash"), ur.url_path(F.col("url")).alias("path"))


@query(
    f"""SELECT page_id, (starts_with({PATH}, '/a') OR starts_with({PATH}, '/p')) AND NOT starts_with({PATH}, '/a%') AS kept FROM pages"""
)
@named("pages")
def f1_path_filter(pages):
    include, exclude = F.array(F.lit("/a"), F.lit("/p")), F.array(F.lit("/a%"))
    return pages.select("page_id", ur.path_filter(F.col("url"), include, exclude).alias("kept"))


@query(
    """SELECT id, CASE WHEN include_path = '' THEN [] ELSE ['/', include_path] END AS rules, NULL::VARCHAR AS error FROM {target}
WHERE n % 5 <> 0 UNION ALL SELECT id, NULL, 'INVALID_FILTER' FROM {target} WHERE n % 5 = 0"""
)
@named("target")
def f2_normalize_path_rules(target):
    path = F.col("include_path")
    rules = F.when(path == "", F.array().cast("array<string>")).otherwise(F.array(path, F.lit("/"), path))
    bad = F.concat(rules, F.array(F.lit("no slash")))
    r = ur.normalize_path_rules(F.when(F.col("n") % 5 == 0, bad).otherwise(rules))
    return target.select("id", r["rules"].alias("rules"), r["error"].alias("error"))


@query("SELECT page_id FROM pages WHERE contains(lower(url), '/en/')")
@named("pages")
def f3_search_urls(pages):
    return pages.where(ur.contains_text(F.col("url"), "/EN/")).select("page_id")


@query(
    f"""WITH h AS (SELECT page_id, {HOST} AS host, regexp_replace({HOST}, '^www\\.', '') AS bare FROM pages)
SELECT page_id, host, bare = 'site1.example.com' OR ends_with(bare, '.site1.example.com') OR ends_with(bare, '.com') AS inside,
  CASE WHEN contains(bare, '.') AND regexp_matches(bare, '^[a-z0-9.-]+$') THEN bare END AS domain FROM h"""
)
@named("pages")
def f7_x4_domains(pages):
    url = F.col("url")
    inside = ur.is_url_within_domain(url, F.lit("site1.example.com")) | F.endswith(
        F.regexp_replace(ur.host_of(url), "^www\\.", ""), F.lit(".com")
    )
    return pages.select(
        "page_id", ur.host_of(url).alias("host"), inside.alias("inside"), ur.normalize_domain(url).alias("domain")
    )


@query(
    f"""WITH h AS (SELECT page_id, {HOST} AS host FROM pages)
SELECT page_id, list_sort([host, CASE WHEN starts_with(host, 'www.') THEN substr(host, 5) ELSE concat('www.', host) END]) AS hosts FROM h"""
)
@named("pages")
def x5_page_hosts(pages):
    return pages.select("page_id", ur.page_hosts(ur.host_of(F.col("url"))).alias("hosts"))


@query(
    f"""WITH h AS (SELECT page_id, {HOST} AS host, regexp_extract(url, '^[^:]+://[^/?#]+([^#]*)', 1) AS tail FROM pages)
SELECT page_id, host AS domain, CASE WHEN tail IN ('', '/') THEN NULL WHEN starts_with(tail, '?') THEN concat('/', tail) ELSE tail END AS page,
  concat('https://', host, '/x/', page_id::VARCHAR) AS built FROM h"""
)
@named("pages")
def x7_x8_website_input(pages):
    got = ur.parse_website_input(F.col("url"))
    built = ur.build_page_url(got["domainHost"], F.concat(F.lit("x/"), F.col("page_id")))
    return pages.select("page_id", got["domainHost"].alias("domain"), got["pagePath"].alias("page"), built.alias("built"))


@query(
    f"""SELECT page_id % 10 AS shard, count(*) FILTER (ends_with({HOST}, '.com')) AS inside,
  count(*) FILTER (NOT ends_with({HOST}, '.com')) AS outside FROM pages GROUP BY 1"""
)
@named("pages")
def f6_split_in_scope(pages):
    from ..operators.views import split_in_scope

    host = ur.host_of(F.col("url"))
    allowed = F.when(F.endswith(host, F.lit(".com")), F.array(host)).otherwise(F.array().cast("array<string>"))
    rows = split_in_scope(pages, allowed).groupBy((F.col("page_id") % 10).alias("shard"))
    return rows.agg(F.count_if("in_scope").alias("inside"), F.count_if(~F.col("in_scope")).alias("outside"))


PAIRS = """
p AS (SELECT id, websiteId, payload, hash, lag(id) OVER w AS previous_id, lag(payload) OVER w AS before, lag(hash) OVER w AS h0,
  row_number() OVER (PARTITION BY websiteId, kind, targetUrl ORDER BY taken DESC, id DESC) AS place
  FROM {snap_hashed} WINDOW w AS (PARTITION BY websiteId, kind, targetUrl ORDER BY taken, id))
"""


@query("WITH " + PAIRS + "SELECT id, websiteId FROM p WHERE place = 1")
@named("snap_hashed")
def w1_latest_snapshot(snap):
    return sn.latest_snapshot(snap).select("id", "websiteId")


@query("WITH " + PAIRS + "SELECT id, previous_id, CASE WHEN h0 IS NOT NULL THEN h0 <> hash END AS changed FROM p")
@named("snap_hashed")
def j9_previous_snapshot(snap):
    return sn.previous_snapshot(snap).select("id", "previous_id", "changed")


@query(
    "WITH " + PAIRS + "SELECT id, substr(hash, 1, 8) AS short_hash, CASE WHEN h0 IS NOT NULL THEN h0 <> hash END AS changed,"
    " place::INT AS place FROM p"
)
@named("snap_hashed")
def w2_fetch_history(snap):
    return sn.fetch_history(snap).select("id", "short_hash", "changed", "place")


LINES = (
    "WITH "
    + PAIRS
    + """, d AS (SELECT id, list_filter(string_split(payload, chr(10)), lambda x: NOT list_contains(string_split(before, chr(10)), x)) AS a,
  list_filter(string_split(before, chr(10)), lambda x: NOT list_contains(string_split(payload, chr(10)), x)) AS r FROM p WHERE h0 <> hash),
c AS (SELECT id, len(a)::BIGINT AS n_a, len(r)::BIGINT AS n_r,
  list_transform(a[1:3], lambda x: CASE WHEN length(x) > 160 THEN concat(substr(x, 1, 157), '…') ELSE x END) AS a,
  list_transform(r[1:3], lambda x: CASE WHEN length(x) > 160 THEN concat(substr(x, 1, 157), '…') ELSE x END) AS r FROM d),
v AS (SELECT id, n_a, n_r, concat_ws(chr(10), CASE WHEN n_a > 0 THEN concat('+ ', array_to_string(a, concat(chr(10), '+ '))) END,
  CASE WHEN n_r > 0 THEN concat('- ', array_to_string(r, concat(chr(10), '- '))) END) AS preview FROM c)
"""
)


@query(LINES + "SELECT id, 'PAGE_CONTENT' AS kind, preview, n_a AS totalAdded, n_r AS totalRemoved FROM v")
@named("snap_hashed")
def x10_p8_content_alerts(snap):
    return sn.content_alerts(snap)


@query(
    LINES
    + """, l AS (SELECT id, unnest(string_split(preview, chr(10))) AS x FROM v)
SELECT id, count(*) FILTER (starts_with(x, '+ ')) AS n_add, count(*) FILTER (starts_with(x, '- ')) AS n_del,
  count(*) FILTER (NOT starts_with(x, '+ ') AND NOT starts_with(x, '- ')) AS n_ctx FROM l GROUP BY 1"""
)
@named("snap_hashed")
def x12_parse_diff(snap):
    rows = sn.content_alerts(snap).select("id", F.explode(tx.parse_diff(F.col("preview"))).alias("l"))
    return rows.groupBy("id").agg(*(F.count_if(F.col("l.kind") == k).alias(f"n_{k}") for k in ("add", "del", "ctx")))


@query(
    LINES
    + """, l AS (SELECT id, unnest(string_split(preview, chr(10))) AS x, generate_subscripts(string_split(preview, chr(10)), 1) AS i FROM v),
k AS (SELECT id, x, row_number() OVER (PARTITION BY id, substr(x, 1, 2) ORDER BY i)::INT AS place FROM l WHERE substr(x, 1, 2) IN ('+ ', '- '))
SELECT id, place, max(CASE WHEN starts_with(x, '- ') THEN substr(x, 3) END) AS removed,
  max(CASE WHEN starts_with(x, '+ ') THEN substr(x, 3) END) AS added FROM k GROUP BY ALL"""
)
@named("snap_hashed")
def w8_pair_diff_lines(snap):
    lines = sn.content_alerts(snap).select("id", F.posexplode(tx.parse_diff(F.col("preview"))).alias("pos", "l"))
    return sn.pair_diff_lines(lines.select("id", "pos", "l.kind", "l.text"), "id")


@query(
    """SELECT doc_id, CASE WHEN length(text) <= 100 THEN text ELSE concat(substr(text, 1, 99), '…') END AS short,
  CASE WHEN length(text) <= 8000 THEN text ELSE concat(substr(text, 1, 7980), chr(10), '… (truncated)') END AS change, sha256(text) AS hash
FROM documents"""
)
@named("documents")
def x16_x37_truncate_and_hash(documents):
    t = F.col("text")
    return documents.select(
        "doc_id", tx.truncate_text(t, 100).alias("short"), tx.truncate_change(t).alias("change"), pa.content_hash(t).alias("hash")
    )


@query(
    """SELECT id, replace(title, 'https://', '') AS shown, concat(title, ' via bot') AS posted, title AS stripped FROM {alert}"""
)
@named("alert")
def x17_alert_titles(alert):
    posted = tx.append_postfix(F.col("title"), "via bot")
    return alert.select(
        "id",
        tx.alert_title(posted, "via bot").alias("shown"),
        tx.append_postfix(posted, "via bot").alias("posted"),
        tx.strip_postfix(posted, "via bot").alias("stripped"),
    )


@query(
    """SELECT page_id, site = 0 AS slack, site IN (0, 2) AND page_id % 5 <> 4 AS webhook,
  CASE WHEN page_id % 4 = 3 THEN '' ELSE concat('p', page_id, '@', host, ' q.r', page_id, '@', host) END AS emails
FROM (SELECT page_id, page_id % 3 AS site, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host FROM pages)"""
)
@named("pages")
def x18_addresses(pages):
    """Each page's URL as a webhook, in forms of which some are none, and lists of addresses at its host."""
    k, n = F.col("page_id") % 3, F.col("page_id")
    host, path = F.regexp_extract("url", "^https?://([^/:?#]+)", 1), F.regexp_extract("url", "^https?://[^/]*(/?[^ ]*)$", 1)
    slack = F.concat(F.lit(" https://hooks.slack.com/services/T"), n, path)
    other = F.when(k == 1, F.concat(F.lit("ftp://"), host)).otherwise(F.concat(F.lit("http://"), host, F.lit(":8080/hook?p="), n))
    url = F.when(k == 0, slack).otherwise(other)
    hook = F.when(n % 5 == 4, F.concat(url, F.lit(" and more"))).otherwise(url)
    good = F.concat(F.lit("p"), n, F.lit("@"), host, F.lit(", nobody, @x.y\n q.r"), n, F.lit("@"), host, F.lit(",,"))
    mails = F.when(n % 4 == 3, F.concat(F.lit("a..b@"), host, F.lit(",@"), host, F.lit(",x@"), host, F.lit("..com"))).otherwise(good)
    return pages.select("page_id", tx.valid_slack_url(url).alias("slack"), tx.valid_webhook_url(hook).alias("webhook"), F.array_join(tx.parse_emails(mails), " ").alias("emails"))


NOW = "1998-06-01 12:00:00"


@query(
    f"""WITH r AS (SELECT id, attempt, observed_at, 1 + id::BIGINT % 24 AS h, TIMESTAMP '{NOW}' AS t FROM {{run}})
SELECT id, observed_at + to_hours((h * (greatest(0, floor(epoch(t - observed_at) / (h * 3600))) + 1))::BIGINT) AS due,
  observed_at + to_hours((h * (floor(greatest(0, epoch(t - observed_at)) / (h * 3600)) + 1))::BIGINT) AS caught_up,
  observed_at + to_hours(least(336, greatest(72, 3 * h))::BIGINT) AS expires,
  CASE WHEN id::BIGINT % 5 <> 0 AND attempt < 4 THEN greatest(CASE attempt WHEN 1 THEN 300000 WHEN 2 THEN 900000 ELSE 3600000 END, 600000)::BIGINT END AS delay
FROM r"""
)
@named("run")
def x21_x24_schedules(run):
    now, hours = F.lit(NOW).cast("timestamp"), F.col("id").cast("long") % 24 + 1
    run = run.withColumn("observed_at", F.col("observed_at").cast("timestamp"))
    return run.select(
        "id",
        tm.next_due_after_success(F.col("observed_at"), hours, now).alias("due"),
        tm.next_due_catch_up(F.col("observed_at"), hours, now).alias("caught_up"),
        tm.candidate_expiry(F.col("observed_at"), hours).alias("expires"),
        tm.retry_delay_ms(F.col("id").cast("long") % 5 != 0, F.col("attempt"), F.lit(600_000)).alias("delay"),
    )


@query(
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_id * 1000 WHEN 1 THEN 60000 END AS wait,
  CASE event_id % 3 WHEN 0 THEN epoch_ms(event_id * 1000) WHEN 1 THEN TIMESTAMP '2024-02-03 04:05:06' END AS parsed FROM events"""
)
@named("events")
def x25_x28_parsed_times(events):
    k = F.col("event_id") % 3
    header = F.when(k == 0, F.col("event_id").cast("string")).when(k == 1, F.lit("Sat, 03 Feb 2024 04:06:06 GMT")).otherwise("soon")
    text = (
        F.when(k == 0, (F.col("event_id") * 1000).cast("string")).when(k == 1, F.lit("2024-02-03T04:05:06Z")).otherwise("never")
    )
    now = F.lit("2024-02-03 04:05:06").cast("timestamp")
    return events.select(
        "event_id", tm.retry_after_ms(header, now).alias("wait"), tm.parse_timestamp(text).alias("parsed")
    )


PRICE_TEXT = "CASE WHEN price IS NULL THEN '—' WHEN currency IS NOT NULL THEN concat(currency, ' ', price::BIGINT::VARCHAR) ELSE price::BIGINT::VARCHAR END"


@query(f"SELECT id, {PRICE_TEXT} AS shown, concat(coalesce(currency, ''), chr(9), coalesce(price::BIGINT::VARCHAR, '')) AS change_key FROM {{price}}")
@named("price")
def x30_x31_price_texts(price):
    p, c = F.col("price"), F.col("currency")
    return price.select("id", pa.format_price(p, c).alias("shown"), pa.price_change_key(p, c).alias("change_key"))


@query("SELECT id, price, currency, is_product_page FROM {price} WHERE id % 9 <> 0 UNION ALL SELECT id, NULL, NULL, NULL FROM {price} WHERE id % 9 = 0")
@named("price")
def x32_parse_product(price):
    body = F.to_json(F.struct("is_product_page", "price", "currency"))
    parsed = pa.parse_product(F.when(F.col("id") % 9 == 0, F.lit("{broken")).otherwise(body))
    return price.select("id", *(parsed[c].alias(c) for c in ("price", "currency", "is_product_page")))


SERIES = """
s AS (SELECT *, lag(id) OVER w AS previous_id, lag(price) OVER w AS previous_price, lag(currency) OVER w AS previous_currency,
  lag(is_product_page) OVER w AS was_page, row_number() OVER w AS point FROM {price} WINDOW w AS (PARTITION BY page ORDER BY createdAt, id))
"""


@query(
    "WITH " + SERIES + """SELECT page, id, previous_id, previous_price, previous_currency, price, currency FROM s
WHERE is_product_page AND was_page AND (price IS DISTINCT FROM previous_price OR coalesce(currency, '') <> coalesce(previous_currency, ''))"""
)
@named("price")
def w4_price_changes(price):
    return sn.price_changes(price)


@query("WITH " + SERIES + "SELECT page, id, point::INT AS point FROM s WHERE is_product_page AND price IS NOT NULL")
@named("price")
def w3_f8_price_series(price):
    return sn.plottable_points(sn.price_series(price)).select("page", "id", "point")


@query(
    """WITH u AS (SELECT website_id, list_sort(list(DISTINCT url)) AS urls FROM {obs} GROUP BY 1)
SELECT website_id, concat('{{"added":[', array_to_string(list_transform(urls[1:100], lambda x: concat('"', x, '"')), ','), ']}}') AS details,
  concat(len(urls)::VARCHAR, ' new link', CASE WHEN len(urls) = 1 THEN '' ELSE 's' END, ' on s', website_id) AS title,
  concat('New links (', len(urls)::VARCHAR, '):', chr(10), array_to_string(urls[1:50], chr(10))) AS change
FROM u""".replace("{{", "{").replace("}}", "}")
)
@named("obs")
def x33_x34_link_alert_texts(obs):
    u = obs.groupBy("website_id").agg(F.array_sort(F.collect_set("url")).alias("urls"))
    n = F.size("urls")
    return u.select(
        "website_id",
        pa.link_alert_details("added", F.col("urls")).alias("details"),
        pa.link_alert_title("added", n, F.concat(F.lit("s"), "website_id")).alias("title"),
        pa.link_change_text("New", F.col("urls")).alias("change"),
    )


@query(
    """SELECT conv_id, turn, conv_id % 6 IN (0, 1) AS suppress,
  CASE conv_id % 6 WHEN 0 THEN 'noise' WHEN 1 THEN 'Judged routine noise' END AS reason FROM conversations"""
)
@named("conversations")
def x36_parse_triage(conversations):
    k = F.col("conv_id") % 6
    reply = (
        F.when(k == 0, F.lit('```json\n{"suppress": true, "reason": " noise "}\n```'))
        .when(k == 1, F.lit('{"suppress": true}'))
        .when(k == 2, F.lit('{"suppress": "true", "reason": "x"}'))
        .when(k == 3, F.lit('[{"suppress": true}]'))
        .when(k == 4, F.lit('{"suppress": 1}'))
        .otherwise(F.col("text"))
    )
    d = pa.parse_triage(reply)
    return conversations.select("conv_id", "turn", d["suppress"].alias("suppress"), d["reason"].alias("reason"))


@query(
    """SELECT id, CASE WHEN id % 5 IN (3, 4) THEN concat('{"aiChangeSummary":', to_json(concat('about ', title))::VARCHAR, '}')
  ELSE concat('{"kind":', to_json(kind)::VARCHAR, ',"n":', id, ',"title":', to_json(concat('"', title, '"'))::VARCHAR, ',"aiChangeSummary":', to_json(concat('about ', title))::VARCHAR, '}') END AS merged FROM {alert}"""
)
@named("alert")
def x35_merge_details(alert):
    """Details of each alert's own fields: without a summary, with one that is replaced, with none, as a list, and broken."""
    k = F.col("id") % 5
    fields = F.struct("kind", F.col("id").alias("n"), F.concat(F.lit('"'), "title", F.lit('"')).alias("title"))
    plain = F.to_json(fields)
    old = F.to_json(F.struct(F.concat(F.lit('an old, "quoted" one of '), "title").alias("aiChangeSummary"), fields.kind.alias("kind"), fields.n.alias("n"), fields.title.alias("title")))
    details = (
        F.when(k == 0, plain).when(k == 1, old).when(k == 2, F.regexp_replace(plain, "}$", ',"aiChangeSummary":null}'))
        .when(k == 3, F.concat(F.lit("["), plain, F.lit("]"))).otherwise(F.substring(plain, 1, 20))
    )
    return alert.select("id", pa.merge_details(details, F.concat(F.lit("about "), "title")).alias("merged"))


@query(
    """WITH u AS (SELECT run_id, list_sort(list(DISTINCT url)) AS urls FROM {obs} GROUP BY 1),
k AS (SELECT run_id, to_json(urls)::VARCHAR AS j, len(urls) AS n FROM u)
SELECT run_id, sha256(concat('["urlset",', j, ',', n::VARCHAR, ']')) AS revision,
  sha256(concat('["p","o",', j, ']')) AS policy, sha256(concat('["key",', j, ']')) AS scope FROM k"""
)
@named("obs")
def x38_revision_and_scope_ids(obs):
    u = obs.groupBy("run_id").agg(F.array_sort(F.collect_set("url")).alias("urls"))
    return u.select(
        "run_id",
        pa.revision_id(F.lit("urlset"), F.col("urls"), F.size("urls")).alias("revision"),
        pa.policy_key(F.lit("p"), F.lit("o"), F.col("urls")).alias("policy"),
        pa.scope_fingerprint(F.lit("key"), F.col("urls")).alias("scope"),
    )


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN list_sort(list_distinct([concat('https://a.com/', page_id::VARCHAR, '.xml'), 'https://b.com/s.xml'])) END AS found FROM pages")
@named("pages")
def x20_robots_sitemaps(pages):
    robots = F.concat(
        F.lit("User-agent: *\nSITEMAP: https://a.com/"), "page_id", F.lit(".xml # one\n  Sitemap:https://b.com/s.xml\nsitemap: https://b.com/s.xml\n")
    )
    body = F.when(F.col("page_id") % 2 == 0, robots).otherwise(F.concat(F.lit("<!DOCTYPE html>"), robots))
    return pages.select("page_id", ur.robots_sitemaps(body).alias("found"))
