"""Alerts from snapshots: every change of a site's links, of a page's content and of a product's price, in one plan.

Each snapshot is compared with the one before it of the same page; the first never alerts. Only those that differ are read any
further: windows carry short payloads and the hashes of long ones, which join afterwards. A change is an alert of every target
that watches it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.payloads import LISTED, link_alert_details, link_alert_title, parse_product, price_change_key
from ..operators.snapshots import SHORT, first_and_counts, line_diffs, price_alert_texts
from ..operators.views import link_scope_emits
from ..scratch import stored

ALERT = ["snapshot_id", "websiteId", "targetId", "kind", "title", "details", "taken"]


#: Characters up to which a payload goes through the window.
CARRIED = 1_000


def changed_payloads(snap: DataFrame, kind: str, order: str = "taken") -> DataFrame:
    """id, websiteId, targetUrl, order, before, after of this kind's snapshots that differ from the one before.

    Only long payloads are joined by their id, so only theirs have to be distinct.
    """
    rows = snap.where(F.col("kind") == kind)
    short = F.length("payload") <= CARRIED
    slim = rows.select("websiteId", "targetUrl", "id", order, F.when(short, F.col("payload")).alias("after"), F.when(~short, F.col("hash")).alias("hash"))
    pairs = slim.withColumn("was", F.lag(F.struct("id", "after", "hash")).over(Window.partitionBy("websiteId", "targetUrl").orderBy(order, "id")))
    known = F.coalesce("after", "hash").isNotNull() & F.coalesce("was.after", "was.hash").isNotNull()
    same = F.col("after").eqNullSafe(F.col("was.after")) & F.col("hash").eqNullSafe(F.col("was.hash"))
    pairs = pairs.where(known & ~same).select("websiteId", "targetUrl", "id", order, "after", F.col("was.after").alias("before"), F.col("was.id").alias("previous_id"))
    long = rows.where(~short).select("id", "payload")
    if not long.isEmpty():
        after = long.select("id", F.col("payload").alias("long_after"))
        before = long.select(F.col("id").alias("previous_id"), F.col("payload").alias("long_before"))
        pairs = pairs.join(after, "id", "left").join(before, "previous_id", "left")
        pairs = pairs.withColumns({"after": F.coalesce("after", "long_after"), "before": F.coalesce("before", "long_before")})
    return pairs.select("id", "websiteId", "targetUrl", order, "before", "after")


def _lacking(left: Column, right: Column) -> Column:
    """What of a short list the other lacks, in order and with repeats."""
    return F.filter(left, lambda x: F.coalesce(~F.array_contains(right, x), F.lit(True)))


def link_changes(changed: DataFrame, target: DataFrame, website: DataFrame) -> DataFrame:
    """NEW_LINK and REMOVED_LINK: titles count all URLs, details hold the first hundred in the order of their set.

    Short lists are compared in their row; the URLs of the others become rows.
    """
    parsed = lambda c: F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
    lists = stored(changed.select("id", "websiteId", "taken", parsed("before").alias("before"), parsed("after").alias("after")), "links")
    few = F.size("before") + F.size("after") <= SHORT
    kinds = [("n_added", "new", _lacking(F.col("after"), F.col("before"))), ("n_removed", "gone", _lacking(F.col("before"), F.col("after")))]
    near = lists.where(few).select("id", "websiteId", "taken", *(c.alias(side) for _, side, c in kinds))
    found = near.select("*", *(F.size(side).cast("long").alias(n) for n, side, _ in kinds)).where("n_added + n_removed > 0")
    rows = lists.where(~few)
    if not rows.isEmpty():
        urls = lambda c: rows.select("id", F.posexplode(c).alias("pos", "line"))
        old, new = urls("before"), urls("after")
        lacking = lambda a, b: a.join(b.select("id", "line").distinct(), ["id", "line"], "left_anti")
        sides = lacking(new, old).withColumn("added", F.lit(True)).unionByName(lacking(old, new).withColumn("added", F.lit(False)))
        found = found.unionByName(first_and_counts(sides, LISTED).join(rows.select("id", "websiteId", "taken"), "id"))
    found = found.join(website.select(F.col("id").alias("websiteId"), "domain"), "websiteId")
    watching = target.where("kind = 'SITEMAP_LINKS'").select("websiteId", F.col("id").alias("targetId"), "linkScope")
    found = found.join(watching, "websiteId")
    one = lambda kind, variant, n, listed, side: found.where((F.col(n) > 0) & link_scope_emits(F.col("linkScope"), variant)).select(
        F.col("id").alias("snapshot_id"), "websiteId", "targetId", F.lit(kind).alias("kind"),
        link_alert_title(side, F.col(n), F.col("domain")).alias("title"), link_alert_details(side, F.col(listed)).alias("details"), "taken",
    )
    return one("NEW_LINK", "new", "n_added", "new", "added").unionByName(one("REMOVED_LINK", "removed", "n_removed", "gone", "removed"))


def _watched(rows: DataFrame, target: DataFrame, kind: str) -> DataFrame:
    """rows with the targets of this kind that watch their page."""
    t = target.where(F.col("kind") == kind).select("websiteId", F.col("id").alias("targetId"), F.col("pageUrl").alias("targetUrl"))
    return rows.join(t, ["websiteId", "targetUrl"])


def content_changes(changed: DataFrame, target: DataFrame) -> DataFrame:
    """PAGE_CONTENT with a preview of lines."""
    rows = stored(changed, "texts")
    diffs = line_diffs(rows.select("id", "before", "after"))
    found = _watched(rows.select("id", "websiteId", "targetUrl", "taken").join(diffs, "id"), target, "PAGE_CONTENT")
    details = F.struct(F.col("targetUrl").alias("pageUrl"), F.col("d.preview").alias("diffPreview"), "d.totalAdded", "d.totalRemoved")
    return found.select(
        F.col("id").alias("snapshot_id"), "websiteId", "targetId", F.lit("PAGE_CONTENT").alias("kind"),
        F.concat(F.lit("Content changed on "), "targetUrl").alias("title"), F.to_json(details).alias("details"), "taken",
    )


def price_changes(changed: DataFrame, target: DataFrame) -> DataFrame:
    """PRODUCT_PRICE where both snapshots are of a product page and price or currency differ."""
    rows = changed.withColumns({"now": parse_product(F.col("after")), "was": parse_product(F.col("before"))})
    key = lambda p: price_change_key(F.col(f"{p}.price"), F.col(f"{p}.currency"))
    rows = rows.where(F.col("now.is_product_page") & F.col("was.is_product_page") & (key("now") != key("was")))
    c = F.col
    title, details = price_alert_texts(c("targetUrl"), c("now.productName"), c("was.price"), c("was.currency"), c("now.price"), c("now.currency"))
    found = _watched(rows.select("id", "websiteId", "targetUrl", "taken", title.alias("title"), details.alias("details")), target, "PRODUCT_PRICE")
    return found.select(F.col("id").alias("snapshot_id"), "websiteId", "targetId", F.lit("PRODUCT_PRICE").alias("kind"), "title", "details", "taken")


def detect_alerts(snap: DataFrame, target: DataFrame, website: DataFrame, order: str = "taken") -> DataFrame:
    """ALERT rows of all snapshots (id, websiteId, kind SITEMAP, MARKDOWN or PRODUCT, targetUrl, payload, hash, order; ids of
    links, of texts and of payloads of more than CARRIED characters are distinct). target: id, websiteId, kind, linkScope, pageUrl; website: id, domain."""
    changed = lambda kind: changed_payloads(snap, kind, order).withColumnRenamed(order, "taken")
    parts = (link_changes(changed("SITEMAP"), target, website), content_changes(changed("MARKDOWN"), target), price_changes(changed("PRODUCT"), target))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select(*ALERT)
