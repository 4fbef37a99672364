"""Snapshots of page content, link sets and prices: latest, previous, changes, histories, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.payloads import format_price, link_alert_details, link_alert_title, number_text, price_change_key
from ..functions.text import PREVIEW_LINES, PROMPT_LINES, diff_preview, preview_of, prompt_text
from ..scratch import stored

PAGE = ["websiteId", "kind", "targetUrl"]


def _by_time(order: str = "taken"):
    return Window.partitionBy(*PAGE).orderBy(order, "id")


def latest_snapshot(snap: DataFrame, order: str = "taken") -> DataFrame:
    """The newest snapshot of each page, ties by id. Payloads join afterwards, so the window moves none."""
    w = Window.partitionBy(*PAGE).orderBy(F.desc(order), F.desc("id"))
    keys = snap.select(*PAGE, "id", order).withColumn("_k", F.row_number().over(w)).where("_k = 1")
    return snap.join(keys.select("id"), "id", "left_semi")


def previous_snapshot(snap: DataFrame, order: str = "taken") -> DataFrame:
    """id, previous_id, changed of each snapshot and the one before it of the same page; only hashes move."""
    w = _by_time(order)
    slim = snap.select(*PAGE, "id", order, "hash")
    before = F.lag("hash").over(w)
    return slim.withColumns(
        {"previous_id": F.lag("id").over(w), "changed": F.when(before.isNotNull(), before != F.col("hash"))}
    )


def fetch_history(snap: DataFrame, order: str = "taken") -> DataFrame:
    """Each snapshot's short hash, whether it changed (null for the first), and its place, newest first."""
    newest = Window.partitionBy(*PAGE).orderBy(F.desc(order), F.desc("id"))
    rows = previous_snapshot(snap, order).withColumn("place", F.row_number().over(newest))
    return rows.select(*PAGE, "id", F.substring("hash", 1, 8).alias("short_hash"), "changed", "place")


def changed_pairs(snap: DataFrame, order: str = "taken") -> DataFrame:
    """id, before, after: payloads of the snapshots that differ from their predecessor."""
    pairs = previous_snapshot(snap, order).where("changed").select("id", "previous_id")
    after = snap.select("id", F.col("payload").alias("after"))
    before = snap.select(F.col("id").alias("previous_id"), F.col("payload").alias("before"))
    return pairs.join(after, "id").join(before, "previous_id")


#: Lines of both sides together up to which a pair is compared in its row.
SHORT = 200


def line_diffs(pairs: DataFrame, lines: int = PREVIEW_LINES) -> DataFrame:
    """id, d: struct(preview, totalAdded, totalRemoved) of pairs (id, before, after; ids are distinct): the lines of each side that
    the other lacks, in order and with repeats.

    Short pairs are compared in their row. The lines of the others become rows, keyed by pair and line, and what has no
    equal on the other side is left by an anti-join: linear in lines, and one huge pair is many keys. Only the first lines
    of a side are gathered back.
    """
    count = lambda c: F.length(c) - F.length(F.regexp_replace(c, "\n", "")) + 1
    sized = pairs.select("id", "before", "after", (count(F.col("before")) + count(F.col("after")) <= SHORT).alias("short"))
    near = sized.where("short").select("id", diff_preview(F.col("before"), F.col("after"), lines).alias("d"))
    long = sized.where("NOT short")
    exploded = lambda c: long.select("id", F.posexplode(F.split(c, "\n", -1)).alias("pos", "line"))
    old, new = exploded("before"), exploded("after")
    lacking = lambda a, b: a.join(b.select("id", "line").distinct(), ["id", "line"], "left_anti")
    side = lacking(new, old).withColumn("added", F.lit(True)).unionByName(lacking(old, new).withColumn("added", F.lit(False)))
    whole = long.select("id").join(first_and_counts(side, lines), "id", "left").fillna(0, ["n_added", "n_removed"])
    none = F.array().cast("array<string>")
    d = preview_of(F.coalesce("new", none), F.col("n_added"), F.coalesce("gone", none), F.col("n_removed"), lines)
    return near.unionByName(whole.select("id", d.alias("d")))


def first_and_counts(side: DataFrame, most: int) -> DataFrame:
    """id, n_added, n_removed, new, gone of rows (id, pos, line, added): how many there are on each side, and the first most of
    them in order of pos. No more than those are gathered."""
    side = stored(side, "sides")
    counts = side.groupBy("id").agg(F.count_if("added").alias("n_added"), F.count_if(~F.col("added")).alias("n_removed"))
    w = Window.partitionBy("id", "added").orderBy("pos")
    first = side.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    of = lambda added: F.array_sort(F.collect_list(F.when(F.col("added") == F.lit(added), F.struct("k", "line"))))["line"]
    return counts.join(first.groupBy("id").agg(of(True).alias("new"), of(False).alias("gone")), "id")


def content_alerts(snap: DataFrame, order: str = "taken") -> DataFrame:
    """PAGE_CONTENT alerts with a line preview; first snapshots never alert."""
    rows = line_diffs(changed_pairs(snap, order))
    return rows.select("id", F.lit("PAGE_CONTENT").alias("kind"), "d.preview", "d.totalAdded", "d.totalRemoved")


def prompts(snap: DataFrame, order: str = "taken") -> DataFrame:
    """id, text: the longer preview of each changed snapshot for a model's prompt."""
    return line_diffs(changed_pairs(snap, order), PROMPT_LINES).select("id", prompt_text(F.col("d")).alias("text"))


def link_alerts(diff: DataFrame, domain: str = "domain") -> DataFrame:
    """NEW_LINK and REMOVED_LINK alerts of (run_id, domain, url, change): title counting all URLs, details the first
    hundred in order."""
    sets = diff.groupBy("run_id", domain, "change").agg(F.array_sort(F.collect_set("url")).alias("urls"))
    added = F.col("change") == "added"
    n = F.size("urls")
    title = F.when(added, link_alert_title("added", n, F.col(domain))).otherwise(
        link_alert_title("removed", n, F.col(domain))
    )
    details = F.when(added, link_alert_details("added", F.col("urls"))).otherwise(
        link_alert_details("removed", F.col("urls"))
    )
    kind = F.when(added, "NEW_LINK").otherwise("REMOVED_LINK")
    return sets.select("run_id", kind.alias("kind"), title.alias("title"), details.alias("details"))


def plottable_points(series: DataFrame) -> DataFrame:
    return series.where(F.col("is_product_page") & F.col("price").isNotNull())


#: What orders prices of a page that share both moment and id, nulls first, so that a result doesn't hang on how rows arrive.
PRICE_TIES = ("is_product_page", "currency", "price")


def price_changes(series: DataFrame, page: str = "page") -> DataFrame:
    """Neighbours in time that are both product pages and differ in currency or price (null is a price of its own)."""
    w = Window.partitionBy(page).orderBy("createdAt", "id", *PRICE_TIES)
    now = F.struct("id", "price", "currency", "is_product_page")
    rows = series.withColumn("p", F.lag(now).over(w))
    same = price_change_key(F.col("price"), F.col("currency")) == price_change_key(F.col("p.price"), F.col("p.currency"))
    return rows.where(F.col("is_product_page") & F.col("p.is_product_page") & ~same).select(
        page, "id", F.col("p.id").alias("previous_id"), F.col("p.price").alias("previous_price"),
        F.col("p.currency").alias("previous_currency"), "price", "currency",
    )


def price_alert_title(name: Column, old: Column, old_currency: Column, new: Column, new_currency: Column) -> Column:
    was, now = format_price(old, old_currency), format_price(new, new_currency)
    return F.concat(F.lit("Price change: "), name, F.lit(" ("), was, F.lit(" → "), now, F.lit(")"))


def price_alert_texts(page: Column, product: Column, old: Column, old_currency: Column, new: Column, new_currency: Column) -> tuple[Column, Column]:
    """title and details of a PRODUCT_PRICE alert."""
    number = lambda c: F.try_parse_json(number_text(c))
    details = F.struct(
        page.alias("pageUrl"), product.alias("productName"), number(old).alias("previousPrice"),
        old_currency.alias("previousCurrency"), number(new).alias("newPrice"), new_currency.alias("newCurrency"),
    )
    title = price_alert_title(F.coalesce(F.when(product != "", product), page), old, old_currency, new, new_currency)
    return title, F.to_json(details, {"ignoreNullFields": "false"})


def price_alerts(changes: DataFrame, page: str = "page", name: str | None = None) -> DataFrame:
    """id, kind, title, details of PRODUCT_PRICE alerts from price_changes; name: a column with the product's name."""
    product = F.lit(None).cast("string") if name is None else F.col(name)
    title, details = price_alert_texts(F.col(page), product, F.col("previous_price"), F.col("previous_currency"), F.col("price"), F.col("currency"))
    return changes.select("id", F.lit("PRODUCT_PRICE").alias("kind"), title.alias("title"), details.alias("details"))


def price_series(series: DataFrame, page: str = "page") -> DataFrame:
    """Points of each page numbered oldest first."""
    w = Window.partitionBy(page).orderBy("createdAt", "id", *PRICE_TIES)
    return series.withColumn("point", F.row_number().over(w))


def pair_diff_lines(lines: DataFrame, key: str) -> DataFrame:
    """Rows (key, pos, kind, text) of a parsed preview as (key, place, removed, added): the k-th removed line beside the
    k-th added one."""
    w = Window.partitionBy(key, "kind").orderBy("pos")
    numbered = lines.where("kind <> 'ctx'").withColumn("place", F.row_number().over(w))
    return numbered.groupBy(key, "place").agg(
        F.max(F.when(F.col("kind") == "del", F.col("text"))).alias("removed"),
        F.max(F.when(F.col("kind") == "add", F.col("text"))).alias("added"),
    )
