"""Triage of alerts and the messages made of routed ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.payloads import parse_triage
from ..functions.text import alert_title, parse_diff, truncate_text

#: Alerts listed in a message.
LISTED = 5


def apply_triage(alert: DataFrame, target: DataFrame, replies: DataFrame) -> DataFrame:
    """Alerts of opted-in targets take their reply's decision: suppressed ones count as read and keep the reason; a
    missing or unreadable reply surfaces."""
    t = target.where("aiTriageEnabled").select(F.col("id").alias("targetId"), F.lit(True).alias("_asks"))
    r = replies.select(F.col("alert_id").alias("id"), parse_triage(F.col("reply")).alias("_d"))
    joined = alert.join(t, "targetId", "left").join(r, "id", "left")
    off = F.coalesce(F.col("_asks") & F.col("_d.suppress"), F.lit(False))
    return joined.withColumns(
        {
            "suppressed": F.col("suppressed") | off,
            "is_read": F.col("is_read") | off,
            "suppressionReason": F.when(off, F.col("_d.reason")),
        }
    ).drop("_asks", "_d")


def build_notifications(routed: DataFrame, base_url: str) -> DataFrame:
    """One message per destination and site: the newest LISTED alerts' titles and how many more there are."""
    newest = Window.partitionBy("destination_id", "websiteId").orderBy(F.desc("createdAt"), F.desc("id"))
    rows = routed.withColumn("_k", F.row_number().over(newest))
    line = F.concat(F.lit("• "), truncate_text(alert_title(F.col("title")), 200), F.lit(f"\n{base_url}/alerts/"), "id")
    agg = rows.groupBy("destination_id", "websiteId", "domain", "channel").agg(
        F.count(F.lit(1)).alias("n_alerts"),
        F.array_sort(F.collect_list(F.when(F.col("_k") <= LISTED, F.struct("_k", line.alias("line"))))).alias("_lines"),
    )
    more = F.when(F.col("n_alerts") > LISTED, F.concat(F.lit("\n… and "), F.col("n_alerts") - LISTED, F.lit(" more"))).otherwise("")
    head = F.concat("n_alerts", F.lit(" new change(s) for "), "domain", F.lit("\n\n"))
    text = F.concat(head, F.array_join(F.col("_lines.line"), "\n\n"), more)
    return agg.withColumn("message", text).drop("_lines")


#: Changed lines of an alert that are listed in full; of more, the first pair and a button.
INLINE = 3


def _escaped(text: Column) -> Column:
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(mark), F.lit(name))
    return text


def _diff_lines(details: Column) -> Column:
    """struct(shown: marked lines of an alert's preview, total: changed lines): removed lines are struck out, added ones
    slanted, in pairs; null without a preview."""
    d = F.from_json(details, "diffPreview string, totalAdded long, totalRemoved long")
    lines = parse_diff(F.coalesce(d["diffPreview"], F.lit("")))
    of = lambda kind: F.transform(F.filter(lines, lambda x: x["kind"] == kind), lambda x: x["text"])
    struck = F.transform(of("del"), lambda x: F.concat(F.lit("~"), _escaped(x), F.lit("~")))
    slanted = F.transform(of("add"), lambda x: F.concat(F.lit("_"), _escaped(x), F.lit("_")))
    total = F.coalesce(d["totalAdded"] + d["totalRemoved"], (F.size(struck) + F.size(slanted)).cast("long"))
    both = F.flatten(F.transform(F.arrays_zip(struck.alias("a"), slanted.alias("b")), lambda p: F.array(p["a"], p["b"])))
    most = F.when(total > INLINE, F.lit(2)).otherwise(F.size(both))
    return F.when(total > 0, F.struct(F.array_compact(F.slice(both, 1, most)).alias("shown"), total.alias("total")))


def message_blocks(routed: DataFrame, base_url: str, app: str = "Site monitor", details: str = "details") -> DataFrame:
    """destination_id, websiteId, blocks: a JSON array for each destination and site. A header with the number of changes, the
    site, of each of the newest LISTED alerts its title as a link with its changed lines (a button where they are many),
    how many more there are, and a link to the newest."""
    newest = Window.partitionBy("destination_id", "websiteId").orderBy(F.desc("createdAt"), F.desc("id"))
    link = F.concat(F.lit(f"{base_url}/alerts/"), "id")
    title = F.replace(_escaped(truncate_text(alert_title(F.col("title")), 200)), F.lit("|"), F.lit("¦"))
    rows = routed.withColumns({"_k": F.row_number().over(newest), "_link": link, "_d": _diff_lines(F.col(details))})
    section = lambda text: F.struct(F.lit("section").alias("type"), F.struct(F.lit("mrkdwn").alias("type"), text.alias("text")).alias("text"))
    divider, json = F.lit('{"type":"divider"}'), F.to_json
    text = F.concat(F.lit("*<"), F.col("_link"), F.lit("|"), title, F.lit(">*"), F.coalesce(F.concat(F.lit("\n"), F.array_join(F.col("_d.shown"), "\n")), F.lit("")))
    button = F.struct(
        F.lit("button").alias("type"),
        F.struct(F.lit("plain_text").alias("type"), F.concat(F.lit("View all "), F.col("_d.total"), F.lit(" changes")).alias("text")).alias("text"),
        F.col("_link").alias("url"),
    )
    actions = F.struct(F.lit("actions").alias("type"), F.array(button).alias("elements"))
    own = F.array_compact(F.array(divider, json(section(text)), F.when(F.col("_d.total") > INLINE, json(actions))))
    agg = rows.groupBy("destination_id", "websiteId", "domain").agg(
        F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_list(F.when(F.col("_k") <= LISTED, F.struct("_k", own.alias("own"))))).alias("listed"),
        F.max(F.when(F.col("_k") == 1, F.col("_link"))).alias("first"),
    )
    s = lambda n: F.when(n == 1, F.lit("")).otherwise(F.lit("s"))
    n, more = F.col("n"), F.col("n") - LISTED
    header = F.struct(
        F.lit("header").alias("type"),
        F.struct(F.lit("plain_text").alias("type"), F.concat(F.lit(f"{app}: "), n, F.lit(" new change"), s(n)).alias("text")).alias("text"),
    )
    rest = F.concat(F.lit("_… and "), more, F.lit(" more change"), s(more), F.lit("_"))
    tail = F.when(more > 0, F.array(divider, json(section(rest)))).otherwise(F.array().cast("array<string>"))
    last = F.array(divider, json(section(F.concat(F.lit("<"), F.col("first"), F.lit(f"|Open in {app}>")))))
    parts = F.concat(F.array(json(header), json(section(F.concat(F.lit("*"), _escaped(F.col("domain")), F.lit("*"))))), F.flatten(F.col("listed.own")), tail, last)
    return agg.select("destination_id", "websiteId", F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]")).alias("blocks"))


def webhook_bodies(routed: DataFrame, base_url: str) -> DataFrame:
    """One JSON document per site and destination: type, version, site, alerts newest first, summary text."""
    site = F.struct(F.col("websiteId").alias("id"), "domain")
    one = F.struct(
        F.col("id"), F.col("kind"), alert_title(F.col("title")).alias("title"),
        F.concat(F.lit(f"{base_url}/alerts/"), "id").alias("dashboardUrl"),
    )
    order = F.struct((-F.unix_micros(F.col("createdAt").cast("timestamp"))).alias("at"), (-F.col("id")).alias("no"), one.alias("alert"))
    agg = routed.groupBy("destination_id", "websiteId", "domain").agg(F.array_sort(F.collect_list(order)).alias("_a"))
    notes = build_notifications(routed, base_url).select("destination_id", "websiteId", "message")
    rows = agg.join(notes, ["destination_id", "websiteId"])
    body = F.struct(
        F.lit("alerts.new").alias("type"), F.lit(1).alias("version"), site.alias("site"), F.col("_a.alert").alias("alerts"),
        F.col("message").alias("summaryText"),
    )
    return rows.select("destination_id", "websiteId", F.to_json(body).alias("body"))
