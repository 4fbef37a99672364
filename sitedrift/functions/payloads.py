"""Snapshot, alert and reply payloads as columns; hashes and ids made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRODUCT = "is_product_page boolean, platform string, productName string, price double, currency string"
LISTED, SHOWN = 100, 50


def number_text(x: Column) -> Column:
    """A double as a script writes it: no trailing .0."""
    return F.when(x == F.floor(x), F.format_string("%d", x.cast("long"))).otherwise(x.cast("string"))


def format_price(price: Column, currency: Column) -> Column:
    c = F.trim(currency)
    return (
        F.when(price.isNull(), F.lit("—"))
        .when(F.coalesce(c, F.lit("")) != "", F.concat(c, F.lit(" "), number_text(price)))
        .otherwise(number_text(price))
    )


def price_change_key(price: Column, currency: Column) -> Column:
    return F.concat(F.coalesce(currency, F.lit("")), F.lit("\t"), F.coalesce(number_text(price), F.lit("")))


def parse_product(payload: Column) -> Column:
    """struct of the product's fields; null if the payload isn't JSON."""
    ok = F.try_parse_json(payload).isNotNull()
    return F.when(ok, F.from_json(payload, PRODUCT))


def link_alert_details(kind: str, urls: Column) -> Column:
    """JSON of the first 100 URLs under added or removed."""
    return F.to_json(F.struct(F.slice(urls, 1, LISTED).alias(kind)))


def link_alert_title(kind: str, n: Column, domain: Column) -> Column:
    s = F.when(n == 1, F.lit("")).otherwise(F.lit("s"))
    if kind == "added":
        return F.concat(n, F.lit(" new link"), s, F.lit(" on "), domain)
    return F.concat(n, F.lit(" link"), s, F.lit(" removed from "), domain)


def link_change_text(head: str, urls: Column) -> Column:
    n = F.size(urls)
    listed = F.array_join(F.slice(urls, 1, SHOWN), "\n")
    more = F.when(n > SHOWN, F.concat(F.lit("\n… and "), n - SHOWN, F.lit(" more"))).otherwise(F.lit(""))
    return F.concat(
        F.lit(f"{head} links ("), n, F.lit("):\n"), F.when(n > 0, listed).otherwise(F.lit("(none listed)")), more
    )


def price_change_text(
    name: Column, page: Column, old: Column, old_currency: Column, new: Column, new_currency: Column, title: Column
) -> Column:
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Product: "), F.coalesce(name, page, F.lit("product"))),
        F.when(F.coalesce(page, F.lit("")) != "", F.concat(F.lit("Page: "), page)),
        F.concat(F.lit("Previous price: "), format_price(old, old_currency)),
        F.concat(F.lit("New price: "), format_price(new, new_currency)),
        F.concat(F.lit("Alert title: "), title),
    )


def content_change_text(page: Column, preview: Column, added: Column, removed: Column) -> Column:
    """Of a content alert whose texts aren't at hand: its page, totals and preview."""
    shown = F.trim(F.coalesce(preview, F.lit("")))
    return F.concat(
        F.lit("Page: "), F.coalesce(page, F.lit("unknown page")), F.lit("\nLines added: "), F.coalesce(added, F.lit(0)),
        F.lit(", removed: "), F.coalesce(removed, F.lit(0)), F.lit("\n\nDiff:\n"),
        F.when(shown == "", F.lit("(diff preview unavailable)")).otherwise(shown),
    )


def merge_details(details: Column, summary: Column) -> Column:
    """The details object with aiChangeSummary set; anything but an object counts as an empty one."""
    base = F.try_parse_json(details)
    is_object = F.startswith(F.schema_of_variant(base), F.lit("OBJECT"))
    inner = F.regexp_extract(F.to_json(base), "(?s)^\\{(.*)\\}$", 1)
    without = F.regexp_replace(inner, '(^|,)"aiChangeSummary":("(?:[^"\\\\]|\\\\.)*"|null|true|false|-?[0-9.eE+-]+)', "")
    without = F.regexp_replace(without, "^,", "")
    own = F.regexp_extract(F.to_json(F.struct(summary.alias("aiChangeSummary"))), "(?s)^\\{(.*)\\}$", 1)
    keep = is_object & (without != "")
    return F.concat(F.lit("{"), F.when(keep, F.concat(without, F.lit(","))).otherwise(F.lit("")), own, F.lit("}"))


def parse_triage(reply: Column) -> Column:
    """struct(suppress, reason) of a model's reply; only an object with suppress true suppresses, all else surfaces."""
    whole = F.try_parse_json(F.trim(reply))
    inside = F.try_parse_json(F.regexp_extract(reply, "(?s)(\\{.*\\})", 1))
    v = F.coalesce(whole, inside)
    is_object = F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
    field = lambda name, kind: F.when(
        is_object & (F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant")) == kind),
        F.try_variant_get(v, f"$.{name}", kind.lower()),
    )
    suppress = F.coalesce(field("suppress", "BOOLEAN"), F.lit(False))
    reason = F.substring(F.trim(F.coalesce(field("reason", "STRING"), F.lit(""))), 1, 200)
    return F.struct(
        suppress.alias("suppress"),
        F.when(suppress, F.when(reason == "", F.lit("Judged routine noise")).otherwise(reason)).alias("reason"),
    )


def content_hash(payload: Column) -> Column:
    return F.sha2(payload, 256)


def event_id(run: Column, hash_: Column, kind: Column) -> Column:
    return F.concat_ws(":", run, hash_, kind)


def json_list(values: Column) -> Column:
    """A JSON array of strings."""
    return F.to_json(F.coalesce(values, F.array().cast("array<string>")))


def revision_id(kind: Column, locations: Column, body_bytes: Column) -> Column:
    return F.sha2(
        F.concat(F.lit('["'), kind, F.lit('",'), json_list(locations), F.lit(","), body_bytes, F.lit("]")), 256
    )


def policy_key(policy: Column, origin: Column, hosts: Column) -> Column:
    head = F.regexp_replace(F.to_json(F.array(policy, origin)), "\\]$", ",")
    return F.sha2(F.concat(head, json_list(hosts), F.lit("]")), 256)


def scope_fingerprint(key: Column, roots: Column) -> Column:
    return F.sha2(F.concat(F.regexp_replace(F.to_json(F.array(key)), "\\]$", ","), json_list(roots), F.lit("]")), 256)

