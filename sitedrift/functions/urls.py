"""URLs as columns: paths, hosts, hashes, typed website input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def url_hash(url: Column) -> Column:
    return F.sha2(url, 256)


def url_path(url: Column) -> Column:
    """The part before the query, without scheme and host; what path rules are matched against."""
    return F.regexp_replace(F.split_part(url, F.lit("?"), F.lit(1)), "^[a-z]+://[^/]+", "")


def path_filter(url: Column, include: Column, exclude: Column) -> Column:
    """True where the path starts with any include (or there is none) and with no exclude; prefixes are literal."""
    path = url_path(url)
    wanted = (F.size(include) == 0) | F.exists(include, lambda p: F.startswith(path, p))
    return F.coalesce(wanted & ~F.exists(exclude, lambda p: F.startswith(path, p)), F.lit(False))


def valid_path_rules(rules: Column) -> Column:
    """At most 100 rules, each starting with / and free of query, fragment, space and control characters."""
    sound = F.forall(
        rules,
        lambda r: F.coalesce(
            F.startswith(r, F.lit("/")) & (F.length(r) <= 2048) & ~r.rlike("[?#\\s\\x00-\\x1f\\x7f]"), F.lit(False)
        ),
    )
    return F.coalesce((F.size(rules) <= 100) & sound, F.lit(False))


def normalize_path_rules(rules: Column) -> Column:
    """struct(rules: sorted distinct, null if invalid; error: INVALID_FILTER or null)."""
    ok = valid_path_rules(rules)
    return F.struct(
        F.when(ok, F.array_sort(F.array_distinct(rules))).alias("rules"),
        F.when(~ok, F.lit("INVALID_FILTER")).alias("error"),
    )


def contains_text(url: Column, query: Column | str) -> Column:
    """Case-insensitive substring; the empty query matches all."""
    q = F.lit(query) if isinstance(query, str) else query
    return F.contains(F.lower(url), F.lower(q))


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute http(s) URL, null for anything else."""
    parts = F.regexp_extract(F.trim(url), "^(?i)https?://(?:[^/?#@]*@)?([^/?#:@\\s]+)(?::[0-9]+)?(?:[/?#][^\\s]*)?$", 1)
    return F.when(parts != "", F.lower(parts))


def _bare(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), "^www\\.", "")


def is_url_within_domain(url: Column, domain: Column) -> Column:
    """Host equals the domain or is below it, both without www; a bad URL isn't, and nothing is below a blank domain."""
    host, own = _bare(host_of(url)), _bare(F.trim(domain))
    return F.coalesce((own != "") & ((host == own) | F.endswith(host, F.concat(F.lit("."), own))), F.lit(False))


def parse_domain(text: Column) -> Column:
    """Host of a URL of any scheme, or what stands before the first slash of a bare domain."""
    bare = F.split_part(F.regexp_replace(text, "^https?://", ""), F.lit("/"), F.lit(1))
    other = F.regexp_extract(F.trim(text), "^(?i)(?!https?:)[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@\\s]+)(?::[0-9]+)?(?:[/?#][^\\s]*)?$", 1)
    return F.coalesce(host_of(text), F.when(other != "", other), bare)


def normalize_domain(text: Column) -> Column:
    """Lower case without www.; null unless it has a dot and only letters, digits, dots and hyphens."""
    raw = F.regexp_replace(F.regexp_replace(F.lower(F.trim(parse_domain(text))), "^www\\.", ""), "/.*$", "")
    return F.when(F.contains(raw, F.lit(".")) & raw.rlike("^[a-z0-9.-]+$"), raw)


def page_hosts(host: Column, configured: Column | None = None) -> Column:
    """Configured hosts, or the host and its www twin (an address has none), distinct and sorted; null where a configured
    one isn't a host name (see invalid_hosts)."""
    host = F.lower(host)
    twin = F.when(F.startswith(host, F.lit("www.")), F.substring(host, 5, 1 << 30)).otherwise(
        F.concat(F.lit("www."), host)
    )
    address = host.rlike("^[0-9.]+$") | F.startswith(host, F.lit("["))
    both = F.when(address, F.array(host)).otherwise(F.array(host, twin))
    if configured is not None:
        own = F.transform(configured, lambda h: F.regexp_replace(F.lower(h), ":0*443$", ""))
        both = F.when(configured.isNull(), both).when(invalid_hosts(configured).isNull(), own)
    return F.array_sort(F.array_distinct(both))


def invalid_hosts(configured: Column) -> Column:
    """INVALID_HOST where an entry is empty, has a path, query, fragment, user or another port than 443; else null."""
    sound = F.forall(
        configured, lambda h: F.coalesce((h != "") & ~h.rlike("[\\s/#?@\\\\]") & ~h.rlike("^[^\\[].*:(?!0*443$)"), F.lit(False))
    )
    return F.when(~sound, F.lit("INVALID_HOST"))


def parse_website_input(raw: Column) -> Column:
    """struct(domainHost, pagePath) of what a user typed: a URL, a host, a host with a path or query."""
    t = F.trim(raw)
    absolute = t.rlike("^(?i)[a-z][a-z0-9+.-]*://[^/?#\\s]+([/?#]\\S*)?$")
    tail = F.regexp_extract(t, "^[^:]+://[^/?#]+([^#]*)", 1)
    tail = F.when(F.startswith(tail, F.lit("?")), F.concat(F.lit("/"), tail)).otherwise(tail)
    rest = F.regexp_replace(F.regexp_replace(t, "^//", ""), "^(?i)https?://", "")
    no_hash = F.split_part(rest, F.lit("#"), F.lit(1))
    host = F.trim(F.regexp_extract(no_hash, "^([^/]*)", 1))
    by_query = F.trim(F.split_part(no_hash, F.lit("?"), F.lit(1)))
    has_slash, has_query = F.contains(rest, F.lit("/")), F.contains(rest, F.lit("?"))
    path = F.regexp_extract(F.regexp_extract(rest, "^[^/]*(/.*)$", 1), "^([^#]*)", 1)
    query = F.concat(
        F.lit("/"), F.regexp_extract(F.regexp_extract(rest, "^[^?]*(\\?.*)$", 1), "^([^#]*)", 1)
    )
    domain = (
        F.when(t == "", F.lit(""))
        .when(absolute, F.lower(F.regexp_extract(t, "^[^:]+://(?:[^/?#@]*@)?([^/?#]+)", 1)))
        .when(has_slash, F.trim(F.split_part(F.split_part(rest, F.lit("/"), F.lit(1)), F.lit("#"), F.lit(1))))
        .when(has_query, by_query)
        .otherwise(host)
    )
    page = (
        F.when(t == "", F.lit(None))
        .when(absolute, F.when(~tail.isin("", "/"), tail))
        .when(has_slash, F.when(path != "/", path))
        .when(has_query, query)
    )
    return F.struct(domain.alias("domainHost"), page.cast("string").alias("pagePath"))


def build_page_url(domain: Column, path: Column) -> Column:
    return F.concat(
        F.lit("https://"), domain, F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))
    )


def robots_sitemaps(body: Column) -> Column:
    """Distinct sorted addresses of a robots file's Sitemap lines, which hold nothing else but a comment after a space;
    null for an HTML body."""
    found = F.regexp_extract_all(body, F.lit("(?im)^\\s*sitemap\\s*:\\s*(\\S+)(?:\\s+#.*)?\\s*$"), F.lit(1))
    html = body.rlike("^\\s*(?i)<(!doctype\\s+html|html)")
    return F.when(~html, F.array_sort(F.array_distinct(found)))
