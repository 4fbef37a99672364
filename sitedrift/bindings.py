"""Monitor tables derived from the given tables. Each is one SELECT that Spark and DuckDB both run.

``{name}`` stands for a given table or another binding, ``sha256`` and ``epoch_days`` for what the engines call
differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .scratch import kept, partitions

OBS = """
SELECT DISTINCT CAST(l_suppkey AS STRING) AS website_id, CAST(l_suppkey AS STRING) AS target_id, 1 AS scope_version,
  concat(CAST(l_suppkey AS STRING), '-', CAST(year(l_shipdate) * 100 + month(l_shipdate) AS STRING)) AS run_id,
  CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS observed_at,
  concat('https://s', CAST(l_suppkey AS STRING), '.example.com/p/', CAST(l_partkey % 12 AS STRING)) AS url
FROM {lineitem}
"""
OBS_HASHED = "SELECT *, sha256(url) AS url_hash FROM {obs}"
RUNS = "SELECT DISTINCT website_id, target_id, scope_version, run_id, observed_at FROM {obs}"

WEBSITE = """
SELECT concat('web_', CAST(c_custkey AS STRING)) AS id, CAST(n_regionkey AS STRING) AS userId, c_name AS name,
  concat('c', CAST(c_custkey AS STRING), '.example.com') AS domain,
  CASE WHEN c_custkey % 10 <> 0 THEN CAST(c_nationkey AS STRING) END AS competitor_group_id,
  CASE WHEN c_custkey % 7 = 0 THEN '[]' WHEN c_custkey % 7 = 1 THEN concat('["dst_', CAST(c_custkey % 120 AS STRING), '"]')
    WHEN c_custkey % 7 = 2 THEN 'not json' END AS notificationDestinationIds
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
"""
TARGET = """
SELECT concat('t_', CAST(c_custkey AS STRING)) AS id, concat('web_', CAST(c_custkey AS STRING)) AS websiteId,
  'SITEMAP_LINKS' AS kind, c_custkey % 5 <> 0 AS enabled,
  CASE WHEN c_custkey % 11 = 0 THEN CAST('2024-01-05 00:00:00' AS TIMESTAMP) END AS archived_at,
  1 AS scope_version,
  CASE WHEN c_custkey % 4 = 0 THEN '/p/1' ELSE '' END AS include_path,
  CASE WHEN c_custkey % 6 = 0 THEN '/p/11' ELSE '' END AS exclude_path,
  CASE WHEN c_custkey % 13 = 0 THEN 'HTTP_500' END AS lastError,
  CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 6 WHEN 2 THEN 12 ELSE 24 END AS checkIntervalHours,
  CASE WHEN c_custkey % 9 <> 0 THEN CAST('2024-01-01 00:00:00' AS TIMESTAMP) END AS nextCheckDueAt,
  CASE WHEN c_custkey % 3 <> 0 THEN concat('t_', CAST(c_custkey AS STRING), '-base') END AS baseline_run_id,
  c_custkey % 2 = 0 AS externalNotify,
  CASE WHEN c_custkey % 8 <> 0 THEN concat('dst_', CAST(c_custkey % 120 AS STRING)) END AS notificationDestinationId,
  c_custkey % 3 = 0 AS aiTriageEnabled, c_custkey AS n
FROM {customer} WHERE c_custkey % 17 <> 0
"""
GROUPS = """
SELECT CAST(n_nationkey AS STRING) AS id, CAST(n_regionkey AS STRING) AS owner_user_id, n_name AS name,
  1 + n_nationkey % 3 AS membership_version FROM {nation}
"""
MEMBERSHIP = """
SELECT CAST(r_regionkey AS STRING) AS ownerUserId, CAST((r_regionkey + 1) % 5 AS STRING) AS memberUserId FROM {region}
"""
RUN = """
SELECT CAST(o_orderkey AS STRING) AS id, CAST(o_custkey % 100 AS STRING) AS target_id,
  CASE o_orderkey % 3 WHEN 0 THEN 'manual' WHEN 1 THEN 'scheduled' ELSE 'confirmation' END AS trigger_kind,
  1 + o_orderkey % 2 AS scope_version,
  CASE WHEN o_orderstatus = 'F' THEN 'succeeded' WHEN o_orderstatus = 'P' THEN 'failed'
    WHEN o_orderkey = max(CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) OVER (PARTITION BY o_custkey % 100)
    THEN 'queued' ELSE 'cancelled' END AS execution_status,
  CASE WHEN o_orderstatus = 'F' THEN 'complete' WHEN o_orderstatus = 'O' THEN 'unknown'
    WHEN o_orderkey % 2 = 0 THEN 'partial' ELSE 'unusable' END AS completeness,
  CASE o_orderkey % 5 WHEN 0 THEN 'baseline' WHEN 1 THEN 'quarantined' WHEN 2 THEN 'stale' ELSE 'applied' END AS adoption_status,
  1 + o_orderkey % 4 AS attempt, o_orderdate AS created_at, o_orderdate AS observed_at,
  CASE WHEN o_orderstatus = 'F' THEN o_orderkey % 1000 END AS url_count
FROM {orders}
"""
ALERT = """
SELECT o_orderkey AS id, concat('web_', CAST(o_custkey AS STRING)) AS websiteId,
  concat('t_', CAST(o_custkey AS STRING)) AS targetId,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'NEW_LINK' WHEN '2' THEN 'REMOVED_LINK' WHEN '3' THEN 'PAGE_CONTENT'
    ELSE 'PRODUCT_PRICE' END AS kind,
  concat('Alert ', CAST(o_orderkey AS STRING), ' on https://example.com') AS title,
  o_orderstatus = 'F' AS is_read, o_orderkey % 7 = 0 AS suppressed, o_orderdate AS createdAt
FROM {orders}
"""
DESTINATION = """
SELECT concat('dst_', CAST(s_suppkey AS STRING)) AS id, CAST(s_nationkey % 5 AS STRING) AS userId,
  CASE s_suppkey % 3 WHEN 0 THEN 'SLACK' WHEN 1 THEN 'EMAIL' ELSE 'WEBHOOK' END AS channel, s_name AS name
FROM {supplier}
"""
SNAP = """
SELECT CAST(2 * doc_id AS BIGINT) AS id, source AS websiteId, 'MARKDOWN' AS kind,
  concat('https://', source, '.example.com/') AS targetUrl, coalesce(text, '') AS payload, 60 * doc_id AS taken
FROM {documents}
UNION ALL
SELECT CAST(2 * doc_id + 1 AS BIGINT), source, 'MARKDOWN', concat('https://', source, '.example.com/'),
  coalesce(text, ''), 60 * doc_id + 1
FROM {documents} WHERE doc_id % 3 = 0
"""
SNAP_HASHED = "SELECT *, sha256(payload) AS hash FROM {snap}"
PRICE = """
SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey % 200 AS page, l_shipdate AS createdAt,
  CASE WHEN l_linenumber <> 7 THEN CAST(floor(l_extendedprice / l_quantity) AS DOUBLE) END AS price,
  CASE l_returnflag WHEN 'A' THEN 'USD' WHEN 'N' THEN 'EUR' END AS currency, l_linestatus = 'O' AS is_product_page
FROM {lineitem}
"""

BINDINGS = {
    "obs": OBS, "obs_hashed": OBS_HASHED, "runs": RUNS, "website": WEBSITE, "target": TARGET, "groups": GROUPS,
    "membership": MEMBERSHIP, "run": RUN, "alert": ALERT, "destination": DESTINATION, "snap": SNAP,
    "snap_hashed": SNAP_HASHED, "price": PRICE,
}


#: Bindings that are written once for an application and its tables, as a monitor stores them rather than derives them, and the
#: given tables they are made of.
KEPT = {"obs": ("lineitem",)}


def _stored_obs(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Writes the rows of OBS as a monitor has them: the URLs of a run beside each other.

    Rows are made distinct as numbers and get their texts afterwards, so what is shuffled is narrow. A row without a supplier has
    no URL, so its part says nothing.
    """
    rows = spark.sql(
        """SELECT l_suppkey AS s, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS m,
  CASE WHEN l_suppkey IS NOT NULL THEN l_partkey % 12 END AS p FROM {lineitem}""",
        lineitem=table(spark, sf_dir, "lineitem"),
    )
    rows = rows.repartition(partitions(spark), "s", "m").distinct().sortWithinPartitions("s", "m", "p")
    spark.sql(
        """SELECT CAST(s AS STRING) AS website_id, CAST(s AS STRING) AS target_id, 1 AS scope_version,
  concat(CAST(s AS STRING), '-', CAST(year(m) * 100 + month(m) AS STRING)) AS run_id, m AS observed_at,
  concat('https://s', CAST(s AS STRING), '.example.com/p/', CAST(p AS STRING)) AS url FROM {rows}""",
        rows=rows,
    ).write.parquet(folder)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A binding, or a given table."""
    if name not in BINDINGS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name not in KEPT:
        return _derived(spark, sf_dir, name)
    sources = [f"{sf_dir}/{t}.parquet" for t in KEPT[name]]
    return spark.read.parquet(kept(spark, name, sources, lambda folder: _stored_obs(spark, sf_dir, folder)))


def _derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = re.sub(r"\bsha256\((\w+)\)", r"sha2(\1, 256)", BINDINGS[name])
    needs = {n: table(spark, sf_dir, n) for n in re.findall(r"\{(\w+)\}", sql)}
    return spark.sql(sql, **needs)


def duck(sql: str) -> str:
    """sql with each {binding} as a common table expression, for DuckDB."""
    order: list[str] = []

    def add(text: str) -> None:
        for n in re.findall(r"\{(\w+)\}", text):
            if n in BINDINGS and n not in order:
                add(BINDINGS[n])
                order.append(n)

    add(sql)
    plain = lambda t: re.sub(r"\{(\w+)\}", lambda m: f"b_{m[1]}" if m[1] in BINDINGS else m[1], t)
    ctes = [f"b_{n} AS ({plain(BINDINGS[n])})" for n in order]
    body = plain(sql).strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        body = re.sub(r"(?i)^with( recursive)?\s+", "", body)
        return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)}, {body}"
    return f"WITH {', '.join(ctes)} {body}"
