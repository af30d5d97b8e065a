"""Queries of cloud listings: paths, permissions and change feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowline.operators import inventory, tree
from stowline.sources import listings, permissions
from stowline.workload.registry import query


def braces(text: str) -> str:
    """JSON text inside SQL whose slots are in braces."""
    return text.replace("{", "{{").replace("}", "}}")


ROOTS = "SELECT DISTINCT library_id, location_id, 'top' AS remote_ref FROM {v_cloud_items}"


@query("cloud_paths", """
WITH RECURSIVE dirs AS (SELECT library_id, remote_ref, parent_ref, replace(coalesce(name, remote_ref), '/', '_') AS seg FROM v_cloud_items WHERE kind = 'directory'),
walk(library_id, remote_ref, path) AS (
  SELECT library_id, remote_ref, concat('/', seg) FROM dirs WHERE parent_ref IS NULL OR parent_ref = 'top'
  UNION ALL SELECT d.library_id, d.remote_ref, concat(w.path, '/', d.seg) FROM dirs d JOIN walk w ON w.library_id = d.library_id AND w.remote_ref = d.parent_ref),
lost(library_id, remote_ref, stopped_at) AS (
  SELECT d.library_id, d.remote_ref, d.parent_ref FROM dirs d WHERE d.parent_ref IS NOT NULL AND d.parent_ref <> 'top'
    AND NOT EXISTS (SELECT 1 FROM dirs p WHERE p.library_id = d.library_id AND p.remote_ref = d.parent_ref)
  UNION ALL SELECT d.library_id, d.remote_ref, l.stopped_at FROM dirs d JOIN lost l ON l.library_id = d.library_id AND l.remote_ref = d.parent_ref)
SELECT i.library_id, i.location_id, i.remote_ref,
       CASE WHEN i.parent_ref IS NULL OR i.parent_ref = 'top' THEN concat('/', replace(coalesce(i.name, i.remote_ref), '/', '_'))
            WHEN w.path IS NOT NULL THEN concat(w.path, '/', replace(coalesce(i.name, i.remote_ref), '/', '_')) END AS path,
       CASE WHEN i.parent_ref IS NULL OR i.parent_ref = 'top' OR w.path IS NOT NULL THEN 'ok' WHEN d.remote_ref IS NULL OR l.stopped_at IS NOT NULL THEN 'missing_parent'
            ELSE 'cycle' END AS path_verdict,
       CASE WHEN i.parent_ref IS NULL OR i.parent_ref = 'top' OR w.path IS NOT NULL THEN NULL WHEN d.remote_ref IS NULL THEN i.parent_ref
            WHEN l.stopped_at IS NOT NULL THEN l.stopped_at ELSE i.parent_ref END AS stopped_at
FROM v_cloud_items i LEFT JOIN dirs d ON d.library_id = i.library_id AND d.remote_ref = i.parent_ref
LEFT JOIN walk w ON w.library_id = i.library_id AND w.remote_ref = i.parent_ref
LEFT JOIN lost l ON l.library_id = i.library_id AND l.remote_ref = i.parent_ref
""")
def _(t):
    found = tree.cloud_paths(t.stored("v_cloud_items"), t.sql(ROOTS))
    return found.select("library_id", "location_id", "remote_ref", "path", "path_verdict", "stopped_at")


DRIVE_GRANTS = braces("""
SELECT CAST(0 AS BIGINT) AS library_id, source AS location_id, concat('{"id":"d', doc_id, '"', CASE doc_id % 7
  WHEN 0 THEN '' WHEN 1 THEN ',"permissions":[]'
  WHEN 2 THEN ',"permissions":[{"id":"u","type":"user","role":"owner"}]'
  WHEN 3 THEN ',"permissions":[{"id":"u","type":"user","role":"owner"},{"id":"anyoneWithLink","type":"anyone","role":"reader"}]'
  WHEN 4 THEN ',"permissions":[{"id":"anyone","type":"anyone","role":"reader","permissionDetails":[{"permissionType":"file","role":"writer","inherited":false},{"permissionType":"file","role":"Reader","inheritedFrom":"f9","inherited":true}]}]'
  WHEN 5 THEN ',"permissions":[{"type":"domain","role":"commenter"},{"type":"group","role":"commenter"}]'
  ELSE ',"permissions":[{"type":"alien","role":"organizer"}]' END, '}') AS json
""") + "FROM {documents} WHERE doc_id % 2 = 0"
GRAPH_GRANTS = braces("""
SELECT CAST(1 AS BIGINT) AS library_id, source AS location_id, concat('{"id":"g', doc_id, '"', CASE doc_id % 7
  WHEN 0 THEN '' WHEN 1 THEN ',"permissions":[]'
  WHEN 2 THEN ',"permissions":[{"roles":["read","write"],"grantedToV2":{"user":{"id":"1"}}}]'
  WHEN 3 THEN ',"permissions":[{"roles":["read"],"link":{"scope":"anonymous","type":"view"}}]'
  WHEN 4 THEN ',"permissions":[{"link":{"scope":"organization","type":"edit"},"inheritedFrom":{"id":"p1"}}]'
  WHEN 5 THEN ',"permissions":[{"roles":["owner"],"grantedTo":{"user":{"id":"1"}}},{"roles":["sp.full"],"grantedToV2":{"siteGroup":{"id":"2"}}}]'
  ELSE ',"permissions":[{"roles":["read"],"link":{"scope":"strange","type":"view"}},{"roles":["read"],"grantedToV2":{"robot":{"id":"3"}}}]' END, '}') AS json
""") + "FROM {documents} WHERE doc_id % 2 = 1"
GRANTS = {
    0: [(0, "Unknown", None, False, None), (2, "User", "owner", False, None), (3, "User", "owner", False, None), (3, "AnyoneWithLink", "reader", False, None),
        (4, "Anyone", "writer", False, None), (4, "Anyone", "reader", True, "f9"), (5, "Group", "commenter", False, None), (6, "Unknown", "organizer", False, None)],
    1: [(0, "Unknown", None, False, None), (2, "User", "reader", False, None), (2, "User", "writer", False, None), (3, "AnyoneWithLink", "reader", False, None),
        (4, "Group", "writer", True, "p1"), (5, "User", "owner", False, None), (5, "Group", "sp.full", False, None), (6, "Unknown", "reader", False, None)],
}


def _cell(value) -> str:
    return "CAST(NULL AS VARCHAR)" if value is None else str(value).lower() if isinstance(value, bool) else f"'{value}'"


def _grants_sql() -> str:
    rows = [f"SELECT {side} AS side, {k} AS k, {_cell(principal)} AS principal, {_cell(role)} AS role, {_cell(inherited)} AS inherited, {_cell(source)} AS inherited_from"
            for side, grants in GRANTS.items() for k, principal, role, inherited, source in grants]
    return f"""
SELECT doc_id % 2 AS library_id, source AS location_id, concat(CASE WHEN doc_id % 2 = 0 THEN 'd' ELSE 'g' END, doc_id) AS remote_ref,
       principal, role, inherited, inherited_from
FROM documents JOIN ({' UNION ALL '.join(rows)}) g ON g.side = doc_id % 2 AND g.k = doc_id % 7
"""


@query("normalise_permissions", _grants_sql())
def _(t):
    return permissions.normalise_permissions(t.sql(DRIVE_GRANTS), t.sql(GRAPH_GRANTS))


PAGE_ROWS = 50


def drive_pages(t) -> DataFrame:
    """Pages of a change feed over the orders, fifty entries each; the last page of even libraries tells the next cursor."""
    entry = braces("""concat('{"changeType":"', CASE WHEN o_orderkey % 31 = 6 THEN 'drive' ELSE 'file' END, '","fileId":"c', o_custkey, '","removed":', CASE WHEN o_orderkey % 9 = 0 THEN 'true}' ELSE
      concat('false,"file":{"id":"c', o_custkey, '","name":"n', o_orderkey, '","mimeType":"text/plain","size":"', CAST(floor(o_totalprice) AS BIGINT),
             '","modifiedTime":"2024-03-01T10:00:00.', lpad(o_orderkey % 1000, 3, '0'), 'Z","parents":["p', o_custkey % 5, '"],"ownedByMe":', o_orderkey % 8 <> 1, ',"trashed":', o_orderkey % 7 = 2, '}}') END)""")
    rows = t.sql(f"""SELECT CAST(o_orderkey % 2 AS BIGINT) AS library_id, 'drive' AS location_id, CAST(floor(o_orderkey / 100) AS BIGINT) AS page_no,
      o_orderkey, {entry} AS entry FROM {{orders}}""")
    pages = rows.groupBy("library_id", "location_id", "page_no").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o_orderkey", "entry"))), lambda r: r["entry"]), ",").alias("body"))
    last = pages.groupBy("library_id").agg(F.max("page_no").alias("last"))
    token = F.when((F.col("page_no") == F.col("last")) & (F.col("library_id") == 0), F.concat(F.lit(',"newStartPageToken":"t'), "page_no", F.lit('"')))
    return pages.join(F.broadcast(last), "library_id").select(
        "library_id", "location_id", "page_no", F.concat(F.lit('{"changes":['), "body", F.lit("]"), F.coalesce(token, F.lit(',"nextPageToken":"x"')), F.lit("}")).alias("json"))


@query("drive_changes", """
SELECT o_orderkey % 2 AS library_id, 'drive' AS location_id, concat('c', o_custkey) AS item_key,
       CAST(floor(o_orderkey / 100) AS BIGINT) * 1048576 + CAST(floor((o_orderkey % 100) / 2) AS BIGINT) AS change_no,
       o_orderkey % 9 = 0 OR o_orderkey % 8 = 1 OR o_orderkey % 7 = 2 AS is_deleted,
       CASE WHEN o_orderkey % 9 <> 0 THEN concat('n', o_orderkey) END AS name, CASE WHEN o_orderkey % 9 <> 0 THEN concat('p', o_custkey % 5) END AS parent_ref,
       CASE WHEN o_orderkey % 9 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS size,
       CASE WHEN o_orderkey % 9 <> 0 THEN 1709287200000 + o_orderkey % 1000 END AS mtime_ms
FROM orders WHERE o_orderkey % 31 <> 6
""")
def _(t):
    return listings.drive_changes(drive_pages(t)).select(
        "library_id", "location_id", "item_key", "change_no", "is_deleted", "name", "parent_ref", "size", F.unix_millis("mtime_utc").alias("mtime_ms"))


@query("drive_feed_merged", """
WITH c AS (SELECT o_orderkey % 2 AS library_id, concat('c', o_custkey) AS item_key, o_orderkey, o_orderkey % 9 = 0 OR o_orderkey % 8 = 1 OR o_orderkey % 7 = 2 AS gone,
                  CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders WHERE o_orderkey % 31 <> 6),
b AS (SELECT library_id, item_key, o_orderkey, gone, size FROM c
      UNION ALL SELECT 0, concat('c', c_custkey), -1, false, 7 FROM customer UNION ALL SELECT 1, concat('c', c_custkey), -1, false, 7 FROM customer)
SELECT library_id, 'drive' AS location_id, item_key, size FROM (
  SELECT *, row_number() OVER (PARTITION BY library_id, item_key ORDER BY o_orderkey DESC) AS n FROM b) WHERE n = 1 AND NOT gone
""")
def _(t):
    base = t.sql("""SELECT CAST(l AS BIGINT) AS library_id, 'drive' AS location_id, concat('c', c_custkey) AS item_key, CAST(7 AS BIGINT) AS size
      FROM {customer} LATERAL VIEW explode(array(0, 1)) x AS l""")
    return inventory.apply_delta(base, listings.drive_changes(drive_pages(t)))


@query("feed_cursors", """
SELECT o_orderkey % 2 AS library_id, 'drive' AS provider_id,
       CASE WHEN o_orderkey % 2 = 0 THEN concat('t', max(CAST(floor(o_orderkey / 100) AS BIGINT))) END AS cursor, o_orderkey % 2 = 0 AS complete
FROM orders GROUP BY o_orderkey % 2
""")
def _(t):
    return listings.feed_cursors(drive_pages(t), "drive")


GRAPH_PAGES = braces("""
SELECT library_id, location_id, page_no, concat('{"value":[', array_join(transform(sort_array(collect_list(struct(doc_id, entry))), r -> r.entry), ','),
       '],"@odata.deltaLink":"link', page_no, '"}') AS json
FROM (SELECT CAST(0 AS BIGINT) AS library_id, 'one' AS location_id, CAST(floor(doc_id / 20) AS BIGINT) AS page_no, doc_id,
             concat('{"id":"g', doc_id % 90, '","name":"n', doc_id, '","size":', n_chars, ',"lastModifiedDateTime":"2024-05-01T00:00:00Z","parentReference":{"id":"', lang, '"}',
                    CASE WHEN doc_id % 10 = 3 THEN ',"deleted":{"state":"deleted"}' WHEN doc_id % 10 = 4 THEN ',"remoteItem":{"id":"x"}' WHEN doc_id % 10 = 5 THEN ',"folder":{"childCount":1}' ELSE '' END, '}') AS entry
      FROM """) + "{documents}) GROUP BY library_id, location_id, page_no"


@query("graph_changes", """
SELECT 0::BIGINT AS library_id, 'one' AS location_id, concat('g', doc_id % 90) AS item_key, CAST(floor(doc_id / 20) AS BIGINT) * 1048576 + doc_id % 20 AS change_no,
       doc_id % 10 IN (3, 4) AS is_deleted, lang AS parent_ref, concat('n', doc_id) AS name, CASE WHEN doc_id % 10 = 5 THEN 'directory' ELSE 'byte' END AS kind,
       CASE WHEN doc_id % 10 <> 5 THEN n_chars END AS size
FROM documents
""")
def _(t):
    return listings.graph_changes(t.sql(GRAPH_PAGES)).drop("mtime_utc", "mime")
