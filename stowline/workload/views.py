"""Catalog-shaped views over the test tables. The text runs in Spark SQL and in plain ANSI engines alike."""

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

VIEWS: dict[str, str] = {}

VIEWS["v_locations"] = """
SELECT s_suppkey AS location_id, CAST(s_suppkey % 2 AS BIGINT) AS library_id, s_suppkey AS provider_id,
       CASE WHEN s_suppkey % 3 = 0 THEN 'cloud' ELSE 'volume' END AS kind,
       s_suppkey % 3 <> 0 AS is_final, s_suppkey % 3 = 2 AS is_shuttle, s_suppkey % 10 = 4 AS is_overlay,
       s_suppkey % 3 = 2 AS removable, s_suppkey % 10 <> 7 AS is_online, s_name AS label,
       concat('S-', CAST(s_suppkey AS VARCHAR(20))) AS volume_serial,
       CAST(floor(abs(s_acctbal)) AS BIGINT) * 1048576 AS free_bytes
FROM {supplier}
"""

VIEWS["v_replicas"] = """
SELECT l.l_partkey * 1000000 + l.l_suppkey AS file_id, l.l_partkey AS blob_id, l.l_suppkey AS location_id,
       CAST(l.l_suppkey % 2 AS BIGINT) AS library_id, CAST(p.p_size AS BIGINT) * 1048576 AS size,
       CASE WHEN max(l.l_returnflag) = 'R' THEN 'suspect' ELSE 'verified' END AS state,
       CASE WHEN l.l_suppkey % 3 = 0 THEN 'cloud_native'
            WHEN l.l_partkey % 5 = 0 AND min(l.l_linestatus) = 'F' THEN 'placeholder'
            ELSE 'local_full' END AS hydration,
       max(l.l_shipdate) AS mtime_utc,
       concat(CASE p.p_type WHEN 'ECONOMY' THEN '/Archives/' WHEN 'STANDARD' THEN '/Videos/Captures/'
                            WHEN 'MEDIUM' THEN '/Docs/' WHEN 'PROMO' THEN '/OldClips/'
                            WHEN 'LARGE' THEN '/backup/' ELSE '/misc/' END,
              'f', CAST(l.l_partkey AS VARCHAR(20)),
              CASE p.p_type WHEN 'MEDIUM' THEN '.pdf' WHEN 'LARGE' THEN '.zip'
                            WHEN 'SMALL' THEN '.bin' ELSE '.mp4' END) AS path
FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey
GROUP BY l.l_partkey, l.l_suppkey, p.p_size, p.p_type
"""

# The same rows as v_replicas for Spark: only numbers are aggregated, so that it hashes the groups and need not sort them.
SPARK_VIEWS: dict[str, str] = {"v_replicas": VIEWS["v_replicas"].replace(
    "max(l.l_returnflag) = 'R'", "max(CASE WHEN l.l_returnflag > 'R' THEN 2 WHEN l.l_returnflag = 'R' THEN 1 END) = 1").replace(
    "min(l.l_linestatus) = 'F'", "min(CASE WHEN l.l_linestatus < 'F' THEN 0 WHEN l.l_linestatus = 'F' THEN 1 END) = 1")}

VIEWS["v_files"] = """
SELECT file_id, blob_id, location_id, library_id, location_id AS provider_id, size, state, hydration, mtime_utc, path,
       concat('f', CAST(blob_id AS VARCHAR(20))) AS name,
       CASE WHEN blob_id % 29 = 0 THEN 'shortcut' WHEN blob_id % 31 = 0 THEN 'directory' ELSE 'byte' END AS kind,
       CASE WHEN location_id % 3 = 0 THEN 'cloud' ELSE 'volume' END AS location_kind,
       location_id % 10 <> 7 AS is_online, blob_id % 17 = 0 AS pinned,
       CASE WHEN blob_id % 7 = 0 THEN 4194304 WHEN blob_id % 11 = 0 THEN 262144 WHEN blob_id % 3 = 0 THEN NULL
            ELSE 32 END AS attrs,
       CAST(CASE WHEN blob_id % 13 = 0 THEN 2415919130 WHEN blob_id % 23 = 0 THEN 2415980570
                 WHEN blob_id % 19 = 0 THEN 2415919132 ELSE 0 END AS BIGINT) AS reparse_tag,
       CASE WHEN blob_id % 4 = 0 THEN NULL WHEN blob_id % 4 = 1 THEN 'video/mp4'
            ELSE 'application/octet-stream' END AS mime,
       CASE WHEN blob_id % 3 = 0 THEN NULL WHEN blob_id % 5 = 1 THEN concat('L', CAST(floor(blob_id / 50) AS VARCHAR(20))) ELSE CAST(file_id AS VARCHAR(20)) END AS ntfs_file_id,
       concat('S-', CAST(location_id AS VARCHAR(20))) AS volume_serial,
       location_id * 10 + blob_id % 3 AS last_scan_id
FROM {v_replicas}
"""

VIEWS["v_prev"] = "SELECT * FROM {v_files} WHERE blob_id % 23 <> 0"
VIEWS["v_curr"] = """
SELECT file_id, blob_id, location_id, library_id, hydration, mtime_utc, ntfs_file_id, volume_serial,
       CASE WHEN blob_id % 11 = 0 THEN size + 1 ELSE size END AS size,
       CASE WHEN blob_id % 7 = 0 THEN concat('/Moved', path) ELSE path END AS path
FROM {v_files} WHERE blob_id % 19 <> 0
"""

VIEWS["v_scans"] = " UNION ALL ".join(f"""
SELECT CAST(s_suppkey % 2 AS BIGINT) AS library_id, s_suppkey * 10 + {k} AS id, s_suppkey AS provider_id,
       CASE WHEN s_suppkey % 7 = {k} THEN 'error' ELSE 'ok' END AS status, {'false' if k == 1 else 'true'} AS is_full,
       CAST('2024-01-0{k + 1} 00:00:00' AS TIMESTAMP) AS started_at,
       CAST(concat('2024-01-0{k + 1} 0', CAST(s_suppkey % 10 AS VARCHAR(2)), ':30:00') AS TIMESTAMP) AS finished_at
FROM {{supplier}}""" for k in range(3))

VIEWS["v_roots"] = """
SELECT DISTINCT CAST(s_suppkey % 2 AS BIGINT) AS library_id,
       CASE WHEN s_suppkey % 4 = 0 THEN '/archives' WHEN s_suppkey % 4 = 1 THEN '/Videos' WHEN s_suppkey % 4 = 2 THEN '/back'
            ELSE '/OldClips/' END AS path
FROM {supplier}
"""

VIEWS["v_candidates"] = """
SELECT CAST(c_nationkey % 2 AS BIGINT) AS library_id,
       concat('D:/N', CAST(c_nationkey AS VARCHAR(20)), '/C', CAST(c_custkey AS VARCHAR(20))) AS root
FROM {customer}
UNION ALL
SELECT CAST(n_nationkey % 2 AS BIGINT), concat('D:/N', CAST(n_nationkey AS VARCHAR(20))) FROM {nation}
"""
VIEWS["v_overlays"] = """
SELECT CAST(n_nationkey % 2 AS BIGINT) AS library_id, concat('d:/n', CAST(n_nationkey AS VARCHAR(20))) AS path
FROM {nation} WHERE n_regionkey = 0
UNION ALL
SELECT CAST(c_nationkey % 2 AS BIGINT),
       concat('D:/n', CAST(c_nationkey AS VARCHAR(20)), '/c', CAST(c_custkey AS VARCHAR(20)), '/Sync')
FROM {customer} WHERE c_mktsegment = 'MACHINERY'
"""

VIEWS["v_base_items"] = """
SELECT CAST(c_custkey % 2 AS BIGINT) AS library_id, CAST(c_nationkey AS BIGINT) AS location_id, c_custkey AS item_key,
       CAST(floor(abs(c_acctbal)) AS BIGINT) AS size, c_name AS path
FROM {customer}
"""
VIEWS["v_changes"] = """
SELECT CAST(o.o_custkey % 2 AS BIGINT) AS library_id, CAST(c.c_nationkey AS BIGINT) AS location_id, o.o_custkey AS item_key,
       CAST(floor(o.o_totalprice) AS BIGINT) AS size, concat('moved-', CAST(o.o_orderkey AS VARCHAR(20))) AS path,
       o.o_orderkey AS change_no, o.o_orderstatus = 'F' AS is_deleted
FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey
"""

VIEWS["v_mime"] = """
SELECT DISTINCT CASE p_type WHEN 'MEDIUM' THEN 'PDF' WHEN 'LARGE' THEN 'zip' WHEN 'SMALL' THEN 'none' ELSE 'mp4' END AS extension,
       CASE p_type WHEN 'MEDIUM' THEN 'application/pdf' WHEN 'LARGE' THEN 'application/zip' WHEN 'SMALL' THEN 'x/none'
            ELSE 'video/mp4' END AS mime
FROM {part}
"""

VIEWS["v_contents"] = """
SELECT doc_id AS file_id, doc_id AS blob_id, CAST(0 AS BIGINT) AS library_id, source AS location_id,
       concat('/', lang, '/', 'clip-', CAST(n_chars % 50 AS VARCHAR(20)), '.txt') AS path,
       concat(CASE WHEN doc_id % 2 = 0 THEN 'Clip-' ELSE 'clip-' END, CAST(n_chars % 50 AS VARCHAR(20)), '.txt') AS name,
       'byte' AS kind, n_chars AS size, text AS content
FROM {documents}
"""

VIEWS["v_bindings"] = """
SELECT CAST(0 AS BIGINT) AS library_id, source AS provider_id, concat('d', CAST(doc_id AS VARCHAR(20))) AS remote_ref,
       'md5' AS algo, md5(text) AS hex, n_chars AS size, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id END AS blob_id
FROM {documents}
"""

VIEWS["v_raw_ids"] = """
SELECT doc_id AS file_id,
       CASE WHEN doc_id % 6 = 0 THEN concat('sha256:', md5(text), md5(lang))
            WHEN doc_id % 6 = 1 THEN concat('b3:', upper(md5(text)), md5(lang))
            WHEN doc_id % 6 = 2 THEN concat('b3:', md5(text))
            WHEN doc_id % 6 = 3 THEN concat(md5(text), md5(lang))
            WHEN doc_id % 6 = 4 THEN concat('b3:', md5(text), md5(lang), '0')
            ELSE concat('md5:', md5(text), md5(lang)) END AS content_id
FROM {documents}
"""

VIEWS["v_snapshots"] = """
SELECT event_id AS id, CAST(user_id % 2 AS BIGINT) AS library_id, user_id AS location_id, ts AS measured_at,
       CASE WHEN user_id % 3 = 0 THEN 'cloud' ELSE 'volume' END AS kind, CAST(floor(value * 100) AS BIGINT) * 1048576 AS free_bytes
FROM {events}
"""
VIEWS["v_mounts"] = """
SELECT CAST(user_id % 2 AS BIGINT) AS library_id, concat('S-', CAST(user_id AS VARCHAR(20))) AS volume_serial, ts AS seen_at,
       CASE event_type WHEN 'signup' THEN 'D:' WHEN 'view' THEN 'E:' WHEN 'click' THEN 'F:' ELSE 'G:' END AS root
FROM {events}
"""
VIEWS["v_hosts"] = """
SELECT s.s_nationkey AS host, concat('V', CAST(s.s_suppkey AS VARCHAR(20))) AS root, s.s_suppkey = m.first_key AS is_system,
       CAST(floor(abs(s.s_acctbal)) AS BIGINT) * 1048576 AS free_bytes
FROM {supplier} s JOIN (SELECT s_nationkey, min(s_suppkey) AS first_key FROM {supplier} GROUP BY s_nationkey) m
  ON m.s_nationkey = s.s_nationkey
"""

# Policies of both libraries; the clouds are suppliers 0, 6 and 3, 9, the volumes 2, 4, 8 and 1, 5, 11.
_POLICIES = (
    "'Archives' AS collection, 0 AS ord, 'cloud_only' AS keep_local, 1 AS min_replicas, 'specific' AS cloud_choice, "
    "false AS pin_local, 'Archives' AS dest_subdir",
    "'Gaming Clips', 1, 'prefer', 2, 'most_free', false, 'Gaming/Clips'",
    "'Documents', 2, 'required', 3, 'any', false, 'Documents/'",
    "'default', 3, 'prefer', 1, 'most_free', true, NULL",
)
VIEWS["v_policies"] = " UNION ALL ".join(
    f"SELECT DISTINCT CAST(s_suppkey % 2 AS BIGINT) AS library_id, {row} FROM {{supplier}}" for row in _POLICIES)

_MEMBERS = (
    ("Archives", "cloud", "0, 3"), ("Gaming Clips", "cloud", "0, 6, 3, 9"), ("Documents", "cloud", "0, 6, 3, 9"), ("default", "cloud", "0, 6, 3, 9"),
    ("Gaming Clips", "local", "2, 1"), ("Documents", "local", "4, 8, 5, 11"),
)
VIEWS["v_members"] = " UNION ALL ".join(
    f"SELECT CAST(s_suppkey % 2 AS BIGINT) AS library_id, '{collection}' AS collection, '{role}' AS role, CAST(s_suppkey AS INTEGER) AS ord, "
    f"s_suppkey AS location_id FROM {{supplier}} WHERE s_suppkey IN ({keys})" for collection, role, keys in _MEMBERS)

VIEWS["v_plan_ops"] = """
SELECT CAST(o_custkey % 2 AS BIGINT) AS library_id, concat('p', CAST(o_custkey AS VARCHAR(20))) AS plan_id,
       CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS seq, o_orderkey AS op_id,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'upload_evict' WHEN '2-HIGH' THEN 'evict' WHEN '3-MEDIUM' THEN 'upload_keep'
            WHEN '5-LOW' THEN 'shuttle' ELSE 'download' END AS kind,
       o_custkey * 7 + o_orderkey % 4 AS blob_id, o_orderkey AS file_id,
       CAST(floor(o_totalprice) AS BIGINT) * 8192 AS size,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN o_custkey % 2 + 2 * (o_orderkey % 5)
            ELSE (o_custkey % 2) * 3 + 30 END AS src,
       CASE WHEN o_orderpriority = '2-HIGH' THEN NULL WHEN o_orderpriority IN ('1-URGENT', '3-MEDIUM', '5-LOW') THEN (o_custkey % 2) * 3 + 30
            ELSE o_custkey % 2 + 2 * (o_orderkey % 5) END AS dest,
       CASE WHEN o_orderpriority = '5-LOW' THEN (o_custkey % 2) * 3 + 8 ELSE NULL END AS staging
FROM {orders}
"""

VIEWS["v_journal"] = """
SELECT event_id, CAST(event_id % 2 AS BIGINT) AS library_id, user_id AS op_id, concat('p', CAST(user_id % 20 AS VARCHAR(20))) AS plan_id, ts AS updated_at,
       CASE event_type WHEN 'signup' THEN 'ReservedSpace' WHEN 'view' THEN 'Transferring' WHEN 'click' THEN 'Verifying'
            WHEN 'purchase' THEN 'Committed' ELSE 'NeedsAttention' END AS state,
       CAST(floor(value * 100) AS BIGINT) - 500 AS stored_offset
FROM {events}
"""
VIEWS["v_op_states"] = """
SELECT o_orderkey AS op_id, CAST(floor(o_totalprice) AS BIGINT) % 3 * 100 AS stored_offset,
       CASE WHEN o_orderkey % 12 = 0 THEN 'NotStarted' WHEN o_orderkey % 12 = 1 THEN 'ReservedSpace'
            WHEN o_orderkey % 12 = 2 THEN 'Transferring' WHEN o_orderkey % 12 IN (3, 4) THEN 'Verifying'
            WHEN o_orderkey % 12 = 5 THEN 'AssertedPrivate' WHEN o_orderkey % 12 = 6 THEN 'DeletingSource'
            WHEN o_orderkey % 12 = 7 THEN 'NeedsAttention' WHEN o_orderkey % 12 = 8 THEN 'Compensating' ELSE 'Committed' END AS state,
       o_orderstatus <> 'P' AS we_created, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'volume' ELSE 'cloud' END AS dest_kind,
       o_orderpriority = '3-MEDIUM' AS verify_failed, o_orderstatus = 'O' AS delete_failed
FROM {orders}
"""
VIEWS["v_op_stats"] = """
SELECT o_orderkey AS op_id, o_totalprice > 100000 AS dest_exists, o_totalprice > 250000 AS binding_ok
FROM {orders} WHERE o_orderpriority <> '1-URGENT'
"""

# Every region, nation and customer as a folder; the access queries read v_folders, which leaves some of them out.
VIEWS["v_folder_tree"] = """
SELECT CAST(0 AS BIGINT) AS library_id, concat('r', CAST(r_regionkey AS VARCHAR(20))) AS ref, CAST(NULL AS VARCHAR(20)) AS parent_ref FROM {region}
UNION ALL SELECT CAST(0 AS BIGINT), concat('n', CAST(n_nationkey AS VARCHAR(20))), concat('r', CAST(n_regionkey AS VARCHAR(20))) FROM {nation}
UNION ALL SELECT CAST(0 AS BIGINT), concat('c', CAST(c_custkey AS VARCHAR(20))), concat('n', CAST(c_nationkey AS VARCHAR(20))) FROM {customer}
"""
# One region, some customers and their parents are not listed; some grants cannot be read.
VIEWS["v_folders"] = """
SELECT CAST(0 AS BIGINT) AS library_id, concat('r', CAST(r_regionkey AS VARCHAR(20))) AS ref, CAST(NULL AS VARCHAR(20)) AS parent_ref,
       'none' AS principal FROM {region} WHERE r_regionkey <> 3
UNION ALL
SELECT CAST(0 AS BIGINT), concat('n', CAST(n_nationkey AS VARCHAR(20))), concat('r', CAST(n_regionkey AS VARCHAR(20))),
       CASE WHEN n_nationkey % 6 = 0 THEN 'AnyoneWithLink' WHEN n_nationkey % 11 = 1 THEN 'Unknown' ELSE 'User' END FROM {nation}
UNION ALL
SELECT CAST(0 AS BIGINT), concat('c', CAST(c_custkey AS VARCHAR(20))), concat('n', CAST(c_nationkey AS VARCHAR(20))),
       CASE WHEN c_mktsegment = 'BUILDING' THEN 'Anyone' WHEN c_custkey % 17 = 5 THEN 'Unknown' ELSE 'User' END FROM {customer} WHERE c_custkey % 13 <> 7
"""
VIEWS["v_items"] = """
SELECT CAST(0 AS BIGINT) AS library_id, concat('o', CAST(o_orderkey AS VARCHAR(20))) AS ref,
       CASE WHEN o_orderkey % 10 <> 4 THEN concat('c', CAST(o_custkey AS VARCHAR(20))) END AS parent_ref,
       CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN 'anonymous' WHEN o_orderkey % 19 = 3 THEN 'Unknown' ELSE 'User' END AS principal
FROM {orders}
"""
VIEWS["v_acl"] = """
SELECT library_id, ref, principal FROM {v_folders} UNION ALL SELECT library_id, ref, principal FROM {v_items}
"""

# A tree of folders by number: some parents are files or not listed, some link to themselves or to each other.
VIEWS["v_cloud_items"] = """
SELECT CAST(o_orderkey % 2 AS BIGINT) AS library_id, 'drive' AS location_id, concat('i', CAST(o_orderkey AS VARCHAR(20))) AS remote_ref,
       CASE WHEN o_orderkey < 6 THEN NULL WHEN o_orderkey < 40 THEN 'top' WHEN o_orderkey % 100 = 47 THEN concat('i', CAST(o_orderkey AS VARCHAR(20)))
            WHEN o_orderkey % 100 = 57 THEN concat('i', CAST(o_orderkey + 2 AS VARCHAR(20)))
            WHEN o_orderkey % 100 = 59 THEN concat('i', CAST(o_orderkey - 2 AS VARCHAR(20)))
            WHEN o_orderkey % 100 = 63 THEN 'gone' ELSE concat('i', CAST(CAST(floor(o_orderkey / 6) AS BIGINT) * 2 + o_orderkey % 2 AS VARCHAR(20))) END AS parent_ref,
       CASE WHEN o_orderkey % 21 = 4 THEN NULL ELSE concat(o_orderstatus, '/', CAST(o_orderkey % 97 AS VARCHAR(20))) END AS name,
       CASE WHEN o_orderkey % 7 = 0 THEN 'byte' ELSE 'directory' END AS kind
FROM {orders}
"""

VIEWS["v_paths"] = """
SELECT page_id, '/data/site' AS root,
       CASE WHEN page_id % 8 = 0 THEN concat('/data/site/', url) WHEN page_id % 8 = 1 THEN concat('../', CAST(page_id AS VARCHAR(20)))
            WHEN page_id % 8 = 2 THEN concat('sub/', CAST(page_id AS VARCHAR(20)), '.mp4:zone') WHEN page_id % 8 = 3 THEN '/etc/passwd'
            WHEN page_id % 8 = 4 THEN concat('C:clip', CAST(page_id AS VARCHAR(20))) WHEN page_id % 8 = 5 THEN concat('/Data/Site/ok/', CAST(page_id AS VARCHAR(20)))
            WHEN page_id % 8 = 6 THEN concat('a/../b', CAST(page_id AS VARCHAR(20))) ELSE concat('ok/', CAST(page_id AS VARCHAR(20)), '..mp4') END AS path
FROM {pages}
"""

VIEWS["v_metrics"] = """
SELECT CASE event_type WHEN 'signup' THEN 'index.files_seen' WHEN 'view' THEN 'apply.bytes_copied' WHEN 'click' THEN 'plan.ops'
            WHEN 'purchase' THEN 'space.free' ELSE 'space.usable' END AS name,
       CASE WHEN event_type IN ('purchase', 'error') THEN 'gauge' ELSE 'counter' END AS kind,
       CAST(floor(value * 100) AS BIGINT) AS value, ts
FROM {events}
"""

VIEWS["v_log_fields"] = """
SELECT event_id AS log_id, ts, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'DEBUG' ELSE 'INFO' END AS level,
       concat('sent Authorization: Bearer k', CAST(user_id AS VARCHAR(20)), ' to api') AS msg,
       concat('tok-', CAST(event_id AS VARCHAR(20))) AS access_token,
       CASE WHEN event_id % 3 = 0 THEN concat('https://host/dl?sig=', CAST(user_id AS VARCHAR(20)), '&x=1')
            ELSE concat('https://host/plain/', CAST(user_id AS VARCHAR(20))) END AS session_uri,
       concat('/Videos/Captures/f', CAST(event_id AS VARCHAR(20)), '.mp4') AS target_path,
       CAST(user_id AS VARCHAR(20)) AS plan_id
FROM {events}
"""

# Only the reference SQL uses these: the intermediate tables of the placement derivation.
ORACLE_VIEWS: dict[str, str] = {}

ORACLE_VIEWS["o_classified"] = """
SELECT f.*, CASE WHEN path_hit OR ext IN ('zip', '7z', 'rar') THEN 'Archives'
                 WHEN (coalesce(starts_with(lower(mime), 'video/'), false) OR ext IN ('mp4', 'mkv', 'mov', 'webm', 'avi')) AND NOT path_hit THEN 'Gaming Clips'
                 WHEN ext IN ('pdf', 'docx', 'xlsx', 'txt', 'md') OR coalesce(starts_with(lower(mime), 'application/pdf'), false) THEN 'Documents'
                 ELSE 'default' END AS collection
FROM (SELECT *, contains(lower(path), '/archive/') OR contains(lower(path), '/archives/') OR contains(lower(path), '/oldclips/') AS path_hit,
             lower(split_part(path, '.', -1)) AS ext FROM v_files) f
"""
ORACLE_VIEWS["o_placed"] = """
SELECT f.library_id, f.file_id, f.blob_id, f.size, f.collection, p.ord, p.keep_local, p.min_replicas, p.cloud_choice, p.pin_local, p.dest_subdir
FROM o_classified f LEFT JOIN v_policies p ON p.library_id = f.library_id AND p.collection = f.collection
"""
ORACLE_VIEWS["o_blobs"] = """
SELECT a.library_id, a.blob_id, a.keep_local, a.min_replicas, a.pin_local, a.collections, a.size, w.collection, w.cloud_choice, w.dest_subdir
FROM (SELECT library_id, blob_id, max(min_replicas) AS min_replicas, bool_or(pin_local) AS pin_local,
             CASE max(CASE keep_local WHEN 'cloud_only' THEN 0 WHEN 'prefer' THEN 1 ELSE 2 END) WHEN 0 THEN 'cloud_only' WHEN 1 THEN 'prefer' ELSE 'required' END AS keep_local,
             string_agg(DISTINCT collection, '|' ORDER BY collection) AS collections, max(size) AS size
      FROM o_placed GROUP BY library_id, blob_id) a
JOIN (SELECT library_id, blob_id, collection, cloud_choice, dest_subdir,
             row_number() OVER (PARTITION BY library_id, blob_id ORDER BY CASE keep_local WHEN 'cloud_only' THEN 0 WHEN 'prefer' THEN 1 ELSE 2 END DESC, ord) AS n
      FROM o_placed) w ON w.library_id = a.library_id AND w.blob_id = a.blob_id AND w.n = 1
"""
ORACLE_VIEWS["o_cloud_pick"] = """
SELECT library_id, collection, location_id AS cloud FROM (
  SELECT p.library_id, p.collection, m.location_id,
         row_number() OVER (PARTITION BY p.library_id, p.collection
           ORDER BY CASE WHEN p.cloud_choice = 'most_free' THEN -l.free_bytes ELSE m.ord END, m.location_id) AS n
  FROM v_policies p JOIN v_members m ON m.library_id = p.library_id AND m.collection = p.collection AND m.role = 'cloud'
  JOIN v_locations l ON l.location_id = m.location_id AND l.is_online) WHERE n = 1
"""
ORACLE_VIEWS["o_goals"] = """
SELECT b.library_id, b.blob_id, b.collection, b.keep_local, b.min_replicas, b.size, m.location_id AS dest, 'volume' AS dest_kind
FROM o_blobs b JOIN v_members m ON m.library_id = b.library_id AND m.collection = b.collection AND m.role = 'local'
JOIN v_locations l ON l.location_id = m.location_id AND l.is_online AND l.is_final
WHERE b.keep_local <> 'cloud_only'
UNION ALL
SELECT DISTINCT b.library_id, b.blob_id, b.collection, b.keep_local, b.min_replicas, b.size, r.location_id, 'volume'
FROM o_blobs b JOIN v_files r ON r.library_id = b.library_id AND r.blob_id = b.blob_id
WHERE b.keep_local <> 'cloud_only' AND r.location_kind = 'volume' AND r.hydration = 'local_full' AND r.is_online
  AND NOT EXISTS (SELECT 1 FROM v_members m WHERE m.library_id = b.library_id AND m.collection = b.collection AND m.role = 'local')
UNION ALL
SELECT b.library_id, b.blob_id, b.collection, b.keep_local, b.min_replicas, b.size, coalesce(h.held, c.cloud), 'cloud'
FROM o_blobs b
LEFT JOIN (SELECT library_id, blob_id, held FROM (
    SELECT r.library_id, r.blob_id, r.location_id AS held, row_number() OVER (PARTITION BY r.library_id, r.blob_id
             ORDER BY CASE r.state WHEN 'verified' THEN 0 ELSE 1 END, r.location_id) AS n
    FROM v_files r JOIN o_blobs b2 ON b2.library_id = r.library_id AND b2.blob_id = r.blob_id
    JOIN v_members m ON m.library_id = b2.library_id AND m.collection = b2.collection AND m.role = 'cloud' AND m.location_id = r.location_id
    WHERE r.location_kind = 'cloud' AND r.is_online) WHERE n = 1) h ON h.library_id = b.library_id AND h.blob_id = b.blob_id
LEFT JOIN o_cloud_pick c ON c.library_id = b.library_id AND c.collection = b.collection
WHERE coalesce(h.held, c.cloud) IS NOT NULL
"""
ORACLE_VIEWS["o_needs"] = """
SELECT g.* FROM o_goals g WHERE NOT EXISTS (
  SELECT 1 FROM v_files r WHERE r.library_id = g.library_id AND r.blob_id = g.blob_id AND r.location_id = g.dest AND r.hydration <> 'placeholder')
"""
ORACLE_VIEWS["o_sources"] = """
SELECT library_id, blob_id, location_id AS src, location_kind AS src_kind, file_id AS src_file_id, path FROM (
  SELECT *, row_number() OVER (PARTITION BY library_id, blob_id ORDER BY
      CASE WHEN location_kind = 'volume' THEN 0 ELSE 2 END + CASE state WHEN 'verified' THEN 0 ELSE 1 END, location_id, file_id) AS n
  FROM v_files WHERE hydration <> 'placeholder' AND is_online) WHERE n = 1
"""
ORACLE_VIEWS["o_sourced"] = """
SELECT n.*, s.src, s.src_kind, s.src_file_id, s.path, s.src IS NULL AS no_source
FROM o_needs n LEFT JOIN o_sources s ON s.library_id = n.library_id AND s.blob_id = n.blob_id
"""
ORACLE_VIEWS["o_evicts"] = """
SELECT r.library_id, r.blob_id, r.file_id, r.location_id, r.size, b.min_replicas, g.n_goals
FROM v_files r JOIN o_blobs b ON b.library_id = r.library_id AND b.blob_id = r.blob_id AND NOT b.pin_local
JOIN (SELECT library_id, blob_id, count(DISTINCT dest) AS n_goals FROM o_goals GROUP BY library_id, blob_id) g
  ON g.library_id = r.library_id AND g.blob_id = r.blob_id
WHERE r.location_kind = 'volume' AND r.hydration = 'local_full' AND r.state = 'verified' AND r.is_online
  AND NOT EXISTS (SELECT 1 FROM o_goals x WHERE x.library_id = r.library_id AND x.blob_id = r.blob_id AND x.dest = r.location_id)
  AND ((SELECT count(*) FROM v_files v WHERE v.library_id = r.library_id AND v.blob_id = r.blob_id AND v.state = 'verified'
          AND v.hydration <> 'placeholder' AND v.is_online) > 1
       OR EXISTS (SELECT 1 FROM o_sourced n WHERE n.library_id = r.library_id AND n.blob_id = r.blob_id AND n.dest_kind = 'cloud' AND NOT n.no_source))
"""
ORACLE_VIEWS["o_effects"] = """
SELECT library_id, plan_id, seq, kind, size, src AS location_id, size AS d, size AS a FROM v_plan_ops WHERE kind = 'evict'
UNION ALL SELECT library_id, plan_id, seq, kind, size, dest, -size, -size FROM v_plan_ops WHERE kind <> 'evict'
UNION ALL SELECT library_id, plan_id, seq, kind, size, staging, -size, 0 FROM v_plan_ops WHERE kind = 'shuttle'
UNION ALL SELECT library_id, plan_id, seq, kind, size, src, 0, 0 FROM v_plan_ops WHERE kind IN ('upload_keep', 'upload_evict')
"""
ORACLE_VIEWS["o_residuals"] = """
SELECT e.library_id, e.plan_id, e.seq, e.kind, e.size, e.location_id, l.kind AS location_kind,
       CAST(l.free_bytes + e.net - e.a + e.d AS BIGINT) AS residual_during, CAST(l.free_bytes + e.net AS BIGINT) AS residual_after,
       CAST(l.free_bytes + e.net - e.a AS BIGINT) AS residual_before
FROM (SELECT *, sum(a) OVER (PARTITION BY library_id, plan_id, location_id ORDER BY seq) AS net FROM o_effects) e
JOIN v_locations l ON l.library_id = e.library_id AND l.location_id = e.location_id
"""
