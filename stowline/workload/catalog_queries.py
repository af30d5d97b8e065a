"""Queries of sources, inventory, identity and duplicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from stowline.functions.content import content_id
from stowline.operators import dups, identity, inventory
from stowline.session import new_folder
from stowline.sources import catalog, files, listings
from stowline.workload.registry import query

# --- sources and inventory


@query("list_files")
def _(t):
    return files.list_files(t.spark, [t.sf_dir], "*.parquet").select("name", "size")


DRIVE_JSON = """
SELECT CAST(doc_id % 2 AS BIGINT) AS library_id, source AS location_id, to_json(named_struct(
  'id', concat('d', doc_id), 'name', concat('clip-', doc_id, '.txt'),
  'mimeType', CASE WHEN doc_id % 11 = 0 THEN 'application/vnd.google-apps.document'
                   WHEN doc_id % 13 = 0 THEN 'application/vnd.google-apps.folder'
                   WHEN doc_id % 19 = 0 THEN 'application/vnd.google-apps.shortcut' ELSE 'text/plain' END,
  'size', CAST(n_chars AS STRING), 'md5Checksum', upper(md5(text)), 'trashed', doc_id % 17 = 0, 'ownedByMe', doc_id % 5 <> 0,
  'parents', array(lang),
  'shortcutDetails', CASE WHEN doc_id % 19 = 0 THEN named_struct('targetId', concat('d', doc_id - 1)) END)) AS json
FROM {documents}
"""


@query("normalise_drive", """
SELECT CAST(doc_id % 2 AS BIGINT) AS library_id, source AS location_id, concat('d', doc_id) AS remote_ref, lang AS parent_ref, kind,
       CASE WHEN kind = 'shortcut' THEN concat('d', doc_id - 1) END AS shortcut_target_ref,
       CASE WHEN kind = 'byte' THEN n_chars END AS size, CASE WHEN kind = 'byte' THEN md5(text) END AS md5
FROM (SELECT *, CASE WHEN doc_id % 19 = 0 THEN 'shortcut' WHEN doc_id % 11 = 0 THEN 'native' WHEN doc_id % 13 = 0 THEN 'directory'
                     ELSE 'byte' END AS kind FROM documents)
WHERE doc_id % 17 <> 0 AND doc_id % 5 <> 0 AND kind <> 'native'
""")
def _(t):
    return listings.normalise_drive(t.sql(DRIVE_JSON)).select(
        "library_id", "location_id", "remote_ref", "parent_ref", "kind", "shortcut_target_ref", "size", "md5")


@query("drive_bindings", """
SELECT CAST(doc_id % 2 AS BIGINT) AS library_id, source AS provider_id, concat('d', doc_id) AS remote_ref, 'md5' AS algo,
       md5(text) AS hex, n_chars AS size
FROM documents WHERE doc_id % 17 <> 0 AND doc_id % 5 <> 0 AND doc_id % 19 <> 0 AND doc_id % 11 <> 0 AND doc_id % 13 <> 0
""")
def _(t):
    return listings.drive_bindings(listings.normalise_drive(t.sql(DRIVE_JSON)))


GRAPH_JSON = """
SELECT CAST(doc_id % 2 AS BIGINT) AS library_id, source AS location_id, to_json(named_struct(
  'id', concat('g', doc_id), 'name', concat('Clip-', doc_id, CASE WHEN doc_id % 23 = 0 THEN '.URL' ELSE '.txt' END),
  'size', n_chars,
  'remoteItem', CASE WHEN doc_id % 7 = 0 THEN named_struct('id', 'x') END,
  'deleted', CASE WHEN doc_id % 29 = 0 THEN named_struct('state', 'deleted') END,
  'parentReference', named_struct('id', lang, 'path', '/drive/root:'),
  'file', named_struct('mimeType', 'text/plain', 'hashes', named_struct(
     'sha1Hash', CASE WHEN doc_id % 3 <> 0 THEN upper(sha1(text)) END, 'sha256Hash', CASE WHEN doc_id % 4 <> 0 THEN sha2(text, 256) END,
     'quickXorHash', CASE WHEN doc_id % 5 = 0 THEN concat('Q', doc_id) END)))) AS json
FROM {documents}
"""


@query("normalise_graph", """
SELECT CAST(doc_id % 2 AS BIGINT) AS library_id, source AS location_id, concat('g', doc_id) AS remote_ref, lang AS parent_ref,
       CASE WHEN doc_id % 23 = 0 THEN 'shortcut' ELSE 'byte' END AS kind,
       CASE WHEN doc_id % 23 <> 0 THEN n_chars END AS size, doc_id % 29 = 0 AS is_deleted
FROM documents WHERE doc_id % 7 <> 0
""")
def _(t):
    return listings.normalise_graph(t.sql(GRAPH_JSON)).select(
        "library_id", "location_id", "remote_ref", "parent_ref", "kind", "size", "is_deleted")


@query("graph_bindings", """
SELECT CAST(doc_id % 2 AS BIGINT) AS library_id, source AS provider_id, concat('g', doc_id) AS remote_ref, algo, hex, n_chars AS size
FROM (SELECT *, 'sha1' AS algo, sha1(text) AS hex FROM documents WHERE doc_id % 3 <> 0
      UNION ALL SELECT *, 'sha256', sha256(text) FROM documents WHERE doc_id % 4 <> 0
      UNION ALL SELECT *, 'quickxor', concat('Q', doc_id) FROM documents WHERE doc_id % 5 = 0)
WHERE doc_id % 7 <> 0 AND doc_id % 29 <> 0 AND doc_id % 23 <> 0
""")
def _(t):
    return listings.graph_bindings(listings.normalise_graph(t.sql(GRAPH_JSON)))


@query("exclude_roots", """
SELECT f.library_id, f.file_id, f.path FROM v_files f WHERE NOT EXISTS (
  SELECT 1 FROM v_roots r WHERE r.library_id = f.library_id
    AND (lower(f.path) = rtrim(lower(r.path), '/') OR starts_with(lower(f.path), concat(rtrim(lower(r.path), '/'), '/'))))
""")
def _(t):
    return inventory.exclude_roots(t.stored("v_files"), t("v_roots")).select("library_id", "file_id", "path")


@query("classify_root", """
SELECT c.library_id, c.root, CASE
  WHEN EXISTS (SELECT 1 FROM v_overlays o WHERE o.library_id = c.library_id
    AND (lower(c.root) = lower(o.path) OR starts_with(lower(c.root), concat(lower(o.path), '/')))) THEN 'refuse'
  WHEN EXISTS (SELECT 1 FROM v_overlays o WHERE o.library_id = c.library_id
    AND starts_with(lower(o.path), concat(lower(c.root), '/'))) THEN 'skip_inner' ELSE 'ok' END AS verdict
FROM v_candidates c
""")
def _(t):
    return inventory.classify_root(t("v_candidates"), t("v_overlays"))


@query("hydration", """
SELECT library_id, file_id, CASE WHEN location_kind = 'cloud' THEN 'cloud_native'
   WHEN (coalesce(attrs, 0) & 4456448) <> 0 OR reparse_tag IN (2415919130, 2415980570) THEN 'placeholder' ELSE 'local_full' END AS hydration
FROM v_files
""")
def _(t):
    return inventory.with_hydration(t("v_files").drop("hydration")).select("library_id", "file_id", "hydration")


@query("apply_delta", """
SELECT library_id, location_id, item_key, size, path FROM (
  SELECT *, row_number() OVER (PARTITION BY library_id, location_id, item_key ORDER BY change_no DESC) AS n FROM (
    SELECT library_id, location_id, item_key, size, path, change_no, is_deleted FROM v_changes
    UNION ALL SELECT library_id, location_id, item_key, size, path, -1, false FROM v_base_items))
WHERE n = 1 AND NOT is_deleted
""")
def _(t):
    return inventory.apply_delta(t("v_base_items"), t("v_changes"))


DIFF_SIDE = """SELECT library_id, path, size, mtime_utc,
  CASE WHEN ntfs_file_id IS NULL THEN concat('@', location_id) ELSE concat('#', volume_serial) END AS space,
  coalesce(ntfs_file_id, path) AS item FROM """


SIDE_RANK = "row_number() OVER (PARTITION BY library_id, space, item ORDER BY md5(path), path)"


@query("diff_snapshots", f"""
WITH p AS ({DIFF_SIDE} v_prev), c AS ({DIFF_SIDE} v_curr),
old_left AS (SELECT *, {SIDE_RANK} AS n FROM p WHERE NOT EXISTS (
  SELECT 1 FROM c WHERE c.library_id = p.library_id AND c.space = p.space AND c.item = p.item AND c.path = p.path)),
new_left AS (SELECT *, {SIDE_RANK} AS n FROM c WHERE NOT EXISTS (
  SELECT 1 FROM p WHERE p.library_id = c.library_id AND p.space = c.space AND p.item = c.item AND p.path = c.path)),
both_sides AS (
  SELECT p.library_id, p.path AS old_path, c.path AS new_path, p.size <> c.size OR p.mtime_utc <> c.mtime_utc AS differs
  FROM p JOIN c ON p.library_id = c.library_id AND p.space = c.space AND p.item = c.item AND p.path = c.path
  UNION ALL
  SELECT coalesce(p.library_id, c.library_id), p.path, c.path, p.size <> c.size OR p.mtime_utc <> c.mtime_utc
  FROM old_left p FULL JOIN new_left c ON p.library_id = c.library_id AND p.space = c.space AND p.item = c.item AND p.n = c.n)
SELECT library_id, coalesce(new_path, old_path) AS path, CASE WHEN old_path <> new_path THEN old_path END AS old_path,
       CASE WHEN old_path IS NULL THEN 'new' WHEN new_path IS NULL THEN 'missing' WHEN old_path <> new_path THEN 'renamed' WHEN differs THEN 'changed' ELSE 'unchanged' END AS change,
       coalesce(differs, false) AS body_changed
FROM both_sides
""")
def _(t):
    return inventory.diff_snapshots(t("v_prev"), t("v_curr"))


@query("scan_summary", """
SELECT s.library_id, s.id AS scan_id, s.provider_id, s.status, coalesce(f.n, 0) AS files_seen,
       date_diff('second', s.started_at, s.finished_at) AS duration_s
FROM v_scans s LEFT JOIN (SELECT library_id, last_scan_id, count(*) AS n FROM v_files GROUP BY 1, 2) f
  ON f.library_id = s.library_id AND f.last_scan_id = s.id
""")
def _(t):
    return inventory.scan_summary(t("v_files"), t("v_scans"))


@query("write_read_catalog", """
SELECT library_id, file_id, CAST(location_id AS VARCHAR) AS location_id, path, kind, size, hydration FROM v_files
""")
def _(t):
    root = new_folder(t.spark, "catalog")
    known = ["library_id", "file_id", "location_id", "path", "name", "kind", "size", "mime", "hydration", "last_scan_id"]
    catalog.write_catalog(t("v_files").select(*known), root, "files")
    return catalog.read_catalog(t.spark, root, "files").select(
        "library_id", "file_id", "location_id", "path", "kind", "size", "hydration")


@query("files_not_seen", """
SELECT f.library_id, f.file_id, f.last_scan_id, s.latest_full
FROM v_files f JOIN (SELECT library_id, provider_id, max(id) AS latest_full FROM v_scans WHERE status = 'ok' AND is_full GROUP BY 1, 2) s
  ON s.library_id = f.library_id AND s.provider_id = f.provider_id WHERE f.last_scan_id < s.latest_full
""")
def _(t):
    return inventory.files_not_seen(t("v_files"), t("v_scans")).select("library_id", "file_id", "last_scan_id", "latest_full")


@query("mime_lookup", """
SELECT f.library_id, f.file_id, coalesce(f.mime, m.mime) AS mime
FROM v_files f LEFT JOIN v_mime m ON f.hydration = 'local_full' AND lower(m.extension) = split_part(f.path, '.', -1)
""")
def _(t):
    return inventory.mime_lookup(t("v_files"), t("v_mime")).select("library_id", "file_id", "mime")


@query("provider_summary", """
SELECT p.library_id, p.provider_id, p.kind, p.label AS account, s.last_scan_id, s.last_index_s, coalesce(f.n, 0) AS files, p.free_bytes
FROM v_locations p
LEFT JOIN (SELECT library_id, provider_id, max(id) AS last_scan_id, CAST(epoch(arg_max(finished_at, id)) AS BIGINT) AS last_index_s FROM v_scans WHERE status = 'ok' GROUP BY 1, 2) s
  ON s.library_id = p.library_id AND s.provider_id = p.provider_id
LEFT JOIN (SELECT library_id, provider_id, count(*) AS n FROM v_files GROUP BY 1, 2) f
  ON f.library_id = p.library_id AND f.provider_id = p.provider_id
""")
def _(t):
    loc = t("v_locations")
    providers = loc.select("library_id", F.col("provider_id").alias("id"), "kind", F.col("label").alias("account"))
    return inventory.provider_summary(providers, t("v_scans"), t("v_files"), loc).withColumn(
        "last_index_s", F.unix_seconds("last_index_at")).drop("last_index_at")


# --- identity


def contents(t):
    return t("v_contents").withColumn("content_id", content_id(F.col("content"))).drop("content")


CONTENTS = "(SELECT *, concat('sha256:', sha256(content)) AS content_id FROM v_contents)"


@query("multi_digest", """
SELECT file_id, size, concat('sha256:', sha256(content)) AS content_id, md5(content) AS md5, sha1(content) AS sha1, sha256(content) AS sha256
FROM v_contents
""")
def _(t):
    return identity.multi_digest(t("v_contents").select("file_id", "size", "content"), ["md5", "sha1", "sha256"])


@query("digest_large_files")
def _(t):
    listing = files.list_files(t.spark, [t.sf_dir], "*.parquet")
    return files.digest_large_files(listing, ["md5", "sha1"]).select(
        F.substring_index("path", "/", -1).alias("name"), "size", "content_id", "md5", "sha1")


@query("quick_hash", """
SELECT file_id, CAST(octet_length(encode(content)) AS BIGINT) AS size,
       CAST(least(octet_length(encode(content)), 65536) AS BIGINT) AS head_len,
       min(file_id) OVER (PARTITION BY md5(encode(content)[1:65536])) AS same_head_as
FROM v_contents
""")
def _(t):
    probes = identity.quick_hash(t("v_contents").select("file_id", "content"))
    first = probes.groupBy("head").agg(F.min("file_id").alias("same_head_as"))
    return probes.join(first, "head").select("file_id", "size", F.col("head_len").cast("long").alias("head_len"), "same_head_as")


@query("prefilter_candidates", """
SELECT file_id, size FROM (SELECT file_id, octet_length(encode(content)) AS size,
  count(*) OVER (PARTITION BY octet_length(encode(content)), md5(encode(content)[1:65536])) AS n FROM v_contents) WHERE n > 1
""")
def _(t):
    return identity.prefilter_candidates(identity.quick_hash(t("v_contents").select("file_id", "content"))).select("file_id", "size")


@query("validate_content_id", """
SELECT file_id, CASE WHEN regexp_full_match(content_id, '(b3|sha256):[0-9a-fA-F]{64}') THEN lower(content_id) END AS content_id,
       regexp_full_match(content_id, '(b3|sha256):[0-9a-fA-F]{64}') AS is_valid
FROM v_raw_ids
""")
def _(t):
    return identity.validate_content_id(t("v_raw_ids"))


@query("dirty_files", f"""
WITH p AS ({DIFF_SIDE} (SELECT * FROM v_prev WHERE blob_id % 5 <> 1 OR blob_id % 2 = 0)),
c AS ({DIFF_SIDE.replace("SELECT library_id,", "SELECT library_id, file_id, hydration,")} v_curr)
SELECT c.library_id, c.file_id FROM c
WHERE c.hydration = 'local_full' AND NOT EXISTS (
  SELECT 1 FROM p WHERE p.library_id = c.library_id AND p.space = c.space AND p.item = c.item AND p.size = c.size AND p.mtime_utc = c.mtime_utc)
""")
def _(t):
    known = t("v_prev").withColumn("content_id", F.when((F.col("blob_id") % 5 != 1) | (F.col("blob_id") % 2 == 0), F.concat(F.lit("b3:"), "path")))
    return identity.dirty_files(t("v_curr"), known).select("library_id", "file_id")


def bound_files(t):
    rows = t("v_bindings").withColumn("file_id", F.substring("remote_ref", 2, 20).cast("long"))
    return rows.withColumn("kind", F.when(F.col("file_id") % 9 == 0, "shortcut").otherwise("byte"))


ATTACHED = """(SELECT f.library_id, f.remote_ref, min(b.blob_id) AS blob_id FROM v_bindings f
  JOIN (SELECT * FROM v_bindings WHERE blob_id IS NOT NULL) b
    ON b.library_id = f.library_id AND b.provider_id = f.provider_id AND b.algo = f.algo AND b.hex = f.hex AND b.size = f.size
  GROUP BY f.library_id, f.remote_ref)"""


@query("attach_bindings", f"""
SELECT library_id, CAST(substr(remote_ref, 2) AS BIGINT) AS file_id, blob_id, 'suspect' AS state FROM {ATTACHED}
""")
def _(t):
    return identity.attach_bindings(bound_files(t), t("v_bindings"))


@query("assign_proto_blobs", f"""
SELECT library_id, file_id AS blob_id, file_id, CAST(NULL AS VARCHAR) AS content_id, size, 'suspect' AS state
FROM (SELECT *, CAST(substr(remote_ref, 2) AS BIGINT) AS file_id FROM v_bindings)
WHERE file_id % 9 <> 0 AND remote_ref NOT IN (SELECT remote_ref FROM {ATTACHED})
""")
def _(t):
    rows = bound_files(t)
    return identity.assign_proto_blobs(rows, identity.attach_bindings(rows, t("v_bindings")))


@query("promote_verified", """
WITH r AS (SELECT 0 AS library_id, doc_id AS file_id, doc_id - doc_id % 2 AS blob_id,
                  CASE WHEN doc_id % 3 <> 0 THEN concat('sha256:', sha256(text)) END AS cid FROM documents),
b AS (SELECT blob_id, min(cid) AS lo, max(cid) AS hi FROM r WHERE cid IS NOT NULL GROUP BY blob_id),
c AS (SELECT lo, min(blob_id) AS canonical FROM b WHERE lo = hi GROUP BY lo)
SELECT CAST(r.library_id AS BIGINT) AS library_id, r.file_id, coalesce(c.canonical, r.blob_id) AS blob_id,
       coalesce(CASE WHEN b.lo = b.hi THEN b.lo END, r.cid) AS content_id,
       CASE WHEN r.cid IS NOT NULL AND b.lo = b.hi THEN 'verified' ELSE 'suspect' END AS state,
       coalesce(b.lo <> b.hi, false) AS conflict
FROM r LEFT JOIN b ON b.blob_id = r.blob_id LEFT JOIN c ON c.lo = b.lo AND b.lo = b.hi
""")
def _(t):
    rows = contents(t)
    replicas = rows.select("library_id", "file_id", (F.col("file_id") - F.col("file_id") % 2).alias("blob_id"), F.lit("suspect").alias("state"))
    hashed = rows.filter(F.col("file_id") % 3 != 0).select("library_id", "file_id", "content_id")
    return identity.promote_verified(replicas, hashed)


MERGED = """
WITH r AS (SELECT 0 AS library_id, doc_id AS file_id, doc_id - doc_id % 4 AS origin, CASE WHEN doc_id % 4 <> 3 THEN concat('sha256:', sha256(CASE WHEN doc_id % 5 < 3 THEN lang ELSE text END)) END AS cid
           FROM documents),
o AS (SELECT origin, min(cid) AS lo, min(cid) <> max(cid) AS split FROM r WHERE cid IS NOT NULL GROUP BY origin),
c AS (SELECT cid, coalesce(min(CASE WHEN NOT split THEN r.origin END), min(file_id)) AS blob_id FROM r JOIN o ON o.origin = r.origin WHERE cid IS NOT NULL GROUP BY cid)
SELECT CAST(0 AS BIGINT) AS library_id, r.file_id, coalesce(c.blob_id, CASE WHEN o.split THEN r.file_id ELSE r.origin END) AS blob_id,
       CASE WHEN r.cid IS NULL THEN 'suspect' ELSE 'verified' END AS state, coalesce(o.split, false) AS conflict
FROM r LEFT JOIN o ON o.origin = r.origin LEFT JOIN c ON c.cid = coalesce(r.cid, CASE WHEN NOT o.split THEN o.lo END)
"""


@query("merge_run", MERGED)
def _(t):
    digests = contents(t).select("library_id", "file_id").join(t.sql(
        "SELECT doc_id AS file_id, concat('sha256:', sha2(CASE WHEN doc_id % 5 < 3 THEN lang ELSE text END, 256)) AS content_id FROM {documents} WHERE doc_id % 4 <> 3"), "file_id")
    replicas = contents(t).select(
        "library_id", "file_id", (F.col("file_id") - F.col("file_id") % 4).alias("origin"), F.lit(None).cast("string").alias("digest"),
        F.lit(None).cast("long").alias("blob_id"), F.lit("suspect").alias("state"), F.lit(False).alias("conflict"))
    blobs = t.spark.createDataFrame([], "library_id long, content_id string, blob_id long")
    return identity.merge_run(replicas, digests, blobs)[0].drop("origin", "digest")


@query("verify_native", """
WITH e AS (SELECT doc_id AS op_id, 'md5' AS algo, md5(text) AS hex FROM documents
           UNION ALL SELECT doc_id, 'sha1', sha1(text) FROM documents WHERE doc_id % 2 = 0),
g AS (SELECT doc_id AS op_id, 'md5' AS algo, CASE WHEN doc_id % 7 = 0 THEN md5(lang) ELSE upper(md5(text)) END AS hex FROM documents WHERE doc_id % 5 <> 0
      UNION ALL SELECT doc_id, 'sha256', sha256(text) FROM documents
      UNION ALL SELECT doc_id, 'sha1', CASE WHEN doc_id % 11 = 0 THEN sha1(lang) ELSE sha1(text) END FROM documents WHERE doc_id % 3 = 0)
SELECT e.op_id, count(g.hex) AS shared, CASE WHEN count(g.hex) = 0 THEN 'native_hash_missing'
   WHEN bool_and(lower(g.hex) = e.hex) THEN 'match' ELSE 'mismatch' END AS verdict
FROM e LEFT JOIN g ON g.op_id = e.op_id AND g.algo = e.algo GROUP BY e.op_id
""")
def _(t):
    expected = t.sql("""SELECT doc_id AS op_id, 'md5' AS algo, md5(text) AS hex FROM {documents}
                        UNION ALL SELECT doc_id, 'sha1', sha1(text) FROM {documents} WHERE doc_id % 2 = 0""")
    returned = t.sql("""
        SELECT doc_id AS op_id, 'md5' AS algo, CASE WHEN doc_id % 7 = 0 THEN md5(lang) ELSE upper(md5(text)) END AS hex
        FROM {documents} WHERE doc_id % 5 <> 0
        UNION ALL SELECT doc_id, 'sha256', sha2(text, 256) FROM {documents}
        UNION ALL SELECT doc_id, 'sha1', CASE WHEN doc_id % 11 = 0 THEN sha1(lang) ELSE sha1(text) END FROM {documents} WHERE doc_id % 3 = 0""")
    return identity.verify_native(expected, returned)


@query("recheck_binding", """
SELECT b.library_id, b.remote_ref, CASE WHEN c.doc_id IS NULL THEN 'gone' WHEN c.hex = b.hex AND c.size = b.size THEN 'bound' ELSE 'changed' END AS binding
FROM v_bindings b LEFT JOIN (SELECT doc_id, concat('d', doc_id) AS remote_ref, source,
  CASE WHEN doc_id % 7 = 0 THEN md5(lang) ELSE md5(text) END AS hex, n_chars + CASE WHEN doc_id % 10 = 1 THEN 1 ELSE 0 END AS size
  FROM documents WHERE doc_id % 13 <> 0) c ON c.remote_ref = b.remote_ref AND c.source = b.provider_id
""")
def _(t):
    current = t.sql("""
        SELECT CAST(0 AS BIGINT) AS library_id, source AS provider_id, concat('d', doc_id) AS remote_ref, 'md5' AS algo,
               CASE WHEN doc_id % 7 = 0 THEN md5(lang) ELSE upper(md5(text)) END AS hex,
               n_chars + CASE WHEN doc_id % 10 = 1 THEN 1 ELSE 0 END AS size
        FROM {documents} WHERE doc_id % 13 <> 0""")
    return identity.recheck_binding(t("v_bindings"), current).select("library_id", "remote_ref", "binding")


@query("collision_audit", """
SELECT library_id, content_id, count(DISTINCT size) AS sizes, min(size) AS min_size, max(size) AS max_size, count(*) AS rows
FROM (SELECT library_id, content_id, size + CASE WHEN file_id % 40 = 0 THEN 1 ELSE 0 END AS size FROM """ + CONTENTS + """)
GROUP BY library_id, content_id HAVING count(DISTINCT size) > 1
""")
def _(t):
    tampered = contents(t).withColumn("size", F.col("size") + F.when(F.col("file_id") % 40 == 0, 1).otherwise(0))
    return identity.collision_audit(tampered, ["library_id", "content_id"])


# --- duplicates


@query("confirmed_dups", """
SELECT library_id, content_id, count(*) AS replicas, count(DISTINCT location_id) AS locations, min(file_id) AS first_file_id,
       max(size) AS size, max(size) * (count(*) - 1) AS extra_bytes
FROM """ + CONTENTS + """ GROUP BY library_id, content_id HAVING count(*) > 1
""")
def _(t):
    return dups.confirmed_dups(contents(t))


@query("dup_members", """
SELECT library_id, content_id, file_id, location_id, replicas FROM
 (SELECT *, count(*) OVER (PARTITION BY library_id, content_id) AS replicas FROM """ + CONTENTS + """) WHERE replicas > 1
""")
def _(t):
    return dups.dup_members(contents(t)).select("library_id", "content_id", "file_id", "location_id", "replicas")


@query("suspect_dups", """
SELECT library_id, size, lower(name) AS folded_name, count(*) AS files, min(file_id) AS first_file_id, max(file_id) AS last_file_id
FROM v_contents WHERE kind = 'byte' GROUP BY 1, 2, 3 HAVING count(*) > 1
""")
def _(t):
    return dups.suspect_dups(t("v_contents"))


@query("suspect_members", """
SELECT library_id, file_id, files FROM (SELECT library_id, file_id, count(*) OVER (PARTITION BY library_id, size, lower(name)) AS files
FROM v_files WHERE kind = 'byte' AND size IS NOT NULL) WHERE files > 1
""")
def _(t):
    return dups.suspect_members(t("v_files")).select("library_id", "file_id", "files")


@query("cross_location_dups", """
SELECT library_id, content_id, count(*) AS replicas, count(DISTINCT location_id) AS locations, max(size) * (count(*) - 1) AS extra_bytes
FROM """ + CONTENTS + """ GROUP BY library_id, content_id HAVING count(*) > 1 AND count(DISTINCT location_id) > 1
""")
def _(t):
    return dups.cross_location_dups(contents(t)).select("library_id", "content_id", "replicas", "locations", "extra_bytes")


GOOD = "state = 'verified' AND hydration <> 'placeholder' AND is_online"


@query("extra_local", f"""
WITH g AS (SELECT * FROM v_files WHERE {GOOD}),
c AS (SELECT library_id, blob_id, count(*) AS verified, count(*) FILTER (WHERE location_kind = 'volume') AS local_verified
      FROM g GROUP BY 1, 2),
r AS (SELECT g.*, c.verified, c.local_verified, row_number() OVER (PARTITION BY g.library_id, g.blob_id ORDER BY g.file_id DESC) AS evict_no
      FROM g JOIN c ON c.library_id = g.library_id AND c.blob_id = g.blob_id WHERE g.location_kind = 'volume' AND NOT g.pinned)
SELECT library_id, blob_id, file_id, location_id, size, verified, evict_no FROM r
WHERE verified - evict_no >= 1 AND local_verified - evict_no >= 1
""")
def _(t):
    return dups.extra_local(t.stored("v_files"))


@query("consolidate", f"""
WITH d AS (SELECT library_id, min(location_id) AS dest FROM v_locations WHERE kind = 'volume' AND is_online GROUP BY library_id),
f AS (SELECT v.*, d.dest FROM v_files v JOIN d ON d.library_id = v.library_id),
h AS (SELECT DISTINCT library_id, blob_id FROM f WHERE location_id = dest AND {GOOD})
SELECT library_id, blob_id, CAST(NULL AS BIGINT) AS file_id, dest AS location_id, max(size) AS size, 'place' AS action FROM f
WHERE size IS NOT NULL AND hydration <> 'placeholder' AND is_online AND (library_id, blob_id) NOT IN (SELECT (library_id, blob_id) FROM h)
GROUP BY library_id, blob_id, dest
UNION ALL
SELECT library_id, blob_id, file_id, location_id, size, CASE WHEN location_kind = 'volume' THEN 'evict_candidate' ELSE 'report_cloud' END
FROM f WHERE {GOOD} AND location_id <> dest AND (library_id, blob_id) IN (SELECT (library_id, blob_id) FROM h)
  AND NOT (pinned AND location_kind = 'volume')
""")
def _(t):
    volumes = t("v_locations").filter("kind = 'volume' AND is_online").groupBy("library_id").agg(F.min("location_id").alias("dest"))
    return dups.consolidate(t.stored("v_files"), volumes)


@query("search", """
SELECT library_id, file_id FROM v_files WHERE contains(lower(path), 'captures/f1') OR coalesce(contains(lower(mime), 'captures/f1'), false)
  OR contains(lower(CASE WHEN blob_id % 10 = 0 THEN 'Old CAPTURES/F1' ELSE 'none' END), 'captures/f1')
""")
def _(t):
    tags = t("v_files").select("library_id", "file_id", F.when(F.col("blob_id") % 10 == 0, "Old CAPTURES/F1").otherwise("none").alias("collection"))
    return dups.search(t("v_files"), "Captures/F1", tags).select("library_id", "file_id")


@query("list_collection", """
SELECT f.library_id, f.file_id, f.path, f.size, f.hydration, concat('b3:', CAST(f.blob_id AS VARCHAR)) AS content_id, h.providers
FROM v_files f JOIN (SELECT library_id, blob_id, count(DISTINCT provider_id) AS providers FROM v_files GROUP BY 1, 2) h
  ON h.library_id = f.library_id AND h.blob_id = f.blob_id WHERE starts_with(f.path, '/Videos/')
""")
def _(t):
    rows = t("v_files").withColumn("content_id", F.concat(F.lit("b3:"), F.col("blob_id").cast("string")))
    cache = rows.select("library_id", "file_id", F.when(F.col("path").startswith("/Videos/"), "Gaming Clips").otherwise("x").alias("collection"))
    held = rows.select("library_id", "file_id", "blob_id", "content_id", "provider_id")
    return dups.list_collection(rows.drop("blob_id", "content_id", "provider_id"), cache, held, "Gaming Clips")


@query("replica_health", f"""
SELECT library_id, blob_id, count(*) FILTER (WHERE {GOOD}) AS verified,
       count(*) FILTER (WHERE state = 'suspect' AND hydration <> 'placeholder') AS suspect,
       count(*) FILTER (WHERE hydration = 'placeholder') AS placeholder, count(*) FILTER (WHERE NOT is_online) AS offline,
       count(*) FILTER (WHERE {GOOD}) = 0 AS at_risk
FROM v_files GROUP BY library_id, blob_id
""")
def _(t):
    return dups.replica_health(t("v_files"))
