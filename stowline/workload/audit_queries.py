"""Queries of journal, access, path, catalog, log and metric audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from stowline.operators import acl, capacity, doctor, inventory, journal, observability
from stowline.plans.simulate import PLAN
from stowline.sources.logs import parse_log_lines
from stowline.workload.plan_queries import residuals
from stowline.workload.policy_queries import RESERVE, classified
from stowline.workload.registry import query

# --- journal

LATEST = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY library_id, op_id ORDER BY updated_at DESC, event_id DESC) AS n FROM v_journal) WHERE n = 1)"""


@query("latest_state", f"SELECT library_id, op_id, event_id, plan_id, state, stored_offset FROM {LATEST}")
def _(t):
    return journal.latest_state(t("v_journal")).drop("updated_at")


USED_STATES = ("ReservedSpace", "Transferring", "Verifying", "Committed", "NeedsAttention")


@query("journal_status", f"""
SELECT library_id, plan_id, {', '.join(f"count(*) FILTER (WHERE state = '{s}') AS {s}" for s in USED_STATES)},
       count(*) FILTER (WHERE state IN ('ReservedSpace', 'Transferring', 'Verifying')) AS in_flight
FROM {LATEST} GROUP BY library_id, plan_id
""")
def _(t):
    return journal.journal_status(t("v_journal")).select("library_id", "plan_id", *USED_STATES, "in_flight")


AUDIT = """
WITH s AS (SELECT library_id, op_id, event_id, coalesce(lag(state) OVER (PARTITION BY library_id, op_id ORDER BY updated_at, event_id), 'NotStarted') AS from_state, state AS to_state FROM v_journal)
SELECT library_id, op_id, event_id, from_state, to_state FROM s
WHERE from_state <> to_state AND concat(from_state, '>', to_state) NOT IN ('NotStarted>ReservedSpace', 'ReservedSpace>Transferring', 'Transferring>Verifying', 'Verifying>Transferring')
  AND NOT (to_state = 'NeedsAttention' AND from_state NOT IN ('Committed', 'NeedsAttention'))
"""


@query("transition_audit", AUDIT)
def _(t):
    return journal.transition_audit(t("v_journal"))


@query("needs_attention", f"SELECT library_id, op_id, event_id, plan_id FROM {LATEST} WHERE state = 'NeedsAttention'")
def _(t):
    return journal.needs_attention(t("v_journal")).select("library_id", "op_id", "event_id", "plan_id")


@query("resume_actions", """
SELECT j.op_id, j.state, CASE WHEN state = 'Committed' THEN 'none' WHEN state = 'NeedsAttention' THEN 'stop'
  WHEN state = 'ReservedSpace' AND NOT there THEN 'release_and_retry'
  WHEN state = 'Transferring' AND stored_offset > 0 THEN 'continue_transfer' WHEN state = 'Transferring' THEN 'restart_transfer'
  WHEN state = 'Verifying' AND dest_kind = 'volume' THEN 'rehash' WHEN state = 'Verifying' AND bound THEN 'continue'
  WHEN state = 'Verifying' AND we_created THEN 'delete_and_restart' WHEN state = 'Verifying' THEN 'stop'
  WHEN state IN ('AssertedPrivate', 'Compensating') AND we_created AND there THEN 'delete_dest' WHEN state = 'Compensating' THEN 'roll_back'
  WHEN state = 'DeletingSource' AND there AND bound THEN 'finish_delete' WHEN state = 'DeletingSource' THEN 'stop' ELSE 'continue' END AS action
FROM (SELECT s.*, coalesce(x.dest_exists, false) AS there, coalesce(x.binding_ok, false) AS bound FROM v_op_states s LEFT JOIN v_op_stats x ON x.op_id = s.op_id) j
""")
def _(t):
    rows = t("v_op_states").withColumnRenamed("stored_offset", "offset")
    return journal.resume_actions(rows, t("v_op_stats")).select("op_id", "state", "action")


SLACK = 64 << 20


@query("space_drift", f"""
SELECT library_id, plan_id, seq, location_id, held, reason FROM (
  SELECT r.*, CASE WHEN kind IN ('download', 'shuttle') THEN size ELSE 0 END AS held,
         CASE WHEN s.live + {SLACK} < r.residual_before THEN 'start_free_below_sim'
              WHEN s.live - CASE WHEN kind IN ('download', 'shuttle') THEN size ELSE 0 END < {RESERVE} THEN 'trough_would_breach_reserve' END AS reason
  FROM o_residuals r JOIN (SELECT library_id, location_id, free_bytes - (location_id % 4) * 40000000 AS live FROM v_locations) s
    ON s.library_id = r.library_id AND s.location_id = r.location_id WHERE r.location_kind = 'volume') WHERE reason IS NOT NULL
""")
def _(t):
    live = t("v_locations").withColumn("live_free", F.col("free_bytes") - (F.col("location_id") % 4) * 40000000)
    return journal.space_drift(residuals(t), live, SLACK, RESERVE).select("library_id", "plan_id", "seq", "location_id", "held", "reason")


REVERSED = """(SELECT library_id, plan_id, row_number() OVER (PARTITION BY library_id, plan_id ORDER BY seq DESC) AS undo_seq, op_id, blob_id, size,
    CASE WHEN kind = 'evict' THEN 'download' ELSE 'delete' END AS undo_kind, CASE WHEN kind = 'evict' THEN src ELSE dest END AS undo_location
  FROM (SELECT o.*, s.we_created FROM v_plan_ops o JOIN v_op_states s ON s.op_id = o.op_id WHERE s.state = 'Committed' AND (o.kind = 'evict' OR s.we_created)))"""


def reverse(t):
    return journal.reverse_plan(t("v_plan_ops"), t("v_op_states"))


@query("reverse_plan", f"SELECT * FROM {REVERSED}")
def _(t):
    return reverse(t)


@query("undo_refusals", f"""
WITH r AS (SELECT * FROM {REVERSED}),
c AS (SELECT r.*, coalesce(k.verified, 0) AS v, coalesce(k.verified, 0) + sum(CASE WHEN undo_kind = 'delete' THEN -1 ELSE 1 END) OVER (PARTITION BY r.library_id, r.plan_id, r.blob_id ORDER BY undo_seq) AS l
  FROM r LEFT JOIN (SELECT library_id, blob_id, count(*) AS verified FROM v_files WHERE state = 'verified' AND hydration <> 'placeholder' AND is_online GROUP BY 1, 2) k
    ON k.library_id = r.library_id AND k.blob_id = r.blob_id),
b AS (SELECT library_id, plan_id, blob_id FROM c GROUP BY 1, 2, 3 HAVING bool_or(l >= 1 OR v > 0) AND min(l) < 1),
s AS (SELECT r.library_id, r.plan_id, p.free_bytes + sum(CASE WHEN undo_kind = 'delete' THEN size ELSE -size END) OVER (PARTITION BY r.library_id, r.plan_id, undo_location ORDER BY undo_seq) AS left_free
  FROM r JOIN v_locations p ON p.library_id = r.library_id AND p.location_id = r.undo_location AND p.kind = 'volume')
SELECT library_id, plan_id, count(*) AS n, 'last_copy' AS reason FROM b GROUP BY 1, 2
UNION ALL SELECT library_id, plan_id, count(*), 'reserve_breach' FROM s WHERE left_free < {2 * RESERVE} GROUP BY 1, 2
""")
def _(t):
    return journal.undo_refusals(reverse(t), t("v_files"), t("v_locations"), 2 * RESERVE)


@query("do_not_eject", """
SELECT l.library_id, l.location_id, x.busy_ops FROM v_locations l JOIN (
  SELECT library_id, location_id, count(*) AS busy_ops FROM (
    SELECT DISTINCT o.library_id, o.op_id, u.location_id FROM (SELECT library_id, op_id, src AS location_id FROM v_plan_ops
       UNION ALL SELECT library_id, op_id, dest FROM v_plan_ops UNION ALL SELECT library_id, op_id, staging FROM v_plan_ops) u
    JOIN v_plan_ops o ON o.op_id = u.op_id JOIN v_op_states s ON s.op_id = o.op_id
    WHERE s.state IN ('Transferring', 'Verifying') AND u.location_id IS NOT NULL) GROUP BY 1, 2) x
ON x.library_id = l.library_id AND x.location_id = l.location_id WHERE l.removable
""")
def _(t):
    return journal.do_not_eject(t("v_op_states"), t("v_plan_ops"), t("v_locations"))


@query("compensation_list", """
SELECT op_id, CASE WHEN delete_failed THEN 'needs_attention' WHEN we_created THEN 'delete_item' ELSE 'leave_in_place' END AS action
FROM v_op_states WHERE verify_failed OR op_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH')
""")
def _(t):
    public = t.sql("SELECT o_orderkey AS op_id FROM {orders} WHERE o_orderpriority = '2-HIGH'")
    return journal.compensation_list(t("v_op_states"), public).select("op_id", "action")


# --- access and paths

@query("ancestors", """
SELECT CAST(0 AS BIGINT) AS library_id, ref, parent_ref AS ancestor, CAST(1 AS BIGINT) AS distance FROM v_folder_tree WHERE parent_ref IS NOT NULL
UNION ALL SELECT CAST(0 AS BIGINT), c.ref, n.parent_ref, CAST(2 AS BIGINT) FROM v_folder_tree c JOIN v_folder_tree n ON n.ref = c.parent_ref WHERE n.parent_ref IS NOT NULL
""")
def _(t):
    return acl.ancestors(t("v_folder_tree")).withColumn("distance", F.col("distance").cast("long"))


PUBLIC = "('Anyone', 'AnyoneWithLink', 'anonymous')"
FOLDER_STATE = f"""(SELECT f.ref, f.public_at, CASE WHEN f.public_at IS NULL THEN f.lost END AS unresolved_at FROM (
  SELECT f.ref, CASE WHEN f.principal IN {PUBLIC} THEN f.ref WHEN p.principal IN {PUBLIC} THEN p.ref WHEN g.principal IN {PUBLIC} THEN g.ref END AS public_at,
         CASE WHEN f.principal = 'Unknown' THEN f.ref WHEN f.parent_ref IS NOT NULL AND p.ref IS NULL THEN f.parent_ref WHEN p.principal = 'Unknown' THEN p.ref
              WHEN p.parent_ref IS NOT NULL AND g.ref IS NULL THEN p.parent_ref WHEN g.principal = 'Unknown' THEN g.ref END AS lost
  FROM v_folders f LEFT JOIN v_folders p ON p.ref = f.parent_ref LEFT JOIN v_folders g ON g.ref = p.parent_ref) f)"""
ITEM_STATE = f"""(SELECT *, CASE WHEN public_at IS NOT NULL THEN 'public' WHEN lost IS NOT NULL THEN 'unresolved' ELSE 'private' END AS exposure,
       CASE WHEN public_at IS NULL THEN lost END AS unresolved_at FROM (
  SELECT i.library_id, i.ref, CASE WHEN i.principal IN {PUBLIC} THEN i.ref ELSE p.public_at END AS public_at,
         CASE WHEN i.principal = 'Unknown' THEN i.ref WHEN p.ref IS NULL THEN i.parent_ref ELSE p.unresolved_at END AS lost
  FROM v_items i LEFT JOIN {FOLDER_STATE} p ON p.ref = i.parent_ref))"""


@query("public_items", f"SELECT library_id, ref, exposure, public_at, unresolved_at FROM {ITEM_STATE} WHERE exposure <> 'private'")
def _(t):
    return acl.public_items(t("v_items"), t("v_folders"), t("v_acl")).select("library_id", "ref", "exposure", "public_at", "unresolved_at")


@query("refused_destinations", f"""
SELECT o.op_id, concat('c', o.cust) AS dest_parent, CASE WHEN p.public_at IS NULL THEN 'unresolved' ELSE 'public' END AS exposure, p.public_at,
       CASE WHEN p.ref IS NULL THEN concat('c', o.cust) ELSE p.unresolved_at END AS unresolved_at
FROM (SELECT op_id, CAST(substr(plan_id, 2) AS BIGINT) AS cust FROM v_plan_ops WHERE kind IN ('upload_keep', 'upload_evict', 'shuttle')) o
LEFT JOIN {FOLDER_STATE} p ON p.ref = concat('c', o.cust) WHERE p.ref IS NULL OR p.public_at IS NOT NULL OR p.unresolved_at IS NOT NULL
""")
def _(t):
    ops = t("v_plan_ops").filter("kind IN ('upload_keep', 'upload_evict', 'shuttle')").select(
        F.lit(0).cast("long").alias("library_id"), "op_id", F.concat(F.lit("c"), F.substring("plan_id", 2, 20)).alias("dest_parent"))
    return acl.refused_destinations(ops, t("v_folders"), t("v_acl")).select("op_id", "dest_parent", "exposure", "public_at", "unresolved_at")


@query("upload_acl_recheck", f"""
WITH l AS (SELECT arg_max(plan_id, (created, plan_id)) AS plan_id FROM (SELECT plan_id, o_orderdate AS created FROM v_plan_ops JOIN orders ON o_orderkey = op_id))
SELECT o.op_id, i.exposure, i.public_at, i.unresolved_at
FROM v_plan_ops o JOIN l ON l.plan_id = o.plan_id JOIN {ITEM_STATE} i ON i.ref = concat('o', o.op_id)
WHERE o.kind IN ('upload_keep', 'upload_evict', 'shuttle') AND i.exposure <> 'private'
""")
def _(t):
    dates = t.sql("SELECT o_orderkey AS op_id, o_orderdate AS created_at FROM {orders}")
    ops = t("v_plan_ops").join(dates, "op_id").withColumn("library_id", F.lit(0).cast("long")).withColumn(
        "dest_ref", F.concat(F.lit("o"), F.col("op_id").cast("string")))
    return acl.upload_acl_recheck(ops, t("v_items"), t("v_folders"), t("v_acl")).select("op_id", "exposure", "public_at", "unresolved_at")


@query("path_escapes", """
SELECT page_id, CASE page_id % 8 WHEN 1 THEN 'parent component' WHEN 6 THEN 'parent component' WHEN 2 THEN 'colon in component'
   WHEN 0 THEN 'colon in component' WHEN 3 THEN 'outside root' WHEN 4 THEN 'drive prefix' END AS reason
FROM pages WHERE page_id % 8 NOT IN (5, 7)
""")
def _(t):
    return acl.path_escapes(t("v_paths")).select("page_id", "reason")


# --- catalog audits


@query("orphans", """
SELECT f.library_id, CAST(f.last_scan_id AS VARCHAR) AS missing_key, count(*) AS rows FROM v_files f
WHERE NOT EXISTS (SELECT 1 FROM v_scans s WHERE s.library_id = f.library_id AND s.id = f.last_scan_id AND s.status = 'ok') GROUP BY 1, 2
""")
def _(t):
    return doctor.orphans(t("v_files"), "last_scan_id", t("v_scans").filter("status = 'ok'"), "id")


def audit_tables(t):
    files = t("v_files").withColumn("hydration", F.when(F.col("blob_id") % 41 == 0, "melted").otherwise(F.col("hydration"))).withColumn(
        "path", F.when(F.col("blob_id") % 43 == 0, "/same").otherwise(F.col("path")))
    replicas = files.select("library_id", "file_id", (F.col("blob_id") + F.when(F.col("blob_id") % 47 == 0, 10_000_000).otherwise(0)).alias("blob_id"),
                            F.when(F.col("blob_id") % 53 == 0, "odd").otherwise(F.col("state")).alias("state"))
    return {"files": files, "replicas": replicas, "locations": t("v_locations"), "scans": t("v_scans"),
            "blobs": files.select("library_id", "blob_id").distinct()}


@query("unique_and_enum_audit", """
SELECT 'unique:locations' AS check, 0::BIGINT AS violations UNION ALL
SELECT 'unique:files', (SELECT count(*) FROM (SELECT 1 FROM v_files WHERE blob_id % 43 = 0 GROUP BY library_id, location_id HAVING count(*) > 1)) UNION ALL
SELECT 'unique:replicas', 0 UNION ALL
SELECT 'enum:files.kind', 0 UNION ALL SELECT 'enum:files.hydration', (SELECT count(*) FROM v_files WHERE blob_id % 41 = 0) UNION ALL
SELECT 'enum:replicas.state', (SELECT count(*) FROM v_files WHERE blob_id % 53 = 0) UNION ALL SELECT 'enum:locations.kind', 0 UNION ALL
SELECT 'enum:scans.status', 0 UNION ALL SELECT 'replica_of_non_file', (SELECT count(*) FROM v_files WHERE kind <> 'byte')
""")
def _(t):
    return doctor.unique_and_enum_audit(audit_tables(t)).select("check", "violations")


@query("foreign_key_audit", """
SELECT 'orphan:files.location_id' AS check, 0::BIGINT AS violations UNION ALL SELECT 'orphan:files.last_scan_id', 0 UNION ALL
SELECT 'orphan:replicas.blob_id', (SELECT count(*) FROM v_files WHERE blob_id % 47 = 0) UNION ALL SELECT 'orphan:replicas.file_id', 0
""")
def _(t):
    return doctor.foreign_key_audit(audit_tables(t)).select("check", "violations")


@query("root_is_overlay", """
SELECT c.library_id, c.root FROM v_candidates c WHERE EXISTS (SELECT 1 FROM v_overlays o WHERE o.library_id = c.library_id
    AND (lower(c.root) = lower(o.path) OR starts_with(lower(c.root), concat(lower(o.path), '/'))))
""")
def _(t):
    return doctor.root_is_overlay(t("v_candidates"), t("v_overlays")).select("library_id", "root")


HOSTS = "SELECT c_custkey AS host, c_mktsegment <> 'FURNITURE' AS sync_client FROM {customer}"


@query("overlay_missing", """
SELECT c_custkey AS host FROM customer WHERE c_mktsegment <> 'FURNITURE' AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
""")
def _(t):
    found = t.sql("SELECT o_custkey AS host FROM {orders} WHERE o_orderpriority = '1-URGENT'")
    return doctor.overlay_missing(t.sql(HOSTS), found).select("host")


@query("doctor", f"""
SELECT 'free_below_reserve' AS check, 'error' AS severity, (SELECT count(*) FROM v_locations WHERE kind = 'volume' AND free_bytes < {RESERVE}) AS violations UNION ALL
SELECT 'needs_attention', 'error', (SELECT count(*) FROM {LATEST} WHERE state = 'NeedsAttention') UNION ALL
SELECT 'root_is_overlay', 'error', (SELECT count(*) FROM v_candidates c WHERE EXISTS (SELECT 1 FROM v_overlays o WHERE o.library_id = c.library_id
    AND (lower(c.root) = lower(o.path) OR starts_with(lower(c.root), concat(lower(o.path), '/'))))) UNION ALL
SELECT 'stale_files', 'warning', (SELECT count(*) FROM v_files f JOIN (SELECT library_id, provider_id, max(id) AS m FROM v_scans WHERE status = 'ok' AND is_full GROUP BY 1, 2) s
  ON s.library_id = f.library_id AND s.provider_id = f.provider_id WHERE f.last_scan_id < s.m)
""")
def _(t):
    return doctor.doctor({
        "free_below_reserve": ("error", capacity.reserve_breaches(t("v_locations"), RESERVE)),
        "needs_attention": ("error", journal.needs_attention(t("v_journal"))),
        "root_is_overlay": ("error", doctor.root_is_overlay(t("v_candidates"), t("v_overlays"))),
        "stale_files": ("warning", inventory.files_not_seen(t("v_files"), t("v_scans"))),
    }).select("check", "severity", "violations")


# --- logs and metrics

LOG_JSON = """
SELECT log_id, CASE WHEN log_id % 50 = 7 THEN concat('torn line ', log_id) ELSE to_json(named_struct(
  'ts', concat('2024-01-0', 1 + log_id % 9, 'T00:00:00Z'), 'level', level, 'target', 'app', 'message', msg, 'access_token', access_token,
  'session_uri', session_uri, 'path', target_path, 'plan_id', plan_id)) END AS value
FROM {v_log_fields}
"""


def parsed_logs(t):
    return parse_log_lines(t.sql(LOG_JSON))


@query("read_logs", """
SELECT CASE WHEN torn THEN NULL ELSE level END AS level, CASE WHEN torn THEN NULL ELSE msg END AS msg, CASE WHEN torn THEN NULL ELSE epoch(make_timestamp(2024, 1, 1 + log_id % 9, 0, 0, 0))::BIGINT END AS ts_s,
       CASE WHEN torn THEN NULL ELSE 4::BIGINT END AS free_fields, CASE WHEN torn THEN concat('torn line ', log_id) END AS corrupt_line
FROM (SELECT *, log_id % 50 = 7 AS torn FROM v_log_fields)
""")
def _(t):
    return parsed_logs(t).select("level", "msg", F.unix_seconds("ts").alias("ts_s"),
                                 F.when(F.col("fields").isNotNull(), F.size("fields").cast("long")).alias("free_fields"), "corrupt_line")


@query("redact", """
SELECT CASE WHEN torn THEN NULL ELSE 'sent Authorization: Bearer [REDACTED] to api' END AS msg, CASE WHEN torn THEN NULL ELSE '[REDACTED]' END AS access_token,
       CASE WHEN torn THEN NULL WHEN contains(session_uri, '?') THEN 'https://host/dl?[REDACTED]' ELSE session_uri END AS session_uri,
       CASE WHEN torn THEN NULL ELSE target_path END AS path, CASE WHEN torn THEN '[UNPARSED]' END AS corrupt_line
FROM (SELECT *, log_id % 50 = 7 AS torn FROM v_log_fields)
""")
def _(t):
    return observability.redact(parsed_logs(t)).select(
        "msg", *[F.col("fields")[k].alias(k) for k in ("access_token", "session_uri", "path")], "corrupt_line")


@query("metric_rollup", """
SELECT name, kind, CASE WHEN kind = 'counter' THEN CAST(sum(value) AS BIGINT) ELSE arg_max(value, (ts, value)) END AS value FROM v_metrics GROUP BY name, kind
""")
def _(t):
    return observability.metric_rollup(t("v_metrics"))


@query("prometheus_text", """
WITH r AS (SELECT name, kind, CASE WHEN kind = 'counter' THEN CAST(sum(value) AS BIGINT) ELSE arg_max(value, (ts, value)) END AS value FROM v_metrics GROUP BY name, kind)
SELECT line FROM (SELECT concat('# TYPE stowline_', replace(name, '.', '_'), ' ', kind) AS line FROM r
UNION ALL SELECT concat('stowline_', replace(name, '.', '_'), ' ', CAST(value AS VARCHAR)) FROM r)
""")
def _(t):
    return observability.prometheus_text(observability.metric_rollup(t("v_metrics"))).select("line")


@query("retain_logs", """
SELECT event_id AS log_id, CAST(ts AS DATE) >= (SELECT min(d) FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events ORDER BY d DESC LIMIT 7)) AS kept FROM events
""")
def _(t):
    return observability.retain_logs(t("v_log_fields")).select("log_id", "kept")


@query("standard_metrics", f"""
WITH r AS (SELECT min(residual_during)::DOUBLE AS m, count(DISTINCT (library_id, plan_id, seq))::DOUBLE AS n FROM o_residuals)
SELECT 'index.files_seen' AS name, 'counter' AS kind, (SELECT count(*)::DOUBLE FROM v_files) AS value UNION ALL
SELECT 'index.files_hashed', 'counter', (SELECT count(*)::DOUBLE FROM v_files WHERE state = 'verified') UNION ALL
SELECT 'index.bytes_hashed', 'counter', (SELECT sum(size)::DOUBLE FROM v_files WHERE state = 'verified') UNION ALL
SELECT 'index.hash_mib_s', 'gauge', (SELECT sum(size)::DOUBLE / 1048576 / 8 FROM v_files WHERE state = 'verified') UNION ALL
SELECT 'plan.unsatisfiable', 'counter', (SELECT count(DISTINCT (library_id, plan_id))::DOUBLE FROM o_residuals WHERE location_kind = 'volume' AND residual_during < 0) UNION ALL
SELECT 'plan.ops', 'counter', (SELECT n FROM r) UNION ALL SELECT 'plan.min_residual', 'gauge', (SELECT m FROM r) UNION ALL
SELECT 'apply.bytes_copied', 'counter', (SELECT sum(stored_offset)::DOUBLE FROM v_op_states WHERE state = 'Committed') UNION ALL
SELECT 'apply.ops_committed', 'counter', (SELECT count(*)::DOUBLE FROM v_op_states WHERE state = 'Committed') UNION ALL
SELECT 'apply.verify_failures', 'counter', (SELECT count(*)::DOUBLE FROM v_op_states WHERE verify_failed) UNION ALL
SELECT 'space.free', 'gauge', (SELECT sum(free_bytes)::DOUBLE FROM v_locations) UNION ALL
SELECT 'space.usable', 'gauge', (SELECT sum(greatest(free_bytes - CASE WHEN kind = 'volume' THEN {RESERVE} ELSE 0 END, 0))::DOUBLE FROM v_locations) UNION ALL
SELECT 'space.drift_events', 'counter', (SELECT count(*)::DOUBLE FROM v_locations WHERE NOT is_online)
""")
def _(t):
    files = t("v_files").withColumn("is_hashed", F.col("state") == "verified")
    space = capacity.with_usable(t("v_locations"), RESERVE).withColumn("drifted", ~F.col("is_online"))
    states = t("v_op_states").withColumnRenamed("stored_offset", "size")
    held = residuals(t)
    ops = held.groupBy(*PLAN, "seq").agg(F.min("residual_during").alias("residual_during"))
    short = F.max((F.col("location_kind") == "volume") & (F.col("residual_during") < 0))
    plans = held.groupBy(*PLAN).agg(F.when(short, "unsatisfiable").otherwise("drafted").alias("status"))
    return observability.standard_metrics(files, ops, states, space, plans, 8.0)


@query("catalog_digest", """
SELECT library_id, location_id, collection, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM o_classified GROUP BY ROLLUP (library_id, location_id, collection)
""")
def _(t):
    return observability.catalog_digest(classified(t))


LEAK_TEXTS = """
SELECT log_id, level, 'msg' AS field, CASE WHEN log_id % 4 = 0 THEN concat('moved ', target_path, ', then ', replace(target_path, 'Videos/Captures', 'misc')) WHEN log_id % 4 = 1 THEN concat('D:', target_path) ELSE msg END AS text FROM v_log_fields
UNION ALL SELECT log_id, level, 'path', target_path FROM v_log_fields
UNION ALL SELECT log_id, level, 'session_uri', concat(session_uri, replace(target_path, '.mp4', '')) FROM v_log_fields
"""


@query("path_leak_audit", f"""
SELECT l.log_id, l.level, l.field, f.path FROM ({LEAK_TEXTS}) l JOIN (SELECT DISTINCT path FROM v_files) f ON strpos(l.text, f.path) > 0 WHERE l.level <> 'DEBUG'
""")
def _(t):
    slots = LEAK_TEXTS.replace("v_log_fields", "{v_log_fields}")
    texts = t.sql(slots).groupBy("log_id", "level").agg(
        F.max(F.when(F.col("field") == "msg", F.col("text"))).alias("msg"),
        F.map_from_entries(F.collect_list(F.when(F.col("field") != "msg", F.struct("field", "text")))).alias("fields"))
    return observability.path_leak_audit(texts, t("v_files"))
