"""Queries of capacity and policy."""

from __future__ import annotations

from pyspark.sql import functions as F

from stowline.functions.rules import EXAMPLE_COLLECTIONS, compile_match, example_rules, rules_from_document, with_match_inputs
from stowline.functions.units import MIB, format_bytes
from stowline.operators import capacity, policy
from stowline.session import cut_lineage
from stowline.workload.registry import query

RESERVE = 512 * MIB


@query("latest_capacity", """
SELECT library_id, location_id, id, kind, free_bytes FROM (
  SELECT *, row_number() OVER (PARTITION BY library_id, location_id ORDER BY measured_at DESC, id DESC) AS n FROM v_snapshots) WHERE n = 1
""")
def _(t):
    return capacity.latest_capacity(t("v_snapshots")).select("library_id", "location_id", "id", "kind", "free_bytes")


@query("usable", f"""
SELECT l.library_id, l.location_id, greatest(l.free_bytes - CASE WHEN l.kind = 'volume' THEN {RESERVE} ELSE 0 END - coalesce(f.held, 0), 0)::BIGINT AS usable
FROM v_locations l LEFT JOIN (SELECT library_id, location_id, sum(size) AS held FROM v_files WHERE state = 'suspect' GROUP BY 1, 2) f
  ON f.library_id = l.library_id AND f.location_id = l.location_id
""")
def _(t):
    held = t("v_files").filter("state = 'suspect'").groupBy("library_id", "location_id").agg(F.sum("size").alias("held"))
    joined = t("v_locations").join(held, ["library_id", "location_id"], "left")
    return capacity.with_usable(joined, RESERVE, "held").select("library_id", "location_id", "usable")


@query("capacity_report", f"""
WITH r AS (SELECT l.library_id, l.kind, l.removable, l.location_id, count(*) AS locations, sum(l.free_bytes * 2)::BIGINT AS used_bytes, sum(l.free_bytes)::BIGINT AS free_bytes,
       sum(CASE WHEN l.kind = 'cloud' THEN l.free_bytes * 3 END)::BIGINT AS quota_bytes, sum(CASE WHEN l.kind = 'volume' THEN {RESERVE} ELSE 0 END)::BIGINT AS reserve,
       sum(greatest(l.free_bytes - CASE WHEN l.kind = 'volume' THEN {RESERVE} ELSE 0 END, 0))::BIGINT AS usable,
       sum(coalesce(p.free_after, l.free_bytes))::BIGINT AS projected
FROM v_locations l LEFT JOIN (SELECT library_id, location_id, max(free_bytes) - 1000 AS free_after FROM v_snapshots GROUP BY 1, 2) p
  ON p.library_id = l.library_id AND p.location_id = l.location_id
GROUP BY ROLLUP (l.library_id, l.kind, l.removable, l.location_id))
SELECT *, CASE WHEN free_bytes >= 1073741824 THEN printf('%.2f GiB', free_bytes / 1073741824.0::DOUBLE) WHEN free_bytes >= 1048576 THEN printf('%.2f MiB', free_bytes / 1048576.0::DOUBLE)
  WHEN free_bytes >= 1024 THEN printf('%.2f KiB', free_bytes / 1024.0::DOUBLE) ELSE concat(free_bytes, ' B') END AS free_text FROM r
""")
def _(t):
    after = t("v_snapshots").groupBy("library_id", "location_id").agg((F.max("free_bytes") - 1000).alias("free_after"))
    measured = t("v_locations").withColumns({
        "used_bytes": F.col("free_bytes") * 2, "quota_bytes": F.when(F.col("kind") == "cloud", F.col("free_bytes") * 3)})
    return capacity.capacity_report(measured, after, RESERVE)


@query("most_free", """
SELECT library_id, choice, location_id, free_bytes FROM (
  SELECT m.library_id, m.collection AS choice, m.location_id, l.free_bytes,
         row_number() OVER (PARTITION BY m.library_id, m.collection ORDER BY l.free_bytes DESC, m.location_id) AS n
  FROM v_members m JOIN v_locations l ON l.library_id = m.library_id AND l.location_id = m.location_id WHERE m.role = 'cloud') WHERE n = 1
""")
def _(t):
    choices = t("v_members").filter("role = 'cloud'").select("library_id", F.col("collection").alias("choice"), "location_id")
    return capacity.most_free(choices, t("v_locations"))


@query("pick_staging", f"""
WITH s AS (SELECT library_id, location_id, is_shuttle, greatest(free_bytes - {RESERVE}, 0) AS usable,
  row_number() OVER (PARTITION BY library_id, is_shuttle ORDER BY free_bytes DESC, location_id) AS n
  FROM v_locations WHERE kind = 'volume' AND is_online AND NOT is_overlay)
SELECT o.library_id, o.op_id, o.size, CASE WHEN a.usable >= o.size THEN a.location_id WHEN b.usable >= o.size THEN b.location_id END AS staging
FROM (SELECT library_id, op_id, size * 3 AS size FROM v_plan_ops) o
LEFT JOIN s a ON a.library_id = o.library_id AND a.is_shuttle AND a.n = 1
LEFT JOIN s b ON b.library_id = o.library_id AND NOT b.is_shuttle AND b.n = 1
""")
def _(t):
    ops = t("v_plan_ops").select("library_id", "op_id", (F.col("size") * 3).alias("size"))
    return capacity.pick_staging(ops, capacity.with_usable(t("v_locations"), RESERVE))


@query("recommend_volume", """
WITH o AS (SELECT *, row_number() OVER (PARTITION BY host, is_system ORDER BY free_bytes DESC, root DESC) AS n FROM v_hosts),
j AS (SELECT s.host, s.free_bytes < 8589934592 AND coalesce(o.free_bytes >= 8589934592, false) AS move, o.root, o.free_bytes
      FROM (SELECT host, free_bytes FROM v_hosts WHERE is_system) s LEFT JOIN o ON o.host = s.host AND NOT o.is_system AND o.n = 1)
SELECT host, CASE WHEN move THEN 'recommend' ELSE 'use_default' END AS advice, CASE WHEN move THEN root END AS root,
       CASE WHEN move THEN free_bytes END AS free_bytes FROM j
""")
def _(t):
    return capacity.recommend_volume(t("v_hosts"))


@query("reserve_breaches", f"SELECT library_id, location_id, free_bytes FROM v_locations WHERE kind = 'volume' AND free_bytes < {4 * RESERVE}")
def _(t):
    return capacity.reserve_breaches(t("v_locations"), 4 * RESERVE).select("library_id", "location_id", "free_bytes")


@query("resolve_volumes", """
SELECT library_id, volume_serial, max(root) FILTER (WHERE n = 1) AS root, count(DISTINCT root) AS roots_seen FROM (
  SELECT *, row_number() OVER (PARTITION BY library_id, volume_serial ORDER BY seen_at DESC, root DESC) AS n FROM v_mounts)
GROUP BY library_id, volume_serial
""")
def _(t):
    return capacity.resolve_volumes(t("v_mounts")).drop("seen_at")


@query("require_online", """
SELECT o.library_id, o.plan_id, o.seq, o.role, o.location_id, l.label, l.volume_serial
FROM (SELECT library_id, plan_id, seq, 'src' AS role, src AS location_id FROM v_plan_ops
      UNION ALL SELECT library_id, plan_id, seq, 'dest', dest FROM v_plan_ops
      UNION ALL SELECT library_id, plan_id, seq, 'staging', staging FROM v_plan_ops) o
JOIN v_locations l ON l.library_id = o.library_id AND l.location_id = o.location_id WHERE NOT l.is_online
""")
def _(t):
    return capacity.require_online(t("v_plan_ops"), t("v_locations"))


@query("format_bytes", """
SELECT o_orderkey AS id, CASE WHEN b >= 1073741824 THEN printf('%.2f GiB', b / 1073741824.0::DOUBLE) WHEN b >= 1048576 THEN printf('%.2f MiB', b / 1048576.0::DOUBLE)
  WHEN b >= 1024 THEN printf('%.2f KiB', b / 1024.0::DOUBLE) ELSE concat(b, ' B') END AS text
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 1024 WHEN o_orderkey % 4 = 1 THEN o_orderkey * 128
  WHEN o_orderkey % 4 = 2 THEN CAST(floor(o_totalprice) AS BIGINT) * 128 ELSE CAST(floor(o_totalprice) AS BIGINT) * 131072 END AS b FROM orders)
""")
def _(t):
    sized = t.sql("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 1024 WHEN o_orderkey % 4 = 1 THEN o_orderkey * 128
        WHEN o_orderkey % 4 = 2 THEN CAST(floor(o_totalprice) AS BIGINT) * 128 ELSE CAST(floor(o_totalprice) AS BIGINT) * 131072 END AS b
        FROM {orders}""")
    return sized.select("id", format_bytes(F.col("b")).alias("text"))


# --- policy

NESTED = {"all": [{"any": [{"path_contains": ["/DOCS/", "\\docs\\"]}, {"extension": [".MP4"]}, {"mime_prefix": "Video/"}]},
                  {"not": {"all": [{"mime_prefix": "video/"}, {"path_contains": "/archives/"}]}}, {"always": True}]}


@query("compile_match", """
SELECT library_id, file_id, (contains(lower(path), '/docs/') OR ends_with(path, '.mp4') OR coalesce(starts_with(mime, 'video/'), false))
  AND NOT (coalesce(starts_with(mime, 'video/'), false) AND contains(lower(path), '/archives/')) AS hit
FROM v_files
""")
def _(t):
    return with_match_inputs(t("v_files")).select("library_id", "file_id", compile_match(NESTED).alias("hit"))


def classified(t):
    return policy.classify(t("v_files"), example_rules())


@query("classify", "SELECT library_id, file_id, collection FROM o_classified")
def _(t):
    return classified(t).select("library_id", "file_id", "collection")


def placed(t):
    return policy.desired_placement(classified(t), t("v_policies"))


@query("desired_placement", "SELECT library_id, file_id, collection, keep_local, CAST(min_replicas AS BIGINT) AS min_replicas, cloud_choice, pin_local, dest_subdir FROM o_placed")
def _(t):
    return placed(t).select("library_id", "file_id", "collection", "keep_local", F.col("min_replicas").cast("long").alias("min_replicas"),
                            "cloud_choice", "pin_local", "dest_subdir")


def shared(t):
    """Two blobs of each four collapsed into one, so that policies really meet."""
    return placed(t).withColumn("blob_id", F.col("blob_id") - F.col("blob_id") % 4)


@query("collapse_to_blob", """
WITH p AS (SELECT *, blob_id - blob_id % 4 AS b, CASE keep_local WHEN 'cloud_only' THEN 0 WHEN 'prefer' THEN 1 ELSE 2 END AS r FROM o_placed),
w AS (SELECT *, row_number() OVER (PARTITION BY library_id, b ORDER BY r DESC, ord) AS n FROM p)
SELECT a.*, w.keep_local, w.collection, w.cloud_choice, w.dest_subdir FROM (
  SELECT library_id, b AS blob_id, CAST(max(min_replicas) AS BIGINT) AS min_replicas, bool_or(pin_local) AS pin_local, string_agg(DISTINCT collection, '|' ORDER BY collection) AS collections,
         max(size) AS size FROM p GROUP BY library_id, b) a
JOIN w ON w.library_id = a.library_id AND w.b = a.blob_id AND w.n = 1
""")
def _(t):
    return policy.collapse_to_blob(shared(t)).withColumn("min_replicas", F.col("min_replicas").cast("long"))


def blobs(t):
    """One placement per blob, stored once per query like the file table it comes from."""
    if "blobs" not in t.shared:
        t.stored("v_files")
        t.shared["blobs"] = cut_lineage(policy.collapse_to_blob(placed(t)))
    return t.shared["blobs"]


def goals(t):
    if "goals" not in t.shared:
        t.shared["goals"] = policy.goal_locations(blobs(t), t("v_files"), t("v_policies"), t("v_members"), t("v_locations"))
    return t.shared["goals"]


@query("goal_locations", "SELECT library_id, blob_id, collection, keep_local, dest, dest_kind, size FROM o_goals")
def _(t):
    return goals(t).select("library_id", "blob_id", "collection", "keep_local", "dest", "dest_kind", "size")


@query("prefer_fallback", """
SELECT library_id, blob_id, wanted, placed, dropped, least(wanted, greatest(placed, 1)) AS effective_min,
       dropped > 0 AS local_preferred_unmet, dropped > 0 AND wanted > placed AS replica_shortfall
FROM (SELECT g.library_id, g.blob_id, CAST(max(g.min_replicas) AS BIGINT) AS wanted, count(*) FILTER (WHERE NOT d) AS placed, count(*) FILTER (WHERE d) AS dropped
      FROM (SELECT *, keep_local = 'prefer' AND dest_kind = 'volume' AND NOT EXISTS (
              SELECT 1 FROM v_files r WHERE r.library_id = o_goals.library_id AND r.blob_id = o_goals.blob_id AND r.location_id = o_goals.dest AND r.state = 'verified') AS d
            FROM o_goals) g GROUP BY g.library_id, g.blob_id)
""")
def _(t):
    admitted = t("v_files").filter("state = 'verified'").select("library_id", "blob_id", F.col("location_id").alias("dest"))
    return policy.prefer_fallback(goals(t), admitted)


@query("compile_feasibility", """
SELECT p.library_id, p.collection, p.keep_local, CAST(p.min_replicas * 3 AS BIGINT) AS min_replicas, CASE WHEN keep_local = 'cloud_only' THEN m.clouds ELSE m.locals + least(m.clouds, 1) END AS reachable
FROM v_policies p JOIN (SELECT library_id, collection, count(DISTINCT location_id) FILTER (WHERE role = 'cloud') AS clouds,
  count(DISTINCT location_id) FILTER (WHERE role = 'local') AS locals FROM v_members GROUP BY 1, 2) m
  ON m.library_id = p.library_id AND m.collection = p.collection
WHERE p.keep_local IN ('cloud_only', 'required') AND p.min_replicas * 3 > CASE WHEN keep_local = 'cloud_only' THEN m.clouds ELSE m.locals + least(m.clouds, 1) END
""")
def _(t):
    stricter = t("v_policies").withColumn("min_replicas", F.col("min_replicas") * 3)
    return policy.compile_feasibility(stricter, t("v_members"))


DEST_NEEDS = """(SELECT f.library_id, f.file_id, f.blob_id, f.path, p.dest_subdir, coalesce(m.dest, -1) AS dest
  FROM o_classified f JOIN v_policies p ON p.library_id = f.library_id AND p.collection = f.collection
  LEFT JOIN (SELECT library_id, collection, min(location_id) AS dest FROM v_members GROUP BY 1, 2) m ON m.library_id = f.library_id AND m.collection = f.collection)"""
DEST_PATHS = f"""(SELECT n.*, coalesce(h.path, concat(CASE WHEN rtrim(coalesce(n.dest_subdir, ''), '/') <> '' THEN concat(rtrim(n.dest_subdir, '/'), '/') ELSE '' END,
   split_part(n.path, '/', -1))) AS dest_path
  FROM {DEST_NEEDS} n LEFT JOIN (SELECT library_id, blob_id, location_id, min(path) AS path FROM v_files GROUP BY 1, 2, 3) h
    ON h.library_id = n.library_id AND h.blob_id = n.blob_id AND h.location_id = n.dest)"""


def dest_paths(t):
    targets = t("v_members").groupBy("library_id", "collection").agg(F.min("location_id").alias("dest"))
    needs = placed(t).join(targets, ["library_id", "collection"], "left").select(
        "library_id", "file_id", "blob_id", "path", "dest_subdir", F.coalesce("dest", F.lit(-1)).alias("dest"))
    held = t("v_files").groupBy("library_id", "blob_id", F.col("location_id").alias("dest")).agg(F.min("path").alias("held_path"))
    return policy.dest_path(needs, held)


@query("dest_path", f"SELECT library_id, file_id, dest, dest_path FROM {DEST_PATHS}")
def _(t):
    return dest_paths(t).select("library_id", "file_id", "dest", "dest_path")


@query("dest_conflicts", f"""
WITH n AS (SELECT library_id, file_id, blob_id, dest, concat('/Docs/', substr(dest_path, 1, length(dest_path) - 5), '.pdf') AS dest_path FROM {DEST_PATHS}),
a AS (SELECT library_id, location_id, lower(path) AS k, min(blob_id) AS lo, max(blob_id) AS hi FROM v_files GROUP BY 1, 2, 3),
v AS (SELECT library_id, dest, lower(dest_path) AS k, min(blob_id) <> max(blob_id) AS rivals FROM n GROUP BY 1, 2, 3)
SELECT n.library_id, n.file_id, CASE WHEN a.lo IS NOT NULL AND NOT (a.lo = n.blob_id AND a.hi = n.blob_id) THEN 'needs_manual' WHEN v.rivals THEN 'needs_manual'
   WHEN a.lo = n.blob_id THEN 'noop' ELSE 'clear' END AS verdict
FROM n LEFT JOIN a ON a.library_id = n.library_id AND a.location_id = n.dest AND a.k = lower(n.dest_path)
JOIN v ON v.library_id = n.library_id AND v.dest = n.dest AND v.k = lower(n.dest_path)
""")
def _(t):
    t.stored("v_files")
    # The last digit of each name is cut off, so that different blobs do meet at one path.
    cut = F.expr("concat('/Docs/', substr(dest_path, 1, length(dest_path) - 5), '.pdf')")
    return policy.dest_conflicts(dest_paths(t).withColumn("dest_path", cut), t("v_files")).select("library_id", "file_id", "verdict")


@query("evictable", """
SELECT f.library_id, f.file_id FROM v_files f JOIN o_placed p ON p.library_id = f.library_id AND p.file_id = f.file_id
WHERE f.location_kind = 'volume' AND f.hydration = 'local_full' AND f.is_online AND p.keep_local <> 'required' AND NOT p.pin_local
""")
def _(t):
    return policy.evictable(placed(t)).select("library_id", "file_id")


INTENT_JSON = """
SELECT CAST(0 AS BIGINT) AS library_id, c_custkey AS intent_id, CASE WHEN c_custkey % 17 = 0 THEN 'not json' ELSE to_json(named_struct(
  'summary', c_name, 'goal', 'Place', 'keep_local', CASE WHEN c_custkey % 3 = 0 THEN 'required' WHEN c_custkey % 3 = 1 THEN 'cloud_only' END,
  'year', CASE WHEN c_custkey % 4 = 0 THEN 2024 END, 'dedup', CASE WHEN c_custkey % 6 = 0 THEN 'ExtraLocalOnly' END,
  'collections', array(named_struct('name', c_mktsegment, 'mime_prefix', 'image/'), named_struct('name', 'Photos', 'mime_prefix', 'image/')),
  'dests', array(named_struct('kind', CASE WHEN c_custkey % 2 = 0 THEN 'LocalPath' ELSE 'ProviderSubdir' END,
                              'location', concat(CAST(c_nationkey AS STRING), CASE WHEN c_custkey % 5 = 0 THEN '/In/Deep' ELSE '' END)),
                 named_struct('kind', 'Elsewhere', 'location', '1')),
  'priorities', array(named_struct('kind', CASE WHEN c_custkey % 4 = 1 THEN 'FreeVolume' WHEN c_custkey % 4 = 2 THEN 'Guess' ELSE 'UseShuttle' END, 'location', CAST(c_nationkey AS STRING), 'collection', CAST(NULL AS STRING)),
                      named_struct('kind', 'PreferNewestLocal', 'location', CAST(NULL AS STRING), 'collection', c_mktsegment)),
  'needs_clarification', CASE WHEN c_custkey % 13 = 0 THEN array('which disk?') ELSE array() END)) END AS json
FROM {customer}
"""
INTENT_REASON = """CASE WHEN c_custkey % 17 = 0 THEN 'bad_json' WHEN c_custkey % 13 = 0 THEN 'needs_clarification' WHEN c_nationkey % 5 = 0 THEN 'unknown_location' END"""


def compiled_intents(t):
    known = t("nation").filter("n_nationkey % 5 <> 0").select(F.lit(0).cast("long").alias("library_id"), F.col("n_nationkey").alias("location_id"))
    return policy.compile_intents(t.sql(INTENT_JSON), known)


@query("compile_intents", f"""
SELECT CAST(0 AS BIGINT) AS library_id, c_custkey AS intent_id, c.collection, 'image/' AS mime_prefix,
       CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'required' WHEN c_custkey % 3 = 1 THEN 'cloud_only' ELSE 'prefer' END AS keep_local,
       CASE WHEN c_custkey % 4 = 0 THEN 2024 END AS year, CASE WHEN c_custkey % 6 = 0 THEN 'ExtraLocalOnly' ELSE 'None' END AS dedup
FROM (SELECT *, c_mktsegment AS collection FROM customer UNION ALL SELECT *, 'Photos' FROM customer) c WHERE {INTENT_REASON} IS NULL
""")
def _(t):
    return compiled_intents(t)[0]


def known_places(t):
    return t("nation").filter("n_nationkey % 5 <> 0").select(F.lit(0).cast("long").alias("library_id"), F.col("n_nationkey").alias("location_id"))


@query("intent_dests", f"""
SELECT CAST(0 AS BIGINT) AS library_id, c_custkey AS intent_id, 0 AS ord, CASE WHEN c_custkey % 2 = 0 THEN 'local' ELSE 'cloud' END AS role,
       CAST(c_nationkey AS VARCHAR) AS location_id, CASE WHEN c_custkey % 5 = 0 THEN 'In/Deep' END AS dest_subdir
FROM customer WHERE {INTENT_REASON} IS NULL
""")
def _(t):
    return policy.intent_dests(t.sql(INTENT_JSON), known_places(t))


@query("intent_priorities", f"""
SELECT CAST(0 AS BIGINT) AS library_id, c_custkey AS intent_id, 0 AS ord, CASE WHEN c_custkey % 4 = 1 THEN 'FreeVolume' ELSE 'UseShuttle' END AS kind,
       CAST(c_nationkey AS VARCHAR) AS location_id, CAST(NULL AS VARCHAR) AS collection FROM customer WHERE c_custkey % 4 <> 2 AND {INTENT_REASON} IS NULL
UNION ALL SELECT 0, c_custkey, 1, 'PreferNewestLocal', NULL, c_mktsegment FROM customer WHERE {INTENT_REASON} IS NULL
""")
def _(t):
    return policy.intent_priorities(t.sql(INTENT_JSON), known_places(t))


@query("intent_rejects", f"SELECT CAST(0 AS BIGINT) AS library_id, c_custkey AS intent_id, {INTENT_REASON} AS reason FROM customer WHERE {INTENT_REASON} IS NOT NULL")
def _(t):
    return compiled_intents(t)[1]


@query("priority_rank", """
SELECT f.library_id, f.file_id, row_number() OVER (PARTITION BY f.library_id ORDER BY coalesce(h.hint, 1073741824),
   CASE WHEN f.collection = 'Archives' THEN 0 ELSE 1 END, f.size DESC, f.file_id) AS evict_rank
FROM o_classified f LEFT JOIN (SELECT library_id, location_id, CAST(location_id % 5 AS BIGINT) AS hint FROM v_locations WHERE removable) h
  ON h.library_id = f.library_id AND h.location_id = f.location_id
""")
def _(t):
    hints = t("v_locations").filter("removable").select("library_id", "location_id", (F.col("location_id") % 5).alias("hint"))
    return policy.priority_rank(classified(t), hints).select("library_id", "file_id", "evict_rank")


@query("filter_year", "SELECT library_id, file_id FROM v_files WHERE year(mtime_utc) = 2000")
def _(t):
    return policy.filter_year(t("v_files"), 2000).select("library_id", "file_id")


@query("newest_that_fit", f"""
SELECT f.library_id, f.location_id, f.file_id, f.running_bytes FROM (
  SELECT *, CAST(sum(size) OVER (PARTITION BY library_id, location_id ORDER BY mtime_utc DESC, file_id) AS BIGINT) AS running_bytes FROM v_files) f
JOIN v_locations l ON l.library_id = f.library_id AND l.location_id = f.location_id
WHERE f.running_bytes <= greatest(l.free_bytes - CASE WHEN l.kind = 'volume' THEN {RESERVE} ELSE 0 END, 0)
""")
def _(t):
    room = capacity.with_usable(t("v_locations"), RESERVE)
    return policy.newest_that_fit(t("v_files"), room).select("library_id", "location_id", "file_id", "running_bytes")


@query("policy_diff", """
WITH n AS (SELECT f.library_id, f.file_id, f.size, f.collection AS old_collection,
  CASE WHEN f.collection = 'Archives' AND NOT f.path_hit THEN CASE WHEN f.mime = 'video/mp4' THEN 'Gaming Clips' ELSE 'default' END
       ELSE f.collection END AS new_collection FROM o_classified f)
SELECT n.library_id, n.old_collection, n.new_collection, o.keep_local AS old_keep, CASE WHEN n.new_collection = 'Documents' THEN 'prefer' ELSE w.keep_local END AS new_keep,
       count(*) AS files, CAST(sum(n.size) AS BIGINT) AS bytes
FROM n JOIN v_policies o ON o.library_id = n.library_id AND o.collection = n.old_collection
JOIN v_policies w ON w.library_id = n.library_id AND w.collection = n.new_collection
WHERE n.old_collection <> n.new_collection OR n.new_collection = 'Documents' GROUP BY 1, 2, 3, 4, 5
""")
def _(t):
    draft = [dict(c) for c in EXAMPLE_COLLECTIONS]
    draft[0] = {**draft[0], "match": draft[0]["match"]["any"][0]}
    softer = t("v_policies").withColumn("keep_local", F.when(F.col("collection") == "Documents", "prefer").otherwise(F.col("keep_local")))
    return policy.policy_diff(t("v_files"), example_rules(), rules_from_document(draft), t("v_policies"), softer)
