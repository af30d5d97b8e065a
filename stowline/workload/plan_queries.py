"""Queries of the placement plan: needs, sequence, simulation, checks and reports."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowline.functions.units import MIB
from stowline.operators import capacity
from stowline.plans import build, checks, placement, sequence, shortfall, simulate
from stowline.scale import order_buckets
from stowline.session import cut_lineage
from stowline.workload.policy_queries import RESERVE, blobs, classified, goals
from stowline.workload.registry import query

# --- needs


@query("need_place", "SELECT library_id, blob_id, dest, dest_kind, size FROM o_needs")
def _(t):
    return placement.need_place(goals(t), t("v_files")).select("library_id", "blob_id", "dest", "dest_kind", "size")


def sourced(t):
    if "sourced" not in t.shared:
        t.shared["goals"] = cut_lineage(goals(t))
        t.shared["sourced"] = cut_lineage(_sourced(t))
    return t.shared["sourced"]


def _sourced(t):
    return placement.choose_source(placement.need_place(goals(t), t("v_files")), t("v_files"))


@query("choose_source", "SELECT library_id, blob_id, dest, src, src_kind, src_file_id, no_source FROM o_sourced")
def _(t):
    # Read once, unlike in the queries below, so neither the goals nor the needs are stored.
    return _sourced(t).select("library_id", "blob_id", "dest", "src", "src_kind", "src_file_id", "no_source")


def evicts(t, needs: DataFrame | None = None):
    return placement.can_evict(goals(t), t("v_files"), sourced(t) if needs is None else needs, blobs(t))


@query("can_evict", "SELECT library_id, blob_id, file_id, location_id, size, CAST(min_replicas AS BIGINT) AS min_replicas, n_goals FROM o_evicts")
def _(t):
    return evicts(t)


CLASSED = """(SELECT n.*, CASE WHEN n.dest_kind = 'cloud' AND n.src_kind = 'volume' AND EXISTS (SELECT 1 FROM o_evicts e WHERE e.library_id = n.library_id AND e.blob_id = n.blob_id)
     THEN 'upload_evict' WHEN n.dest_kind = 'cloud' AND n.src_kind = 'volume' THEN 'upload_keep' WHEN n.dest_kind = 'cloud' THEN 'shuttle' ELSE 'download' END AS op_class
  FROM o_sourced n WHERE NOT n.no_source)"""


@query("classify_ops", f"""
SELECT library_id, blob_id, dest, op_class, CASE WHEN op_class IN ('download', 'shuttle') THEN -size ELSE 0 END AS during_delta,
       CASE WHEN op_class = 'download' THEN -size ELSE 0 END AS after_delta FROM {CLASSED}
""")
def _(t):
    needs = sourced(t)
    return placement.classify_ops(needs, evicts(t, needs)).select("library_id", "blob_id", "dest", "op_class", "during_delta", "after_delta")


@query("too_large", f"""
SELECT n.library_id, n.blob_id, n.dest, n.size, CAST(greatest(l.free_bytes // 200 - {RESERVE // 128}, 0) + coalesce(e.f, 0) // 400 AS BIGINT) AS room
FROM o_needs n JOIN v_locations l ON l.library_id = n.library_id AND l.location_id = n.dest AND l.kind = 'volume'
LEFT JOIN (SELECT library_id, location_id, sum(size) AS f FROM o_evicts GROUP BY 1, 2) e ON e.library_id = n.library_id AND e.location_id = n.dest
WHERE n.dest_kind = 'volume' AND n.size > greatest(l.free_bytes // 200 - {RESERVE // 128}, 0) + coalesce(e.f, 0) // 400
""")
def _(t):
    needs = sourced(t)
    tight = t("v_locations").withColumn("free_bytes", F.floor(F.col("free_bytes") / 200))
    gone = evicts(t, needs).groupBy("library_id", "location_id").agg(F.floor(F.sum("size") / 400).alias("size"))
    return placement.too_large(needs, gone, tight, RESERVE // 128).select("library_id", "blob_id", "dest", "size", "room")


# --- sequence


def best_fit_rows(t):
    """Every whole replica as a candidate for its own location's usable bytes."""
    room = capacity.with_usable(t("v_locations"), RESERVE).select("library_id", F.col("location_id").alias("dest"), "usable")
    rows = t("v_files").filter("size IS NOT NULL").select(
        "library_id", "blob_id", F.col("location_id").alias("dest"), "size", (F.col("hydration") != "placeholder").alias("whole"))
    return rows.join(room, ["library_id", "dest"])


@query("admit_largest", f"""
SELECT g.library_id, g.dest, unnest(g.taken) AS blob_id FROM (
  SELECT library_id, dest, (list_reduce(list_prepend({{'left': usable, 'taken': CAST([] AS BIGINT[]), 'size': CAST(0 AS BIGINT), 'blob': CAST(0 AS BIGINT)}}, rows),
    lambda a, r: CASE WHEN r.size <= a.left THEN {{'left': a.left - r.size, 'taken': list_append(a.taken, r.blob), 'size': a.size, 'blob': a.blob}} ELSE a END)).taken AS taken
  FROM (SELECT f.library_id, f.location_id AS dest, greatest(max(l.free_bytes) - CASE WHEN max(l.kind) = 'volume' THEN {RESERVE} ELSE 0 END, 0)::BIGINT AS usable,
               list({{'left': CAST(0 AS BIGINT), 'taken': CAST([] AS BIGINT[]), 'size': f.size, 'blob': f.blob_id}} ORDER BY f.size DESC, f.blob_id) AS rows
        FROM v_files f JOIN v_locations l ON l.library_id = f.library_id AND l.location_id = f.location_id
        WHERE f.hydration <> 'placeholder' GROUP BY 1, 2)) g
""")
def _(t):
    rows, buckets = order_buckets(cut_lineage(best_fit_rows(t)), ["library_id", "dest"], "size", "blob_id", descending=True)
    return sequence.admit_largest(rows, buckets, "whole", "usable").filter("admitted").select("library_id", "dest", "blob_id")


CREATED = datetime(2024, 6, 1, tzinfo=timezone.utc)


def stored_files(t):
    if "classified" not in t.shared:
        t.shared["classified"] = cut_lineage(classified(t))
    return t.shared["classified"]


def full_plan(t):
    """Plan over the whole catalog; the classified view is stored once, as a catalog table would be."""
    return build.build_plan(stored_files(t), t("v_policies"), t("v_members"), t("v_locations"), RESERVE, created_at=CREATED)


@query("build_plan")
def _(t):
    return build.stored_ops(full_plan(t)).select(
        "library_id", "plan_id", "seq", "op_id", "kind", "blob_id", "file_id", "size", "src", "dest",
        F.to_json("residual_during").alias("residual_during"), F.to_json("residual_after").alias("residual_after"), "rollback_note")


@query("plan_checks", """
SELECT c.name AS name, CAST(0 AS BIGINT) AS violations
FROM (SELECT unnest(['check_goal', 'check_last_copy', 'check_no_overwrite', 'check_placeholder', 'check_prefix', 'check_space', 'cloud_delete_audit']) AS name) c
""")
def _(t):
    """All safety checks over the plan of the whole catalog; each must find nothing."""
    plan, files, places = full_plan(t), stored_files(t), t("v_locations")
    ledger = checks.space_ledger(plan.ops, places)
    # Goals that the sequencing reports as impossible are not promised by the plan.
    open_goals = plan.leftover.select("library_id", "blob_id", "dest").unionByName(plan.dropped.select("library_id", "blob_id", "dest")).unionByName(
        plan.needs.filter("no_source OR verdict <> 'clear'").select("library_id", "blob_id", "dest"))
    found = {
        "check_goal": checks.check_goal(plan.goals.filter("size IS NOT NULL"), open_goals, files, plan.ops),
        "check_last_copy": checks.check_last_copy(plan.ops, files),
        "check_no_overwrite": checks.check_no_overwrite(plan.ops, files),
        "check_placeholder": checks.check_placeholder(plan.ops, files),
        "check_prefix": checks.check_prefix(plan.residuals, ledger),
        # A volume that starts below the reserve breaches it without any help; only ops that take space count.
        "check_space": checks.check_space(plan.ops, places, RESERVE).join(
            plan.ops.filter("kind IN ('download', 'shuttle')").select("library_id", "plan_id", "seq"), ["library_id", "plan_id", "seq"], "left_semi"),
        "cloud_delete_audit": checks.cloud_delete_audit(plan.ops, places),
    }
    out = None
    for name, rows in found.items():
        part = rows.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("name"), "violations")
        out = part if out is None else out.unionByName(part)
    return out


# --- simulation and reports, over a stored plan table


def residuals(t):
    return simulate.simulate(t("v_plan_ops"), t("v_locations"))


@query("simulate", "SELECT library_id, plan_id, seq, location_id, residual_during, residual_after FROM o_residuals")
def _(t):
    return residuals(t).select("library_id", "plan_id", "seq", "location_id", "residual_during", "residual_after")


@query("residual_maps", """
SELECT o.library_id, o.plan_id, o.seq, m.during, m.after FROM v_plan_ops o LEFT JOIN (
  SELECT library_id, plan_id, seq, string_agg(concat(location_id, '=', residual_during), ',' ORDER BY CAST(location_id AS VARCHAR)) AS during,
         string_agg(concat(location_id, '=', residual_after), ',' ORDER BY CAST(location_id AS VARCHAR)) AS after
  FROM o_residuals GROUP BY 1, 2, 3) m ON m.library_id = o.library_id AND m.plan_id = o.plan_id AND m.seq = o.seq
""")
def _(t):
    def flat(column: str):
        return F.array_join(F.transform(F.map_entries(column), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")

    maps = simulate.residual_maps(t("v_plan_ops"), residuals(t))
    return maps.select("library_id", "plan_id", "seq", flat("residual_during").alias("during"), flat("residual_after").alias("after"))


PROBLEMS = """(SELECT library_id, plan_id, bool_or(kind = 'shuttle' AND size > 3000000000) AS unsat, bool_or(kind = 'download' AND size > 3000000000) AS manual
  FROM v_plan_ops GROUP BY 1, 2)"""


@query("plan_summary", f"""
SELECT o.library_id, o.plan_id, o.ops, o.moved_bytes, r.min_residual, CASE WHEN p.unsat THEN 'unsatisfiable' WHEN p.manual THEN 'needs_manual' ELSE 'drafted' END AS status
FROM (SELECT library_id, plan_id, count(*) AS ops, CAST(sum(CASE WHEN kind <> 'evict' THEN size ELSE 0 END) AS BIGINT) AS moved_bytes FROM v_plan_ops GROUP BY 1, 2) o
JOIN {PROBLEMS} p ON p.library_id = o.library_id AND p.plan_id = o.plan_id
LEFT JOIN (SELECT library_id, plan_id, min(residual_during) AS min_residual FROM o_residuals WHERE location_kind = 'volume' GROUP BY 1, 2) r
  ON r.library_id = o.library_id AND r.plan_id = o.plan_id
""")
def _(t):
    big = t("v_plan_ops").filter("size > 3000000000 AND kind IN ('shuttle', 'download')")
    problems = big.select("library_id", "plan_id", F.when(F.col("kind") == "shuttle", "unsatisfiable").otherwise("needs_manual").alias("problem"))
    return simulate.plan_summary(t("v_plan_ops"), residuals(t), problems)


@query("check_space", f"""
SELECT library_id, plan_id, seq, location_id, residual_during AS during, residual_after AS after FROM o_residuals
WHERE location_kind = 'volume' AND least(residual_during, residual_after) < {4 * RESERVE}
""")
def _(t):
    return checks.check_space(t("v_plan_ops"), t("v_locations"), 4 * RESERVE).drop("location_kind")


COPIES = """(SELECT library_id, blob_id, count(*) AS verified FROM v_files WHERE state = 'verified' AND hydration <> 'placeholder' AND is_online GROUP BY 1, 2)"""


@query("check_last_copy", f"""
WITH n AS (SELECT o.library_id, o.plan_id, o.blob_id, o.seq, coalesce(c.verified, 0) AS v, coalesce(c.verified, 0) +
   sum(CASE WHEN o.kind = 'evict' THEN -1 ELSE 1 END) OVER (PARTITION BY o.library_id, o.plan_id, o.blob_id ORDER BY o.seq) AS l
   FROM v_plan_ops o LEFT JOIN {COPIES} c ON c.library_id = o.library_id AND c.blob_id = o.blob_id)
SELECT library_id, plan_id, blob_id, CAST(min(l) AS BIGINT) AS lowest, min(seq) FILTER (WHERE l < 1) AS first_seq FROM n
GROUP BY 1, 2, 3 HAVING bool_or(l >= 1 OR v > 0) AND min(l) < 1
""")
def _(t):
    return checks.check_last_copy(t("v_plan_ops"), t("v_files"))


@query("check_goal", """
SELECT g.library_id, g.blob_id, g.dest FROM o_goals g
WHERE NOT EXISTS (SELECT 1 FROM v_files f WHERE f.library_id = g.library_id AND f.blob_id = g.blob_id AND f.location_id = g.dest AND f.hydration <> 'placeholder'
    AND NOT EXISTS (SELECT 1 FROM v_plan_ops o WHERE o.kind = 'evict' AND o.library_id = f.library_id AND o.blob_id = f.blob_id AND o.file_id = f.file_id))
  AND NOT EXISTS (SELECT 1 FROM v_plan_ops o WHERE o.kind <> 'evict' AND o.library_id = g.library_id AND o.blob_id = g.blob_id AND o.dest = g.dest)
""")
def _(t):
    none = goals(t).select("library_id", "blob_id", "dest").filter("false")
    return checks.check_goal(goals(t), none, t("v_files"), t("v_plan_ops")).select("library_id", "blob_id", "dest")


@query("check_prefix", """
SELECT library_id, plan_id, seq, location_id, residual_during, residual_during + 1 AS during FROM o_residuals WHERE seq % 3 = 0
""")
def _(t):
    """The ledger is falsified on purpose at every third position, so that disagreement shows."""
    ledger = checks.space_ledger(t("v_plan_ops"), t("v_locations"))
    ledger = ledger.withColumn("during", F.col("during") + F.when(F.col("seq") % 3 == 0, 1).otherwise(0))
    return checks.check_prefix(residuals(t), ledger).select("library_id", "plan_id", "seq", "location_id", "residual_during", "during")


@query("check_no_overwrite", """
WITH n AS (SELECT *, concat('/docs/F', blob_id % 500, '.pdf') AS dest_path FROM v_plan_ops WHERE kind <> 'evict'),
a AS (SELECT library_id, location_id, lower(path) AS k, min(blob_id) AS lo, max(blob_id) AS hi FROM v_files GROUP BY 1, 2, 3),
v AS (SELECT library_id, dest, lower(dest_path) AS k, min(blob_id) <> max(blob_id) AS rivals FROM n GROUP BY 1, 2, 3)
SELECT n.library_id, n.plan_id, n.seq FROM n LEFT JOIN a ON a.library_id = n.library_id AND a.location_id = n.dest AND a.k = lower(n.dest_path)
JOIN v ON v.library_id = n.library_id AND v.dest = n.dest AND v.k = lower(n.dest_path)
WHERE v.rivals OR (a.lo IS NOT NULL AND NOT (a.lo = n.blob_id AND a.hi = n.blob_id))
""")
def _(t):
    ops = t("v_plan_ops").withColumn("dest_path", F.concat(F.lit("/docs/F"), F.col("blob_id") % 500, F.lit(".pdf")))
    return checks.check_no_overwrite(ops, t("v_files")).select("library_id", "plan_id", "seq")


READS = """SELECT library_id, 'p' AS plan_id, blob_id AS seq, file_id FROM {v_files} WHERE mime IS NULL"""


@query("check_placeholder", """
SELECT library_id, seq, file_id FROM (SELECT library_id, blob_id AS seq, file_id, hydration FROM v_files WHERE mime IS NULL) WHERE hydration = 'placeholder'
""")
def _(t):
    return checks.check_placeholder(t.sql(READS), t("v_files")).select("library_id", "seq", "file_id")


@query("unsat_report", f"""
WITH e AS (SELECT c.library_id, c.dest_kind, c.size * 40 AS size, c.op_class, c.no_source, greatest(coalesce(l.free_bytes - CASE WHEN l.kind = 'volume' THEN {RESERVE} ELSE 0 END, 0), 0) AS usable
  FROM (SELECT s.*, CASE WHEN dest_kind = 'cloud' AND src_kind = 'volume' THEN 'upload_keep' WHEN dest_kind = 'cloud' THEN 'shuttle' ELSE 'download' END AS op_class FROM o_sourced s) c
  LEFT JOIN v_locations l ON l.library_id = c.library_id AND l.location_id = c.dest),
r AS (SELECT *, CASE WHEN no_source THEN 'no_source' WHEN dest_kind = 'volume' THEN 'volume_full' WHEN op_class = 'shuttle' AND size <= usable THEN 'staging_full' ELSE 'cloud_full' END AS reason FROM e)
SELECT library_id, reason, count(*) AS leftover, CAST(sum(size) AS BIGINT) AS bytes, CAST(min(greatest(size - usable, 0)) AS BIGINT) AS min_shortfall,
  CASE reason WHEN 'no_source' THEN 'restore_or_rescan_source' WHEN 'volume_full' THEN 'mark_cloud_only_or_lower_reserve' WHEN 'staging_full' THEN 'attach_shuttle_volume_or_free_space'
    ELSE 'add_provider_quota' END AS suggestion
FROM r GROUP BY library_id, reason
""")
def _(t):
    kind = (F.when((F.col("dest_kind") == "cloud") & (F.col("src_kind") == "volume"), "upload_keep")
            .when(F.col("dest_kind") == "cloud", "shuttle").otherwise("download"))
    left = sourced(t).withColumn("op_class", kind).withColumn("size", F.col("size") * 40)
    return checks.unsat_report(left, capacity.with_usable(t("v_locations"), RESERVE))


# Leftovers: every sourced need at forty times its size, held against what the locations have.
LEFT = f"""l0 AS (SELECT s.library_id, s.blob_id, s.dest, s.dest_kind, s.size * 40 AS size,
       CASE WHEN s.dest_kind = 'cloud' AND s.src_kind = 'volume' THEN 'upload_keep' WHEN s.dest_kind = 'cloud' THEN 'shuttle' ELSE 'download' END AS op_class FROM o_sourced s),
b AS (SELECT library_id, location_id, kind, is_online, is_shuttle, is_overlay, free_bytes, greatest(free_bytes - CASE WHEN kind = 'volume' THEN {RESERVE} ELSE 0 END, 0) AS usable FROM v_locations),
p AS (SELECT library_id, is_shuttle, arg_min(usable, (-free_bytes, location_id)) AS usable FROM b WHERE kind = 'volume' AND is_online AND NOT is_overlay GROUP BY 1, 2),
h AS (SELECT library_id, max(usable) AS staging_usable FROM p GROUP BY 1),
left_rows AS (SELECT l0.*, coalesce(b.usable, 0) AS usable, coalesce(h.staging_usable, 0) AS staging_usable,
       CASE WHEN dest_kind = 'volume' THEN 'volume_full' WHEN op_class = 'shuttle' AND size <= coalesce(b.usable, 0) AND size > coalesce(h.staging_usable, 0) THEN 'staging_full' ELSE 'cloud_full' END AS cause
  FROM l0 LEFT JOIN b ON b.library_id = l0.library_id AND b.location_id = l0.dest LEFT JOIN h ON h.library_id = l0.library_id)"""


def stuck(t):
    kind = (F.when((F.col("dest_kind") == "cloud") & (F.col("src_kind") == "volume"), "upload_keep")
            .when(F.col("dest_kind") == "cloud", "shuttle").otherwise("download"))
    left = sourced(t).withColumn("op_class", kind).withColumn("size", F.col("size") * 40)
    return left, capacity.with_usable(t("v_locations"), RESERVE)


@query("shortfall_steps", f"""
WITH {LEFT},
n AS (SELECT *, row_number() OVER (PARTITION BY library_id, dest, cause ORDER BY size, blob_id) AS nth,
             sum(size) OVER (PARTITION BY library_id, dest, cause ORDER BY size, blob_id) AS run FROM left_rows)
SELECT library_id, dest, cause, nth, blob_id, size, CAST(greatest(CASE WHEN cause = 'staging_full' THEN size - staging_usable ELSE run - usable END, 0) AS BIGINT) AS extra_bytes FROM n
""")
def _(t):
    return shortfall.shortfall_steps(*stuck(t))


@query("shortfall_report", f"""
WITH {LEFT},
g AS (SELECT library_id, dest, cause, count(*) AS leftovers, CAST(sum(size) AS BIGINT) AS bytes,
             greatest(min(size) - max(CASE WHEN cause = 'staging_full' THEN staging_usable ELSE usable END), 0) AS least_for_one,
             CAST(greatest(CASE WHEN cause = 'staging_full' THEN max(size) - max(staging_usable) ELSE sum(size) - max(usable) END, 0) AS BIGINT) AS least_for_all
      FROM left_rows GROUP BY library_id, dest, cause),
d AS (SELECT DISTINCT library_id FROM b WHERE kind = 'volume' AND is_shuttle AND NOT is_online),
w AS (SELECT DISTINCT library_id FROM v_plan_ops WHERE kind = 'download')
SELECT library_id, dest, cause, leftovers, bytes, least_for_one, least_for_all, concat_ws('|',
  CASE WHEN cause = 'volume_full' THEN 'mark_cloud_only' END, CASE WHEN cause <> 'cloud_full' AND least_for_one <= {max(RESERVE - shortfall.RESERVE_FLOOR, 0)} THEN 'lower_reserve' END,
  CASE WHEN cause <> 'cloud_full' THEN 'free_unreferenced_files' END, CASE WHEN cause = 'cloud_full' THEN 'add_provider_quota' END,
  CASE WHEN cause = 'staging_full' AND library_id IN (SELECT library_id FROM d) THEN 'plug_in_shuttle_volume' END, CASE WHEN cause = 'staging_full' THEN 'attach_shuttle_volume' END,
  CASE WHEN cause = 'staging_full' AND library_id IN (SELECT library_id FROM w) THEN 'move_download_after_shuttle' END) AS suggestions
FROM g
""")
def _(t):
    return shortfall.shortfall_report(*stuck(t), RESERVE, t("v_plan_ops")).withColumn("suggestions", F.array_join("suggestions", "|"))


@query("plan_warnings", """
WITH there AS (SELECT library_id, blob_id, location_id AS dest FROM v_files WHERE hydration <> 'placeholder' AND state IN ('verified', 'suspect')
               UNION SELECT library_id, blob_id, dest FROM o_sourced WHERE blob_id % 3 <> 0),
j AS (SELECT g.library_id, g.blob_id, max(g.min_replicas) AS wanted, count(*) FILTER (WHERE t.dest IS NULL AND g.keep_local = 'prefer' AND g.dest_kind = 'volume') AS dropped, count(*) AS goals
      FROM o_goals g LEFT JOIN there t ON t.library_id = g.library_id AND t.blob_id = g.blob_id AND t.dest = g.dest GROUP BY 1, 2)
SELECT library_id, blob_id, warning, CAST(wanted AS BIGINT) AS wanted, goals - dropped AS placed, 'prefer_dropped_local' AS reason
FROM j JOIN (SELECT unnest(['local_preferred_unmet', 'replica_shortfall']) AS warning) w
  ON dropped > 0 AND (warning = 'local_preferred_unmet' OR wanted > goals - dropped)
""")
def _(t):
    """As if two thirds of the needs had found a place."""
    sourced(t)
    moved = sourced(t).filter("blob_id % 3 <> 0").withColumn("kind", F.lit("download"))
    return build.plan_warnings(t.shared["goals"], t("v_files"), moved)


@query("plan_offline", """
WITH away AS (SELECT DISTINCT library_id, blob_id, location_id FROM v_files WHERE NOT is_online AND hydration <> 'placeholder' AND state IN ('verified', 'suspect')),
down AS (SELECT * FROM v_locations WHERE kind = 'volume' AND NOT is_online),
asked AS (
  SELECT b.library_id, 'dest' AS role, m.location_id, b.blob_id FROM o_blobs b JOIN v_members m ON m.library_id = b.library_id AND m.collection = b.collection AND m.role = 'local'
  JOIN down d ON d.library_id = m.library_id AND d.location_id = m.location_id AND d.is_final WHERE b.keep_local <> 'cloud_only'
    AND NOT EXISTS (SELECT 1 FROM away a WHERE a.library_id = b.library_id AND a.blob_id = b.blob_id AND a.location_id = m.location_id)
  UNION ALL SELECT DISTINCT n.library_id, 'src', a.location_id, n.blob_id FROM o_sourced n JOIN away a ON a.library_id = n.library_id AND a.blob_id = n.blob_id WHERE n.no_source
  UNION ALL SELECT s.library_id, 'staging', d.location_id, s.blob_id FROM o_sourced s JOIN down d ON d.library_id = s.library_id AND d.is_shuttle WHERE s.dest_kind = 'cloud' AND s.src_kind = 'cloud')
SELECT a.library_id, a.role, a.location_id, d.label, d.volume_serial, count(*) AS blobs FROM asked a JOIN down d ON d.library_id = a.library_id AND d.location_id = a.location_id
GROUP BY ALL
""")
def _(t):
    """One more local target is unmounted, and every move between clouds found no room to hop."""
    hops = sourced(t).filter("dest_kind = 'cloud' AND src_kind = 'cloud'").withColumn("op_class", F.lit("shuttle"))
    return build.offline_volumes(blobs(t), sourced(t), hops, t("v_files"), t("v_members"), t("v_locations"))


@query("stored_plans")
def _(t):
    return build.stored_plans(full_plan(t))


@query("authorise_delete", """
WITH r AS (SELECT f.library_id, f.blob_id, f.file_id, f.location_kind, coalesce(f.state = 'verified' AND f.hydration <> 'placeholder' AND f.is_online
             AND (f.location_kind = 'volume' OR CASE WHEN f.blob_id % 3 = 0 THEN 'changed' ELSE 'bound' END = 'bound'), false) AS stands FROM v_files f),
e AS (SELECT r.*, CAST(sum(CASE WHEN stands AND location_kind = 'volume' THEN 1 ELSE 0 END) OVER (PARTITION BY library_id, blob_id ORDER BY file_id) AS BIGINT) AS evict_no FROM r)
SELECT e.library_id, e.blob_id, e.file_id, e.evict_no, CASE WHEN e.location_kind <> 'volume' THEN 'refused_not_local' WHEN NOT e.stands THEN 'refused_not_verified'
   WHEN coalesce(c.n, 0) - e.evict_no >= 1 THEN 'permit' ELSE 'refused_last_copy' END AS verdict
FROM e LEFT JOIN (SELECT library_id, blob_id, count(*) AS n FROM r WHERE stands GROUP BY 1, 2) c ON c.library_id = e.library_id AND c.blob_id = e.blob_id
""")
def _(t):
    stat = t.stored("v_files").withColumn("binding", F.when(F.col("blob_id") % 3 == 0, "changed").otherwise("bound"))
    asked = stat.select("library_id", "blob_id", "file_id")
    return checks.authorise_delete(asked, stat)


@query("plan_show", """
SELECT o.library_id, o.plan_id, o.seq, o.kind, o.blob_id,
       CASE WHEN o.size >= 1073741824 THEN printf('%.2f GiB', o.size / 1073741824.0::DOUBLE) ELSE printf('%.2f MiB', o.size / 1048576.0::DOUBLE) END AS size_text,
       o.src, o.dest, r.during, r.after
FROM v_plan_ops o LEFT JOIN (SELECT library_id, plan_id, seq, min(residual_during) >= 0 AS during, min(residual_after) >= 0 AS after FROM o_residuals WHERE location_kind = 'volume' GROUP BY 1, 2, 3) r
  ON r.library_id = o.library_id AND r.plan_id = o.plan_id AND r.seq = o.seq
""")
def _(t):
    return simulate.plan_show(t("v_plan_ops"), residuals(t)).select(
        "library_id", "plan_id", "seq", "kind", "blob_id", "size_text", "src", "dest",
        (~F.col("during_text").startswith("-")).alias("during"), (~F.col("after_text").startswith("-")).alias("after"))


@query("cap_plan", f"""
SELECT library_id, plan_id, seq, moved_so_far FROM (SELECT library_id, plan_id, seq,
  CAST(sum(CASE WHEN kind <> 'evict' THEN size ELSE 0 END) OVER (PARTITION BY library_id, plan_id ORDER BY seq) AS BIGINT) AS moved_so_far FROM v_plan_ops)
WHERE moved_so_far <= {8192 * MIB}
""")
def _(t):
    return simulate.cap_plan(t("v_plan_ops"), 8192 * MIB).select("library_id", "plan_id", "seq", "moved_so_far")


@query("cloud_delete_audit", """
SELECT o.library_id, o.plan_id, o.seq, o.src FROM v_plan_ops o JOIN v_locations l ON l.library_id = o.library_id AND l.location_id = o.src
WHERE o.kind = 'evict' AND l.kind = 'cloud'
""")
def _(t):
    return checks.cloud_delete_audit(t("v_plan_ops"), t("v_locations")).select("library_id", "plan_id", "seq", "src")
