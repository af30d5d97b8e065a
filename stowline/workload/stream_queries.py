"""Streaming jobs run to the end of their input, and what they left in their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowline.plans.simulate import PLAN
from stowline.session import cut_lineage, new_folder
from stowline.streaming import jobs, retention, snapshots, transitions
from stowline.streaming.tables import BATCH, read_batches
from stowline.workload.audit_queries import AUDIT, LATEST, SLACK
from stowline.workload.plan_queries import residuals
from stowline.workload.policy_queries import RESERVE
from stowline.workload.registry import query


def stream(t, table: str) -> DataFrame:
    """The base table as a file stream."""
    schema = t(table).schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(t.sf_dir)


CHANGE_COLUMNS = """CAST(o_custkey % 2 AS BIGINT) AS library_id, CAST(o_custkey % 25 AS BIGINT) AS location_id, o_custkey AS item_key,
  CAST(floor(o_totalprice) AS BIGINT) AS size, concat('moved-', CAST(o_orderkey AS STRING)) AS path, o_orderkey AS change_no, o_orderstatus = 'F' AS is_deleted"""
STREAM_BASE = """SELECT CAST(c_custkey % 2 AS BIGINT) AS library_id, CAST(c_custkey % 25 AS BIGINT) AS location_id, c_custkey AS item_key,
  CAST(floor(abs(c_acctbal)) AS BIGINT) AS size, c_name AS path FROM {customer}"""


@query("stream_inventory", f"""
SELECT library_id, location_id, item_key, size, path FROM (
  SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY change_no DESC) AS n FROM (
    SELECT {CHANGE_COLUMNS.replace('STRING', 'VARCHAR')} FROM orders UNION ALL SELECT *, -1, false FROM ({STREAM_BASE})))
WHERE n = 1 AND NOT is_deleted
""")
def _(t):
    changes = stream(t, "orders").selectExpr(*[c.strip() for c in _split(CHANGE_COLUMNS)])
    table, checkpoint = jobs.scratch(t.spark, "inventory")
    jobs.run_to_end(jobs.stream_inventory(changes, table, checkpoint))
    base = t.sql(STREAM_BASE)
    return jobs.read_inventory(base, changes, table)


def _split(columns: str) -> list[str]:
    """Split a select list at top-level commas."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(columns):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(columns[start:i])
            start = i + 1
    return [*out, columns[start:]]


@query("stream_redact", """
SELECT event_id AS log_id, '[REDACTED]' AS access_token, concat('https://host/dl', '?[REDACTED]') AS session_uri,
       concat('sent Bearer [REDACTED] for ', CAST(user_id AS VARCHAR)) AS msg FROM events
""")
def _(t):
    lines = stream(t, "events").select(F.to_json(F.struct(
        F.lit("INFO").alias("level"), F.col("event_id").alias("log_id"), F.concat(F.lit("k"), "user_id").alias("access_token"),
        F.concat(F.lit("https://host/dl?sig="), "user_id").alias("session_uri"),
        F.concat(F.lit("sent Bearer x"), "event_id", F.lit(" for "), "user_id").alias("message"))).alias("value"))
    table, checkpoint = jobs.scratch(t.spark, "logs")
    jobs.run_to_end(jobs.stream_redact(lines, table, checkpoint))
    stored = t.spark.read.schema(jobs.redacted(lines).schema).parquet(table)
    return stored.select(F.col("fields")["log_id"].cast("long").alias("log_id"), F.col("fields")["access_token"].alias("access_token"),
                         F.col("fields")["session_uri"].alias("session_uri"), "msg")


METRIC = """CASE event_type WHEN 'signup' THEN 'index.files_seen' WHEN 'view' THEN 'apply.bytes_copied' WHEN 'click' THEN 'plan.ops'
            WHEN 'purchase' THEN 'space.free' ELSE 'space.usable' END"""


@query("stream_metrics", """
SELECT name, kind, CASE WHEN kind = 'counter' THEN CAST(sum(value) AS BIGINT) ELSE arg_max(value, (ts, value)) END AS value FROM v_metrics GROUP BY name, kind
""")
def _(t):
    events = stream(t, "events").select(
        F.expr(METRIC).alias("name"), F.when(F.col("event_type").isin("purchase", "error"), "gauge").otherwise("counter").alias("kind"),
        F.floor(F.col("value") * 100).cast("long").alias("value"), "ts")
    table, checkpoint = jobs.scratch(t.spark, "metrics")
    jobs.run_to_end(jobs.stream_metrics(events, table, checkpoint))
    return jobs.read_metrics(t.spark, table)


@query("stream_drift", f"""
WITH w AS (SELECT r.library_id, r.location_id, r.plan_id, r.seq, r.kind, r.size, r.residual_before FROM o_residuals r
  JOIN (SELECT library_id, location_id, max(plan_id) AS plan_id FROM o_residuals WHERE location_kind = 'volume' GROUP BY 1, 2) p
    ON p.library_id = r.library_id AND p.location_id = r.location_id AND p.plan_id = r.plan_id
  WHERE r.seq = (SELECT min(x.seq) FROM o_residuals x WHERE x.library_id = r.library_id AND x.location_id = r.location_id AND x.plan_id = r.plan_id)),
e AS (SELECT event_id, CAST(user_id % 2 AS BIGINT) AS library_id, user_id % 10 AS location_id, CAST(floor(value * 100) AS BIGINT) * 1048576 AS live_free FROM events)
SELECT event_id, w.plan_id, w.seq, CASE WHEN live_free + {SLACK} < residual_before THEN 'start_free_below_sim' ELSE 'trough_would_breach_reserve' END AS reason
FROM e JOIN w ON w.library_id = e.library_id AND w.location_id = e.location_id
WHERE live_free + {SLACK} < residual_before OR live_free - CASE WHEN kind IN ('download', 'shuttle') THEN size ELSE 0 END < {RESERVE}
""")
def _(t):
    """Each reading is held against the first operation of the newest plan on its volume."""
    rows = residuals(t).filter("location_kind = 'volume'")
    head = rows.groupBy("library_id", "location_id").agg(F.max("plan_id").alias("plan_id"))
    newest = rows.join(head, ["library_id", "location_id", "plan_id"], "left_semi")
    waiting = newest.groupBy("library_id", "location_id").agg(
        F.min_by(F.struct(*PLAN[1:], "seq", "kind", "size", "residual_before"), "seq").alias("o")).select(
        "library_id", "location_id", "o.*")
    readings = stream(t, "events").select(
        "event_id", (F.col("user_id") % 2).alias("library_id"), (F.col("user_id") % 10).alias("location_id"),
        (F.floor(F.col("value") * 100).cast("long") * 1048576).alias("live_free"))
    table, checkpoint = jobs.scratch(t.spark, "drift")
    jobs.run_to_end(jobs.stream_drift(readings, waiting, table, checkpoint, SLACK, RESERVE))
    schema = jobs.drift_alerts(readings, waiting, SLACK, RESERVE).schema
    return t.spark.read.schema(schema).parquet(table).select("event_id", "plan_id", "seq", "reason")


STATE = """CASE event_type WHEN 'signup' THEN 'ReservedSpace' WHEN 'view' THEN 'Transferring'
            WHEN 'click' THEN 'Verifying' WHEN 'purchase' THEN 'Committed' ELSE 'NeedsAttention' END"""


@query("stream_journal", f"SELECT library_id, op_id, event_id, plan_id, state FROM {LATEST}")
def _(t):
    transitions = stream(t, "events").select(
        "event_id", (F.col("event_id") % 2).alias("library_id"), F.col("user_id").alias("op_id"),
        F.concat(F.lit("p"), (F.col("user_id") % 20).cast("string")).alias("plan_id"), F.col("ts").alias("updated_at"), F.expr(STATE).alias("state"))
    table, checkpoint = jobs.scratch(t.spark, "journal")
    jobs.run_to_end(jobs.stream_journal(transitions, table, checkpoint))
    return jobs.read_journal(transitions, table).select("library_id", "op_id", "event_id", "plan_id", "state")


def arrivals(rows: DataFrame, slices: int, folder: str, slice_no) -> None:
    """Write rows as ``slices`` files, in the order in which a stream will read them."""
    dealt = cut_lineage(rows.withColumn("_slice", slice_no.cast("int")), "_slice")
    for n in range(slices):
        dealt.filter(F.col("_slice") == n).drop("_slice").coalesce(1).write.mode("append").parquet(folder)


@query("stream_transitions", AUDIT)
def _(t):
    """The journal in six arrivals, a tenth of the rows a day late, and a last row of no op that lets the watermark pass."""
    rows = t("v_journal").select("library_id", "op_id", "event_id", "state", F.col("updated_at").cast("timestamp").alias("updated_at"))
    first, last = rows.agg(F.min("updated_at"), F.max("updated_at")).first()
    late = F.when(F.col("event_id") % 10 == 0, F.expr("INTERVAL 1 DAY")).otherwise(F.expr("INTERVAL 0 DAY"))
    step = max((last - first).total_seconds() / 5, 1.0)
    at = F.least(F.floor((F.unix_micros(F.col("updated_at") + late) - F.unix_micros(F.lit(first))) / F.lit(step * 1e6)), F.lit(5))
    source = new_folder(t.spark, "arrivals")
    arrivals(rows, 6, source, at)
    end = rows.limit(1).select(F.lit(-1).cast("long").alias("library_id"), F.lit(-1).cast("long").alias("op_id"), F.lit(-1).cast("long").alias("event_id"),
                               F.lit("NotStarted").alias("state"), F.expr(f"TIMESTAMP_MICROS({int(last.timestamp() * 1e6)}) + INTERVAL 9 DAYS").alias("updated_at"))
    end.coalesce(1).write.mode("append").parquet(source)
    arriving = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    table, checkpoint = jobs.scratch(t.spark, "transitions")
    jobs.run_to_end(transitions.stream_transitions(arriving, table, checkpoint, "2 days", 90 * 24 * 3600 * 1000))
    return read_batches(t.spark, table, transitions.OUT).drop(BATCH)


@query("stream_compaction", f"""
SELECT library_id, location_id, item_key, size, path FROM (
  SELECT *, row_number() OVER (PARTITION BY item_key ORDER BY change_no DESC) AS n FROM (
    SELECT {CHANGE_COLUMNS.replace('STRING', 'VARCHAR')} FROM orders UNION ALL SELECT *, -1, false FROM ({STREAM_BASE})))
WHERE n = 1 AND NOT is_deleted
""")
def _(t):
    """The changes in four arrivals, each item's newest ones first, with a compaction after each and old folders deleted."""
    changes = t.sql(f"SELECT {CHANGE_COLUMNS} FROM {{orders}}")
    source = new_folder(t.spark, "changes")
    table, checkpoint = jobs.scratch(t.spark, "compaction")
    schema = ", ".join(f"{n} {k}" for n, k in changes.dtypes)
    for n in (2, 0, 3, 1):
        changes.filter(F.col("change_no") % 4 == n).write.mode("append").parquet(source)
        arriving = t.spark.readStream.schema(changes.schema).parquet(source)
        jobs.run_to_end(jobs.stream_inventory(arriving, table, checkpoint))
        if n != 1:
            snapshots.compact(t.spark, table, schema)
            snapshots.vacuum(t.spark, table)
    return snapshots.read_current(t.sql(STREAM_BASE), schema, table)


@query("stream_retention", """
SELECT strftime(ts, '%Y-%m-%d') AS log_day, count(*) AS rows FROM events
WHERE CAST(ts AS DATE) IN (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events ORDER BY d DESC LIMIT 7) GROUP BY 1
""")
def _(t):
    lines = stream(t, "events").select(F.to_json(F.struct(
        F.lit("INFO").alias("level"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"), F.concat(F.lit("seen "), "event_id").alias("message"))).alias("value"))
    logs = jobs.redacted(lines)
    table, checkpoint = jobs.scratch(t.spark, "days")
    jobs.run_to_end(retention.store_days(logs, table, checkpoint))
    retention.expire_days(t.spark, table, 7)
    schema = ", ".join(f"{n} {k}" for n, k in logs.dtypes)
    return retention.read_days(t.spark, table, schema).groupBy(retention.DAY).agg(F.count(F.lit(1)).alias("rows"))
