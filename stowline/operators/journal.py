"""Journal state, drift gates, reverse plans and compensation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowline.operators.capacity import DEFAULT_RESERVE, DEFAULT_SLACK
from stowline.plans.checks import check_last_copy, check_space
from stowline.plans.simulate import PLAN
from stowline.scale import ROWS_PER_BUCKET, lookup_join, order_buckets, previous_in, rank_in

# The journal states in order of progress, and which state may follow which.
STATES = (
    "NotStarted", "ReservedSpace", "ParentAclChecked", "Transferring", "Verifying", "Verified", "AssertedPrivate",
    "DeletingSource", "SourceDeleted", "ReleasedSpace", "Committed", "Compensating", "RolledBack", "NeedsAttention",
)
EDGES = (
    ("NotStarted", "ReservedSpace"),
    ("ReservedSpace", "ParentAclChecked"),
    ("ReservedSpace", "Transferring"),
    ("ReservedSpace", "NotStarted"),
    ("ParentAclChecked", "Transferring"),
    ("Transferring", "Verifying"),
    ("Verifying", "Verified"),
    ("Verifying", "Transferring"),
    ("Verifying", "Compensating"),
    ("Verified", "AssertedPrivate"),
    ("Verified", "DeletingSource"),
    ("Verified", "ReleasedSpace"),
    ("AssertedPrivate", "DeletingSource"),
    ("AssertedPrivate", "ReleasedSpace"),
    ("AssertedPrivate", "Compensating"),
    ("DeletingSource", "SourceDeleted"),
    ("SourceDeleted", "ReleasedSpace"),
    ("ReleasedSpace", "Committed"),
    ("Compensating", "RolledBack"),
)
TERMINAL = ("Committed", "RolledBack", "NeedsAttention")


def edge_table(spark: SparkSession) -> DataFrame:
    """Allowed transitions; any state that is not final may also end in ``NeedsAttention``."""
    edges = list(EDGES) + [(s, "NeedsAttention") for s in STATES if s not in TERMINAL]
    return spark.createDataFrame(edges, "from_state STRING, to_state STRING")


def op_key(rows: DataFrame) -> list[str]:
    """Ops are told apart by library and id; a journal of one library may leave out the library."""
    return [c for c in ("library_id", "op_id") if c in rows.columns]


def latest_state(transitions: DataFrame) -> DataFrame:
    """Newest transition per op, ties by id; reduced before the shuffle. Works on streams too."""
    key = op_key(transitions)
    rest = [c for c in transitions.columns if c not in key]
    newest = transitions.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("updated_at", "event_id")).alias("s"))
    return newest.select(*key, *[F.col(f"s.{c}").alias(c) for c in rest])


def journal_status(transitions: DataFrame, states: tuple[str, ...] = STATES) -> DataFrame:
    """Ops per plan and latest state, one column per state, and how many are in flight."""
    now = latest_state(transitions)
    plan = [c for c in ("library_id", "plan_id") if c in now.columns]
    counts = now.groupBy(*plan).pivot("state", list(states)).agg(F.count(F.lit(1)))
    filled = counts.select(*plan, *[F.coalesce(F.col(s), F.lit(0).cast("long")).alias(s) for s in states])
    flying = [F.col(s) for s in states if s not in TERMINAL and s != "NotStarted"]
    total = F.lit(0).cast("long")
    for column in flying:
        total = total + column
    return filled.withColumn("in_flight", total)


def transition_audit(transitions: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Transitions that are not allowed, with the state before; an op starts from ``NotStarted``."""
    spark = transitions.sparkSession
    key = op_key(transitions)
    stamped = transitions.withColumn("_at", F.unix_micros(F.col("updated_at").cast("timestamp")))
    stamped, buckets = order_buckets(stamped, key, "_at", "event_id", rows_per_bucket=rows_per_bucket)
    moved = previous_in(stamped, key, [F.col("_at"), F.col("event_id")], F.struct("_at", "event_id"), "state",
                        "from_state", buckets)
    steps = moved.withColumn("from_state", F.coalesce("from_state", F.lit("NotStarted"))).withColumn("to_state", F.col("state"))
    real = steps.filter(F.col("from_state") != F.col("to_state"))
    return lookup_join(real, edge_table(spark), ["from_state", "to_state"], "left_anti").select(
        *key, "event_id", "from_state", "to_state")


def needs_attention(transitions: DataFrame) -> DataFrame:
    return latest_state(transitions).filter(F.col("state") == "NeedsAttention")


def resume_actions(journal: DataFrame, stats: DataFrame) -> DataFrame:
    """What a restart does per op, from its state and a fresh look at the dest.

    ``journal`` has the latest row per op with offset, we_created and dest_kind; ``stats`` holds
    (op_id, dest_exists, binding_ok).
    """
    joined = journal.join(stats, "op_id", "left")
    there, bound = F.coalesce("dest_exists", F.lit(False)), F.coalesce("binding_ok", F.lit(False))
    ours = F.coalesce("we_created", F.lit(False))
    state = F.col("state")
    action = (
        F.when(state.isin("Committed", "RolledBack"), "none")
        .when(state == "NeedsAttention", "stop")
        .when((state == "ReservedSpace") & ~there, "release_and_retry")
        .when((state == "Transferring") & (F.coalesce("offset", F.lit(0)) > 0), "continue_transfer")
        .when(state == "Transferring", "restart_transfer")
        .when((state == "Verifying") & (F.col("dest_kind") == "volume"), "rehash")
        .when((state == "Verifying") & bound, "continue")
        .when((state == "Verifying") & ours, "delete_and_restart")
        .when(state == "Verifying", "stop")
        .when(state.isin("AssertedPrivate", "Compensating") & ours & there, "delete_dest")
        .when(state == "Compensating", "roll_back")
        .when((state == "DeletingSource") & there & bound, "finish_delete")
        .when(state == "DeletingSource", "stop")
        .otherwise("continue")
    )
    return joined.withColumn("action", action)


def space_drift(residuals: DataFrame, live: DataFrame, slack: int = DEFAULT_SLACK, reserve: int = DEFAULT_RESERVE) -> DataFrame:
    """Ops that may not start now, with both gates reported.

    Gate one compares live free space with the simulated free space before the op; gate two asks
    whether the op would still honour the reserve. ``live`` holds (library_id, location_id, live_free).
    """
    volumes = residuals.filter(F.col("location_kind") == "volume")
    joined = lookup_join(volumes, live.select("library_id", "location_id", "live_free"), ["library_id", "location_id"], "inner")
    return drift_verdict(joined, slack, reserve).filter(F.col("reason").isNotNull())


def drift_verdict(rows: DataFrame, slack: int, reserve: int) -> DataFrame:
    """``reason`` of the first gate that fails; rows carry kind, size, residual_before and live_free."""
    held = F.when(F.col("kind").isin("download", "shuttle", "ingest"), F.col("size")).otherwise(F.lit(0).cast("long"))
    reason = (
        F.when(F.col("live_free") + F.lit(slack).cast("long") < F.col("residual_before"), "start_free_below_sim")
        .when(F.col("live_free") - held < reserve, "trough_would_breach_reserve")
    )
    return rows.withColumn("held", held).withColumn("reason", reason)


def reverse_plan(ops: DataFrame, journal: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Committed ops backwards: an evict becomes a download, a copy this plan created becomes a delete.

    Renumbered per plan by descending position; an upload it did not create is left in place.
    """
    committed = journal.filter(F.col("state") == "Committed").select(
        "op_id", F.coalesce("we_created", F.lit(False)).alias("we_created")).distinct()
    rows = ops.join(committed, "op_id")
    rows = rows.filter((F.col("kind") == "evict") | F.col("we_created"))
    kind = F.when(F.col("kind") == "evict", "download").otherwise("delete")
    bucket = -F.floor((F.col("seq") - 1) / F.lit(rows_per_bucket)).cast("long")
    ranked = rank_in(rows.withColumn("_bucket", bucket), PLAN, [F.col("seq").desc()], "undo_seq", ["_bucket"])
    return ranked.withColumn("undo_kind", kind).withColumn(
        "undo_location", F.when(F.col("kind") == "evict", F.col("src")).otherwise(F.col("dest"))).select(
        *PLAN, "undo_seq", "op_id", "blob_id", "size", "undo_kind", "undo_location")


def undo_refusals(reverse: DataFrame, replicas: DataFrame, locations: DataFrame, reserve: int = DEFAULT_RESERVE,
                  rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Why a reverse plan is refused: a blob without verified copy, or a trough below the reserve."""
    null = F.lit(None).cast(dict(reverse.dtypes)["undo_location"])
    deletes = F.col("undo_kind") == "delete"
    as_ops = reverse.select(
        *PLAN, F.col("undo_seq").alias("seq"), "blob_id", "size",
        F.when(deletes, "evict").otherwise("download").alias("kind"),
        F.when(deletes, F.col("undo_location")).alias("src"),
        F.when(~deletes, F.col("undo_location")).alias("dest"), null.alias("staging"))
    copies = check_last_copy(as_ops, replicas, rows_per_bucket).groupBy(*PLAN).agg(
        F.count(F.lit(1)).alias("n")).withColumn("reason", F.lit("last_copy"))
    space = check_space(as_ops, locations, reserve, rows_per_bucket).groupBy(*PLAN).agg(
        F.count(F.lit(1)).alias("n")).withColumn("reason", F.lit("reserve_breach"))
    return copies.unionByName(space)


def do_not_eject(journal: DataFrame, ops: DataFrame, locations: DataFrame) -> DataFrame:
    """Removable volumes with ops that transfer or verify now."""
    busy = journal.filter(F.col("state").isin("Transferring", "Verifying")).select("op_id")
    touched = ops.join(busy, "op_id", "left_semi").select(
        "library_id", F.explode(F.array_distinct(F.array("src", "dest", "staging"))).alias("location_id")).filter(
        F.col("location_id").isNotNull())
    counts = touched.groupBy("library_id", "location_id").agg(F.count(F.lit(1)).alias("busy_ops"))
    return locations.filter(F.col("removable")).select("library_id", "location_id").join(counts, ["library_id", "location_id"])


def compensation_list(journal: DataFrame, acl_failures: DataFrame) -> DataFrame:
    """Objects to delete after a failed verification or access check; a failed delete needs a person.

    ``journal`` carries state, we_created, verify_failed and delete_failed; ``acl_failures`` holds op_id.
    """
    public = acl_failures.select("op_id").distinct().withColumn("_public", F.lit(True))
    joined = journal.join(public, "op_id", "left")
    failed = F.coalesce("verify_failed", F.lit(False)) | F.coalesce("_public", F.lit(False))
    action = F.when(F.coalesce("delete_failed", F.lit(False)), "needs_attention").when(
        F.coalesce("we_created", F.lit(False)), "delete_item").otherwise("leave_in_place")
    return joined.filter(failed).withColumn("action", action).drop("_public")
