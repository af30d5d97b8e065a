"""Residual free space of a plan, and its summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowline.functions.units import format_bytes
from stowline.scale import ROWS_PER_BUCKET, position_bucket, running_sum

PLAN = ["library_id", "plan_id"]

# How each kind is undone.
ROLLBACK_NOTES = {
    "upload_keep": "Delete the cloud item if this plan created it and verification or access check fails",
    "upload_evict": "Delete the cloud item if this plan created it and verification or access check fails",
    "evict": "Download again from the stored cloud reference while its checksum still matches",
    "download": "Delete the local temporary or final file",
    "shuttle": "Delete the staging file, and the cloud item if this plan created it",
    "ingest": "Delete the local temporary file",
}


def effects(ops: DataFrame) -> DataFrame:
    """One row per op and location it touches: bytes while it runs and bytes for good.

    A shuttle holds its body on the staging volume only while it runs; an evict gives bytes back; an
    upload leaves its source volume as it is, which is stated as a zero row.
    """
    size, none = F.col("size"), F.lit(0).cast("long")

    def hit(location: Column, during: Column, after: Column) -> Column:
        return F.struct(location.alias("location_id"), during.alias("during_delta"), after.alias("after_delta"))

    kind = F.col("kind")
    dest = hit(F.col("dest"), -size, -size)
    touched = (
        F.when(kind == "evict", F.array(hit(F.col("src"), size, size)))
        .when(kind == "shuttle", F.array(dest, hit(F.col("staging"), -size, none)))
        .when(kind.isin("upload_keep", "upload_evict"), F.array(dest, hit(F.col("src"), none, none)))
        .otherwise(F.array(dest))
    )
    rows = ops.select(*PLAN, "seq", "kind", "size", F.explode(touched).alias("t"))
    return rows.select(*PLAN, "seq", "kind", "size", "t.location_id", "t.during_delta", "t.after_delta").filter(
        F.col("location_id").isNotNull())


def simulate(ops: DataFrame, locations: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Residual during and after each op on every location it touches.

    The running sum is split at every ``rows_per_bucket`` positions, so one plan that holds a third of
    all operations on one location is many tasks.
    """
    key = [*PLAN, "location_id"]
    steps = effects(ops).withColumn("_bucket", position_bucket("seq", rows_per_bucket))
    summed = running_sum(steps, key, [F.col("seq")], F.col("after_delta"), "_net", ["_bucket"])
    start = locations.select("library_id", "location_id", "kind", "free_bytes").withColumnRenamed("kind", "location_kind")
    joined = summed.join(start, ["library_id", "location_id"])
    after = F.col("free_bytes") + F.col("_net")
    return joined.select(
        *PLAN, "seq", "kind", "size", "location_id", "location_kind",
        (after - F.col("after_delta") + F.col("during_delta")).alias("residual_during"), after.alias("residual_after"),
        (after - F.col("after_delta")).alias("residual_before"),
    )


def residual_maps(ops: DataFrame, residuals: DataFrame) -> DataFrame:
    """Ops with their two residual maps; an op touches two locations at most, so the maps are bounded."""
    maps = residuals.groupBy(*PLAN, "seq").agg(*[
        F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("location_id").cast("string"), F.col(c))))).alias(c)
        for c in ("residual_during", "residual_after")])
    notes = F.create_map(*[F.lit(x) for pair in ROLLBACK_NOTES.items() for x in pair])
    return ops.join(maps, [*PLAN, "seq"], "left").withColumn("rollback_note", F.element_at(notes, F.col("kind")))


def plan_summary(ops: DataFrame, residuals: DataFrame, problems: DataFrame) -> DataFrame:
    """Ops, moved bytes (evicts excluded), lowest trough on a volume, and status per plan.

    ``problems`` holds (library_id, plan_id, problem) with ``unsatisfiable`` or ``needs_manual``.
    """
    moved = F.when(F.col("kind") != "evict", F.col("size")).otherwise(F.lit(0).cast("long"))
    counts = ops.groupBy(*PLAN).agg(F.count(F.lit(1)).alias("ops"), F.sum(moved).alias("moved_bytes"))
    trough = residuals.filter(F.col("location_kind") == "volume").groupBy(*PLAN).agg(
        F.min("residual_during").alias("min_residual"))
    bad = problems.groupBy(*PLAN).agg(
        F.count_if(F.col("problem") == "unsatisfiable").alias("_unsat"), F.count_if(F.col("problem") == "needs_manual").alias("_manual"))
    joined = counts.join(trough, PLAN, "left").join(bad, PLAN, "full")
    status = F.when(F.col("_unsat") > 0, "unsatisfiable").when(F.col("_manual") > 0, "needs_manual").otherwise("drafted")
    zero = F.lit(0).cast("long")
    return joined.select(*PLAN, F.coalesce("ops", zero).alias("ops"), F.coalesce("moved_bytes", zero).alias("moved_bytes"),
                         "min_residual", status.alias("status"))


def plan_show(ops: DataFrame, residuals: DataFrame) -> DataFrame:
    """Readable listing in plan order: size, places, residuals of the volume touched, rollback note."""
    volume = residuals.filter(F.col("location_kind") == "volume").groupBy(*PLAN, "seq").agg(
        F.min("residual_during").alias("_during"), F.min("residual_after").alias("_after"))
    notes = F.create_map(*[F.lit(x) for pair in ROLLBACK_NOTES.items() for x in pair])
    return ops.join(volume, [*PLAN, "seq"], "left").select(
        *PLAN, "seq", "kind", "blob_id", format_bytes(F.col("size")).alias("size_text"), "src", "dest",
        format_bytes(F.col("_during")).alias("during_text"), format_bytes(F.col("_after")).alias("after_text"),
        F.element_at(notes, F.col("kind")).alias("rollback_note"),
    ).orderBy(*PLAN, "seq")


def cap_plan(ops: DataFrame, max_bytes: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Longest prefix per plan whose moved bytes stay within ``max_bytes``; evicts move nothing."""
    moved = F.when(F.col("kind") != "evict", F.col("size")).otherwise(F.lit(0).cast("long"))
    bucketed = ops.withColumn("_bucket", position_bucket("seq", rows_per_bucket))
    return running_sum(bucketed, PLAN, [F.col("seq")], moved, "moved_so_far", ["_bucket"]).filter(
        F.col("moved_so_far") <= max_bytes).drop("_bucket")
