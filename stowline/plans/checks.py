"""Independent re-checks of a plan. Each returns the violations, so a safe plan returns no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowline.operators.dups import usable_verified
from stowline.operators.identity import BLOB_KEY
from stowline.operators.policy import dest_conflicts
from stowline.plans.simulate import PLAN
from stowline.scale import ROWS_PER_BUCKET, lookup_join, order_buckets, position_bucket, rank_in, running_sum, skew_join
from stowline.session import cut_lineage


def space_ledger(ops: DataFrame, locations: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Troughs and ends per op and location from separate ledgers of bytes freed, placed and held.

    Built from the op kinds alone, without the deltas the simulation uses.
    """
    zero = F.lit(0).cast("long")
    freed = ops.filter("kind = 'evict'").select(
        *PLAN, "seq", F.col("src").alias("location_id"), F.col("size").alias("freed"), zero.alias("placed"), zero.alias("held"))
    placed = ops.filter("kind <> 'evict' AND dest IS NOT NULL").select(
        *PLAN, "seq", F.col("dest").alias("location_id"), zero.alias("freed"), F.col("size").alias("placed"), zero.alias("held"))
    held = ops.filter("kind = 'shuttle' AND staging IS NOT NULL").select(
        *PLAN, "seq", F.col("staging").alias("location_id"), zero.alias("freed"), zero.alias("placed"), F.col("size").alias("held"))
    kept = ops.filter("kind IN ('upload_keep', 'upload_evict') AND src IS NOT NULL").select(
        *PLAN, "seq", F.col("src").alias("location_id"), zero.alias("freed"), zero.alias("placed"), zero.alias("held"))
    rows = freed.unionByName(placed).unionByName(held).unionByName(kept).withColumn("_bucket", position_bucket("seq", rows_per_bucket))
    key = [*PLAN, "location_id"]
    rows = running_sum(rows, key, [F.col("seq")], F.col("freed"), "_freed", ["_bucket"])
    rows = running_sum(rows, key, [F.col("seq")], F.col("placed"), "_placed", ["_bucket"])
    start = locations.select("library_id", "location_id", F.col("kind").alias("location_kind"), "free_bytes")
    end = F.col("free_bytes") + F.col("_freed") - F.col("_placed")
    return rows.join(start, ["library_id", "location_id"]).select(
        *PLAN, "seq", "location_id", "location_kind", (end - F.col("held")).alias("during"), end.alias("after"))


def check_space(ops: DataFrame, locations: DataFrame, reserve: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Ops that leave a volume below the reserve, during or after."""
    return space_ledger(ops, locations, rows_per_bucket).filter(
        (F.col("location_kind") == "volume") & (F.least("during", "after") < reserve))


def verified_changes(ops: DataFrame) -> DataFrame:
    """+1 for each copy an op verifies at a dest, -1 for each evict."""
    change = F.when(F.col("kind") == "evict", -1).otherwise(1).cast("long")
    return ops.select(*PLAN, "blob_id", "seq", change.alias("change"))


def check_last_copy(ops: DataFrame, replicas: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Blobs with a verified copy, at the start or later, that reach none after some op."""
    base = replicas.filter(usable_verified()).groupBy(*BLOB_KEY).agg(F.count(F.lit(1)).alias("verified"))
    steps = verified_changes(ops).withColumn("_bucket", position_bucket("seq", rows_per_bucket))
    net = running_sum(steps, [*PLAN, "blob_id"], [F.col("seq")], F.col("change"), "_net", ["_bucket"])
    joined = net.join(base, BLOB_KEY, "left").withColumn("left", F.coalesce("verified", F.lit(0)) + F.col("_net"))
    per_blob = joined.groupBy(*PLAN, "blob_id").agg(
        F.min("left").alias("lowest"), F.min(F.when(F.col("left") < 1, F.col("seq"))).alias("first_seq"),
        F.max((F.col("left") >= 1) | (F.coalesce("verified", F.lit(0)) > 0)).alias("_had"))
    return per_blob.filter(F.col("_had") & (F.col("lowest") < 1)).drop("_had")


def check_goal(goals: DataFrame, dropped: DataFrame, replicas: DataFrame, ops: DataFrame) -> DataFrame:
    """Goals, less the preferred ones given up, that the final state does not hold."""
    key = [*BLOB_KEY, "location_id"]
    whole = replicas.filter((F.col("hydration") != "placeholder") & F.col("state").isin("verified", "suspect"))
    arrived = ops.filter("kind <> 'evict'").select(*BLOB_KEY, F.col("dest").alias("location_id"))
    gone = ops.filter("kind = 'evict'").select(*BLOB_KEY, "file_id")
    final = whole.select(*key, "file_id").join(gone, [*BLOB_KEY, "file_id"], "left_anti").select(*key).unionByName(arrived)
    wanted = goals.join(dropped.select(*BLOB_KEY, "dest"), [*BLOB_KEY, "dest"], "left_anti")
    return wanted.join(final.withColumnRenamed("location_id", "dest"), [*BLOB_KEY, "dest"], "left_anti")


def check_prefix(residuals: DataFrame, ledger: DataFrame) -> DataFrame:
    """Ops where the simulation and the ledger disagree on a residual, or only one of them has the row."""
    key = [*PLAN, "seq", "location_id"]
    left = residuals.select(*key, "residual_during", "residual_after")
    right = ledger.groupBy(*key).agg(F.min("during").alias("during"), F.min("after").alias("after"))
    joined = left.join(right, key, "full")
    same = F.col("residual_during").eqNullSafe(F.col("during")) & F.col("residual_after").eqNullSafe(F.col("after"))
    return joined.filter(~same)


def check_no_overwrite(ops: DataFrame, files: DataFrame) -> DataFrame:
    """Ops whose dest path holds, or will hold, another blob. ``ops`` carry dest_path."""
    writes = ops.filter("kind <> 'evict'")
    return dest_conflicts(writes, files).filter(F.col("verdict") == "needs_manual")


def check_placeholder(ops: DataFrame, files: DataFrame) -> DataFrame:
    """Ops that would read a placeholder."""
    hollow = files.filter(F.col("hydration") == "placeholder").select("library_id", "file_id")
    return ops.join(hollow, ["library_id", "file_id"], "left_semi")


def cloud_delete_audit(ops: DataFrame, locations: DataFrame) -> DataFrame:
    """Evicts whose source is a cloud location."""
    clouds = locations.filter(F.col("kind") == "cloud").select("library_id", F.col("location_id").alias("src"))
    return lookup_join(ops.filter("kind = 'evict'"), clouds, ["library_id", "src"], "left_semi")


# What to suggest for each reason a placement is left over.
SUGGESTIONS = {
    "no_source": "restore_or_rescan_source",
    "no_goal": "add_target_or_provider",
    "cloud_full": "add_provider_quota",
    "volume_full": "mark_cloud_only_or_lower_reserve",
    "staging_full": "attach_shuttle_volume_or_free_space",
}


def unsat_report(leftover: DataFrame, locations: DataFrame) -> DataFrame:
    """Per library and reason: how many placements are left, the smallest shortfall, and what may help.

    ``leftover`` holds (library_id, dest, dest_kind, size, op_class, no_source); locations carry usable.
    """
    room = locations.select("library_id", F.col("location_id").alias("dest"), "usable")
    joined = lookup_join(leftover, room, ["library_id", "dest"], "left")
    short = F.col("size") - F.greatest(F.coalesce("usable", F.lit(0).cast("long")), F.lit(0).cast("long"))
    reason = (
        F.when(F.col("no_source"), "no_source").when(F.col("dest_kind") == "volume", "volume_full")
        .when((F.col("op_class") == "shuttle") & (short <= 0), "staging_full").otherwise("cloud_full")
    )
    hints = F.create_map(*[F.lit(x) for pair in SUGGESTIONS.items() for x in pair])
    return joined.withColumn("reason", reason).withColumn("_short", F.greatest(short, F.lit(0).cast("long"))).groupBy(
        "library_id", "reason").agg(
        F.count(F.lit(1)).alias("leftover"), F.sum("size").alias("bytes"), F.min("_short").alias("min_shortfall"),
    ).withColumn("suggestion", F.element_at(hints, F.col("reason")))


def authorise_delete(evicts: DataFrame, replicas: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Verdict per evict: permitted only while another counted copy of the blob remains.

    Counted are verified copies on mounted locations, except placeholders; a cloud copy counts only
    with ``binding = 'bound'`` from a fresh stat. Evicts of one blob that are legal by themselves are numbered, so
    that a batch cannot remove all of them; a refused row takes no number.
    """
    stands = usable_verified() & ((F.col("location_kind") == "volume") | (F.col("binding") == "bound"))
    counted = replicas.filter(stands).groupBy(*BLOB_KEY).agg(F.count(F.lit(1)).alias("counted"))
    own = replicas.select("library_id", "file_id", stands.alias("_self"), (F.col("location_kind") == "volume").alias("_local"))
    # The bucket sizes, the hot keys and the verdicts all read the evicts with their replicas, so these are stored first.
    rows = cut_lineage(evicts.join(own, ["library_id", "file_id"], "left").withColumn("_self", F.coalesce("_self", F.lit(False))))
    rows, buckets = order_buckets(rows, BLOB_KEY, "file_id", rows_per_bucket=rows_per_bucket)
    rows = skew_join(rows, counted, BLOB_KEY, "left", hot_rows=rows_per_bucket)
    legal = F.col("_self") & F.coalesce("_local", F.lit(False))
    ranked = running_sum(rows, BLOB_KEY, [F.col("file_id")], legal.cast("long"), "evict_no", buckets)
    remaining = F.coalesce("counted", F.lit(0)) - F.col("evict_no")
    verdict = (
        F.when(~F.coalesce("_local", F.lit(False)), "refused_not_local").when(~F.col("_self"), "refused_not_verified")
        .when(remaining >= 1, "permit").otherwise("refused_last_copy")
    )
    return ranked.withColumn("verdict", verdict).drop("_self", "_local", "_b1", "counted")
