"""What a plan that is stuck would need: the least space, per location, that lets its leftovers in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowline.operators.capacity import staging_candidates
from stowline.scale import ROWS_PER_BUCKET, lookup_join, order_buckets, running_sum

PLACE = ["library_id", "dest"]

# Fixed value: the lowest reserve that may be set without a special consent.
RESERVE_FLOOR = 64 << 20


def blocked(leftover: DataFrame, balance: DataFrame) -> DataFrame:
    """Leftover placements with ``usable`` of their dest and the ``cause``: volume_full, cloud_full or staging_full.

    ``balance`` is what the plan leaves: locations with kind, free_bytes, usable, is_online, is_shuttle and is_overlay. A
    shuttle whose dest has room waits for staging space; ``staging_usable`` is the most that a staging volume has left.
    """
    room = balance.select("library_id", F.col("location_id").alias("dest"), F.greatest("usable", F.lit(0).cast("long")).alias("usable"))
    hop = staging_candidates(balance).select(
        "library_id", F.greatest("shuttle.usable", "other.usable", F.lit(0).cast("long")).alias("staging_usable"))
    zero = F.lit(0).cast("long")
    rows = lookup_join(lookup_join(leftover, room, PLACE, "left"), hop, ["library_id"], "left").withColumns(
        {"usable": F.coalesce("usable", zero), "staging_usable": F.coalesce("staging_usable", zero)})
    waits = (F.col("op_class") == "shuttle") & (F.col("size") <= F.col("usable")) & (F.col("size") > F.col("staging_usable"))
    cause = F.when(F.col("dest_kind") == "volume", "volume_full").when(waits, "staging_full").otherwise("cloud_full")
    return rows.withColumn("cause", cause)


def shortfall_steps(leftover: DataFrame, balance: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """(library_id, dest, cause, nth, blob_id, size, extra_bytes): the leftovers of each location, smallest first, and how many
    bytes more it would take to let the first n in.

    The least space for n leftovers is that of the n smallest, a running sum against what the plan leaves free. A body in
    staging goes again before the next one comes, so there the n-th step needs room for the n-th body only. A location
    with very many leftovers is summed in buckets.
    """
    rows = blocked(leftover, balance)
    key = [*PLACE, "cause"]
    rows, buckets = order_buckets(rows, key, "size", "blob_id", rows_per_bucket=rows_per_bucket)
    order = [F.col("size"), F.col("blob_id")]
    rows = running_sum(rows, key, order, F.col("size"), "_sum", buckets)
    rows = running_sum(rows, key, order, F.lit(1).cast("long"), "nth", buckets)
    zero = F.lit(0).cast("long")
    extra = F.when(F.col("cause") == "staging_full", F.col("size") - F.col("staging_usable")).otherwise(F.col("_sum") - F.col("usable"))
    return rows.select(*key, "nth", "blob_id", "size", F.greatest(extra, zero).alias("extra_bytes"))


def shortfall_report(leftover: DataFrame, balance: DataFrame, reserve: int, ops: DataFrame | None = None) -> DataFrame:
    """Per (library_id, dest, cause): leftovers, their bytes, the least extra bytes for one and for all, and what may help.

    ``suggestions`` depend on the cause and on what the figures allow: a lower reserve only if it would let one in above the
    floor, another order only where ``ops`` holds a download on the staging side, a volume to plug in only where one is
    unmounted that could help.
    """
    rows = blocked(leftover, balance)
    zero = F.lit(0).cast("long")
    need = F.when(F.col("cause") == "staging_full", F.col("staging_usable")).otherwise(F.col("usable"))
    per_place = rows.groupBy(*PLACE, "cause").agg(
        F.count(F.lit(1)).alias("leftovers"), F.sum("size").alias("bytes"), F.min("size").alias("_one"),
        F.when(F.col("cause") == "staging_full", F.max("size")).otherwise(F.sum("size")).alias("_all"), F.max(need).alias("_have"))
    offline = balance.filter((F.col("kind") == "volume") & ~F.col("is_online") & F.coalesce("is_shuttle", F.lit(False))).groupBy("library_id").agg(
        F.count(F.lit(1)).alias("_offline"))
    loads = None if ops is None else ops.filter("kind = 'download'").groupBy("library_id").agg(F.count(F.lit(1)).alias("_loads"))
    marked = lookup_join(per_place, offline, ["library_id"], "left")
    marked = marked.withColumn("_loads", zero) if loads is None else lookup_join(marked, loads, ["library_id"], "left")
    one, every = F.greatest(F.col("_one") - F.col("_have"), zero), F.greatest(F.col("_all") - F.col("_have"), zero)
    volume, cloud, staging = (F.col("cause") == c for c in ("volume_full", "cloud_full", "staging_full"))
    spare = max(reserve - RESERVE_FLOOR, 0)
    hints = F.filter(F.array(
        F.when(volume, "mark_cloud_only"), F.when((volume | staging) & (one <= spare), "lower_reserve"),
        F.when(volume | staging, "free_unreferenced_files"), F.when(cloud, "add_provider_quota"),
        F.when(staging & (F.coalesce("_offline", zero) > 0), "plug_in_shuttle_volume"), F.when(staging, "attach_shuttle_volume"),
        F.when(staging & (F.coalesce("_loads", zero) > 0), "move_download_after_shuttle")), lambda h: h.isNotNull())
    return marked.select(*PLACE, "cause", "leftovers", "bytes", one.alias("least_for_one"), every.alias("least_for_all"), hints.alias("suggestions"))
