"""Free space: latest snapshots, usable bytes, picks and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowline.functions.units import GIB, MIB, format_bytes, usable
from stowline.scale import lookup_join

# Default reserve, its floor, the drift slack and the free space a data folder needs.
DEFAULT_RESERVE = GIB
RESERVE_FLOOR = 64 * MIB
DEFAULT_SLACK = 64 * MIB
MIN_DATA_DIR_FREE = 8 * GIB


def latest_capacity(snapshots: DataFrame) -> DataFrame:
    """Newest snapshot per location, ties by snapshot id; reduced before the shuffle."""
    key = ["library_id", "location_id"]
    rest = [c for c in snapshots.columns if c not in key]
    newest = snapshots.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct("measured_at", "id")).alias("s"))
    return newest.select(*key, *[F.col(f"s.{c}").alias(c) for c in rest])


def with_usable(capacity: DataFrame, reserve: int | Column = DEFAULT_RESERVE, in_flight: str | None = None) -> DataFrame:
    """Usable bytes: free minus reserve and in-flight, at least 0. Clouds keep no reserve."""
    keep = reserve if isinstance(reserve, Column) else F.lit(reserve).cast("long")
    held = F.coalesce(F.col(in_flight), F.lit(0)).cast("long") if in_flight else F.lit(0).cast("long")
    floor = F.when(F.col("kind") == "volume", keep).otherwise(F.lit(0).cast("long"))
    return capacity.withColumn("usable", usable(F.col("free_bytes"), floor, held))


def capacity_report(capacity: DataFrame, projected: DataFrame, reserve: int = DEFAULT_RESERVE) -> DataFrame:
    """Used, free, quota, reserve, usable and projected bytes per location, with subtotals per removable flag, kind and library.

    A subtotal has NULL in the columns it runs over; ``locations`` counts what a row sums. ``projected`` holds
    (library_id, location_id, free_after) of a plan; without one free stays. Only volumes keep the reserve.
    """
    joined = with_usable(capacity, reserve).join(projected, ["library_id", "location_id"], "left")
    flat = joined.withColumn("projected", F.coalesce("free_after", "free_bytes")).withColumn(
        "reserve", F.when(F.col("kind") == "volume", F.lit(reserve)).otherwise(F.lit(0)).cast("long"))
    for column in ("used_bytes", "quota_bytes"):
        if column not in flat.columns:
            flat = flat.withColumn(column, F.lit(None).cast("long"))
    totals = flat.rollup("library_id", "kind", "removable", "location_id").agg(
        F.count(F.lit(1)).alias("locations"),
        *[F.sum(c).alias(c) for c in ("used_bytes", "free_bytes", "quota_bytes", "reserve", "usable", "projected")])
    return totals.withColumn("free_text", format_bytes(F.col("free_bytes")))


def most_free(choices: DataFrame, capacity: DataFrame) -> DataFrame:
    """Per choice key the listed location with most free bytes, ties by lowest id.

    ``choices``: one row per (library_id, choice, location_id).
    """
    joined = lookup_join(choices, capacity.select("library_id", "location_id", "free_bytes"), ["library_id", "location_id"], "inner")
    best = F.min(F.struct((-F.col("free_bytes")).alias("less"), "location_id"))
    return joined.groupBy("library_id", "choice").agg(best.alias("b")).select(
        "library_id", "choice", F.col("b.location_id").alias("location_id"), (-F.col("b.less")).alias("free_bytes"))


def staging_candidates(locations: DataFrame) -> DataFrame:
    """Per library the online volume with most usable bytes among shuttle volumes, and among the others.

    ``locations`` carries usable, is_shuttle, is_overlay, kind and is_online.
    """
    volumes = locations.filter(
        (F.col("kind") == "volume") & F.col("is_online") & ~F.coalesce(F.col("is_overlay"), F.lit(False)))
    pick = F.struct((-F.col("free_bytes")).alias("less"), "location_id", "usable")
    return volumes.groupBy("library_id").agg(
        F.min(F.when(F.col("is_shuttle"), pick)).alias("shuttle"), F.min(F.when(~F.col("is_shuttle"), pick)).alias("other"))


def pick_staging(ops: DataFrame, locations: DataFrame) -> DataFrame:
    """Staging volume per op: the roomiest shuttle volume if the body fits, else the roomiest other, else NULL."""
    joined = lookup_join(ops, staging_candidates(locations), ["library_id"], "left")
    choice = (
        F.when(F.col("shuttle.usable") >= F.col("size"), F.col("shuttle.location_id"))
        .when(F.col("other.usable") >= F.col("size"), F.col("other.location_id"))
    )
    return joined.withColumn("staging", choice).drop("shuttle", "other")


def recommend_volume(volumes: DataFrame) -> DataFrame:
    """Per host: the default if the system volume has 8 GiB free, else the largest other that has, else the default."""
    per_host = volumes.groupBy("host").agg(
        F.max(F.when(F.col("is_system"), F.col("free_bytes"))).alias("system_free"),
        F.max(F.when(~F.col("is_system"), F.struct("free_bytes", "root"))).alias("best"),
    )
    move = (F.coalesce(F.col("system_free"), F.lit(0)) < MIN_DATA_DIR_FREE) & (F.col("best.free_bytes") >= MIN_DATA_DIR_FREE)
    return per_host.select(
        "host", F.when(move, "recommend").otherwise("use_default").alias("advice"),
        F.when(move, F.col("best.root")).alias("root"), F.when(move, F.col("best.free_bytes")).alias("free_bytes"))


def reserve_breaches(capacity: DataFrame, reserve: int = DEFAULT_RESERVE) -> DataFrame:
    """Volumes that already hold less free space than the reserve."""
    return capacity.filter((F.col("kind") == "volume") & (F.col("free_bytes") < reserve))


def resolve_volumes(mounts: DataFrame) -> DataFrame:
    """One location per volume serial: its newest mount root."""
    return mounts.groupBy("library_id", "volume_serial").agg(
        F.max_by("root", F.struct("seen_at", "root")).alias("root"), F.max("seen_at").alias("seen_at"),
        F.count_distinct("root").alias("roots_seen"))


def require_online(ops: DataFrame, locations: DataFrame) -> DataFrame:
    """Ops that touch an unmounted source, dest or staging location, one row per role; non-empty means stop."""
    down = locations.filter(~F.col("is_online")).select(
        "library_id", "location_id", *[c for c in ("label", "volume_serial") if c in locations.columns])
    touched = ops.select("library_id", "plan_id", "seq", F.explode(F.array(*[
        F.struct(F.lit(role).alias("role"), F.col(role).alias("location_id")) for role in ("src", "dest", "staging")
    ])).alias("t")).select("library_id", "plan_id", "seq", "t.role", "t.location_id").filter("location_id IS NOT NULL")
    return lookup_join(touched, down, ["library_id", "location_id"], "inner")
