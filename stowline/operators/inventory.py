"""Listing upkeep: exclusion, hydration, deltas, snapshot differences and scan reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowline.functions.content import hydration
from stowline.functions.paths import dirname, extension, folded, prefixes
from stowline.scale import ROWS_PER_BUCKET, lookup_join, order_buckets, rank_in
from stowline.session import cut_lineage


def exclude_roots(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Files that neither are, nor lie under, a root of their library.

    Only the distinct folders are expanded into their ancestors, so everything is an equi-join and
    the large table is matched once on (library, folder). Compared case-insensitively, on whole names.
    """
    targets = roots.select("library_id", folded(F.col("path")).alias("_root")).distinct()
    keyed = files.withColumn("_dir", F.lower(dirname(F.col("path")))).withColumn("_self", folded(F.col("path")))
    folders = keyed.select("library_id", "_dir").distinct()
    hidden = lookup_join(
        folders.withColumn("_root", F.explode(prefixes(F.col("_dir")))), targets, ["library_id", "_root"], "left_semi"
    ).select("library_id", "_dir").distinct()
    outside = lookup_join(keyed, hidden, ["library_id", "_dir"], "left_anti")
    named = targets.withColumnRenamed("_root", "_self")
    return lookup_join(outside, named, ["library_id", "_self"], "left_anti").select(*files.columns)


def classify_root(candidates: DataFrame, overlays: DataFrame) -> DataFrame:
    """``refuse`` a root that is or lies in an overlay, ``skip_inner`` if it holds one, else ``ok``.

    Both directions are equi-joins of one side's path with the other side's ancestors.
    """
    roots = candidates.withColumn("_root", folded(F.col("root")))
    inner = overlays.select("library_id", folded(F.col("path")).alias("_overlay")).distinct()
    refused = (
        roots.select("library_id", "_root", F.explode(prefixes(F.col("root"))).alias("_overlay")).distinct()
        .join(inner, ["library_id", "_overlay"], "left_semi")
        .select("library_id", "_root").distinct().withColumn("_refused", F.lit(True))
    )
    holding = (
        inner.select("library_id", F.explode(prefixes(F.col("_overlay"))).alias("_root")).distinct()
        .withColumn("_holds", F.lit(True))
    )
    joined = roots.join(refused, ["library_id", "_root"], "left").join(holding, ["library_id", "_root"], "left")
    verdict = F.when(F.col("_refused"), "refuse").when(F.col("_holds"), "skip_inner").otherwise("ok")
    return joined.withColumn("verdict", verdict).select(*candidates.columns, "verdict")


def with_hydration(files: DataFrame) -> DataFrame:
    """Hydration from attribute bits, reparse tag and the kind of the location."""
    return files.withColumn("hydration", hydration(F.col("attrs"), F.col("reparse_tag"), F.col("location_kind")))


def apply_delta(base: DataFrame, changes: DataFrame, keys: tuple[str, ...] = ("library_id", "location_id", "item_key")
                ) -> DataFrame:
    """Latest row per item over ``base`` and ``changes``; removed items are dropped.

    ``changes`` carries ``change_no`` (increasing per item) and ``is_deleted``. An aggregate, not a
    window: rows are reduced before the shuffle, so an item changed a billion times is no hot task.
    Of equal change numbers a removal wins, then the greatest row, so that the result is always the same.
    """
    state = base.withColumn("change_no", F.lit(-1).cast("long")).withColumn("is_deleted", F.lit(False))
    merged = state.unionByName(changes.select(*state.columns))
    payload = [c for c in state.columns if c not in keys]
    latest = merged.groupBy(*keys).agg(F.max_by(F.struct(*payload), F.struct("change_no", "is_deleted", *payload)).alias("row"))
    rest = [F.col(f"row.{c}").alias(c) for c in base.columns if c not in keys]
    return latest.filter(~F.col("row.is_deleted")).select(*keys, *rest)


def stable_key() -> list:
    """Identity of a file inside a volume: its file number, else its path. Never NULL, so it never skews a join."""
    numbered = F.col("ntfs_file_id").isNotNull() & F.col("volume_serial").isNotNull()
    return [
        F.when(numbered, F.concat(F.lit("#"), F.col("volume_serial")))
        .otherwise(F.concat(F.lit("@"), F.col("location_id").cast("string"))).alias("_space"),
        F.when(numbered, F.col("ntfs_file_id").cast("string")).otherwise(F.col("path")).alias("_item"),
    ]


def diff_snapshots(prev: DataFrame, curr: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """One row per path of either snapshot: new, missing, renamed, changed or unchanged.

    Several paths may share one file number (hard links). Equal paths of a file meet first; only what is left of a file,
    old paths and new ones, is paired, by the rank of the paths' digests on either side, and each pair is a rename. So a
    link that stays is never taken for a renamed one, and n old and m new paths give max(n, m) rows. A number that a broken
    volume gives to all its files is ranked in buckets. ``prev`` and ``curr`` hold one row per path of a volume.
    """
    place = ["library_id", "_space", "_item"]

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select("library_id", *stable_key(), F.col("path").alias("_path"), F.struct("size", "mtime_utc").alias(tag))

    met = side(prev, "old").join(side(curr, "new"), [*place, "_path"], "full")
    # Met once and stored: what is kept needs no file number any more.
    single = F.col("old").isNull() | F.col("new").isNull()
    met = cut_lineage(met.select("library_id", *[F.when(single, F.col(c)).alias(c) for c in place[1:]], "_path", "old", "new", single.alias("_single")), "_single")
    sides = [F.when(F.col(c).isNotNull(), F.struct(F.col("_path").alias("path"), f"{c}.size", f"{c}.mtime_utc")).alias(c) for c in ("old", "new")]
    kept = met.filter("NOT _single").select("library_id", *sides)
    left = met.filter("_single").select(
        *place, F.col("old").isNull().alias("_side"), F.md5(F.col("_path").cast("binary")).alias("_by"),
        F.conv(F.substring(F.md5(F.col("_path").cast("binary")), 1, 12), 16, 10).cast("long").alias("_lead"), "_path", *sides)
    left = cut_lineage(left)
    group = [*place, "_side"]
    left, buckets = order_buckets(left, group, "_lead", rows_per_bucket=rows_per_bucket)
    ranked = rank_in(left, group, [F.col("_lead"), F.col("_by"), F.col("_path")], "_rank", buckets)
    paired = ranked.groupBy(*place, "_rank").agg(F.max("old").alias("old"), F.max("new").alias("new"))
    both = kept.unionByName(paired.select("library_id", "old", "new"))
    same = F.col("old.size").eqNullSafe(F.col("new.size")) & F.col("old.mtime_utc").eqNullSafe(F.col("new.mtime_utc"))
    change = (
        F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "missing")
        .when(F.col("old.path") != F.col("new.path"), "renamed")
        .when(~same, "changed").otherwise("unchanged")
    )
    return both.select(
        "library_id", F.coalesce("new.path", "old.path").alias("path"),
        F.when(change == "renamed", F.col("old.path")).alias("old_path"),
        change.alias("change"), (F.col("old").isNotNull() & F.col("new").isNotNull() & ~same).alias("body_changed"),
    )


def scan_summary(files: DataFrame, scans: DataFrame) -> DataFrame:
    """Files last seen by each scan, with its status and duration in seconds."""
    seen = files.groupBy("library_id", F.col("last_scan_id").alias("id")).agg(F.count(F.lit(1)).alias("files_seen"))
    base = scans.drop("files_seen") if "files_seen" in scans.columns else scans
    joined = base.join(seen, ["library_id", "id"], "left")
    return joined.select(
        "library_id", F.col("id").alias("scan_id"), "provider_id", "status",
        F.coalesce("files_seen", F.lit(0).cast("long")).alias("files_seen"),
        (F.unix_seconds(F.col("finished_at").cast("timestamp"))
         - F.unix_seconds(F.col("started_at").cast("timestamp"))).alias("duration_s"),
    )


def files_not_seen(files: DataFrame, scans: DataFrame) -> DataFrame:
    """Files whose last scan precedes the latest finished full scan of their provider; reported, not deleted."""
    full = scans.filter((F.col("status") == "ok") & F.col("is_full")).groupBy("library_id", "provider_id").agg(
        F.max("id").alias("latest_full"))
    joined = lookup_join(files, full, ["library_id", "provider_id"], "inner")
    return joined.filter(F.coalesce(F.col("last_scan_id"), F.lit(-1)) < F.col("latest_full"))


def mime_lookup(files: DataFrame, table: DataFrame) -> DataFrame:
    """MIME type by extension for ``local_full`` files; a known type and every other file stay as they are."""
    types = table.select(F.lower("extension").alias("_ext"), F.col("mime").alias("_mime"))
    keyed = files.withColumn("_ext", F.when(F.col("hydration") == "local_full", extension(F.col("path"))).otherwise(""))
    joined = lookup_join(keyed, types, ["_ext"], "left")
    return joined.withColumn("mime", F.coalesce("mime", "_mime")).drop("_ext", "_mime")


def provider_summary(providers: DataFrame, scans: DataFrame, files: DataFrame, capacity: DataFrame) -> DataFrame:
    """Provider, last finished scan and its time, file count and latest free bytes, one row each."""
    last = scans.filter(F.col("status") == "ok").groupBy("library_id", "provider_id").agg(
        F.max("id").alias("last_scan_id"), F.max_by("finished_at", "id").cast("timestamp").alias("last_index_at"))
    counts = files.groupBy("library_id", "provider_id").agg(F.count(F.lit(1)).alias("files"))
    free = capacity.groupBy("library_id", "provider_id").agg(F.sum("free_bytes").alias("free_bytes"))
    keyed = providers.withColumnRenamed("id", "provider_id")
    for side in (last, counts, free):
        keyed = keyed.join(side, ["library_id", "provider_id"], "left")
    return keyed.select(
        "library_id", "provider_id", "kind", "account", "last_scan_id", "last_index_at",
        F.coalesce("files", F.lit(0).cast("long")).alias("files"), "free_bytes",
    )
