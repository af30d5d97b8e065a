"""Placement policy: from first-match collections to goal locations per blob."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowline.functions.paths import basename, place_key
from stowline.functions.rules import KEEP_LOCAL, MATCH_INPUTS, Rule, collection_of, with_match_inputs
from stowline.operators.capacity import most_free
from stowline.operators.identity import BLOB_KEY
from stowline.scale import ROWS_PER_BUCKET, lookup_join, order_buckets, rank_in, running_sum, skew_join
from stowline.session import cut_lineage

POLICY_SCHEMA = ("library_id BIGINT, collection STRING, ord INT, keep_local STRING, min_replicas INT, "
                 "cloud_choice STRING, pin_local BOOLEAN, dest_subdir STRING")
MEMBER_SCHEMA = "library_id BIGINT, collection STRING, role STRING, ord INT, location_id STRING"


def policy_tables(spark: SparkSession, rules: Sequence[Rule], library_ids: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """The rules as two tables per library: one row per collection, one per listed location."""
    heads, members = [], []
    for lib in library_ids:
        for n, rule in enumerate(rules):
            p = rule.policy
            heads.append((lib, rule.name, n, p.keep_local, p.min_replicas, p.cloud_choice, p.pin_local, p.dest_subdir))
            members += [(lib, rule.name, "local", i, loc) for i, loc in enumerate(p.local_targets)]
            members += [(lib, rule.name, "cloud", i, loc) for i, loc in enumerate(p.clouds)]
    return spark.createDataFrame(heads, POLICY_SCHEMA), spark.createDataFrame(members, MEMBER_SCHEMA)


def classify(files: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """First matching collection in document order, else ``default``; one chained expression in one scan."""
    return with_match_inputs(files).withColumn("collection", collection_of(rules)).drop(*MATCH_INPUTS)


def keep_rank(column: str = "keep_local") -> Column:
    """0 cloud_only, 1 prefer, 2 required: a higher rank is more conservative."""
    return F.array_position(F.array(*[F.lit(k) for k in KEEP_LOCAL]), F.col(column)).cast("int") - 1


def rank_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in KEEP_LOCAL]), rank + 1)


def desired_placement(files: DataFrame, policies: DataFrame) -> DataFrame:
    """Attach the policy of the file's collection."""
    return lookup_join(files, policies, ["library_id", "collection"], "left")


def collapse_to_blob(placed: DataFrame) -> DataFrame:
    """One placement per blob: strictest keep_local, highest min_replicas, any pin, union of collections.

    Cloud choice, targets and folder come from the strictest collection, the earliest one on ties.
    The collected set is bounded by the number of collections. A blob's files meet per policy first, as numbers only.
    """
    placed = placed.groupBy(*BLOB_KEY, "collection", "keep_local", "cloud_choice", "dest_subdir", "ord").agg(
        F.max("min_replicas").alias("min_replicas"), F.max(F.coalesce(F.col("pin_local"), F.lit(False))).alias("pin_local"),
        F.max("size").alias("size"))
    winner = F.min_by(F.struct("collection", "cloud_choice", "dest_subdir", "ord"),
                      F.struct((-keep_rank()).alias("r"), "ord"))
    return placed.groupBy(*BLOB_KEY).agg(
        F.max(keep_rank()).alias("_rank"), F.max("min_replicas").alias("min_replicas"),
        F.max("pin_local").alias("pin_local"), winner.alias("w"),
        F.array_join(F.sort_array(F.collect_set("collection")), "|").alias("collections"),
        F.max("size").alias("size"),
    ).select(
        *BLOB_KEY, rank_name(F.col("_rank")).alias("keep_local"), "min_replicas", "pin_local", "collections", "size",
        F.col("w.collection").alias("collection"), F.col("w.cloud_choice").alias("cloud_choice"),
        F.col("w.dest_subdir").alias("dest_subdir"),
    )


def cloud_pick(policies: DataFrame, members: DataFrame, locations: DataFrame) -> DataFrame:
    """Cloud that each (library, collection) would choose today: the listed one, or the one with most free bytes."""
    live = locations.filter((F.col("kind") == "cloud") & F.col("is_online")).select("library_id", "location_id", "free_bytes")
    clouds = members.filter(F.col("role") == "cloud").select("library_id", "collection", "ord", "location_id")
    listed = clouds.join(live, ["library_id", "location_id"], "left_semi").groupBy("library_id", "collection").agg(
        F.min_by("location_id", F.struct("ord", "location_id")).alias("_first"))
    freest = most_free(clouds.withColumnRenamed("collection", "choice"), live).select(
        "library_id", F.col("choice").alias("collection"), F.col("location_id").alias("_freest"))
    joined = policies.select("library_id", "collection", "cloud_choice").join(
        listed, ["library_id", "collection"], "left").join(freest, ["library_id", "collection"], "left")
    return joined.select("library_id", "collection", F.when(
        F.col("cloud_choice") == "most_free", F.col("_freest")).otherwise(F.col("_first")).alias("cloud"))


def goal_locations(blobs: DataFrame, replicas: DataFrame, policies: DataFrame, members: DataFrame,
                   locations: DataFrame) -> DataFrame:
    """Goal rows (blob, dest, dest_kind): the local targets plus one cloud.

    Local targets must be mounted volumes with role ``final``; a policy without targets keeps the volumes that hold the
    blob now. A blob already on a cloud its policy allows keeps that cloud.
    """
    finals = locations.filter((F.col("kind") == "volume") & F.col("is_online") & F.col("is_final")).select(
        "library_id", F.col("location_id").alias("dest"))
    local_members = members.filter(F.col("role") == "local").select(
        "library_id", "collection", F.col("location_id").alias("dest"))
    targets = local_members.join(finals, ["library_id", "dest"], "left_semi")
    has_targets = local_members.select("library_id", "collection").distinct().withColumn("_targets", F.lit(True))
    wants_local = lookup_join(blobs.filter(F.col("keep_local") != "cloud_only"), has_targets, ["library_id", "collection"], "left")
    head = [*BLOB_KEY, "collection", "keep_local", "min_replicas", "size"]
    listed = _expand(wants_local.filter(F.col("_targets")).select(*head), targets)
    here = replicas.filter((F.col("location_kind") == "volume") & (F.col("hydration") == "local_full")
                           & F.col("is_online") & (F.col("state") != "partial")).select(
        *BLOB_KEY, F.col("location_id").alias("dest")).distinct()
    kept = wants_local.filter(F.col("_targets").isNull()).select(*head).join(here, BLOB_KEY)
    columns = [*head, "dest", "dest_kind"]
    local = listed.select(*head, "dest").unionByName(kept.select(*head, "dest")).withColumn("dest_kind", F.lit("volume"))

    allowed = members.filter(F.col("role") == "cloud").select("library_id", "collection", "location_id").distinct()
    on_cloud = replicas.filter((F.col("location_kind") == "cloud") & (F.col("state") != "partial") & F.col("is_online")).select(
        *BLOB_KEY, "location_id", F.when(F.col("state") == "verified", 0).otherwise(1).alias("_r"))
    held = lookup_join(on_cloud.join(blobs.select(*BLOB_KEY, "collection"), BLOB_KEY), allowed,
                       ["library_id", "collection", "location_id"], "left_semi")
    held = held.groupBy(*BLOB_KEY).agg(F.min(F.struct("_r", "location_id")).alias("h")).select(
        *BLOB_KEY, F.col("h.location_id").alias("_held"))
    choice = cloud_pick(policies, members, locations)
    cloud = lookup_join(blobs.select(*head).join(held, BLOB_KEY, "left"), choice, ["library_id", "collection"], "left")
    cloud = cloud.withColumn("dest", F.coalesce("_held", "cloud")).filter(F.col("dest").isNotNull()).withColumn(
        "dest_kind", F.lit("cloud"))
    return local.select(*columns).unionByName(cloud.select(*columns))


def _expand(blobs: DataFrame, targets: DataFrame) -> DataFrame:
    """Each blob once per target of its collection: targets are gathered per collection, so the join stays one-to-one."""
    lists = targets.groupBy("library_id", "collection").agg(F.sort_array(F.collect_set("dest")).alias("_dests"))
    return lookup_join(blobs, lists, ["library_id", "collection"], "inner").withColumn(
        "dest", F.explode("_dests")).drop("_dests")


def prefer_fallback(goals: DataFrame, admitted: DataFrame) -> DataFrame:
    """Drop preferred local goals that could not be placed, and state the effective replica target per blob.

    ``admitted`` holds (library_id, blob_id, dest) that exist or are planned. The result has one row per
    blob with the goals kept and dropped and the warnings.
    """
    soft = (F.col("keep_local") == "prefer") & (F.col("dest_kind") == "volume")
    met = goals.join(admitted.select(*BLOB_KEY, "dest").distinct().withColumn("_met", F.lit(True)), [*BLOB_KEY, "dest"], "left")
    dropped = soft & F.col("_met").isNull()
    per_blob = met.groupBy(*BLOB_KEY).agg(
        F.max("min_replicas").cast("long").alias("wanted"), F.count_if(~dropped).alias("placed"), F.count_if(dropped).alias("dropped"))
    return per_blob.select(
        *BLOB_KEY, "wanted", "placed", "dropped",
        F.least("wanted", F.greatest("placed", F.lit(1))).alias("effective_min"),
        (F.col("dropped") > 0).alias("local_preferred_unmet"),
        ((F.col("dropped") > 0) & (F.col("wanted") > F.col("placed"))).alias("replica_shortfall"),
    )


def compile_feasibility(policies: DataFrame, members: DataFrame) -> DataFrame:
    """Collections that can never reach min_replicas: cloud_only with too few clouds, required with too few places."""
    counts = members.groupBy("library_id", "collection").agg(
        F.count_distinct(F.when(F.col("role") == "cloud", F.col("location_id"))).alias("clouds"),
        F.count_distinct(F.when(F.col("role") == "local", F.col("location_id"))).alias("locals"))
    joined = policies.join(counts, ["library_id", "collection"], "left").fillna(0, ["clouds", "locals"])
    reach = F.when(F.col("keep_local") == "cloud_only", F.col("clouds")).otherwise(
        F.col("locals") + F.least(F.col("clouds"), F.lit(1)))
    strict = F.col("keep_local").isin("cloud_only", "required")
    return joined.filter(strict & (F.col("min_replicas") > reach)).select(
        "library_id", "collection", "keep_local", F.col("min_replicas").cast("long").alias("min_replicas"),
        reach.alias("reachable"))


def dest_path(needs: DataFrame, held: DataFrame) -> DataFrame:
    """Path at the dest: the one it already has there, else folder plus base name. The parent chain is dropped.

    ``held`` holds (library_id, blob_id, dest, held_path), one row per blob and dest.
    """
    joined = needs.join(held, [*BLOB_KEY, "dest"], "left")
    sub = F.rtrim(F.coalesce("dest_subdir", F.lit("")), F.lit("/"))
    fresh = F.concat(F.when(sub != "", F.concat(sub, F.lit("/"))).otherwise(F.lit("")), basename(F.col("path")))
    return joined.withColumn("dest_path", F.coalesce("held_path", fresh)).drop("held_path")


def dest_conflicts(needs: DataFrame, files: DataFrame) -> DataFrame:
    """Verdict per need: ``noop`` if the same blob is at the path, ``needs_manual`` if another one is there
    or a second blob of this plan targets it, else ``clear``. A need without path keeps ``no_path``.

    ``files`` holds (library_id, location_id, path, blob_id). Paths meet without their drive, leading slash and case.
    The needs are read several times, so they are stored first.
    """
    needs = cut_lineage(needs)
    at = files.select("library_id", F.col("location_id").alias("dest"), place_key(F.col("path")).alias("_key"),
                      F.col("blob_id").alias("_there"))
    at = at.groupBy("library_id", "dest", "_key").agg(F.min("_there").alias("_low"), F.max("_there").alias("_high"))
    keyed = needs.filter(F.col("dest_path").isNotNull()).withColumn("_key", place_key(F.col("dest_path")))
    rivals = keyed.groupBy("library_id", "dest", "_key").agg(
        (F.min("blob_id") != F.max("blob_id")).alias("_rivals"))
    # Both sides are one row a path, so the needs, of which very many may target one path, meet them once and in place.
    state = rivals.join(at, ["library_id", "dest", "_key"], "left")
    joined = skew_join(keyed, state, ["library_id", "dest", "_key"], "inner")
    same = (F.col("_low") == F.col("blob_id")) & (F.col("_high") == F.col("blob_id"))
    verdict = (
        F.when(F.col("_low").isNotNull() & ~same, "needs_manual").when(F.col("_rivals"), "needs_manual")
        .when(same, "noop").otherwise("clear")
    )
    judged = joined.withColumn("verdict", verdict).select(*needs.columns, "verdict")
    return judged.unionByName(needs.filter(F.col("dest_path").isNull()).withColumn("verdict", F.lit("no_path")))


def evictable(replicas: DataFrame) -> DataFrame:
    """Local full copies that policy lets go: not required, not pinned; a cloud object never is."""
    return replicas.filter(
        (F.col("location_kind") == "volume") & (F.col("hydration") == "local_full") & F.col("is_online")
        & (F.col("keep_local") != "required") & ~F.coalesce(F.col("pin_local"), F.lit(False)))


INTENT_SCHEMA = (
    "summary STRING, goal STRING, keep_local STRING, year INT, dedup STRING, "
    "collections ARRAY<STRUCT<name: STRING, mime_prefix: STRING>>, "
    "dests ARRAY<STRUCT<kind: STRING, location: STRING>>, "
    "priorities ARRAY<STRUCT<kind: STRING, location: STRING, collection: STRING>>, "
    "needs_clarification ARRAY<STRING>"
)
# The kinds of dests and priorities that an intent may name.
DEST_ROLES = {"LocalPath": "local", "ProviderSubdir": "cloud"}
PRIORITIES = ("FreeVolume", "KeepPinned", "EvictUnpinnedArchivesFirst", "PreferNewestLocal", "UseShuttle")


def compile_intents(intents: DataFrame, locations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Intent rows (library_id, intent_id, json) to policy rows, and the rejects with their reason.

    Pending questions or an unknown location (a volume or cloud, up to a slash) reject the whole intent. ``keep_local`` defaults to
    ``prefer``; only a named local dest makes ``required`` stand. An intent without collections is one row without one.
    """
    read = intents.withColumn("i", F.from_json("json", INTENT_SCHEMA))
    named = read.select("library_id", "intent_id", F.explode("i.dests").alias("d")).select(
        "library_id", "intent_id", F.substring_index("d.location", "/", 1).alias("location_id"))
    known = locations.select("library_id", F.col("location_id").cast("string").alias("location_id"))
    unknown = lookup_join(named, known, ["library_id", "location_id"], "left_anti").select(
        "library_id", "intent_id").distinct().withColumn("_unknown", F.lit(True))
    marked = read.join(unknown, ["library_id", "intent_id"], "left")
    reason = (
        F.when(F.col("i").isNull() | F.col("i.goal").isNull(), "bad_json")
        .when(F.size(F.coalesce("i.needs_clarification", F.array().cast("array<string>"))) > 0, "needs_clarification")
        .when(F.col("_unknown"), "unknown_location")
    )
    marked = marked.withColumn("reason", reason)
    rejects = marked.filter("reason IS NOT NULL").select("library_id", "intent_id", "reason")
    names_local = F.exists(F.coalesce("i.dests", F.array().cast("array<struct<kind:string,location:string>>")),
                           lambda d: d["kind"] == "LocalPath")
    keep = F.when((F.col("i.keep_local") == "required") & names_local, "required").when(
        F.col("i.keep_local") == "cloud_only", "cloud_only").otherwise("prefer")
    rows = marked.filter("reason IS NULL").select(
        "library_id", "intent_id", F.explode_outer("i.collections").alias("c"), keep.alias("keep_local"),
        F.col("i.year").alias("year"), F.coalesce("i.dedup", F.lit("None")).alias("dedup"))
    policies = rows.select("library_id", "intent_id", F.col("c.name").alias("collection"),
                           F.col("c.mime_prefix").alias("mime_prefix"), "keep_local", "year", "dedup")
    return policies, rejects


def intent_dests(intents: DataFrame, locations: DataFrame) -> DataFrame:
    """Targets (library_id, intent_id, ord, role, location_id, dest_subdir) that accepted intents name, in their order.

    A local dest is a volume, by itself or with a folder behind a slash; a provider dest is a cloud, likewise. Dests of other
    kinds give no row. Rejected intents (see :func:`compile_intents`) give none either.
    """
    read = _accepted(intents, locations)
    each = read.select("library_id", "intent_id", F.posexplode("i.dests").alias("ord", "d"))
    roles = F.create_map(*[F.lit(x) for pair in DEST_ROLES.items() for x in pair])
    place = F.substring_index("d.location", "/", 1)
    return each.withColumn("role", F.element_at(roles, F.col("d.kind"))).filter(F.col("role").isNotNull()).select(
        "library_id", "intent_id", "ord", "role", place.alias("location_id"),
        F.when(F.contains("d.location", F.lit("/")), F.expr("substring(d.location, length(substring_index(d.location, '/', 1)) + 2)")).alias("dest_subdir"))


def intent_priorities(intents: DataFrame, locations: DataFrame) -> DataFrame:
    """Priorities (library_id, intent_id, ord, kind, location_id, collection) of accepted intents, in their order; kinds that are
    not known are dropped, as hints never stop a plan."""
    each = _accepted(intents, locations).select("library_id", "intent_id", F.posexplode("i.priorities").alias("ord", "p"))
    return each.filter(F.col("p.kind").isin(*PRIORITIES)).select(
        "library_id", "intent_id", "ord", F.col("p.kind").alias("kind"), F.col("p.location").alias("location_id"), F.col("p.collection").alias("collection"))


def _accepted(intents: DataFrame, locations: DataFrame) -> DataFrame:
    _, rejects = compile_intents(intents, locations)
    read = intents.withColumn("i", F.from_json("json", INTENT_SCHEMA))
    return read.join(rejects.select("library_id", "intent_id"), ["library_id", "intent_id"], "left_anti")


def evict_hints(priorities: DataFrame) -> DataFrame:
    """(library_id, location_id, hint): volumes to free, the first named first; what ``priority_rank`` and the plan order by."""
    return priorities.filter((F.col("kind") == "FreeVolume") & F.col("location_id").isNotNull()).groupBy("library_id", "location_id").agg(
        F.min("ord").cast("int").alias("hint"))


def with_shuttle_hints(locations: DataFrame, priorities: DataFrame) -> DataFrame:
    """Locations where only the named volumes hop, in libraries that name one that is mounted; others keep their roles."""
    named = priorities.filter((F.col("kind") == "UseShuttle") & F.col("location_id").isNotNull()).select("library_id", "location_id").distinct()
    kind = dict(locations.dtypes)["location_id"]
    usable = locations.filter((F.col("kind") == "volume") & F.col("is_online")).select("library_id", "location_id")
    named = named.withColumn("location_id", F.col("location_id").cast(kind)).join(usable, ["library_id", "location_id"], "left_semi").withColumn("_named", F.lit(True))
    hinted = named.select("library_id").distinct().withColumn("_hinted", F.lit(True))
    marked = lookup_join(lookup_join(locations, named, ["library_id", "location_id"], "left"), hinted, ["library_id"], "left")
    return marked.withColumn("is_shuttle", F.when(F.col("_hinted"), F.coalesce("_named", F.lit(False))).otherwise(F.col("is_shuttle"))).drop("_named", "_hinted")


def priority_rank(evicts: DataFrame, volumes_first: DataFrame, archives: str = "Archives",
                  rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Evict order per library: hinted volumes by their rank, then unpinned archives, then largest first.

    ``volumes_first`` holds (library_id, location_id, hint). Hints only order what :func:`evictable` allows.
    """
    hinted = lookup_join(evicts, volumes_first, ["library_id", "location_id"], "left")
    keyed = hinted.withColumn("_hint", F.coalesce(F.col("hint"), F.lit(1 << 30))).withColumn(
        "_plain", F.when(F.col("collection") == archives, 0).otherwise(1))
    keyed, buckets = order_buckets(keyed, ["library_id"], "size", "file_id", descending=True, rows_per_bucket=rows_per_bucket)
    if buckets:
        buckets = ["_hint", "_plain", *buckets]
    order = [F.col("_hint"), F.col("_plain"), F.col("size").desc(), F.col("file_id")]
    return rank_in(keyed, ["library_id"], order, "evict_rank", buckets).drop("_hint", "_plain", "hint", "_b1", "_b2")


def filter_year(files: DataFrame, year: int, column: str = "mtime_utc") -> DataFrame:
    return files.filter(F.year(column) == year)


def newest_that_fit(files: DataFrame, capacity: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Per location the newest files whose running size stays within its usable bytes.

    ``capacity`` holds (library_id, location_id, usable).
    """
    key = ["library_id", "location_id"]
    sized = files.filter(F.col("size").isNotNull() & F.col("mtime_utc").isNotNull()).withColumn(
        "_when", F.unix_micros(F.col("mtime_utc").cast("timestamp")))
    sized, buckets = order_buckets(sized, key, "_when", "file_id", descending=True, rows_per_bucket=rows_per_bucket)
    summed = running_sum(sized, key, [F.col("_when").desc(), F.col("file_id")], F.col("size"), "running_bytes", buckets)
    return lookup_join(summed, capacity.select(*key, "usable"), key, "inner").filter(
        F.col("running_bytes") <= F.col("usable")).drop("_when", "_b1", "_b2")


def policy_diff(files: DataFrame, old: Sequence[Rule], new: Sequence[Rule], old_policies: DataFrame,
                new_policies: DataFrame) -> DataFrame:
    """What a drafted policy changes: files and bytes per (old, new) collection and keep_local pair.

    Both placements are columns of one scan, so nothing but the counts is shuffled.
    """
    both = with_match_inputs(files).withColumns({"old_collection": collection_of(old), "new_collection": collection_of(new)})
    for tag, table in (("old", old_policies), ("new", new_policies)):
        side = table.select("library_id", F.col("collection").alias(f"{tag}_collection"),
                            F.struct("keep_local", "min_replicas", "cloud_choice", "pin_local", "dest_subdir").alias(tag))
        both = lookup_join(both, side, ["library_id", f"{tag}_collection"], "left")
    changed = (F.col("old_collection") != F.col("new_collection")) | ~F.col("old").eqNullSafe(F.col("new"))
    return both.filter(changed).groupBy(
        "library_id", "old_collection", "new_collection", F.col("old.keep_local").alias("old_keep"),
        F.col("new.keep_local").alias("new_keep"),
    ).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))
