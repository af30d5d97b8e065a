"""Walks up parent links in doubling strides, for folder trees of any depth and any damage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowline.scale import lookup_join, skew_join
from stowline.session import cut_lineage

ITEM = ["library_id", "location_id", "remote_ref"]
PARENT = ["library_id", "location_id", "parent_ref"]


def follow(start: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], stuck: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Follow ``ptr`` (NULL once a row is settled) until every row is settled or is known to loop.

    ``start`` holds one row per node. ``combine(open, state)`` joins the open rows to the node that their pointer shows and
    gives their next state; ``stuck`` settles the rows whose walk never ends. The strides double, so round k settles the
    rows 2**(k-1) to 2**k - 1 links below a settled one. These distances have no gaps: a round that settles nothing leaves
    only loops and what hangs below them. Each round is a table of the shared folder; nothing is collected but a count.
    """
    state = cut_lineage(start)
    waiting = state.filter(F.col("ptr").isNotNull()).count()
    while waiting:
        done, open_rows = state.filter(F.col("ptr").isNull()), state.filter(F.col("ptr").isNotNull())
        state = cut_lineage(done.unionByName(combine(open_rows, state)))
        now = state.filter(F.col("ptr").isNotNull()).count()
        if now == waiting:
            loops = stuck(state.filter(F.col("ptr").isNotNull())).withColumn("ptr", F.lit(None).cast("string"))
            return state.filter(F.col("ptr").isNull()).unionByName(loops).drop("ptr")
        waiting = now
    return state.drop("ptr")


def folder_paths(folders: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(library_id, location_id, remote_ref, path, verdict, stopped_at) of each folder; see :func:`cloud_paths`."""
    once = folders.filter(F.col("remote_ref").isNotNull()).groupBy(*ITEM).agg(F.min(F.struct("parent_ref", "name")).alias("r"))
    text = F.lit(None).cast("string")
    nodes = once.select(
        *ITEM, F.col("r.parent_ref").alias("ptr"), F.concat(F.lit("/"), segment(F.col("r.name"), F.col("remote_ref"))).alias("path"),
        F.when(F.col("r.parent_ref").isNull(), "ok").alias("verdict"), text.alias("stopped_at"))
    if roots is not None:
        tops = roots.select(*ITEM).distinct()
        nodes = lookup_join(nodes, tops, ITEM, "left_anti").unionByName(tops.select(
            *ITEM, text.alias("ptr"), F.lit("").alias("path"), F.lit("ok").alias("verdict"), text.alias("stopped_at")))

    def combine(open_rows: DataFrame, state: DataFrame) -> DataFrame:
        hop = state.select("library_id", "location_id", F.col("remote_ref").alias("ptr"), F.col("path").alias("_path"),
                           F.col("ptr").alias("_next"), F.col("verdict").alias("_verdict"), F.col("stopped_at").alias("_stop"),
                           F.lit(True).alias("_found"))
        met = skew_join(open_rows, hop, ["library_id", "location_id", "ptr"], "left")
        lost = F.col("_found").isNull()
        return met.select(
            *ITEM, F.col("_next").alias("ptr"), F.concat("_path", "path").alias("path"),
            F.when(lost, "missing_parent").otherwise(F.col("_verdict")).alias("verdict"),
            F.when(lost, F.col("ptr")).otherwise(F.col("_stop")).alias("stopped_at"))

    def loops(rows: DataFrame) -> DataFrame:
        return rows.withColumn("verdict", F.lit("cycle")).withColumn("path", text).withColumn("stopped_at", F.col("remote_ref"))

    return follow(nodes, combine, loops)


def segment(name, ref):
    """A name as one path segment: slashes become underscores; an item without a name goes by its id."""
    return F.replace(F.coalesce(F.when(name != "", name), ref), F.lit("/"), F.lit("_"))


def cloud_paths(items: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Items of cloud listings with ``path``, ``path_verdict`` and ``stopped_at``, one row per row.

    ``items`` hold (library_id, location_id, remote_ref, parent_ref, name, kind); ``roots`` (library_id, location_id,
    remote_ref) name the drives' top folders, listed or not, which add no segment. An item without a parent starts a path.
    Verdicts: ``ok``; ``missing_parent``, when the chain of parents leaves the listing (``stopped_at`` is the id that is not
    there); ``cycle``, when it never ends. Only an ``ok`` item has a path; the root's own is ``/``. Of a folder listed twice
    the least (parent, name) counts. Only folders take part in the walk: one narrow row each, log-depth rounds; files join
    once, by their parent, and a folder that holds a third of all files is met in place.
    """
    folders = items.filter(F.col("kind") == "directory").select(*PARENT, "remote_ref", "name")
    above = folder_paths(folders, roots).select(
        "library_id", "location_id", F.col("remote_ref").alias("parent_ref"), F.col("path").alias("_path"),
        F.col("verdict").alias("_verdict"), F.col("stopped_at").alias("_stop"))
    own = segment(F.col("name"), F.col("remote_ref"))
    top = items.filter(F.col("parent_ref").isNull()).select(
        "*", F.concat(F.lit("/"), own).alias("path"), F.lit("ok").alias("path_verdict"), F.lit(None).cast("string").alias("stopped_at"))
    below = skew_join(items.filter(F.col("parent_ref").isNotNull()), above, PARENT, "left").select(
        *[F.col(c) for c in items.columns],
        F.when(F.col("_verdict") == "ok", F.concat("_path", F.lit("/"), own)).alias("path"),
        F.coalesce("_verdict", F.lit("missing_parent")).alias("path_verdict"),
        F.when(F.col("_verdict").isNull(), F.col("parent_ref")).otherwise(F.col("_stop")).alias("stopped_at"))
    found = top.unionByName(below)
    if roots is None:
        return found
    marked = lookup_join(found, roots.select(*ITEM).distinct().withColumn("_top", F.lit(True)), ITEM, "left")
    return marked.select(
        *[F.col(c) for c in items.columns], F.when(F.col("_top"), "/").otherwise(F.col("path")).alias("path"),
        F.when(F.col("_top"), "ok").otherwise(F.col("path_verdict")).alias("path_verdict"),
        F.when(F.col("_top").isNull(), F.col("stopped_at")).alias("stopped_at"))
