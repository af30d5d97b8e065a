"""Folder ancestry, public access and path safety."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowline.functions.paths import escape_reason
from stowline.operators.tree import follow
from stowline.scale import skew_join
from stowline.session import cut_lineage
from stowline.sources.permissions import UNKNOWN

NODE = ["library_id", "ref"]
MAX_DOUBLINGS = 40

# Principals that make an item public, in lower case.
PUBLIC_PRINCIPALS = ("anyone", "anyonewithlink", "anonymous")


class FolderCycle(ValueError):
    """Raised when parent links loop."""


def is_public() -> Column:
    """The grant is to anyone; services differ in the case they write."""
    return F.lower(F.trim("principal")).isin(*PUBLIC_PRINCIPALS)


def ancestors(folders: DataFrame) -> DataFrame:
    """All (ref, ancestor, distance) pairs of a (library_id, ref, parent_ref) edge list.

    Pointer doubling: after k joins every pair up to distance 2^k is known. Pairs are the answer here;
    :func:`exposure` does not need them and never builds them.
    """
    pairs = cut_lineage(folders.filter(F.col("parent_ref").isNotNull()).select(
        *NODE, F.col("parent_ref").alias("ancestor"), F.lit(1).alias("distance")))
    reach = 1
    for _ in range(MAX_DOUBLINGS):
        far = pairs.filter(F.col("distance") == reach).select(
            "library_id", "ref", F.col("ancestor").alias("mid"), F.col("distance").alias("d1"))
        more = pairs.select("library_id", F.col("ref").alias("mid"), "ancestor", F.col("distance").alias("d2"))
        grown = far.join(more, ["library_id", "mid"]).select(*NODE, "ancestor", (F.col("d1") + F.col("d2")).alias("distance"))
        grown = cut_lineage(grown)
        if grown.isEmpty():
            return pairs
        if not grown.filter(F.col("ref") == F.col("ancestor")).isEmpty():
            raise FolderCycle("parent links loop")
        pairs = cut_lineage(pairs.unionByName(grown))
        reach *= 2
    raise FolderCycle("parent links loop, or are deeper than any real tree")


def is_unknown() -> Column:
    """A grant that could not be read; it hides whether the item is public."""
    return F.lower(F.trim("principal")) == UNKNOWN.lower()


def _marks(acl: DataFrame) -> DataFrame:
    """Per node whether it is granted to anyone, and whether a grant of it cannot be read."""
    return acl.filter(is_public() | is_unknown()).groupBy(*NODE).agg(
        F.bool_or(is_public()).alias("_public"), F.bool_or(is_unknown()).alias("_unknown"))


def folder_exposure(folders: DataFrame, acl: DataFrame) -> DataFrame:
    """(library_id, ref, public_ref, unresolved_ref) per folder.

    ``public_ref``: the nearest public node on its way to the root, itself included. ``unresolved_ref``, only where no
    public one is known: the nearest node that may hide one, because a grant of it cannot be read, because the walk leaves
    the folder table there, or because parents loop. Both NULL: private. ``acl`` holds (library_id, ref, principal). Each
    node carries one pointer and what is nearest so far, so the state stays one row per node through all log-depth joins.
    """
    start = folders.groupBy(*NODE).agg(F.min("parent_ref").alias("parent_ref")).join(_marks(acl), NODE, "left").select(
        *NODE, F.when(F.col("_public"), F.lit(None)).otherwise(F.col("parent_ref")).alias("ptr"),
        F.when(F.col("_public"), F.col("ref")).alias("public_ref"), F.when(F.col("_unknown"), F.col("ref")).alias("unresolved_ref"))

    def combine(open_rows: DataFrame, state: DataFrame) -> DataFrame:
        hop = state.select("library_id", F.col("ref").alias("ptr"), F.col("ptr").alias("_next"), F.col("public_ref").alias("_public"),
                           F.col("unresolved_ref").alias("_unresolved"), F.lit(True).alias("_found"))
        lost = F.when(F.col("_found").isNull(), F.col("ptr"))
        return skew_join(open_rows, hop, ["library_id", "ptr"], "left").select(
            *NODE, F.col("_next").alias("ptr"), F.col("_public").alias("public_ref"),
            F.coalesce("unresolved_ref", "_unresolved", lost).alias("unresolved_ref"))

    found = follow(start, combine, lambda rows: rows.withColumn("unresolved_ref", F.coalesce("unresolved_ref", "ref")))
    return found.withColumn("unresolved_ref", F.when(F.col("public_ref").isNull(), F.col("unresolved_ref")))


def exposure(items: DataFrame, folders: DataFrame, acl: DataFrame) -> DataFrame:
    """``items`` with ``exposure`` (public, unresolved or private) and the node that decides it, ``public_at`` or ``unresolved_at``.

    ``items`` holds (library_id, ref, parent_ref). Unresolved is not private: a grant that cannot be read, a parent that is
    not listed or parents that loop may hide a public one. Only folders take part in the walk; the item table is joined
    once, by its parent; an item without a parent stands by its own grants.
    """
    up = folder_exposure(folders, acl).select("library_id", F.col("ref").alias("parent_ref"), "public_ref", "unresolved_ref",
                                              F.lit(True).alias("_found"))
    own = items.join(_marks(acl), NODE, "left")
    top = own.filter(F.col("parent_ref").isNull()).select(
        "*", F.lit(None).cast("string").alias("public_ref"), F.lit(None).cast("string").alias("unresolved_ref"), F.lit(True).alias("_found"))
    joined = top.unionByName(skew_join(own.filter(F.col("parent_ref").isNotNull()), up, ["library_id", "parent_ref"], "left"))
    public = F.when(F.col("_public"), F.col("ref")).otherwise(F.col("public_ref"))
    hidden = F.coalesce(F.when(F.col("_unknown"), F.col("ref")), F.when(F.col("_found").isNull(), F.col("parent_ref")), F.col("unresolved_ref"))
    return joined.select(
        *[F.col(c) for c in items.columns],
        F.when(public.isNotNull(), "public").when(hidden.isNotNull(), "unresolved").otherwise("private").alias("exposure"),
        public.alias("public_at"), F.when(public.isNull(), hidden).alias("unresolved_at"))


def public_items(items: DataFrame, folders: DataFrame, acl: DataFrame) -> DataFrame:
    """Items that are not known to be private, with ``exposure`` (public or unresolved), ``public_at`` and ``unresolved_at``."""
    return exposure(items, folders, acl).filter(F.col("exposure") != "private")


def refused_destinations(ops: DataFrame, folders: DataFrame, acl: DataFrame) -> DataFrame:
    """Ops whose dest folder is not known to be private, with ``exposure``, ``public_at`` and ``unresolved_at``. ``ops`` carry dest_parent.

    Refused are dest folders that are public or below a public one, those whose way to the root cannot be read, and those
    that no folder row names, NULL included.
    """
    state = folder_exposure(folders, acl).select("library_id", F.col("ref").alias("dest_parent"), "public_ref", "unresolved_ref",
                                                 F.lit(True).alias("_found"))
    met = skew_join(ops, state, ["library_id", "dest_parent"], "left")
    hidden = F.when(F.col("_found").isNull(), F.col("dest_parent")).otherwise(F.col("unresolved_ref"))
    refused = met.filter(F.col("_found").isNull() | F.coalesce("public_ref", "unresolved_ref").isNotNull())
    return refused.select(*[F.col(c) for c in ops.columns], F.when(F.col("public_ref").isNotNull(), "public").otherwise("unresolved").alias("exposure"),
                          F.col("public_ref").alias("public_at"), hidden.alias("unresolved_at"))


def upload_acl_recheck(ops: DataFrame, items: DataFrame, folders: DataFrame, acl: DataFrame) -> DataFrame:
    """Uploads of each library's latest plan whose object is not known to be private now; one that no listing holds counts."""
    latest = ops.groupBy("library_id").agg(F.max(F.struct("created_at", "plan_id")).alias("l")).select(
        "library_id", F.col("l.plan_id").alias("plan_id"))
    sent = ops.filter(F.col("kind").isin("upload_keep", "upload_evict", "shuttle")).join(
        latest, ["library_id", "plan_id"], "left_semi").select("library_id", "op_id", F.col("dest_ref").alias("ref"))
    known = exposure(items, folders, acl).select(*NODE, "exposure", "public_at", "unresolved_at")
    met = sent.join(known, NODE, "left").withColumn("unresolved_at", F.when(F.col("exposure").isNull(), F.col("ref")).otherwise(F.col("unresolved_at")))
    return met.withColumn("exposure", F.coalesce("exposure", F.lit("unresolved"))).filter(F.col("exposure") != "private")


def public_folders(folders: DataFrame, acl: DataFrame) -> DataFrame:
    """(library_id, ref, public_ref) per folder, without those verdicts that nothing is known."""
    return folder_exposure(folders, acl).drop("unresolved_ref")


def path_escapes(paths: DataFrame) -> DataFrame:
    """Rows of (path, root, ...) that lexically leave the root, with the reason."""
    return paths.withColumn("reason", escape_reason(F.col("path"), F.col("root"))).filter(F.col("reason").isNotNull())
