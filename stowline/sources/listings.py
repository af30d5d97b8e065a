"""Exported cloud listings, one JSON object per row, to catalog file rows and checksum bindings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DRIVE_SCHEMA = (
    "id STRING, name STRING, mimeType STRING, size STRING, md5Checksum STRING, modifiedTime STRING, "
    "parents ARRAY<STRING>, trashed BOOLEAN, ownedByMe BOOLEAN, "
    "shortcutDetails STRUCT<targetId: STRING, targetMimeType: STRING>"
)
GRAPH_SCHEMA = (
    "id STRING, name STRING, size BIGINT, lastModifiedDateTime STRING, deleted STRUCT<state: STRING>, "
    "folder STRUCT<childCount: INT>, root STRING, remoteItem STRUCT<id: STRING>, "
    "parentReference STRUCT<id: STRING, path: STRING>, "
    "file STRUCT<mimeType: STRING, hashes: STRUCT<sha1Hash: STRING, sha256Hash: STRING, quickXorHash: STRING>>"
)
# Native document types that hold no bytes, and the folder type.
NATIVE_DOC_PREFIX = "application/vnd.google-apps."
FOLDER_MIME = "application/vnd.google-apps.folder"


def instant(column: str) -> Column:
    """An RFC 3339 time; one that cannot be read is NULL."""
    return F.col(column).try_cast("timestamp")


def _drive_shown() -> Column:
    native = F.coalesce(F.col("mimeType").startswith(NATIVE_DOC_PREFIX), F.lit(False))
    return (
        F.coalesce(F.col("ownedByMe"), F.lit(False)) & ~F.coalesce(F.col("trashed"), F.lit(False))
        & (F.col("shortcutDetails").isNotNull() | _drive_folder() | ~native)
    )


def _drive_folder() -> Column:
    return F.coalesce(F.col("mimeType") == FOLDER_MIME, F.lit(False))


def _drive_columns() -> list[Column]:
    is_shortcut, is_folder = F.col("shortcutDetails").isNotNull(), _drive_folder()
    return [
        F.get("parents", F.lit(0)).alias("parent_ref"),
        F.col("name"),
        F.when(is_shortcut, "shortcut").when(is_folder, "directory").otherwise("byte").alias("kind"),
        F.col("shortcutDetails.targetId").alias("shortcut_target_ref"),
        F.when(is_shortcut | is_folder, F.lit(None)).otherwise(F.col("size").try_cast("long")).alias("size"),
        instant("modifiedTime").alias("mtime_utc"),
        F.col("mimeType").alias("mime"),
        F.lit("cloud_native").alias("hydration"),
        F.when(~(is_shortcut | is_folder), F.lower("md5Checksum")).alias("md5"),
    ]


def normalise_drive(listing: DataFrame, json: str = "json") -> DataFrame:
    """Owned, not trashed items. Native documents are dropped; a shortcut keeps its target and no bytes."""
    item = listing.withColumn("item", F.from_json(json, DRIVE_SCHEMA)).select("library_id", "location_id", "item.*")
    return item.filter(_drive_shown()).select("library_id", "location_id", F.col("id").alias("remote_ref"), *_drive_columns())


def _graph_columns() -> list[Column]:
    is_folder = F.col("folder").isNotNull()
    link = ~is_folder & F.lower("name").endswith(".url")
    return [
        F.col("parentReference.id").alias("parent_ref"),
        F.col("name"),
        F.when(is_folder, "directory").when(link, "shortcut").otherwise("byte").alias("kind"),
        F.when(is_folder | link, F.lit(None)).otherwise(F.col("size")).alias("size"),
        instant("lastModifiedDateTime").alias("mtime_utc"),
        F.col("file.mimeType").alias("mime"),
        F.lit("cloud_native").alias("hydration"),
        F.col("deleted").isNotNull().alias("is_deleted"),
        F.col("root").isNotNull().alias("is_root"),
        F.when(~(is_folder | link), F.create_map(
            F.lit("sha1"), F.lower("file.hashes.sha1Hash"),
            F.lit("sha256"), F.lower("file.hashes.sha256Hash"),
            F.lit("quickxor"), F.col("file.hashes.quickXorHash"),
        )).alias("hashes"),
    ]


def normalise_graph(listing: DataFrame, json: str = "json") -> DataFrame:
    """Items of the own drive; items shared from another drive are dropped."""
    item = listing.withColumn("item", F.from_json(json, GRAPH_SCHEMA)).select("library_id", "location_id", "item.*")
    return item.filter(F.col("remoteItem").isNull()).select("library_id", "location_id", F.col("id").alias("remote_ref"), *_graph_columns())


def graph_roots(files: DataFrame) -> DataFrame:
    """The top folders that a Graph listing marks; ``cloud_paths`` gives them no segment."""
    return files.filter(F.col("is_root") & ~F.col("is_deleted")).select("library_id", "location_id", "remote_ref").distinct()


#: Columns of a change row; ``apply_delta`` merges them into a table keyed by (library_id, location_id, item_key).
CHANGE = ("library_id", "location_id", "item_key", "change_no", "is_deleted", "parent_ref", "name", "kind", "size", "mtime_utc", "mime")
PAGE = {"drive": ("changes", "newStartPageToken"), "graph": ("value", "@odata.deltaLink")}


def feed_entries(pages: DataFrame, service: str, json: str = "json") -> DataFrame:
    """(library_id, location_id, change_no, entry): the entries of feed pages (library_id, location_id, page_no, json).

    ``change_no`` follows the feed, pages first; a page holds fewer than 2**20 entries.
    """
    name = PAGE[service][0]
    told = F.get_json_object(json, f"$['{name}']")
    each = pages.select("library_id", "location_id", "page_no", F.posexplode(F.from_json(told, "array<string>")).alias("at", "entry"))
    return each.select("library_id", "location_id", (F.shiftleft(F.col("page_no").cast("long"), 20) + F.col("at")).alias("change_no"), "entry")


def feed_cursors(pages: DataFrame, service: str, json: str = "json") -> DataFrame:
    """(library_id, provider_id, cursor, complete): where the next run starts, from the last page of each feed.

    Only the last page of a finished feed tells a cursor; a feed that breaks off has none and is not complete, so its
    changes may be applied, but the old cursor stays.
    """
    cursor = F.get_json_object(json, f"$['{PAGE[service][1]}']")
    last = pages.groupBy("library_id", F.col("location_id").alias("provider_id")).agg(F.max_by(cursor, "page_no").alias("cursor"))
    return last.withColumn("complete", F.col("cursor").isNotNull())


def drive_changes(pages: DataFrame, json: str = "json") -> DataFrame:
    """Pages of a Drive change feed as change rows, keyed by the file's id.

    An entry marked removed, and a file that a listing would not show (trashed, owned by another, a native document),
    removes the item. Entries of other kinds than files, and those without an id, are dropped.
    """
    outer = F.from_json("entry", "fileId STRING, removed BOOLEAN, changeType STRING, file STRING")
    entry = feed_entries(pages, "drive", json).withColumn("e", outer).withColumn("item", F.from_json("e.file", DRIVE_SCHEMA))
    each = entry.filter(F.coalesce("e.changeType", F.lit("file")) == "file").select(
        "library_id", "location_id", F.coalesce("e.fileId", "item.id").alias("item_key"), "change_no", F.col("e.removed").alias("removed"), "item.*")
    gone = F.coalesce("removed", F.lit(False)) | ~F.coalesce(_drive_shown(), F.lit(False))
    return each.filter(F.col("item_key").isNotNull()).select(
        "library_id", "location_id", "item_key", "change_no", gone.alias("is_deleted"), *_drive_columns()).select(*CHANGE)


def graph_changes(pages: DataFrame, json: str = "json") -> DataFrame:
    """Pages of a Graph delta feed as change rows, keyed by the item's id; deleted and remote items remove it."""
    each = feed_entries(pages, "graph", json).withColumn("item", F.from_json("entry", GRAPH_SCHEMA)).select(
        "library_id", "location_id", "change_no", "item.*").filter(F.col("id").isNotNull())
    gone = F.col("deleted").isNotNull() | F.col("remoteItem").isNotNull()
    columns = [c for c in CHANGE if c != "is_deleted"]
    rows = each.select("library_id", "location_id", F.col("id").alias("item_key"), "change_no", gone.alias("gone"), *_graph_columns())
    return rows.select(*columns, F.col("gone").alias("is_deleted")).select(*CHANGE)


def drive_bindings(files: DataFrame) -> DataFrame:
    """One checksum row per byte file that carries an md5."""
    return files.filter((F.col("kind") == "byte") & F.col("md5").isNotNull()).select(
        "library_id", F.col("location_id").alias("provider_id"), "remote_ref",
        F.lit("md5").alias("algo"), F.col("md5").alias("hex"), "size",
    )


def graph_bindings(files: DataFrame) -> DataFrame:
    """One checksum row per digest family the listing returned for a byte file."""
    live = files.filter((F.col("kind") == "byte") & ~F.col("is_deleted"))
    return live.select(
        "library_id", F.col("location_id").alias("provider_id"), "remote_ref", "size",
        F.explode("hashes").alias("algo", "hex"),
    ).filter(F.col("hex").isNotNull()).select("library_id", "provider_id", "remote_ref", "algo", "hex", "size")
