"""Permissions of cloud listings, one JSON object per item, to rows of one grant table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DRIVE_PERMISSIONS = (
    "id STRING, permissions ARRAY<STRUCT<id: STRING, type: STRING, role: STRING, permissionDetails: "
    "ARRAY<STRUCT<permissionType: STRING, role: STRING, inheritedFrom: STRING, inherited: BOOLEAN>>>>"
)
_WHO = "STRUCT<user: STRUCT<id: STRING>, group: STRUCT<id: STRING>, siteUser: STRUCT<id: STRING>, siteGroup: STRUCT<id: STRING>>"
GRAPH_PERMISSIONS = (
    "id STRING, permissions ARRAY<STRUCT<id: STRING, roles: ARRAY<STRING>, link: STRUCT<scope: STRING, type: STRING>, "
    f"grantedToV2: {_WHO}, grantedTo: {_WHO}, inheritedFrom: STRUCT<id: STRING>>>"
)
#: A grant that cannot be read, or is of no kind that is known; whoever asks for privacy must refuse it.
UNKNOWN = "Unknown"
GRANT = ("library_id", "location_id", "remote_ref", "principal", "role", "inherited", "inherited_from")


def _granted(item: DataFrame, principal: Column, role: Column, inherited: Column, source: Column) -> DataFrame:
    """Rows of ``item`` (with ``p``, NULL where the item carries no permissions at all) as grants, equal ones once."""
    unread = F.col("p").isNull()
    return item.select(
        "library_id", "location_id", F.col("id").alias("remote_ref"),
        F.when(unread, UNKNOWN).otherwise(F.coalesce(principal, F.lit(UNKNOWN))).alias("principal"),
        F.lower(role).alias("role"), F.coalesce(inherited, F.lit(False)).alias("inherited"), source.alias("inherited_from"),
    ).distinct()


def _opened(listing: DataFrame, json: str, schema: str) -> DataFrame:
    """One row per permission; an item with an empty list has none, one without a list has a row with a NULL ``p``."""
    item = listing.withColumn("item", F.from_json(json, schema)).select("library_id", "location_id", "item.*").filter(F.col("id").isNotNull())
    several = F.col("permissions").isNull() | (F.size("permissions") > 0)
    return item.filter(several).select("library_id", "location_id", "id", F.explode_outer("permissions").alias("p"))


def drive_permissions(listing: DataFrame, json: str = "json") -> DataFrame:
    """Grants of Drive items. A permission with details gives one row for each, with the role and origin told there.

    Principals: User, Group (groups and domains), Anyone, AnyoneWithLink; any other type, and an item that carries no
    permission list, is Unknown. An item with an empty list is private and gives no row. Equal grants come once.
    """
    each = _opened(listing, json, DRIVE_PERMISSIONS).select("*", F.explode_outer("p.permissionDetails").alias("q"))
    kind = F.lower("p.type")
    principal = (
        F.when(kind == "user", "User").when(kind.isin("group", "domain"), "Group")
        .when((kind == "anyone") & (F.lower("p.id") == "anyonewithlink"), "AnyoneWithLink").when(kind == "anyone", "Anyone")
    )
    return _granted(each, principal, F.coalesce("q.role", "p.role"), F.col("q.inherited"),
                    F.when(F.col("q.inherited"), F.col("q.inheritedFrom")))


def graph_permissions(listing: DataFrame, json: str = "json") -> DataFrame:
    """Grants of Graph items, one row for each role of each permission.

    A link's scope tells its principal: anonymous is AnyoneWithLink, organization Group, users User; without a link it
    is the identity granted to. Roles: a link's type, else the roles told; view and read are reader, edit and write
    writer. ``inheritedFrom`` marks and names the origin. Unknown and empty as in :func:`drive_permissions`.
    """
    told = F.when(F.col("p.link.type").isNotNull(), F.array("p.link.type")).otherwise(F.col("p.roles"))
    each = _opened(listing, json, GRAPH_PERMISSIONS).select("*", F.explode_outer(told).alias("q"))
    scope = F.lower("p.link.scope")
    user = F.coalesce("p.grantedToV2.user", "p.grantedTo.user").isNotNull() | F.coalesce("p.grantedToV2.siteUser", "p.grantedTo.siteUser").isNotNull()
    group = F.coalesce("p.grantedToV2.group", "p.grantedTo.group").isNotNull() | F.coalesce("p.grantedToV2.siteGroup", "p.grantedTo.siteGroup").isNotNull()
    principal = (
        F.when(scope == "anonymous", "AnyoneWithLink").when(scope == "organization", "Group").when(scope == "users", "User")
        .when(F.col("p.link").isNotNull(), UNKNOWN).when(group, "Group").when(user, "User")
    )
    word = F.lower("q")
    role = F.when(word.isin("view", "read"), "reader").when(word.isin("edit", "write"), "writer").otherwise(word)
    return _granted(each, principal, role, F.col("p.inheritedFrom").isNotNull(), F.col("p.inheritedFrom.id"))


def normalise_permissions(drive: DataFrame | None, graph: DataFrame | None, json: str = "json") -> DataFrame:
    """One grant table (library_id, location_id, remote_ref, principal, role, inherited, inherited_from) of both services."""
    sides = [fn(listing, json) for fn, listing in ((drive_permissions, drive), (graph_permissions, graph)) if listing is not None]
    if not sides:
        raise ValueError("no listing given")
    return sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
