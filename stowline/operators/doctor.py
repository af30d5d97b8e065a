"""Catalog audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowline.operators.inventory import classify_root
from stowline.schemas import ENUMS, FOREIGN_KEYS, UNIQUE_KEYS


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child rows whose key has no parent row in the same library; NULL keys refer to nothing.

    Distinct child keys are checked first, so a missing key that half the rows share is one row in the join.
    """
    have = parent.select("library_id", F.col(parent_column).cast("string").alias("_key")).distinct()
    keys = child.filter(F.col(column).isNotNull()).groupBy("library_id", F.col(column).cast("string").alias("_key")).agg(
        F.count(F.lit(1)).alias("rows"))
    return keys.join(have, ["library_id", "_key"], "left_anti").withColumnRenamed("_key", "missing_key")


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Key values held by more than one row; rows with a NULL key part are exempt."""
    rows = df
    for column in key:
        rows = rows.filter(F.col(column).isNotNull())
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def unknown_values(df: DataFrame, column: str, allowed: Sequence[str]) -> DataFrame:
    """Values of an enum column outside its list, NULL included."""
    bad = F.col(column).isNull() | ~F.col(column).isin(*allowed)
    return df.filter(bad).groupBy("library_id", F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("rows"))


def replicas_of_non_files(replicas: DataFrame, files: DataFrame) -> DataFrame:
    """Replicas held by a shortcut or a directory."""
    other = files.filter(F.col("kind") != "byte").select("library_id", "file_id", "kind")
    return replicas.select("library_id", "file_id", "blob_id").join(other, ["library_id", "file_id"])


def _summary(found: DataFrame, check: str, severity: str, weight: str | None = None) -> DataFrame:
    sample = F.max(F.to_json(F.struct(*[c for c in found.columns])))
    n = F.coalesce(F.sum(weight), F.lit(0)).cast("long") if weight else F.count(F.lit(1))
    return found.agg(n.alias("violations"), sample.alias("sample")).select(
        F.lit(check).alias("check"), F.lit(severity).alias("severity"), "violations", "sample")


def unique_and_enum_audit(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Duplicate keys, unknown enum words and replicas of shortcuts, one summary row per check."""
    parts = []
    for name, key in UNIQUE_KEYS.items():
        if name in tables and set(key) <= set(tables[name].columns):
            parts.append(_summary(duplicate_keys(tables[name], key), f"unique:{name}", "error"))
    for (name, column), allowed in ENUMS.items():
        if name in tables and column in tables[name].columns:
            parts.append(_summary(unknown_values(tables[name], column, allowed), f"enum:{name}.{column}", "error", "rows"))
    if {"replicas", "files"} <= set(tables) and "kind" in tables["files"].columns:
        parts.append(_summary(replicas_of_non_files(tables["replicas"], tables["files"]), "replica_of_non_file", "error"))
    return _union(parts)


def foreign_key_audit(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows without parent for each declared foreign key whose two tables are given."""
    parts = []
    for child, column, parent, parent_column in FOREIGN_KEYS:
        if child in tables and parent in tables and column in tables[child].columns and parent_column in tables[parent].columns:
            lost = orphans(tables[child], column, tables[parent], parent_column)
            parts.append(_summary(lost, f"orphan:{child}.{column}", "error", "rows"))
    return _union(parts)


def root_is_overlay(locations: DataFrame, overlays: DataFrame) -> DataFrame:
    """Configured roots that are, or lie in, an overlay."""
    return classify_root(locations, overlays).filter(F.col("verdict") == "refuse")


def overlay_missing(hosts: DataFrame, overlays: DataFrame) -> DataFrame:
    """Hosts with a sync client installed but no overlay registered."""
    return hosts.filter(F.col("sync_client")).join(overlays.select("host").distinct(), "host", "left_anti")


def doctor(checks: Mapping[str, tuple[str, DataFrame]]) -> DataFrame:
    """One row per named check: severity, number of findings, and the greatest finding as a sample."""
    return _union([_summary(found, name, severity) for name, (severity, found) in checks.items()])


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    if not parts:
        raise ValueError("no check applies to the given tables")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
