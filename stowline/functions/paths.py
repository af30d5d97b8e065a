"""Path expressions. Both separators count; needles are literals, never patterns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def slashed(path: Column) -> Column:
    """Path with forward slashes only."""
    return F.translate(path, "\\", "/")


def basename(path: Column) -> Column:
    return F.substring_index(slashed(path), "/", -1)


def dirname(path: Column) -> Column:
    """Everything before the last separator, in slashed form and without a trailing one."""
    return F.regexp_extract(slashed(path), "^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """Lower-case text after the last dot of the name; empty when there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))


def folded(path: Column) -> Column:
    """Comparison form of a volume path: slashed, lower case, no trailing slash."""
    return F.lower(F.rtrim(slashed(path), F.lit("/")))


def place_key(path: Column) -> Column:
    """One form of a path inside its location, whatever the spelling: no drive, one leading slash, folded."""
    return F.concat(F.lit("/"), F.ltrim(F.regexp_replace(folded(path), "^[a-z]:", ""), F.lit("/")))


def prefixes(path: Column) -> Column:
    """The folded path and each of its ancestors, as an array."""
    parts = F.split(folded(path), "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )


def contains_any(lowered: Column, needles: Iterable[str]) -> Column:
    """Literal substring test of lower-case text against any needle in any case; NULL counts as no match."""
    hit = F.lit(False)
    for needle in needles:
        hit = hit | lowered.contains(needle.lower())
    return F.coalesce(hit, F.lit(False))


def escape_reason(path: Column, root: Column) -> Column:
    """Why a path may not be written under ``root``; NULL when it is lexically inside.

    Checked on components only: links on disk are out of reach of a table job.
    """
    flat = slashed(path)
    has_drive = flat.rlike("^[A-Za-z]:")
    absolute = flat.startswith("/") | flat.rlike("^[A-Za-z]:/")
    body = F.when(has_drive, F.substring(flat, F.lit(3), F.length(flat))).otherwise(flat)
    parts = F.split(body, "/")
    base, full = (F.regexp_replace(folded(p), r"(/\.)+(?=/|$)", "") for p in (root, path))
    inside = (full == base) | full.startswith(F.concat(base, F.lit("/")))
    return (
        F.when(path.isNull(), F.lit("missing path"))
        .when(root.isNull(), F.lit("missing root"))
        .when(F.exists(parts, lambda p: p == ".."), F.lit("parent component"))
        .when(F.exists(parts, lambda p: p.contains(":")), F.lit("colon in component"))
        .when(has_drive & ~absolute, F.lit("drive prefix"))
        .when(absolute & ~inside, F.lit("outside root"))
        .otherwise(F.lit(None).cast("string"))
    )
