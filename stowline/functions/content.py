"""Content identity expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bytes of a file covered by the head probe, and the digest families a listing may carry.
HEAD_PROBE_BYTES = 65536
ID_ALGORITHM = "sha256"
DIGEST_ALGORITHMS = ("md5", "sha1", "sha256")
ID_PATTERN = "^(b3|sha256):[0-9a-fA-F]{64}$"

# File attribute bits and reparse tag of recall-on-access placeholders.
RECALL_ON_DATA_ACCESS = 0x00400000
RECALL_ON_OPEN = 0x00040000
REPARSE_TAG_CLOUD = 0x9000001A
REPARSE_TAG_CLOUD_MASK = 0xFFFF0FFF


class UnsupportedDigest(ValueError):
    """Raised for a digest this library cannot compute; a wrong value is never returned."""


def content_id(content: Column) -> Column:
    return F.concat(F.lit(f"{ID_ALGORITHM}:"), F.sha2(content, 256))


def digest(content: Column, algo: str) -> Column:
    if algo == "md5":
        return F.md5(content)
    if algo == "sha1":
        return F.sha1(content)
    if algo == "sha256":
        return F.sha2(content, 256)
    raise UnsupportedDigest(f"{algo}: known digests are {', '.join(DIGEST_ALGORITHMS)}")


def digests(content: Column, algos: Iterable[str]) -> list[Column]:
    return [digest(content, algo).alias(algo) for algo in algos]


def head_digest(content: Column) -> Column:
    """64-byte digest of the first 64 KiB, in hex: a prefilter, not an identity."""
    return F.sha2(F.substring(content.cast("binary"), 1, HEAD_PROBE_BYTES), 512)


def head_length(content: Column) -> Column:
    return F.least(F.octet_length(content), F.lit(HEAD_PROBE_BYTES))


def normal_id(raw: Column) -> Column:
    """Lower-case content id, or NULL when it is not a known prefix and exactly 64 hex digits."""
    return F.when(raw.rlike(ID_PATTERN), F.lower(raw))


def hydration(attrs: Column, reparse_tag: Column, location_kind: Column) -> Column:
    """``cloud_native``, ``placeholder`` or ``local_full``; missing attributes count as none set."""
    bits = F.coalesce(attrs.cast("long"), F.lit(0).cast("long"))
    recall = bits.bitwiseAND(F.lit(RECALL_ON_DATA_ACCESS | RECALL_ON_OPEN)) != 0
    tag = F.coalesce(reparse_tag.cast("long"), F.lit(0).cast("long"))
    cloud_tag = tag.bitwiseAND(F.lit(REPARSE_TAG_CLOUD_MASK)) == F.lit(REPARSE_TAG_CLOUD)
    return (
        F.when(location_kind == "cloud", F.lit("cloud_native"))
        .when(recall | cloud_tag, F.lit("placeholder"))
        .otherwise(F.lit("local_full"))
    )
