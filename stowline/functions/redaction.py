"""Masking of secrets in log fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The mask, the sensitive name parts and the names that hold a URL.
MASK = "[REDACTED]"
SENSITIVE_NAMES = ("token", "authorization", "secret", "password", "api_key")
URL_NAMES = ("session_uri", "url", "uri", "href")


def is_sensitive(name: Column) -> Column:
    lowered = F.lower(name)
    hit = F.lit(False)
    for part in SENSITIVE_NAMES:
        hit = hit | lowered.contains(part)
    return hit


def scrub_bearer(value: Column) -> Column:
    """Mask what follows each ``Bearer `` up to white space or a quote."""
    return F.regexp_replace(value, "(?U)Bearer [^\\s\"']*", f"Bearer {MASK}")


def redact_value(name: Column, value: Column) -> Column:
    without_query = F.when(
        F.lower(name).isin(*URL_NAMES) & value.contains("?"),
        F.concat(F.substring_index(value, "?", 1), F.lit(f"?{MASK}")),
    ).otherwise(value)
    return F.when(is_sensitive(name), F.lit(MASK)).otherwise(scrub_bearer(without_query))


def redact_map(fields: Column) -> Column:
    return F.transform_values(fields, redact_value)
