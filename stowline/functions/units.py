"""Byte arithmetic and formatting; plans stay in integer bytes, only reports are formatted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KIB = 1 << 10
MIB = 1 << 20
GIB = 1 << 30


def saturating_sub(left: Column, right: Column) -> Column:
    return F.greatest(left - right, F.lit(0).cast("long"))


def usable(free: Column, reserve: Column, in_flight: Column) -> Column:
    """Bytes open to user payloads: free minus the reserve and what running operations hold."""
    return saturating_sub(free, reserve + in_flight)


def format_bytes(size: Column) -> Column:
    """``B``, ``KiB``, ``MiB`` or ``GiB`` with two decimals; GiB is the largest unit."""
    def scaled(unit: int, label: str) -> Column:
        # Hundredths in integers, a half rounded to the even digit: no float decides a printed digit.
        part = (size % unit) * 100
        floor, rest = F.floor(part / unit), part % unit
        up = (rest * 2 > unit) | ((rest * 2 == unit) & (floor % 2 == 1))
        hundredths = F.floor((size - size % unit) / unit) * 100 + floor + F.when(up, 1).otherwise(0)
        return F.format_string(f"%d.%02d {label}", F.floor(hundredths / 100), hundredths % 100)

    return (
        F.when(size.isNull(), F.lit(None).cast("string"))
        .when(size >= GIB, scaled(GIB, "GiB"))
        .when(size >= MIB, scaled(MIB, "MiB"))
        .when(size >= KIB, scaled(KIB, "KiB"))
        .otherwise(F.concat(size.cast("string"), F.lit(" B")))
    )
