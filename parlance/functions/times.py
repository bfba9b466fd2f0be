"""Vendor clocks to Unix seconds, and Unix seconds to calendar days.

All of these work on integers and ``timestamp_ntz`` values and name their zone, so that a result does
not depend on ``spark.sql.session.timeZone``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: Unix seconds of 2001-01-01 00:00 UTC, where both vendor clocks start.
VENDOR_EPOCH = 978307200
NANOS = 1_000_000_000
EPOCH_NTZ = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def apple_seconds(ns: Column) -> Column:
    """Nanoseconds since 2001 to Unix seconds, rounding down in integers."""
    whole = ns - F.pmod(ns, F.lit(NANOS))
    return F.call_function("div", whole, F.lit(NANOS)) + VENDOR_EPOCH


def whatsapp_seconds(seconds: Column) -> Column:
    """Fractional seconds since 2001 to Unix seconds, fraction cut off."""
    return (seconds + F.lit(float(VENDOR_EPOCH))).cast("bigint")


def ntz_seconds(ts: Column) -> Column:
    """Whole seconds from the epoch to a ``timestamp_ntz`` read as UTC.

    Built from the calendar fields: a difference of timestamps would pass through the session zone and
    be off where its daylight saving time differs from that of 1970-01-01.
    """
    days = F.unix_date(ts.cast("date")).cast("bigint")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def seconds_ntz(ts: Column, zone: str = "UTC") -> Column:
    """Wall-clock ``timestamp_ntz`` of a Unix second in a zone."""
    utc = F.timestamp_add("SECOND", ts.cast("bigint"), F.expr(EPOCH_NTZ))
    return utc if zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def wall_clock_seconds(ntz: Column, zone: str = "UTC") -> Column:
    """Unix second of a wall-clock time in a zone."""
    utc = ntz if zone == "UTC" else F.convert_timezone(F.lit(zone), F.lit("UTC"), ntz)
    return ntz_seconds(utc)


def local_day(ts: Column, zone: str = "UTC") -> Column:
    """Calendar day of a Unix second in a zone."""
    if zone == "UTC":
        return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ts / 86400).cast("int"))
    return F.to_date(seconds_ntz(ts, zone))
