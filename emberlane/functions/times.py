"""Time functions as Columns. Times without a zone are UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 100-nanosecond steps between 1601 and 1970 (fixed value).
FILETIME_EPOCH = 116_444_736_000_000_000
_FULL = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|z|[+-][0-9]{2}:?[0-9]{2})?$"


def parse_micros(text: Column) -> Column:
    """Microseconds since 1970 of an ISO time with a clock part; finer digits are cut; null otherwise."""
    base = F.regexp_extract(text, r"^(.{10})[T ](.{8})", 1)
    clock = F.regexp_extract(text, r"^(.{10})[T ](.{8})", 2)
    fraction = F.rpad(F.substring(F.regexp_extract(text, r"\.([0-9]+)", 1), 1, 6), 6, "0").cast("bigint")
    zone = F.regexp_extract(text, r"([+-][0-9]{2}):?([0-9]{2})$", 1)
    zone_minutes = F.regexp_extract(text, r"([+-][0-9]{2}):?([0-9]{2})$", 2)
    offset = F.when(F.regexp_extract(text, r":[0-9]{2}(?:\.[0-9]+)?([+-][0-9]{2}:?[0-9]{2})$", 1) != "", (F.substring(zone, 2, 2).cast("bigint") * 60 + zone_minutes.cast("bigint")) * F.when(zone.startswith("-"), -1).otherwise(1)).otherwise(0)
    moment = F.try_to_timestamp(F.concat(base, F.lit(" "), clock, F.lit("+00:00")), F.lit("yyyy-MM-dd HH:mm:ssXXX"))
    return F.when(text.rlike(_FULL), F.unix_micros(moment) + F.coalesce(fraction, F.lit(0)) - offset * 60_000_000)


def second_of(text: Column) -> Column:
    """Whole seconds of the part before the first dot, without zone; null if it is not a plain time."""
    head = F.regexp_replace(F.split_part(text, F.lit("."), F.lit(1)), "[Zz]$", "")
    return F.when(head.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}$"), F.unix_micros(F.try_to_timestamp(F.concat(F.replace(head, F.lit("T"), F.lit(" ")), F.lit("+00:00")), F.lit("yyyy-MM-dd HH:mm:ssXXX"))) / 1_000_000).cast("bigint")


def micros(column: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    c = F.col(column) if isinstance(column, str) else column
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c.cast("timestamp_ntz"))


def filetime_micros(filetime: Column) -> Column:
    """Microseconds since 1970; null for zero and negative values."""
    return F.when(filetime > 0, F.call_function("div", filetime - F.lit(FILETIME_EPOCH), F.lit(10)))


def window_around(micros_: Column, before_days: int, after_days: int) -> tuple[Column, Column]:
    day = 86_400_000_000
    return micros_ - before_days * day, micros_ + after_days * day


def local_widened(start: Column, end: Column, offset_hours: int = 9, pad_hours: int = 2) -> tuple[Column, Column]:
    """A window given in local time, in UTC, padded; it only ever widens."""
    hour = 3_600_000_000
    return F.least(start, start - (offset_hours + pad_hours) * hour), F.greatest(end, end - (offset_hours - pad_hours) * hour)


def clamped(start: Column, end: Column, collected: Column) -> tuple[Column, Column]:
    """The window up to the time of collection; a start beyond it moves to it, so the window is never empty."""
    return F.least(start, collected), F.greatest(F.least(end, collected), F.least(start, collected))
