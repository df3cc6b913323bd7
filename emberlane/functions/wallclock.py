"""Dates and times of day that a description names, in Korean or as digits, and time ranges that have to cover them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlane.functions.text import let

#: A date with its year or without, and the characters behind it in which its time of day may stand (fixed values).
_AHEAD = 20
_DATE = r"(?s)(?:(?:([0-9]{4})\s*년\s*)?([0-9]{1,2})\s*월\s*([0-9]{1,2})\s*일|([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2}))(?=(.{0,%d}))" % _AHEAD
_TIME = r"(오전|오후|새벽|아침|저녁|밤)?\s*(?:([0-9]{1,2})\s*시(?:\s*([0-9]{1,2})\s*분)?|([0-9]{1,2}):([0-9]{2}))"
#: Words of the two halves of a day, and what tells that times are UTC (fixed values).
_AFTERNOON, _MORNING = ("오후", "저녁", "밤"), ("오전", "새벽", "아침")
_UTC = r"(?i)\bUTC\b|\bGMT\b|[0-9]\s*Z\b|협정\s*세계시"
#: Hours that local time is ahead, and microseconds that are covered on both sides (fixed values).
OFFSET_HOURS, PAD = 9, 2 * 3_600_000_000
_MINUTE = 60_000_000


def wall_clocks(text: Column) -> Column:
    """Microseconds, as if in UTC, of the moments that a text names, in order.

    A date with a time of day behind it is one moment, a date without one is the first and
    last minute of its day. Dates without a year, days that are none and times that are none
    are left out; a time of day without a date is not looked for.
    """
    group = lambda i: F.regexp_extract_all(text, F.lit(_DATE), F.lit(i))
    either = lambda a, b: F.when(a != "", a).otherwise(b)

    def moments(found: Column) -> Column:
        part = lambda i: F.regexp_extract(found["tail"], _TIME, i)
        day = F.unix_date(F.try_to_date(F.concat_ws("-", found["y"], F.lpad(found["m"], 2, "0"), F.lpad(found["d"], 2, "0")), "yyyy-MM-dd"))
        hour, minute = either(part(2), part(4)).try_cast("int"), F.coalesce(either(part(3), part(5)).try_cast("int"), F.lit(0))
        full = F.when(part(1).isin(*_AFTERNOON) & (hour < 12), hour + 12).when(part(1).isin(*_MORNING) & (hour == 12), 0).otherwise(hour)
        start = day.cast("bigint") * 1440
        one = F.when((full <= 23) & (minute <= 59), F.array(start + full * 60 + minute)).otherwise(F.array().cast("array<bigint>"))
        return F.when((found["y"] == "") | day.isNull(), F.array().cast("array<bigint>")).when(hour.isNull(), F.array(start, start + 1439)).otherwise(one)

    rows = F.transform(
        F.arrays_zip(group(1).alias("y1"), group(2).alias("m1"), group(3).alias("d1"), group(4).alias("y2"), group(5).alias("m2"), group(6).alias("d2"), group(7).alias("tail")),
        lambda r: F.named_struct(F.lit("y"), either(r["y1"], r["y2"]), F.lit("m"), either(r["m1"], r["m2"]), F.lit("d"), either(r["d1"], r["d2"]), F.lit("tail"), r["tail"]),
    )
    return F.transform(F.flatten(F.transform(rows, moments)), lambda m: m * _MINUTE)


def covering(text: Column, start: Column, end: Column, *, offset_hours: int = OFFSET_HOURS, pad: int = PAD) -> Column:
    """(start, end, clocks): a range in microseconds, widened so that it covers every moment that the text names, with ``pad`` around it.

    Moments are local time in a text with Hangul and UTC where the text says so; of other
    texts nothing is assumed. A range only widens; clocks are the moments if it did, else null.
    """
    hours = F.when(text.rlike(_UTC), 0).when(text.rlike("[가-힣]"), offset_hours).cast("bigint")

    def widened(clocks: Column) -> Column:
        low, high = F.array_min(clocks) - hours * 60 * _MINUTE - pad, F.array_max(clocks) - hours * 60 * _MINUTE + pad
        more = F.coalesce((low < start) | (high > end), F.lit(False))
        return F.named_struct(F.lit("start"), F.when(more, F.least(start, low)).otherwise(start), F.lit("end"), F.when(more, F.greatest(end, high)).otherwise(end), F.lit("clocks"), F.when(more, clocks))

    return let(wall_clocks(text), widened)
