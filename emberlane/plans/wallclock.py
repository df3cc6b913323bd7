"""Time ranges of events' descriptions, which name days and times of day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlane.functions.times import clamped
from emberlane.functions.wallclock import covering
from emberlane.plans.views import EVENTS_SQL, events

#: Descriptions by k mod their number, with the minutes after the day's start that they name (None: the range stays) and whether they are local time. @d is the day of January 2024.
SHAPES = [
    ("2024년 1월 @d일 오후 3시 20분경 실행", [920], True), ("2024-01-@d 11:05 에 꽂음", [665], True), ("1월 @d일 오전 9시", None, True), ("2024.1.@d 전체", [0, 1439], True), ("2024년 1월 @d일 새벽 12시부터 2024-01-@d 밤 11시", [0, 1380], True), ("On 2024-01-@d 11:05", None, True),
    ("2024-01-@d 13:37 UTC 에", [817], False), ("2024-01-@d 25:10 이상", None, True), ("2024-13-@d 이상", None, True), ("오후 3시", None, True), ("2024년 1월 @d일, 아주 긴 설명이 이어지고 나서야 비로소 오후 3시", [0, 1439], True), ("2024/01/@d 10:61 한", None, True), (None, None, True),
]


def described_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hour after each event, widened to what its description names, up to the end of January."""
    e = events(spark, sf_dir)
    shape = F.get(F.array(*(F.lit(s).cast("string") for s, _, _ in SHAPES)), (F.col("k") % len(SHAPES)).cast("int"))
    text = F.replace(shape, F.lit("@d"), F.lpad((F.col("user_id") % 28 + 1).cast("string"), 2, "0"))
    rows = e.select("event_id", covering(text, F.col("us"), F.col("us") + 3_600_000_000).alias("c"))
    start, end = clamped(F.col("c.start"), F.col("c.end"), F.lit(1_706_700_000_000_000))
    return rows.select("event_id", start.alias("start_us"), end.alias("end_us"), F.array_join(F.transform("c.clocks", lambda x: x.cast("string")), ",").alias("clocks"))


QUERIES = {"described_ranges": described_ranges}
_LOW = "[" + ", ".join("null" if m is None else str(min(m)) for _, m, _ in SHAPES) + "]"
_HIGH = "[" + ", ".join("null" if m is None else str(max(m)) for _, m, _ in SHAPES) + "]"
_ALL = "[" + ", ".join("null" if m is None else str(m) for _, m, _ in SHAPES) + "]"
_AHEAD = "[" + ", ".join("540" if local else "0" for _, _, local in SHAPES) + "]"
ORACLE = {
    "described_ranges": f"""
with {EVENTS_SQL}, s as (select event_id, us, k % {len(SHAPES)} + 1 as i, 1704067200000000 + (user_id % 28) * 86400000000 as day from ev),
b as (select *, day + ({_LOW}[i] - {_AHEAD}[i] - 120)::bigint * 60000000 as low, day + ({_HIGH}[i] - {_AHEAD}[i] + 120)::bigint * 60000000 as high from s),
w as (select *, coalesce(low < us or high > us + 3600000000, false) as more from b),
r as (select *, case when more then least(us, low) else us end as s0, case when more then greatest(us + 3600000000, high) else us + 3600000000 end as e0 from w)
select event_id, least(s0, 1706700000000000) as start_us, greatest(least(e0, 1706700000000000), least(s0, 1706700000000000)) as end_us,
  case when more then array_to_string(list_transform({_ALL}[i], lambda m: day + m::bigint * 60000000), ',') end as clocks from r"""
}
