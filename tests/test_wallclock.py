"""Moments that descriptions name, by hand."""

from datetime import datetime

from pyspark.sql import functions as F

from emberlane.functions.wallclock import covering, wall_clocks


def test_moments(spark):
    at = lambda *x: int((datetime(*x) - datetime(1970, 1, 1)).total_seconds()) * 1_000_000
    cases = {
        "2026년 9월 7일 오전 11시경": [at(2026, 9, 7, 11, 0)], "2026.09.07 오후 12시 5분": [at(2026, 9, 7, 12, 5)], "2026-9-7 오전 12:30": [at(2026, 9, 7, 0, 30)], "9월 7일 오후 3시": [], "오후 3시": [], "": [],
        "2026년 2월 30일": [], "2024-02-29": [at(2024, 2, 29, 0, 0), at(2024, 2, 29, 23, 59)], "2026-01-01 밤 11시 59분 2026-01-02 24:00": [at(2026, 1, 1, 23, 59)], "2026/1/2\n새벽 3시": [at(2026, 1, 2, 3, 0)],
        "2026-01-02 에는 아무 일도 없었고 그 뒤로 한참 지나 5시": [at(2026, 1, 2, 0, 0), at(2026, 1, 2, 23, 59)], "12026-01-02": [at(2026, 1, 2, 0, 0), at(2026, 1, 2, 23, 59)], "2026-01-02 99:99": [],
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    assert {r.i: r.c for r in df.select("i", wall_clocks(F.col("t")).alias("c")).collect()} == dict(enumerate(cases.values()))
    assert spark.range(1).select(wall_clocks(F.lit(None).cast("string")).alias("c")).first().c is None


def test_ranges_only_widen(spark):
    hour, day = 3_600_000_000, 19_724 * 24 * 3_600_000_000  # 2024-01-02
    cases = [("2024-01-02 12:00 에", 0, (day + hour, day + 5 * hour, True)), ("2024-01-02 12:00 UTC", 0, (day + 10 * hour, day + 14 * hour, True)), ("2024-01-02 12:00", 0, None), ("2024-01-02 12:00 에", 1, None), (None, 0, None), ("에", 0, None)]
    for text, wide, want in cases:
        start, end = (day, day + 24 * hour) if wide else (day + 3 * hour, day + 4 * hour)
        if want and not wide and "UTC" in text:
            start, end = day + 11 * hour, day + 12 * hour
        r = spark.range(1).select(covering(F.lit(text).cast("string"), F.lit(start), F.lit(end)).alias("c")).first().c
        assert (r.start, r.end, r.clocks is not None) == (want or (start, end, False)), text
