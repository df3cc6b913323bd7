"""Ordered analytics: bursts, densest windows, caps per key, durations, owners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def trailing_counts(rows: DataFrame, *, key: str, at: str, kind: str, width: int, ordinal: list[str]) -> DataFrame:
    """Adds ``_kinds`` and ``_rows``: different kinds and rows of the key in the ``width`` up to each row, ties included.

    A sweep: a kind is alive from a row of it until ``width`` after the last one, so each
    row opens its kind if it was not alive, and closes it if no other row renews it. Running
    sums of openings and closings are the counts; no window is held, whatever its rows.
    """
    same = Window.partitionBy(key, kind).orderBy(at, *ordinal)
    opens = F.col(kind).isNotNull() & ~F.coalesce(F.lag(at).over(same) >= F.col(at) - width, F.lit(False))
    closes = F.col(kind).isNotNull() & ~F.coalesce(F.lead(at).over(same) <= F.col(at) + width, F.lit(False))
    marked = rows.withColumn("_opens", opens.cast("int")).withColumn("_closes", closes.cast("int"))
    ends = marked.select(key, (F.col(at) + width).alias(at), (-F.col("_closes")).alias("_opens"), F.lit(-1).alias("_step"), F.lit(1).alias("_end"))
    both = marked.withColumn("_step", F.lit(1)).withColumn("_end", F.lit(0)).unionByName(ends, allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy(at, "_end")  # what ends at a time still counts there; rows of one time see each other
    out = both.withColumn("_kinds", F.sum("_opens").over(order)).withColumn("_rows", F.sum("_step").over(order))
    return out.where("_end = 0").drop("_opens", "_closes", "_step", "_end")


def first_burst(rows: DataFrame, *, key: str, at: str, ordinal: str, endpoint: str, ref: str, width: int, least: int) -> DataFrame:
    """(key, at, refs): for each key, the first row whose trailing window holds ``least`` different endpoints, and the window's rows.

    Rows are in the order of (at, ordinal). The window of a row reaches back ``width`` and
    ends with the row itself. Only rows that could end a burst, were all rows of their time
    before them, are looked at again, and refs are gathered for the burst alone.
    """
    counted = trailing_counts(rows, key=key, at=at, kind=endpoint, width=width, ordinal=[ordinal])
    time = counted.where(F.col("_kinds") >= least).groupBy(key).agg(F.min(at).alias("_burst"))
    held = rows.join(time, key).where((F.col(at) <= F.col("_burst")) & (F.col(at) >= F.col("_burst") - width))
    fresh = F.col(endpoint).isNotNull() & (F.row_number().over(Window.partitionBy(key, endpoint).orderBy(at, ordinal)) == 1)
    kinds = held.withColumn("_fresh", fresh.cast("int")).withColumn("_seen", F.sum("_fresh").over(Window.partitionBy(key).orderBy(at, ordinal).rowsBetween(Window.unboundedPreceding, 0)))
    # at the burst's time the row that brings the last endpoint ends it
    inside = kinds.where((F.col("_seen") < least) | (F.col("_fresh") == 1) & (F.col("_seen") == least) | (F.col(at) < F.col("_burst")))
    found = inside.groupBy(key).agg(F.max(F.col("_burst")).alias("at"), F.array_sort(F.collect_list(F.struct(F.col(at).alias("t"), F.col(ordinal).alias("o"), F.col(ref).alias("r")))).alias("w"))
    return found.select(key, "at", F.transform("w", lambda x: x.r).alias("refs"))


def densest_start(rows: DataFrame, *, key: str, at: str, signal: str, width: int, reference: Column | None = None) -> DataFrame:
    """(key, start, signals, density): the start whose forward window has most different signals, then lies nearest to the reference, then is densest; the earliest wins."""
    back = rows.select(key, (-F.col(at)).alias("_back"), F.col(signal).alias("_signal"))
    scored = trailing_counts(back, key=key, at="_back", kind="_signal", width=width, ordinal=[]).select(key, (-F.col("_back")).alias(at), "_kinds", "_rows")
    far = F.abs(F.col(at) - reference) if reference is not None else F.lit(0)
    best = F.max_by(F.struct(F.col(at).alias("start"), F.col("_kinds").alias("signals"), F.col("_rows").alias("density")), F.struct("_kinds", -far, "_rows", -F.col(at)))
    return scored.groupBy(key).agg(best.alias("b")).select(key, F.col("b.start").alias("start"), F.col("b.signals").alias("signals"), F.col("b.density").alias("density"))


def soft_cap(rows: DataFrame, *, group: list[str], repeat: str, order: list, first: int, seats: int) -> DataFrame:
    """The first ``seats`` of each group, where a repeat key's rows after the first few wait until all others are seated."""
    rank = F.row_number().over(Window.partitionBy(*group, repeat).orderBy(*order))
    seat = F.row_number().over(Window.partitionBy(*group).orderBy((F.col("_rank") > first), *order))
    return rows.withColumn("_rank", rank).withColumn("seat", seat).where(F.col("seat") <= seats).drop("_rank")


def hard_cap(rows: DataFrame, *, group: list[str], repeat: str, order: list, first: int, seats: int) -> DataFrame:
    """As soft_cap, with no more than twice ``first`` rows of a repeat key."""
    rank = F.row_number().over(Window.partitionBy(*group, repeat).orderBy(*order))
    seat = F.row_number().over(Window.partitionBy(*group).orderBy((F.col("_rank") > first), *order))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= 2 * first).withColumn("seat", seat).where(F.col("seat") <= seats).drop("_rank")


def nested_caps(rows: DataFrame, *, levels: list[tuple[list[str], int]], order: list) -> DataFrame:
    """Keeps the first rows of each key, level after level, in one order."""
    for i, (keys, most) in enumerate(levels):
        window = Window.partitionBy(*keys).orderBy(*order) if keys else None
        if window is None:
            return rows.orderBy(*order).limit(most)
        rows = rows.withColumn(f"_l{i}", F.row_number().over(window)).where(F.col(f"_l{i}") <= most).drop(f"_l{i}")
    return rows


def stage_durations(rows: DataFrame, *, run: str, stage: str, at: str) -> DataFrame:
    """Adds ``seconds`` since the stage before; null for the first stage, after a gap, and when time runs backwards."""
    order = Window.partitionBy(run).orderBy(stage)
    step = F.col(at) - F.lag(at).over(order)
    follows = F.col(stage) - F.lag(stage).over(order) == 1
    return rows.withColumn("seconds", F.when(follows & (step >= 0), F.bround(step / 1_000_000, 3)))


def owner(claims: DataFrame, *, ref: str, who: str, ordinal: str) -> DataFrame:
    """The first claimant of each ref."""
    return claims.groupBy(ref).agg(F.min_by(who, F.struct(ordinal, who)).alias("owner"))


def islands(rows: DataFrame, *, key: list[str], place: str, flag: str, least: int) -> DataFrame:
    """(key, first, last, n): maximal runs of flagged places, ``least`` long or longer."""
    step = F.col(place) - F.row_number().over(Window.partitionBy(*key).orderBy(place))
    runs = rows.where(F.col(flag)).withColumn("_run", step).groupBy(*key, "_run").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"))
    return runs.where(F.col("n") >= least).drop("_run")
