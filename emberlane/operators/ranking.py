"""Ranking, seat allocation by highest averages, budgets, sampling and packing into chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlane.tables import written

#: Weight of a priority (fixed values); anything else counts as priority 2.
WEIGHTS = {1: 4.0, 2: 2.0, 3: 1.0}


def weight_of(priority: Column) -> Column:
    return F.when(priority == 1, 4.0).when(priority == 3, 1.0).otherwise(2.0)


def seats(parties: DataFrame, *, party: str, weight: str, items: str, cap: str, limit: int) -> DataFrame:
    """(party, seats, wasted): highest averages with a first seat each, then seats up to the cap, then the rest.

    A party's averages fall with each seat, so the greedy choice is a sort of all seats
    by (round, average, party). Seats that no item fills are wasted, as they are handed
    out by cap. A party never needs more than ``limit`` seats, which bounds the seats.
    """
    most = F.least(F.lit(limit), F.greatest(F.col(items), F.greatest(F.lit(1), F.col(cap))))
    each = parties.select(party, weight, items, cap, F.explode(F.sequence(F.lit(1), most.cast("int"))).alias("k"))
    round_ = F.when(F.col("k") == 1, 0).when(F.col("k") <= F.greatest(F.lit(1), F.col(cap)), 1).otherwise(2)
    # the best seats of each part suffice, so no part sorts all seats
    ranked = each.select(party, items, "k", round_.alias("r"), (F.col(weight) / F.when(F.col("k") == 1, 1).otherwise(F.col("k"))).alias("average"))
    won = ranked.orderBy("r", F.desc("average"), party).limit(limit)
    return won.groupBy(party).agg(F.count_if(F.col("k") <= F.col(items)).alias("seats"), F.count_if(F.col("k") > F.col(items)).alias("wasted"))


def numbered(rows: DataFrame, *, group: str, order: list, place: str = "rank", size: str | None = None) -> DataFrame:
    """Adds ``place``, the number of a row in its group's order from 1, and with ``size`` the number of rows of its group.

    Rows are dealt out by ranges of (group, order) and sorted, so a group of any size lies in
    as many tasks as it needs; a row's place is its place in its task, plus the rows of the
    group in the tasks before, which are one number for each task and group.
    """
    kept = [F.col(c) for c in rows.columns]
    keys = [F.col(k) if isinstance(k, str) else k for k in order]
    placed = rows.repartitionByRange(F.col(group), *keys).sortWithinPartitions(F.col(group), *keys)
    at = written(placed.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", 33)
    counts = at.groupBy(F.col(group).alias("_g"), part.alias("_sp")).agg(F.min("_at").alias("_first"), F.count("*").alias("_in"))
    of_group = Window.partitionBy("_g").orderBy("_sp")
    before = F.coalesce(F.sum("_in").over(of_group.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_g", "_sp", "_first", before.alias("_before"), F.sum("_in").over(Window.partitionBy("_g")).alias("_all"))
    # a task has the rows of a few groups, and a table of them one row for each
    met = at.withColumn("_part", part).join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_sp")))
    return met.select(*kept, (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias(place), *([F.col("_all").alias(size)] if size else []))


def within_group_rank(rows: DataFrame, *, group: str, keys: list) -> DataFrame:
    return numbered(rows, group=group, order=keys)


def budget_prefix(rows: DataFrame, *, group: str, order: list, size: str, budget: int) -> DataFrame:
    """The longest prefix of each group whose sizes sum to the budget or less."""
    total = F.sum(size).over(Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("used", total).where(F.col("used") <= budget)


def evenly_spaced(rows: DataFrame, *, group: str, order: list, n: int) -> DataFrame:
    """``n`` rows of each group at even steps of its order, or all of a smaller group."""
    numbers = numbered(rows, group=group, order=order, place="_p", size="_n").withColumn("_p", F.col("_p") - 1)
    keep = (F.col("_n") <= n) | (F.floor(F.col("_p") * n / F.col("_n")) > F.floor((F.col("_p") - 1) * n / F.col("_n")))
    return numbers.where(keep).drop("_p", "_n")


def next_fit(rows: DataFrame, *, case: str, unit: str, order: str, size: str, capacity: int) -> DataFrame:
    """Adds ``chunk``: units in order fill chunks of a capacity. A unit stays whole unless it alone exceeds the capacity; then it is cut, in order, wherever its running size passes a multiple of the capacity.

    Next-fit depends on every earlier choice, so a case is walked in order, over totals of units
    only. A task walks its cases one after the other as a stream, so nothing is held but the chunk
    that is being filled.
    """
    sofar = F.sum(size).over(Window.partitionBy(case, unit).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum(size).over(Window.partitionBy(case, unit))
    cut = rows.withColumn("_piece", F.when(whole > capacity, F.floor((sofar - 1) / capacity)).otherwise(0).cast("bigint"))
    units = cut.groupBy(case, unit, "_piece").agg(F.min(order).alias("_first"), F.sum(size).alias("_total"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, used, last = 0, 0, ()
        for batch in batches:
            out = []
            for of, total in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if last != (of,):
                    chunk, used, last = 0, 0, (of,)
                total = total or 0
                if used and used + total > capacity:
                    chunk, used = chunk + 1, 0
                out.append(chunk)
                used += total
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.int64())], names=[case, unit, "_piece", "chunk"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    in_order = units.repartition(case).sortWithinPartitions(case, F.asc_nulls_last("_first"), unit, "_piece").select(case, unit, "_piece", "_total")
    placed = in_order.mapInArrow(walk, f"`{case}` {kinds[case]}, `{unit}` {kinds[unit]}, _piece long, chunk long")
    return cut.join(placed, [case, unit, "_piece"]).drop("_piece")
