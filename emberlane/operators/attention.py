"""Signals that ask for attention: what matched, around which moment, and which records stand for it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlane.operators.windows import densest_start, soft_cap
from emberlane.tables import written


@dataclass(frozen=True)
class Signal:
    """Holds if the text has every token of ``every``, or any of ``any``, or the record a flag of ``flags``; an empty list never holds."""

    name: str
    every: tuple[str, ...] = ()
    any: tuple[str, ...] = ()
    flags: tuple[str, ...] = ()
    score: int = 1


def matches(records: DataFrame, signals: list[Signal], *, text: str = "text", flags: str = "flags") -> DataFrame:
    """Adds a row a signal that holds: signal, score, requirement (every, any or flags, the first that holds), tokens (those found)."""
    found, low = [], F.col("_low")
    for s in signals:
        held = lambda words: F.array_compact(F.array(*(F.when(F.contains(low, F.lit(w.lower())), F.lit(w)) for w in words))) if words else F.array().cast("array<string>")
        flagged = F.array_intersect(F.col(flags), F.array(*map(F.lit, s.flags))) if s.flags else F.array().cast("array<string>")
        why = F.when((F.size(held(s.every)) == len(s.every)) & F.lit(bool(s.every)), "every").when(F.size(held(s.any)) > 0, "any").when(F.size(flagged) > 0, "flags")
        tokens = F.when(why == "every", held(s.every)).when(why == "any", held(s.any)).otherwise(flagged)
        found.append(F.when(why.isNotNull(), F.struct(F.lit(s.name).alias("signal"), F.lit(s.score).alias("score"), why.alias("requirement"), tokens.alias("tokens"))))
    # the text is made lower once; a plain explode would let the optimizer test the size of the list at the scan, and so match twice
    each = records.withColumn("_low", F.lower(F.col(text))).withColumn("_found", F.array_compact(F.array(*found)))
    return each.withColumn("_m", F.explode_outer("_found")).where("_m is not null").select(*records.columns, "_m.*")


def apply(records: DataFrame, signals: list[Signal], *, width: int, per_signal: int, same: int) -> DataFrame:
    """(case, signal, ref, seat, requirement, tokens, anchor): the records that stand for each signal of a case.

    records: case, ref, at (microseconds), text, flags, repeat. The anchor of a case is the
    start of its densest window of signals. Records of a signal are taken by score, distance to the
    anchor, time and ref; of one repeat key the first ``same``, others only while seats remain.
    A case without a known time has no anchor, and its records are taken by score and ref.
    """
    hit = written(matches(records, signals).drop("text", "flags"), "signals")  # read twice
    anchors = densest_start(hit.where("at is not null"), key="case", at="at", signal="signal", width=width).select("case", F.col("start").alias("anchor"))
    near = hit.join(anchors, "case", "left").withColumn("_far", F.abs(F.col("at") - F.col("anchor")))
    order = [F.desc("score"), F.asc_nulls_last("_far"), F.asc_nulls_last("at"), "ref"]
    chosen = soft_cap(near, group=["case", "signal"], repeat="repeat", order=order, first=same, seats=per_signal)
    return chosen.select("case", "signal", "ref", F.col("seat").cast("bigint").alias("seat"), "requirement", "tokens", "anchor")


def context_table(links: DataFrame, *, axes: list[str], most: int) -> DataFrame:
    """The ``most`` links whose axis comes first, then the earliest, with their place by time. links: axis, value, at."""
    priority = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for i, a in enumerate(axes) for x in (a, i))), F.col("axis")), F.lit(len(axes)))
    kept = links.withColumn("_p", priority).orderBy("_p", F.asc_nulls_first("at"), "axis", "value").limit(most)  # a table of ``most`` rows from here on
    return kept.select("axis", "value", "at", F.row_number().over(Window.orderBy(F.asc_nulls_first("at"), "axis", "value")).cast("bigint").alias("place"))
