"""Handing out a bounded number of places to records: ranks within artifacts, seats by highest averages, a lane past the limit, a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlane.operators.joins import nearest_anchor
from emberlane.operators.ranking import weight_of

#: Depth of a record that no named entity leads to.
UNNAMED = 1000


def candidates(records: DataFrame, anchors: DataFrame, *, tolerance: int, window: tuple[int, int]) -> DataFrame:
    """Records that are no noise, with the keys that order them within their artifact.

    records: case, ref, artifact, at (microseconds), signal, noise, kept (booleans), depth
    (0 for a named entity, null where unknown), burst (boolean), repeat, must, size; priority
    if known. anchors: case, at.
    Keys: affinity (0 named, 1 + depth in its tree, UNNAMED else), burst band (0 in a burst),
    tier (0 signal, 1 near an anchor, 2 only in scope), window band (0 inside, 1 kept by a
    flag, 2 outside; an unknown time is outside), distance to an anchor.
    """
    live = records.where(~F.coalesce("noise", F.lit(False)))
    near = nearest_anchor(live, anchors, by=["case"], point="at", anchor="at", tolerance=tolerance)
    inside = F.coalesce(F.col("at").between(*window), F.lit(False))
    return near.select(
        "*",
        F.when(F.col("depth") == 0, 0).otherwise(F.coalesce(F.col("depth") + 1, F.lit(UNNAMED))).cast("int").alias("affinity"),
        F.when(F.col("burst"), 0).otherwise(1).alias("burst_band"),
        F.when(F.col("signal"), 0).when(F.col("distance").isNotNull(), 1).otherwise(2).alias("tier"),
        F.when(inside, 0).when(F.col("kept"), 1).otherwise(2).alias("window_band"),
    )


def keys() -> list[Column]:
    return [F.col("affinity"), F.col("burst_band"), F.col("tier"), F.col("window_band"), F.asc_nulls_last("distance"), F.asc_nulls_last("at"), F.col("ref")]


def quotas(ranked: DataFrame, parsed: DataFrame) -> DataFrame:
    """(case, artifact, parsed, candidates, cap, weight): rows read, rows that may be seated, those of the first two window bands, and the weight of the strongest priority."""
    read = parsed.groupBy("case", "artifact").agg(F.count("*").alias("parsed"))
    own = ranked.groupBy("case", "artifact").agg(F.count("*").alias("candidates"), F.count_if(F.col("window_band") < 2).alias("cap"), weight_of(F.least(F.coalesce(F.min("priority"), F.lit(2)), F.lit(2))).alias("weight"))
    return read.join(own, ["case", "artifact"], "left").na.fill(0, ["candidates", "cap"]).na.fill(2.0, ["weight"])


def allocate(records: DataFrame, anchors: DataFrame, *, tolerance: int, window: tuple[int, int], limit: int, repeats: int, budget: int) -> DataFrame:
    """(case, place, ref, artifact, guaranteed): the records of a case that are delivered, in the order of their times.

    Within an artifact, rows of one repeat key beyond the first ``repeats`` wait behind
    the others, and beyond twice as many they are left out. Artifacts are seated by highest
    averages: a first seat each, then up to their cap, then the rest. Records that must be seen
    take no seat. Both together are cut where their sizes exceed ``budget``, which records that must be
    seen never are. No more than ``limit`` rows of an artifact are ranked across artifacts, so a
    case with very many rows is cut before its rows meet in one task.
    """
    rows = candidates(records, anchors, tolerance=tolerance, window=window)
    lane = rows.where("must").select("case", "ref", "artifact", "at", "size", F.lit(0).alias("seat"), F.lit(True).alias("guaranteed"))
    of_repeat = Window.partitionBy("case", "artifact", "repeat").orderBy(*keys())
    capped = rows.where(~F.coalesce("must", F.lit(False))).withColumn("_n", F.row_number().over(of_repeat)).where(F.col("_n") <= 2 * repeats)
    shares = capped.groupBy("case", "artifact").agg(F.count_if(F.col("window_band") < 2).alias("cap"), weight_of(F.least(F.coalesce(F.min("priority"), F.lit(2)), F.lit(2))).alias("weight"))
    within = F.row_number().over(Window.partitionBy("case", "artifact").orderBy((F.col("_n") > repeats), *keys()))
    first = capped.withColumn("k", within).where(F.col("k") <= limit).join(shares, ["case", "artifact"])
    round_ = F.when(F.col("k") == 1, 0).when(F.col("k") <= F.col("cap"), 1).otherwise(2)
    order = Window.partitionBy("case").orderBy(round_, F.desc(F.col("weight") / F.col("k")), "artifact", "k")
    seated = first.withColumn("seat", F.row_number().over(order)).where(F.col("seat") <= limit)
    both = lane.unionByName(seated.select("case", "ref", "artifact", "at", "size", "seat", F.lit(False).alias("guaranteed")))
    used = F.sum("size").over(Window.partitionBy("case").orderBy("seat", "artifact", "ref").rowsBetween(Window.unboundedPreceding, 0))
    fits = both.withColumn("_used", used).where(F.col("guaranteed") | (F.col("_used") <= budget))
    place = F.row_number().over(Window.partitionBy("case").orderBy(F.asc_nulls_last("at"), "artifact", "seat", "ref"))
    return fits.select("case", place.cast("bigint").alias("place"), "ref", "artifact", "guaranteed")
