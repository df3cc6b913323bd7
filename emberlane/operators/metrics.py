"""Tallies, recall and precision, evidence funnels, reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlane.functions.compare import ratio


def tally(rows: DataFrame, by: list[list[str]]) -> DataFrame:
    """Counts for several sets of columns at once (grouping sets): every column, null where it is not grouped, grouping_id and n."""
    columns = list(dict.fromkeys(c for cs in by for c in cs))
    sets = [[F.col(c) for c in cs] for cs in by]
    return rows.groupingSets(sets, *columns).agg(F.grouping_id().alias("grouping"), F.count("*").alias("n"))


def set_scores(expected: DataFrame, got: DataFrame, *, case: str, item: str) -> DataFrame:
    """(case, expected, got, hit, precision, recall); a ratio is null when its denominator is 0."""
    both = expected.select(case, item, F.lit(1).alias("e")).join(got.select(case, item, F.lit(1).alias("g")), [case, item], "full_outer")
    sums = both.groupBy(case).agg(F.count("e").alias("expected"), F.count("g").alias("got"), F.count_if(F.col("e").isNotNull() & F.col("g").isNotNull()).alias("hit"))
    return sums.withColumn("precision", ratio(F.col("hit"), F.col("got"))).withColumn("recall", ratio(F.col("hit"), F.col("expected")))


def funnel(required: DataFrame, steps: dict[str, DataFrame], *, key: str) -> DataFrame:
    """(first_break, n): how many required keys reach which step. A step counts only when all before it do."""
    out = required.select(key).distinct()
    for name, rows in steps.items():
        out = out.join(rows.select(key).distinct().withColumn(name, F.lit(True)), key, "left")
    broken = F.lit("complete")
    for name in reversed(list(steps)):
        broken = F.when(F.col(name).isNull(), name).otherwise(broken)
    return out.groupBy(broken.alias("first_break")).agg(F.count("*").alias("n"))


def reconcile(declared: DataFrame, found: DataFrame, *, key: str, counts: list[str]) -> DataFrame:
    """(key, counts, declared, found): counts that differ; a missing side counts 0."""
    both = declared.select(key, *(F.col(c).alias(f"d_{c}") for c in counts)).join(found.select(key, *(F.col(c).alias(f"f_{c}") for c in counts)), key, "full_outer")
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("what"), F.coalesce(f"d_{c}", F.lit(0)).alias("declared"), F.coalesce(f"f_{c}", F.lit(0)).alias("found")) for c in counts)))
    return both.select(key, each.alias("x")).select(key, "x.*").where("declared <> found")


def rejections_by_combination(rejections: DataFrame, ledger: DataFrame) -> DataFrame:
    """(technique, artifacts, n, status): rejections of a technique and a set of artifacts, with what a ledger says of that pair; ``new`` where it says nothing.

    rejections: technique, artifacts (array); ledger: technique, artifacts (array), status.
    """
    key = F.array_join(F.array_sort(F.array_distinct("artifacts")), ",").alias("artifacts")
    grouped = rejections.select("technique", key).groupBy("technique", "artifacts").agg(F.count("*").alias("n"))
    known = ledger.select("technique", key, "status").groupBy("technique", "artifacts").agg(F.max("status").alias("status"))
    return grouped.join(known, ["technique", "artifacts"], "left").na.fill("new", ["status"])


def reason_histogram(rejections: DataFrame) -> DataFrame:
    return rejections.groupBy("reason").agg(F.count("*").alias("n"))


def behaviours_reported(texts: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Adds ``behaviours``, the labels whose pattern occurs in ``text``, in the order of the labels."""
    hits = (F.when(F.col("text").rlike("(?i)" + p), F.lit(label)) for label, p in patterns.items())
    return texts.withColumn("behaviours", F.array_compact(F.array(*hits)))


def manifest_totals(files: DataFrame, counts: list[str]) -> DataFrame:
    return files.agg(F.count("*").alias("files"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts))
