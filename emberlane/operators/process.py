"""Processes that descend from some, by ids and, where there is none, by number and image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlane.tables import written

#: A time for rows that have none, so that they are only near each other.
NO_TIME = -(1 << 62)


def _key(column: str) -> Column:
    """Lower case without blanks at the ends; null for an empty one."""
    text = F.lower(F.trim(F.col(column).cast("string")))
    return F.when(text != "", text)


def started_within(points: DataFrame, starts: DataFrame, *, by: list[str], at: str, within: int) -> DataFrame:
    """The points (by, at, ...) that some start (by, at) of their keys precedes by ``within`` at most.

    Both lie in one order per key and the last start is carried along, so no pair is formed;
    time is cut into buckets of that width, so that a key with very many rows is spread.
    """
    bucket = F.floor(F.col(at) / within).cast("bigint")
    p = points.withColumn("_start", F.lit(None).cast("bigint")).withColumn("_bucket", bucket)
    s = starts.select(*by, at).distinct().withColumn("_start", F.col(at)).withColumn("_bucket", F.explode(F.array(bucket, bucket + 1)))
    both = p.withColumn("_point", F.lit(True)).unionByName(s.withColumn("_point", F.lit(False)), allowMissingColumns=True)
    last = F.last("_start", ignorenulls=True).over(Window.partitionBy(*by, "_bucket").orderBy(at).rangeBetween(Window.unboundedPreceding, 0))
    return both.withColumn("_last", last).where(F.col("_point") & (F.col(at) - F.col("_last") <= within)).select(*points.columns)


def process_closure(rows: DataFrame, seeds: DataFrame, *, key: str, guid: str, parent_guid: str, number: str, image: str, parent_number: str, parent_image: str, at: str, within: int = 120_000_000, depth: int = 4) -> DataFrame:
    """(key, depth): processes reached from the seeds (key), at their least depth, ``depth`` at most.

    A process is a child of one whose guid is its parent guid ("-" is none), and of one
    whose number and image are its parent number and image and that started at the same
    time or at most ``within`` before it, as numbers are used again. Keys are compared in
    lower case; rows without a time are near each other only. A level is reached by two
    joins with the one before, whatever number of processes share a key, and written.
    """
    own = rows.select(F.col(key).alias("k"), _key(guid).alias("g"), _key(parent_guid).alias("pg"), _key(number).alias("n"), _key(image).alias("i"), _key(parent_number).alias("pn"), _key(parent_image).alias("pi"), F.coalesce(F.col(at).cast("bigint"), F.lit(NO_TIME)).alias("t")).where("k is not null")
    own = written(own, "processes")
    level = written(own.join(seeds.select(F.col(key).alias("k")).distinct(), "k", "left_semi"), "level")
    reached = level.select("k", F.lit(0).alias("depth"))
    for d in range(1, depth + 1):
        if level.isEmpty():
            break
        rest = own.join(reached.select("k"), "k", "left_anti")
        by_guid = rest.join(level.where("g <> '-'").select(F.col("g").alias("pg")).distinct(), "pg", "left_semi").select(*own.columns)
        starts = level.where("n is not null and i is not null").select(F.col("n").alias("pn"), F.col("i").alias("pi"), "t")
        by_number = started_within(rest.where("pn is not null and pi is not null"), starts, by=["pn", "pi"], at="t", within=within)
        level = written(by_guid.unionByName(by_number.select(*own.columns)).dropDuplicates(["k"]), "level")
        reached = reached.unionByName(level.select("k", F.lit(d).alias("depth")))
    return reached.groupBy("k").agg(F.min("depth").alias("depth")).withColumnRenamed("k", key)
