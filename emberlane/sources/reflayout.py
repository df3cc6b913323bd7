"""Records laid out by reference, so that a lookup reads the file that holds the number and no other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlane.functions.text import ref_parts

#: Numbers of one file of a prefix.
WIDTH = 100_000


def _place(number: Column, width: int) -> Column:
    return F.floor(number / width).cast("bigint")


def write_layout(records: DataFrame, path: str, *, ref: str = "ref", width: int = WIDTH) -> None:
    """Writes records by prefix and stretch of ``width`` numbers, sorted by number in a file; rows without a sound reference go to a prefix of their own.

    A stretch is written by one task. Columns named prefix, stretch or number are replaced.
    """
    parts = ref_parts(F.col(ref))
    placed = records.withColumn("number", parts["number"]).withColumn("prefix", F.coalesce(parts["prefix"], F.lit("-"))).withColumn("stretch", F.coalesce(_place(F.col("number"), width), F.lit(-1)))
    placed.repartition("prefix", "stretch").sortWithinPartitions("prefix", "stretch", "number").write.partitionBy("prefix", "stretch").parquet(path)


def lookup(spark: SparkSession, path: str, refs: list[str], *, width: int = WIDTH) -> DataFrame:
    """Records of some references; files of other prefixes and stretches are not read. A reference that is none has no record."""
    sound = [(r.split("#")[0], int(r.split("#")[1])) for r in refs if r.count("#") == 1 and r.split("#")[1].isdecimal()]
    rows = spark.read.parquet(path)
    places: dict[tuple[str, int], list[int]] = {}
    for prefix, number in sound:
        places.setdefault((prefix, number // width), []).append(number)
    wanted = F.lit(False)
    for (prefix, stretch), numbers in sorted(places.items()):
        wanted = wanted | ((F.col("prefix") == prefix) & (F.col("stretch") == stretch) & F.col("number").isin(numbers))
    return rows.where(wanted & F.col("ref").isin(refs))


def lookup_all(spark: SparkSession, path: str, refs: DataFrame, *, ref: str = "ref", width: int = WIDTH) -> DataFrame:
    """(ref, ...): the records of a table of references; stretches that it does not name are pruned while the query runs."""
    parts = ref_parts(F.col(ref))
    wanted = refs.select(F.col(ref).alias("_ref"), parts["prefix"].alias("prefix"), _place(parts["number"], width).alias("stretch"), parts["number"].alias("number")).where("prefix is not null").distinct()
    return spark.read.parquet(path).join(wanted, ["prefix", "stretch", "number"]).where(F.col("ref") == F.col("_ref")).drop("_ref", "prefix", "stretch", "number")
