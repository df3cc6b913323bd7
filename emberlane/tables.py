"""Tables written on the way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset a local session gets a temporary folder; a cluster must set it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="emberlane-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """df as a table in the shared folder: it has no lineage, and it outlives executors."""
    at = new_path(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def dealt(df: DataFrame, rows: int, *keys: str, each: int = 250_000) -> DataFrame:
    """df dealt out by the keys over so many tasks that each has about ``each`` of ``rows`` rows, and no fewer than Spark would take.

    Tasks grow in number, not in size: Spark joins small parts to some megabytes of packed bytes,
    which sorts and hash tables unpack to a hundred times that, but leaves a given number alone.
    """
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // each)), *keys)
