"""The tables as the operators see them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlane.functions.times import micros


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, us (microseconds), user_id, event_type, value, k (from props)."""
    return table(spark, sf_dir, "events").select("event_id", micros("ts").alias("us"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


#: The same view in SQL.
EVENTS_SQL = "ev as (select event_id, epoch_us(ts) as us, user_id, event_type, value, cast(json_extract_string(props, '$.k') as bigint) as k from events)"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as evidence records: artifact by type, event id and fields by k."""
    kinds = {"click": "evtx:Sysmon", "view": "evtx:Security", "purchase": "evtx:System", "error": "evtx:Application", "signup": "$UsnJrnl"}
    e = events(spark, sf_dir)
    artifact = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))[F.col("event_type")]
    event_id = F.when(F.col("event_type") == "click", F.when(F.col("k") % 3 == 0, 1).when(F.col("k") % 3 == 1, 3).otherwise(5)).when(F.col("event_type") == "view", F.when(F.col("k") % 2 == 0, 4624).otherwise(1102)).when(F.col("event_type") == "purchase", F.when(F.col("k") % 2 == 0, 7045).otherwise(104)).when(F.col("event_type") == "error", F.when(F.col("k") % 2 == 0, 18456).otherwise(1000))
    image = F.when(F.col("k") % 4 == 0, "C:\\Windows\\System32\\cmd.exe").when(F.col("k") % 4 == 1, "D:\\tools\\whoami.exe").when(F.col("k") % 4 == 2, "C:\\staging\\run.exe").otherwise("C:\\Windows\\explorer.exe")
    fields = F.to_json(F.struct(image.alias("Image"), F.concat(F.lit("10.0."), F.col("user_id") % 8, F.lit("."), F.col("k")).alias("DestinationIp"), (F.col("k") * 100).cast("string").alias("DestinationPort"), F.when(F.col("k") % 5 == 0, "10").otherwise("3").alias("LogonType"), F.concat(F.lit("CORP\\user"), F.col("user_id")).alias("User")))
    no = F.lit(None).cast("string")
    return e.select(
        F.concat(F.lit("n"), F.col("user_id") % 8).alias("node"), F.concat(F.lit("EV#"), F.col("event_id")).alias("ref"), "event_id", "us", "k", "user_id",
        artifact.alias("artifact"), event_id.cast("bigint").alias("record_event"), F.try_parse_json(fields).alias("fields"),
        F.array(F.when(F.col("k") % 2 == 0, "file_create").otherwise("file_delete")).alias("reason"), F.lit(True).alias("allocated"),
        *(no.alias(c) for c in ("timestamp", "path", "si_btime", "si_ctime", "si_mtime", "si_atime", "fn_btime", "fn_ctime", "fn_mtime")),
    ).drop("event_id").withColumnRenamed("record_event", "event_id")
