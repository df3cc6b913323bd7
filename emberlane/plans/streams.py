"""Streaming queries over events, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlane.functions.times import micros
from emberlane.streaming import live


# A glob names one file as well as a folder of files.


def stream_error_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = live.event_stream(spark, f"{sf_dir}/events.parque[t]")
    kinds = stream.select("event_type", F.when(F.col("value") > 50, "abort").when(F.col("value") > 10, "retry").otherwise("skip").alias("action"))
    return live.run_to_end(live.running_tally(kinds, ["event_type", "action"]), "complete")


def stream_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = live.event_stream(spark, f"{sf_dir}/events.parque[t]").select("user_id", micros("ts").alias("us"), "event_id", F.concat_ws("/", "event_type", F.get_json_object("props", "$.k")).alias("endpoint"))
    return live.run_to_end(live.first_bursts(stream, key="user_id", at="us", ordinal="event_id", endpoint="endpoint", width=24 * 3_600_000_000, least=4), "append")


QUERIES = {f.__name__: f for f in (stream_error_tally, stream_bursts)}
ORACLE = {
    "stream_error_tally": "select event_type, case when value > 50 then 'abort' when value > 10 then 'retry' else 'skip' end as action, count(*) as n from events group by 1, 2",
    "stream_bursts": """with n as (select user_id, epoch_us(ts) as us, event_id, event_type || '/' || json_extract_string(props, '$.k') as e, row_number() over (partition by user_id order by ts, event_id) as rn from events),
w as (select a.user_id, a.us, a.rn, string_agg(b.event_id::varchar, ',' order by b.rn) as refs from n a join n b on a.user_id = b.user_id and b.rn <= a.rn and b.us >= a.us - 86400000000 group by all having count(distinct b.e) >= 4)
select user_id, us as at, refs from w qualify row_number() over (partition by user_id order by rn) = 1""",
}
