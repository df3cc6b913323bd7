"""Walks of open objects: events as records whose fields are nested to a depth that differs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlane.operators import openobject
from emberlane.plans.views import EVENTS_SQL, events


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of each event: names, lists of mixed types, and bytes sent at depth k mod 7."""
    e = events(spark, sf_dir)
    inner = F.format_string('{"BytesSent": %s, "list": [1, "Two", null, {"x": [true, []]}], "s": "é %s"}', F.when(F.col("k") % 2 == 0, F.format_string('"%d"', F.col("k") * 1000)).otherwise((F.col("k") * 1000).cast("string")), "event_type")
    text = F.concat(F.repeat(F.lit('{"n": {"bytes_out": -1, "down": '), (F.col("k") % 7).cast("int")), inner, F.repeat(F.lit("}}"), (F.col("k") % 7).cast("int")))
    rows = e.select("event_id", F.when(F.col("k") % 11 != 0, F.parse_json(text)).alias("fields"))
    return openobject.walk(rows, key="event_id", value="fields")


def open_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _members(spark, sf_dir).where("kind <> 'object'")


def record_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return openobject.texts(_members(spark, sf_dir), key="event_id").withColumn("values", F.array_join("values", "|"))


def nested_outbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return openobject.largest_number(_members(spark, sf_dir), ["bytessent", "bytes_out"], key="event_id").withColumn("most", F.col("most").cast("bigint"))


QUERIES = {f.__name__: f for f in (open_members, record_blobs, nested_outbound)}
_BASE = f"with {EVENTS_SQL}, b as (select event_id, event_type, k, k % 7 as d, case when k % 7 = 0 then '' else repeat('n.down.', (k % 7)::int) end as p from ev where k % 11 <> 0)"
_LEAVES = """m as (select event_id, p || x.path as path, x.name, x.kind, x.text from b, lateral (select unnest([
  {'path': 'BytesSent', 'name': 'BytesSent', 'kind': 'scalar', 'text': (k * 1000)::varchar}, {'path': 'list', 'name': 'list', 'kind': 'array', 'text': null}, {'path': 'list[0]', 'name': '0', 'kind': 'scalar', 'text': '1'},
  {'path': 'list[1]', 'name': '1', 'kind': 'scalar', 'text': 'Two'}, {'path': 'list[2]', 'name': '2', 'kind': 'null', 'text': null}, {'path': 'list[3].x', 'name': 'x', 'kind': 'array', 'text': null}, {'path': 'list[3].x[0]', 'name': '0', 'kind': 'scalar', 'text': 'true'},
  {'path': 'list[3].x[1]', 'name': '1', 'kind': 'array', 'text': null}, {'path': 's', 'name': 's', 'kind': 'scalar', 'text': 'é ' || event_type}]) as x)
 union all select event_id, repeat('n.down.', i::int) || 'n.bytes_out', 'bytes_out', 'scalar', '-1' from b, lateral (select unnest(range(d)) as i))"""
ORACLE = {
    "open_members": f"{_BASE}, {_LEAVES} select * from m",
    "record_blobs": f"""{_BASE} select event_id, repeat('n bytes_out -1 down ', d::int) || 'bytessent ' || k * 1000 || ' list 1 two x true s é ' || event_type as blob, repeat('-1|', d::int) || k * 1000 || '|1|Two|true|é ' || event_type as values from b""",
    "nested_outbound": f"{_BASE} select event_id, k * 1000 as most from b",
}
