"""Objects in texts that models could have written, one for each event."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlane.functions.modeltext import extract_object
from emberlane.plans.views import EVENTS_SQL, events

#: Texts by k; @ is the event's number.
SHAPES = [
    '{"id": @}', '```json\n{"id": @, "s": "```"}\n```', 'Sure: {"a": {"b": "}{\\" }"}, "id": @} and {"id": 0}', "no object @", "[@]", '  \n ', 'cut {"id": @, "a": "}', '\\"{\\"id\\": @} {"id": @}', 'x {"id" @} y', '"{" {"id": @}', "```\n[1]\n```", 'é漢🙂 {"id": @, "🙂": "\\u007d"} tail }',
]


def model_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    shape = F.get(F.array(*map(F.lit, SHAPES)), (F.col("k") % len(SHAPES)).cast("int"))
    text = F.when(F.col("k") != 13, F.replace(shape, F.lit("@"), F.col("event_id").cast("string")))
    rows = e.select("event_id", extract_object(text).alias("o"))
    return rows.select("event_id", F.try_variant_get("o.object", "$.id", "bigint").alias("id"), "o.problem")


QUERIES = {"model_objects": model_objects}
ORACLE = {
    "model_objects": f"""
with {EVENTS_SQL}, s as (select event_id, case when k = 13 then 5 else k % {len(SHAPES)} end as s from ev)
select event_id, case when s in (0, 1, 2, 11) then event_id end as id, case when s in (4, 10) then 'not_an_object' when s in (3, 8) then 'not_found' when s = 5 then 'empty' when s in (6, 7, 9) then 'cut_off' end as problem from s"""
}
