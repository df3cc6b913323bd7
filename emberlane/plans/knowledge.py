"""Rules and families that come as documents, and lookups by reference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlane.operators import rules
from emberlane.plans import records as plain_records
from emberlane.plans.views import EVENTS_SQL, events, records
from emberlane.sources import evidence, knowledge, reflayout
from emberlane.tables import new_path


def _saved(spark: SparkSession, text: str, name: str) -> str:
    path = new_path(spark, name)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
    return path


def rules_of_a_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags by rules that were written as a document and read back."""
    read = knowledge.load(spark, _saved(spark, knowledge.to_document(rules.RULES, "rules"), "rules"), "rules")
    return rules.exploded(rules.tag(records(spark, sf_dir), read), "artifact").groupBy("artifact", "flag").agg(F.count("*").alias("n"))


def ref_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that purchases of every seventh kind cite: the event before them."""
    e = events(spark, sf_dir)
    path = new_path(spark, "by-reference")
    reflayout.write_layout(e.select(F.concat(F.when(F.col("event_type") == "click", "SYSMON").otherwise("EVTX-SEC"), F.lit("#"), "event_id").alias("ref"), "us", "k"), path, width=2_000)
    cited = e.where("event_type = 'purchase' and k % 7 = 0").select(F.explode(F.array(F.concat(F.lit("SYSMON#"), F.col("event_id") - 1), F.concat(F.lit("EVTX-SEC#"), F.col("event_id") - 1), F.lit("SYSMON#007"))).alias("ref"))
    return reflayout.lookup_all(spark, path, cited, width=2_000)


QUERIES = {f.__name__: f for f in (rules_of_a_document, ref_lookup)}
ORACLE = {
    "rules_of_a_document": plain_records.ORACLE["flag_histogram"],
    "ref_lookup": f"""with {EVENTS_SQL} select case when b.event_type = 'click' then 'SYSMON#' else 'EVTX-SEC#' end || b.event_id as ref, b.us, b.k from ev a join ev b on b.event_id = a.event_id - 1 where a.event_type = 'purchase' and a.k % 7 = 0""",
}


def integrity_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References that are missing, repeated, of another artifact or of another number, planted by k."""
    e, k = events(spark, sf_dir), F.col("k")
    number = F.col("event_id") - F.when(k % 31 == 3, 1).otherwise(0)
    ref = F.when(k % 41 != 0, F.concat(F.when(k % 37 == 1, "MFT").otherwise("SYSMON"), F.lit("#"), number))
    rows = e.select(F.when(k % 43 == 5, "").otherwise(ref).alias("ref"), F.lit("evtx:Sysmon").alias("artifact"), (number + F.when(k % 29 == 2, 7).otherwise(0)).alias("record_num"))
    return evidence.violations(rows)


QUERIES["integrity_violations"] = integrity_violations
ORACLE["integrity_violations"] = f"""
with {EVENTS_SQL}, n as (select *, event_id - case when k % 31 = 3 then 1 else 0 end as num from ev),
r as (select case when k % 43 = 5 then '' when k % 41 <> 0 then case when k % 37 = 1 then 'MFT#' else 'SYSMON#' end || num end as ref, num, num + case when k % 29 = 2 then 7 else 0 end as stated, k from n)
select 'missing_ref' as "check", ref, count(*) as n from r where coalesce(ref, '') = '' group by ref
union all select 'wrong_prefix', ref, count(*) from r where ref is not null and (ref = '' or ref like 'MFT#%') group by ref
union all select 'wrong_number', ref, count(*) from r where ref <> '' and num <> stated group by ref
union all select 'repeated_ref', ref, count(*) from r where ref is not null group by ref having count(*) > 1"""
