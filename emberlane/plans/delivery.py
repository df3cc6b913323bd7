"""Whole procedures: records handed out to a case, signals of attention, and findings reviewed end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlane.functions.fields import record_blob
from emberlane.operators import allocation, attention, review, rules
from emberlane.plans.records import _REC
from emberlane.plans.views import EVENTS_SQL, events, records, table

HOUR = 3_600_000_000
WINDOW = (1_704_500_000_000_000, 1_705_500_000_000_000)


def _case_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records of their user's case."""
    k = F.col("k")
    return events(spark, sf_dir).select(
        F.col("user_id").alias("case"), F.col("event_id").alias("ref"), F.col("event_type").alias("artifact"), F.when(k % 13 != 0, F.col("us")).alias("at"),
        (k % 4 == 0).alias("signal"), (k % 11 == 0).alias("noise"), (k % 10 == 0).alias("kept"), F.when(k % 17 == 0, 0).when(k % 5 == 0, k % 3).alias("depth"),
        (F.col("value") > 100).alias("burst"), (k % 3).alias("repeat"), (k % 23 == 0).alias("must"), (k % 7 + 5).alias("size"),
        F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "view", 3).otherwise(2).alias("priority"),
    )


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("event_type = 'error' and k % 3 = 0").select(F.col("user_id").alias("case"), F.col("us").alias("at"))


def record_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return allocation.allocate(_case_records(spark, sf_dir), _anchors(spark, sf_dir), tolerance=6 * HOUR, window=WINDOW, limit=14, repeats=2, budget=90)


def allocation_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _case_records(spark, sf_dir)
    return allocation.quotas(allocation.candidates(r, _anchors(spark, sf_dir), tolerance=6 * HOUR, window=WINDOW), r)


#: Signals of the query.
SIGNALS = [
    attention.Signal("tools", any=("whoami", "\\tools\\"), score=3),
    attention.Signal("shell", every=("system32", "cmd.exe"), score=2),
    attention.Signal("staged", every=("staging", "no such token"), any=("run.exe",)),
    attention.Signal("tampering", flags=("service_installed", "log_cleared")),
]


def attention_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rules.tag(records(spark, sf_dir))
    cases = r.select(F.col("user_id").alias("case"), "ref", F.col("us").alias("at"), record_blob(F.to_json("fields")).alias("text"), "flags", F.concat_ws("/", "artifact", F.col("k") % 3).alias("repeat"))
    return attention.apply(cases, SIGNALS, width=6 * HOUR, per_signal=6, same=2).withColumn("tokens", F.array_join("tokens", ","))


def context_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of 60 links: by axis, then time; shown by time."""
    found = events(spark, sf_dir).groupBy(F.col("event_type").alias("axis"), F.col("k").cast("string").alias("value")).agg(F.min("us").alias("at"))
    return attention.context_table(found, axes=["error", "signup", "purchase"], most=60)


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as findings about their parts: a claim a line, one assertion about the first part, a number in the statement."""
    ref, o = F.concat(F.lit("P#"), F.col("l_partkey")), F.col("finding_id")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("finding_id"), "l_partkey", ref.alias("ref"), (F.col("l_partkey") + F.when(F.col("l_suppkey") % 40 == 0, 1).otherwise(0)).cast("string").alias("value"))
    own = lines.groupBy("finding_id").agg(
        F.array_sort(F.collect_set("ref")).alias("refs"), F.array_sort(F.collect_set(F.when(F.col("l_partkey") % 47 != 0, F.col("ref")))).alias("input_refs"),
        F.array_sort(F.collect_set(F.struct("ref", F.lit("fields.key").alias("field"), "value"))).alias("claims"), F.min("l_partkey").alias("least"),
    )
    first = F.element_at("refs", 1)
    made = lambda p, field, to_ref, to, tolerance=None: F.struct(F.lit(p).alias("predicate"), first.alias("subject_ref"), F.lit(field).alias("subject"), (first if to_ref else F.lit(None).cast("string")).alias("object_ref"), F.lit(to).alias("object"), F.lit(tolerance).cast("double").alias("tolerance"))
    kinds = F.array(made("under_path", "path", False, "C:\\Parts"), made("duration", "size", False, "25", 24.0), made("spawned", "children", True, "brand"), made("count", "size", True, "fields.size"), made("before", "made", False, "2024-01-01T00:00:40Z"), made("outside_path", "path", False, "C:\\Windows"))
    return own.select(
        "finding_id", F.when(o % 3 != 0, F.concat(F.lit("T"), o % 5)).alias("technique"), F.concat(F.lit("order with part "), F.col("least") + 10_000, F.when(o % 7 == 0, " and 99999999").otherwise(""), F.when(o % 13 == 0, F.concat(F.lit(" near "), F.floor((F.col("least") + 10_000) / 10))).otherwise("")).alias("statement"),
        "refs", "input_refs", F.when(o % 11 != 0, F.col("claims")).alias("claims"), F.when(o % 11 != 0, F.array(F.element_at(kinds, (o % 6 + 1).cast("int")))).alias("assertions"),
    )


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part").where("p_partkey % 53 <> 0"), F.col("p_partkey")
    entries = {
        "key": k.cast("string"), "code": (k + 10_000).cast("string"), "size": F.col("p_size").cast("string"), "brand": F.col("p_brand"), "path": F.when(k % 29 == 0, "C:\\Parts\\..\\Other\\x").otherwise(F.concat(F.lit("c:/parts/"), k.cast("string"))),
        "made": F.concat(F.lit("2024-01-01T00:00:"), F.lpad((F.col("p_size") % 60).cast("string"), 2, "0"), F.lit("Z")), "children": F.when(k % 31 != 0, F.concat_ws(", ", "p_type", "p_brand")),
    }
    data = F.map_filter(F.create_map(*(x for n, c in entries.items() for x in (F.lit(n), c))), lambda _, v: v.isNotNull())
    return p.select(F.concat(F.lit("P#"), k).alias("ref"), F.col("p_brand").alias("artifact"), data.alias("data"))


def _support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.concat(F.lit("T"), F.ascii(F.right("p_brand", F.lit(1))) % 4).alias("technique"), F.col("p_brand").alias("artifact")).distinct()


def finding_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = review.review(_findings(spark, sf_dir), _parts(spark, sf_dir), _support(spark, sf_dir))
    return out.withColumn("missing", F.array_join("missing", ",")).withColumn("also_supports", F.array_join("also_supports", ","))


def story_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' stories cite their parts; orders are the findings."""
    items = table(spark, sf_dir, "lineitem")
    sentences = items.groupBy(F.col("l_suppkey").alias("sentence_id")).agg(F.slice(F.array_sort(F.collect_set("l_partkey")), 1, 2).alias("refs")).select("sentence_id", "refs", F.when(F.col("sentence_id") % 9 == 0, "insufficient").otherwise("supported").alias("verdict"))
    verdict = F.when(F.max("l_quantity") > 49, F.when(F.max("l_tax") > 0.07, "rejected").otherwise("unverifiable")).otherwise("passed")
    findings = items.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("refs"), verdict.alias("verdict"))
    return review.story_review(sentences, findings)


QUERIES = {f.__name__: f for f in (record_allocation, allocation_quotas, attention_apply, context_rows, finding_review, story_review)}

_CASES = f"""with {EVENTS_SQL}, r as (select user_id as c, event_id as ref, event_type as a, case when k % 13 <> 0 then us end as tm, k % 4 = 0 as signal, k % 10 = 0 as kept, case when k % 17 = 0 then 0 when k % 5 = 0 then k % 3 end as depth, value > 100 as burst,
 k % 3 as rep, k % 23 = 0 as must, k % 7 + 5 as size, event_type = 'purchase' as strong from ev where k % 11 <> 0),
an as (select distinct user_id as c, us as t from ev where event_type = 'error' and k % 3 = 0), d as (select r.c, r.ref, min(abs(tm - t)) as dist from r join an on r.c = an.c group by 1, 2),
q as (select r.*, case when dist <= 21600000000 then dist end as dist, case when depth = 0 then 0 else coalesce(depth + 1, 1000) end as k1, case when burst then 0 else 1 end as k2, case when signal then 0 when dist <= 21600000000 then 1 else 2 end as k3,
 case when tm between 1704500000000000 and 1705500000000000 then 0 when kept then 1 else 2 end as k4 from r left join d using (c, ref))"""
_KEY = "k1, k2, k3, k4, dist nulls last, tm nulls last, ref"
ORACLE = {
    "record_allocation": f"""{_CASES}, n as (select *, row_number() over (partition by c, a, rep order by {_KEY}) as n from q where not must), m as (select * from n where n <= 4),
s as (select c, a, count(*) filter (k4 < 2) as cap, case when bool_or(strong) then 4.0 else 2.0 end::double as w from m group by 1, 2), o as (select m.*, cap, w, row_number() over (partition by c, a order by (n > 2), {_KEY}) as k from m join s using (c, a)),
t as (select c, ref, a, tm, size, false as guaranteed, row_number() over (partition by c order by case when k = 1 then 0 when k <= cap then 1 else 2 end, w / k desc, a, k) as seat from o qualify seat <= 14),
b as (select * from t union all select c, ref, a, tm, size, true, 0 from q where must), u as (select *, sum(size) over (partition by c order by seat, a, ref rows unbounded preceding) as used from b)
select c as "case", row_number() over (partition by c order by tm nulls last, a, seat, ref) as place, ref, a as artifact, guaranteed from u where guaranteed or used <= 90""",
    "allocation_quotas": f"""{_CASES}, o as (select c, a, count(*) as n, count(*) filter (k4 < 2) as cap, case when bool_or(strong) then 4.0 else 2.0 end::double as w from q group by 1, 2)
select user_id as "case", event_type as artifact, count(*) as parsed, coalesce(max(n), 0) as candidates, coalesce(max(cap), 0) as cap, coalesce(max(w), 2.0) as weight from ev left join o on c = user_id and a = event_type group by 1, 2""",
    "attention_apply": f"""{_REC}, b as (select user_id as c, ref, us as tm, flags, k, artifact || '/' || (k % 3) as rep from tagged),
h as (select *, 'tools' as signal, 3 as score, 'any' as requirement, 'whoami,\\tools\\' as tokens from b where k % 4 = 1 union all select *, 'shell', 2, 'every', 'system32,cmd.exe' from b where k % 4 = 0
 union all select *, 'staged', 1, 'any', 'run.exe' from b where k % 4 = 2 union all select *, 'tampering', 1, 'flags', array_to_string(list_filter(flags, lambda x: x in ('service_installed', 'log_cleared')), ',') from b where list_has_any(flags, ['service_installed', 'log_cleared'])),
w as (select x.c, x.tm, count(distinct h.signal) as signals, count(*) as density from (select distinct c, tm from h) x join h on h.c = x.c and h.tm between x.tm and x.tm + 21600000000 group by 1, 2),
an as (select c, tm as anchor from w qualify row_number() over (partition by c order by signals desc, density desc, tm) = 1),
n as (select h.*, anchor, abs(tm - anchor) as far, row_number() over (partition by c, signal, rep order by score desc, abs(tm - anchor), tm, ref) as rn from h join an using (c))
select c as "case", signal, ref, row_number() over (partition by c, signal order by (rn > 2), score desc, far, tm, ref) as seat, requirement, tokens, anchor from n qualify seat <= 6""",
    "context_rows": f"""with {EVENTS_SQL}, l as (select event_type as axis, k::varchar as value, min(us) as tm from ev group by 1, 2), t as (select * from l order by case axis when 'error' then 0 when 'signup' then 1 when 'purchase' then 2 else 3 end, tm, axis, value limit 60)
select axis, value, tm as at, row_number() over (order by tm, axis, value) as place from t""",
    "finding_review": """with l as (select distinct l_orderkey as o, l_partkey as p, l_suppkey % 40 = 0 as wrong from lineitem), s as (select distinct 'T' || (ascii(right(p_brand, 1)) % 4) as t, p_brand as b from part),
i as (select o, case when o % 3 <> 0 then 'T' || (o % 5) end as technique, min(p) as least, min_by(p, 'P#' || p) as first, bool_or(p % 53 = 0) as c0, bool_or(p % 47 = 0) as c1 from l group by o),
n as (select o, wrong, row_number() over (partition by o order by 'P#' || p, (p + wrong::int)::varchar) - 1 as i from l where o % 11 <> 0), c as (select o, count(*) as claims, min(i) filter (wrong) as c2 from n group by o),
a as (select i.o, case o % 6 when 0 then first % 29 <> 0 when 1 then abs(p_size - 25) <= 24 when 2 then first % 31 <> 0 when 3 then true when 4 then p_size < 40 else true end as holds from i join part on p_partkey = first),
b as (select distinct o, p_brand as b from l join part on p = p_partkey where p % 53 <> 0), g as (select o, bool_or(s.t = technique) as shown from i join b using (o) join s using (b) group by o), alt as (select o, string_agg(distinct s.t, ',' order by s.t) as also from i join b using (o) join s using (b) where s.t <> technique group by o),
v as (select o, unnest([p, case when o % 11 <> 0 then p + wrong::int end, case when p % 53 <> 0 then p + 10000 end, case when p % 53 <> 0 then 2024 end]) as v from l), nums as (select o, list(v) as nums from v group by o),
x as (select i.*, nums, coalesce(claims, 0) as claims, c2, (o % 11 <> 0)::bigint as asserted, o % 11 <> 0 and not holds as c3, technique in (select t from s) and not shown as c4 from i left join c using (o) left join a using (o) left join g using (o) left join nums using (o)),
y as (select *, case when c0 then 0 when c1 then 1 when c2 is not null then 2 when c3 then 3 when c4 then 4 end as failed, concat_ws(',', case when not list_contains(nums, least + 10000) then (least + 10000)::varchar end, case when o % 7 = 0 then '99999999' end, case when o % 13 = 0 and not list_contains(nums, (least + 10000) // 10) then ((least + 10000) // 10)::varchar end) as missing from x)
select o as finding_id, case when failed is not null then 'rejected' when claims + asserted = 0 or missing <> '' then 'unverifiable' else 'passed' end as verdict,
 case when failed is not null then ['ref_not_found', 'ref_not_in_input', 'claim_mismatch', 'assertion_contradicted', 'technique_unsupported'][failed + 1] when claims + asserted = 0 then 'nothing_to_check' when missing <> '' then 'statement_ungrounded' end as reason,
 case when coalesce(failed, 9) >= 2 then claims else 0 end + case when coalesce(failed, 9) >= 3 then asserted else 0 end as checks, case when coalesce(failed, 9) >= 2 then coalesce(c2, claims) else 0 end + case when coalesce(failed, 9) >= 3 then asserted - (failed is not null and failed = 3)::bigint else 0 end as checks_passed,
 missing, case when failed = 4 then also end as also_supports from y left join alt using (o)""",
    "story_review": """with f as (select l_orderkey, case when max(l_quantity) > 49 then case when max(l_tax) > 0.07 then 'rejected' else 'unverifiable' end else 'passed' end as v from lineitem group by 1), r as (select l_partkey as p, bool_or(v = 'passed') as ok, bool_or(v = 'rejected') as bad, bool_or(v = 'unverifiable') as warn from lineitem join f using (l_orderkey) group by 1),
s as (select distinct l_suppkey as s, l_partkey as p from lineitem), t as (select * from s qualify row_number() over (partition by s order by p) <= 2)
select s as sentence_id, case when s % 9 = 0 then 'insufficient' when bool_or(bad) then 'contradicted' when bool_and(ok or warn) then case when bool_or(warn) then 'supported_with_warning' else 'supported' end else 'insufficient' end as verdict from t left join r using (p) group by s""",
}
