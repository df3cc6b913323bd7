"""Queries on proposals, relations, candidates, displays and small text rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlane.operators import proposals as op
from emberlane.plans.views import EVENTS_SQL, events, table
from emberlane.tables import dealt

HOUR = 3_600_000_000


def pick_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines propose a part for a supplier; the part's fields depend on its size."""
    items = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("P#"), F.col("l_partkey")).alias("ref"), (F.col("l_suppkey") % 10).alias("technique"), F.when(F.col("l_quantity") > 3, "because").otherwise(" ").alias("reason"), F.when(F.col("l_tax") > 0.04, F.array(F.lit("size"), F.lit("brand"))).otherwise(F.array(F.lit("size"))).alias("evidence_fields"))
    parts = table(spark, sf_dir, "part").where("p_partkey % 19 <> 0").select(F.concat(F.lit("P#"), F.col("p_partkey")).alias("ref"), F.when(F.col("p_size") > 10, F.array(F.lit("size"), F.lit("brand"))).otherwise(F.array(F.lit("size"))).alias("fields_present"))
    may = table(spark, sf_dir, "part").select(F.concat(F.lit("P#"), F.col("p_partkey")).alias("ref"), F.explode(F.sequence(F.lit(0).cast("bigint"), (F.col("p_size") % 10).cast("bigint"))).alias("technique"))
    return op.pick_violations(items, parts, may).groupBy("problem").agg(F.count("*").alias("n"))


def connection_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("connection")).agg(F.collect_list("l_suppkey").alias("refs"))
    picks = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("ref"))
    return op.connection_violations(links, picks)


def request_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    requests = e.select("event_id", F.when(F.col("k") % 2 == 0, "artifact").otherwise("pivot_window").alias("type"), F.col("k").alias("based_on_ref"), F.concat(F.lit("Brand#"), F.col("k") % 40).alias("artifact"), (F.col("k") % 30).alias("window_hours"))
    known = table(spark, sf_dir, "part").where("p_partkey % 7 <> 0").select(F.col("p_partkey").alias("ref"))
    catalog = table(spark, sf_dir, "part").select(F.col("p_brand").alias("artifact"))
    return op.request_dispositions(requests, known, catalog).select("event_id", "disposition")


def window_widening(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    start, end = op.widened(F.lit(1_704_500_000_000_000), F.lit(1_705_000_000_000_000), F.col("us"), F.col("k"), F.lit(1_705_500_000_000_000))
    return e.select("event_id", start.alias("start"), end.alias("end"))


def coverage_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    family = F.concat_ws("/", "source", "lang").alias("family")
    return op.coverage(d.select(family).distinct(), d.where("n_chars > 3000").select(family), d.where("n_chars > 500").select(family), d.where("n_chars > 8000").select(family))


def claim_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") > 5, F.col("p_name")).alias("name"), F.col("p_brand").alias("brand"), F.lit("").alias("empty"), F.col("p_type").alias("type"), F.col("p_size").alias("size"), F.col("p_partkey").alias("key"))
    claims = op.claims_of(["empty", "name", "brand", "type", "size", "key"])
    return p.select("p_partkey", F.array_join(F.transform(claims, lambda c: F.concat_ws("=", c.field, c.value)), ";").alias("claims"))


def prompt_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    shown = op.without_fields(F.create_map(F.lit("Name"), F.col("p_name"), F.lit("Hashes"), F.col("p_brand"), F.lit("Type"), F.col("p_type")), ["Hashes", "ProcessGuid"])
    return p.select("p_partkey", F.array_join(F.array_sort(F.map_keys(shown)), ",").alias("shown"), F.length(F.array_join(F.map_values(shown), "")).cast("bigint").alias("size"))


def relation_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations between selected records, numbered at each anchor: parts of one order, of which an order has a few."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    n = lines.count()
    items = dealt(lines, n, "l_orderkey").distinct()
    met = items.alias("a").join(items.alias("b"), "l_orderkey").where("a.l_partkey < b.l_partkey").select(F.col("a.l_partkey").alias("anchor"), F.col("b.l_partkey").alias("target"))
    # an order has a few parts, so pairs are a few times the lines; they are made unique and numbered where they are dealt to
    pairs = dealt(met, 3 * n, "anchor").distinct()
    return pairs.withColumn("relation", F.concat(F.lit("R"), F.row_number().over(Window.partitionBy("anchor").orderBy("target"))))


def candidate_techniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Techniques that a record may show: its family's if one matches, else those of its scope."""
    e = events(spark, sf_dir).select("event_id", "event_type", "k")
    family = F.when(F.col("k") == 1, "f1").when(F.col("k") == 2, "f2")
    rules = e.select("event_type", "k").distinct().select("event_type", F.concat(F.lit("T"), F.col("k")).alias("technique"), family.alias("of"))
    return op.candidate_techniques(e.withColumn("family", family), rules.withColumnRenamed("of", "family"), key="event_id", scope="event_type").withColumn("techniques", F.array_join("techniques", ","))


def evidence_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select("event_id", F.concat_ws(" ", F.concat(F.lit("EV#"), F.col("event_id")), F.col("event_type"), F.concat(F.lit("user="), F.col("user_id")), F.when(F.col("k") > 50, F.concat(F.lit("k="), F.col("k")))).alias("line"))


def field_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which fields the records of a kind can offer."""
    p = table(spark, sf_dir, "part").select("p_brand", F.array_compact(F.array(F.when(F.col("p_size") > 25, "large"), F.when(F.col("p_retailprice") > 1000, "dear"), F.lit("name"))).alias("fields"))
    return p.groupBy("p_brand").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("fields")))), ",").alias("fields"))


def named_executables(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    text = F.concat(F.lit("Then "), F.replace("p_name", F.lit(" "), F.lit(".exe ran ")), F.lit(".DLL and notes.txt by "), F.col("p_brand"))
    found = F.regexp_extract_all(text, F.lit(r"(?i)([a-z0-9_-]+\.(?:exe|dll|ps1|bat))\b"), F.lit(1))
    return p.select("p_partkey", F.array_join(F.array_distinct(F.transform(found, F.lower)), ",").alias("names"))


def mechanism_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a cue of a technique, white space squeezed out."""
    cues = {"licence": ["licensedunder", "allrightsreserved"], "secret": ["token="]}
    squeezed = F.regexp_replace(F.lower("text"), r"[ \n\t\r]+", "")
    found = F.array_compact(F.array(*(F.when(squeezed.contains(c[0]) | (squeezed.contains(c[1]) if len(c) > 1 else F.lit(False)), t) for t, c in cues.items())))
    return table(spark, sf_dir, "documents").select(F.explode(found).alias("technique")).groupBy("technique").agg(F.count("*").alias("n"))


def repeat_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    key = F.coalesce(F.when(F.col("event_type") == "click", F.concat(F.lit("net:"), F.col("k"))), F.when(F.col("k") % 2 == 0, F.concat(F.lit("proc:"), F.col("user_id"))), F.concat(F.lit("file:"), F.col("event_type")))
    return e.groupBy(key.alias("key")).agg(F.count("*").alias("n"))


def numbered_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return op.numbered(o, case="o_custkey", order=[F.desc("o_totalprice"), "o_orderkey"]).select("o_custkey", "o_orderkey", "finding_id")


def story_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as findings, customers' sentences cite their parts."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    findings = items.groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("refs"), F.when(F.max("o_totalprice") > 499_000, "passed").otherwise("rejected").alias("verdict"))
    sentences = items.groupBy(F.col("o_custkey").alias("sentence")).agg(F.collect_set("l_suppkey").alias("refs"))
    return op.story_kept(sentences, findings).select("sentence", "kept")


def loop_back_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that were cited once and must be delivered again, and whether the second round kept them."""
    first = table(spark, sf_dir, "lineitem").where("l_discount = 0.1 and l_tax = 0.08").select("l_partkey").distinct()
    second = table(spark, sf_dir, "lineitem").where("l_quantity > 48").select("l_partkey").distinct().withColumn("again", F.lit(True))
    return first.join(second, "l_partkey", "left").select("l_partkey", F.coalesce("again", F.lit(False)).alias("kept"))


QUERIES = {f.__name__: f for f in (pick_checks, connection_checks, request_checks, window_widening, coverage_ledger, claim_extraction, prompt_projection, relation_catalog, candidate_techniques, evidence_lines, field_inventory, named_executables, mechanism_cues, repeat_keys, numbered_findings, story_filter, loop_back_pins)}

ORACLE = {
    "pick_checks": """with i as (select l_partkey as p, l_suppkey % 10 as t, l_quantity > 3 as why, l_tax > 0.04 as two from lineitem), j as (select i.*, p_size, p % 19 <> 0 as known from i left join part on p_partkey = p),
x as (select 'unknown_ref' as problem from j where not known union all select 'no_reason' from j where not why union all select 'technique_not_supported' from j where t > p_size % 10 union all select 'field_not_found' from j where not known or (two and p_size <= 10))
select problem, count(*) as n from x group by 1""",
    "connection_checks": """with c as (select distinct l_orderkey as connection, l_suppkey as s from lineitem), g as (select connection, count(*) as n, count(*) filter (s not in (select s_suppkey from supplier where s_acctbal > 0)) as bad from c group by 1)
select connection, 'fewer_than_two' as problem from g where n < 2 union all select connection, 'not_picked' from g where bad > 0""",
    "request_checks": f"""with {EVENTS_SQL} select event_id, case when k % 7 = 0 or k not in (select p_partkey from part) then 'unknown_ref' when k % 2 = 0 and 'Brand#' || (k % 40) not in (select p_brand from part) then 'unknown_artifact'
 when k % 2 = 1 and not k % 30 between 1 and 24 then 'window_out_of_range' else 'accepted' end as disposition from ev""",
    "window_widening": f"with {EVENTS_SQL} select event_id, least(1704500000000000, us - k * 3600000000) as start, greatest(1705000000000000, least(us + k * 3600000000, 1705500000000000)) as end from ev",
    "coverage_ledger": "select source || '/' || lang as family, case when max(n_chars) > 8000 then 'verified' when max(n_chars) > 3000 then 'observed' when max(n_chars) > 500 then 'searched_no_evidence' else 'not_searched' end as status from documents group by 1",
    "claim_extraction": "select p_partkey, case when p_size > 5 then 'name=' || p_name || ';' else '' end || 'brand=' || p_brand || ';type=' || p_type || ';size=' || p_size || case when p_size > 5 then '' else ';key=' || p_partkey end as claims from part",
    "prompt_projection": "select p_partkey, 'Name,Type' as shown, length(p_name) + length(p_type) as size from part",
    "relation_catalog": """with k as (select distinct l_orderkey, l_partkey from lineitem), p as (select distinct a.l_partkey as anchor, b.l_partkey as target from k a join k b on a.l_orderkey = b.l_orderkey and a.l_partkey < b.l_partkey)
select anchor, target, 'R' || row_number() over (partition by anchor order by target) as relation from p""",
    "candidate_techniques": f"""with {EVENTS_SQL}, e as (select event_id, event_type, k, case k when 1 then 'f1' when 2 then 'f2' end as fam from ev), r as (select distinct event_type, 'T' || k as technique, case k when 1 then 'f1' when 2 then 'f2' end as own from e)
select event_id, string_agg(distinct technique, ',' order by technique) as techniques from e join r using (event_type) where own is not distinct from fam group by 1""",
    "evidence_lines": f"with {EVENTS_SQL} select event_id, concat_ws(' ', 'EV#' || event_id, event_type, 'user=' || user_id, case when k > 50 then 'k=' || k end) as line from ev",
    "field_inventory": "select p_brand, concat_ws(',', case when max(p_retailprice) > 1000 then 'dear' end, case when max(p_size) > 25 then 'large' end, 'name') as fields from part group by 1",
    "named_executables": """with p as (select p_partkey, regexp_extract_all('Then ' || replace(p_name, ' ', '.exe ran ') || '.DLL and notes.txt by ' || p_brand, '(?i)([a-z0-9_-]+\\.(?:exe|dll|ps1|bat))\\b', 1) as f from part)
select p_partkey, array_to_string(list_transform(f, lambda x: lower(x)), ',') as names from p""",
    "mechanism_cues": """with s as (select regexp_replace(lower(text), '[ \\n\\t\\r]+', '', 'g') as t from documents), x as (select 'licence' as technique from s where contains(t, 'licensedunder') or contains(t, 'allrightsreserved') union all select 'secret' from s where contains(t, 'token='))
select technique, count(*) as n from x group by 1""",
    "repeat_keys": f"with {EVENTS_SQL} select case when event_type = 'click' then 'net:' || k when k % 2 = 0 then 'proc:' || user_id else 'file:' || event_type end as key, count(*) as n from ev group by 1",
    "numbered_findings": "select o_custkey, o_orderkey, 'F' || row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as finding_id from orders",
    "story_filter": """with i as (select * from lineitem join orders on l_orderkey = o_orderkey), g as (select distinct l_suppkey from i where l_orderkey in (select l_orderkey from i group by 1 having max(o_totalprice) > 499000))
select o_custkey as sentence, bool_and(l_suppkey in (select l_suppkey from g)) as kept from i group by 1""",
    "loop_back_pins": "select distinct l_partkey, l_partkey in (select l_partkey from lineitem where l_quantity > 48) as kept from lineitem where l_discount = 0.1 and l_tax = 0.08",
}
