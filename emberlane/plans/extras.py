"""Queries on forced selection, rounds, ledgers, packets, menus, and the fields and keys of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlane.functions import fields as fx
from emberlane.functions import times
from emberlane.functions.compare import is_path_field
from emberlane.functions.text import nt_normalize, under_path
from emberlane.operators import campaign, metrics, proposals, selection
from emberlane.plans.campaign import NODES, observations
from emberlane.plans.views import EVENTS_SQL, events, table


def _strings(c: str) -> Column:
    return F.col(c).cast("string")


def forced_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as artifacts: usable but for some, chosen and deferred by their parts, two forced by name."""
    p = table(spark, sf_dir, "part")
    catalog = p.groupBy(F.col("p_brand").alias("artifact")).agg((F.min("p_partkey") % 3 != 0).alias("usable"))
    by = lambda c: p.where(c).groupBy(F.col("p_brand").alias("artifact")).agg(F.lit(2).alias("priority"))
    first = p.agg(F.min("p_brand").alias("a"), F.max("p_brand").alias("b")).first()  # two names
    forced = selection.forced_names([first.a, first.b], catalog)
    chosen = by("p_retailprice > 1800")
    return selection.with_forced(chosen, forced, by("p_size = 1").join(chosen, "artifact", "left_anti"), catalog)


def rounds_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' scopes, the lines of returned parts in the first round and of accepted ones in the second."""
    items = table(spark, sf_dir, "lineitem")
    one = lambda flag: items.where(F.col("l_returnflag") == flag).groupBy(F.col("l_suppkey").alias("artifact")).agg(fx.scope_key(lines=F.collect_list("l_linenumber"), modes=F.collect_list(F.floor("l_quantity").cast("bigint") % 2)).alias("scope"))
    return selection.rounds_compared(one("R"), one("A"))


def rejection_combinations_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list((F.col("l_suppkey") % 5).cast("string")).alias("artifacts"))
    rejected = items.select((F.col("l_orderkey") % 4).alias("technique"), "artifacts")
    ledger = items.where("l_orderkey % 50 = 0").select((F.col("l_orderkey") % 4).alias("technique"), "artifacts", F.lit("known").alias("status"))
    return metrics.rejections_by_combination(rejected, ledger)


def rejection_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.reason_histogram(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("reason")))


def reported_behaviours(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = metrics.behaviours_reported(table(spark, sf_dir, "documents").select("doc_id", "text"), {"licence": r"licen[cs]ed?", "secret": r"token\s*=", "junk": "[#&]{3}"})
    return d.select("doc_id", F.array_join("behaviours", ",").alias("behaviours"))


def manifest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("records"), F.count_if(F.col("o_totalprice") > 200_000).alias("flagged"))
    return metrics.manifest_totals(files, ["records", "flagged"])


def packets_restricted(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    packets = items.groupBy(F.col("l_orderkey").alias("anchor")).agg(F.array_sort(F.collect_set("l_partkey")).alias("refs"))
    out = proposals.packets_restricted(packets, items.where("l_quantity > 45").select(F.col("l_partkey").alias("ref")))
    return out.select("anchor", F.array_join("refs", ",").alias("refs"))


def packet_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    packets = items.groupBy(F.col("l_orderkey").alias("ordinal")).agg(F.max("l_partkey").alias("anchor"), F.array_sort(F.collect_set("l_partkey")).alias("refs"))
    return proposals.packet_owners(packets, table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("ref")))


def finding_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("finding_id"), F.col("p_brand").alias("technique"), F.col("p_name").alias("statement"))
    families = spark.createDataFrame([("metal", ["Brand#11", "Brand#12"], r"\b(tin|steel|copper)\b"), ("colour", [], "red|green"), ("brand", ["Brand#13", "Brand#11"], None)], "family string, techniques array<string>, keyword string")
    return proposals.finding_families(p, families)


def pivot_menu(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = events(spark, sf_dir), F.col("k")
    r = e.select(F.col("event_id").alias("ref"), F.when(k % 6 == 0, F.array(F.lit("flag"))).otherwise(F.array().cast("array<string>")).alias("flags"), F.array_compact(F.array(F.when(k % 5 != 0, F.col("us")), F.when(k % 7 == 0, F.col("us") - 1000))).alias("times"))
    return proposals.pivot_menu(r, e.where("event_type = 'error'").select(F.col("event_id").alias("ref")))


def correlated_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of a user, picked together."""
    e, k = events(spark, sf_dir).where("event_type = 'error'"), F.col("k")
    kind = F.when(k % 3 == 0, "file_times").when(k % 3 == 1, "account_created").when(k % 4 == 0, "group_add").otherwise("other")
    out = proposals.correlated(e.select(F.col("user_id").alias("case"), F.col("event_id").alias("ref"), F.when(k % 9 != 0, F.col("us")).alias("at"), kind.alias("kind")))
    return out.select("case", "pattern", F.array_join(F.transform("timeline", lambda r: r.cast("string")), ",").alias("timeline"))


def timeline_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return proposals.timeline_visible(items.groupBy(F.col("l_orderkey").alias("entry")).agg(F.collect_list("l_suppkey").alias("refs")), table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("ref")))


def campaign_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    node = F.concat(F.lit("n"), F.col("user_id") % NODES)
    own = e.where("event_type = 'signup'").select(node.alias("node"), _strings("k").alias("value"))
    seen = e.where("event_type = 'error'").select(node.alias("node"), _strings("k").alias("value"), F.col("us").alias("at"))
    return campaign.build(observations(spark, sf_dir), own, seen, nodes=NODES, axes=["peer", "error", "click"])


def list_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated keys numbered, keys renamed, and lists without their empty tail."""
    p = table(spark, sf_dir, "part")
    kind = F.split_part("p_type", F.lit(" "), F.lit(1))
    keys = F.array(F.lit("Data"), kind, F.lit("Data"), F.when(F.col("p_size") > 25, "Data").otherwise("Name"))
    m = F.create_map(F.lit("a"), F.col("p_brand"), F.lit("b"), kind, F.when(F.col("p_size") > 25, "Brand").otherwise("c"), F.lit("x"))
    renamed = fx.renamed_keys(m, F.create_map(F.lit("a"), F.lit("Brand"), F.lit("b"), F.lit("Kind"), F.lit("c"), F.lit("Kind")))
    tail = fx.without_empty_tail(F.array(F.lit(""), F.when(F.col("p_size") > 10, kind), F.when(F.col("p_size") > 30, "z").otherwise("")))
    return p.select("p_partkey", F.array_join(fx.numbered_keys(keys), ",").alias("numbered"), F.array_join(F.array_sort(F.map_keys(renamed)), ",").alias("renamed"), F.size(tail).cast("bigint").alias("tail"))


def record_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Process identity, a host's own address, an event id as a number, and the confidence of a severity."""
    k = F.col("k")
    guid = F.when(k % 3 == 0, F.concat(F.lit(" {AB-"), k, F.lit("} "))).when(k % 3 == 1, "-")
    severity = F.element_at(F.array(*map(F.lit, ("Critical", "high", "medium", "low", "informational", "unheard of"))), (k % 6 + 1).cast("int"))
    return events(spark, sf_dir).select(
        "event_id", fx.process_identity(guid, F.concat(F.lit("C:\\A\\"), F.col("event_type"), F.lit(".EXE")), k).alias("identity"), fx.self_address(k % 4, F.when(k % 8 == 3, "True").otherwise("false"), F.concat(F.lit("10.0.0."), k)).alias("address"),
        fx.int_or_zero(F.when(k % 2 == 0, F.concat(k, F.lit(" "))).otherwise(F.concat(F.lit("x"), k))).alias("number"), fx.confidence_of(severity).alias("confidence"),
    )


def activity_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earliest activity: the record's own time if it has one, even if it cannot be read, else its file times; and install dates."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    day, us = F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "MM/dd/yyyy")
    own = F.when(k % 4 == 0, F.concat(day, F.lit("T01:00:00Z"))).when(k % 4 == 1, "not a time")
    found = fx.activity_times(own, [F.concat(day, F.lit("T03:00:00Z")), F.concat(day, F.lit(" 02:00:00")), F.lit(None).cast("string")])
    install = F.when(k % 3 == 0, us).when(k % 3 == 1, F.concat(us, F.lit(" 04:05:06"))).otherwise(day)
    return o.select("o_orderkey", F.array_min(found).alias("first"), fx.install_date_micros(install).alias("installed"))


def reason_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons that are nothing but flags, and the first clause of a document that speaks of a licence."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    reason = F.when(k % 3 == 0, "'log_cleared', deleted and (file_created).").when(k % 3 == 1, F.concat(F.lit("deleted by "), "source")).otherwise(" ; ")
    return d.select("doc_id", fx.flag_dump(reason, ["log_cleared", "deleted", "file_created"]).alias("dump"), F.length(fx.first_clause(F.col("text"), ["licen"])).cast("bigint").alias("clause"))


def local_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows in local time widened to UTC, cut at the time of collection."""
    e = events(spark, sf_dir)
    start, end = times.local_widened(F.col("us"), F.col("us") + F.col("k") * 60_000_000)
    low, high = times.clamped(start, end, F.lit(1_705_000_000_000_000))
    return e.select("event_id", low.alias("start"), high.alias("end"))


def nt_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with dots resolved, and which of them lie in a folder; fields that hold paths."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit("C:\\Data\\x\\..\\.\\"), F.col("p_brand"))).when(k % 3 == 1, F.concat(F.lit("C:/Data//"), F.col("p_brand"), F.lit("/"))).otherwise(F.concat(F.lit("C:\\Data\\..\\Windows\\"), F.col("p_brand")))
    field = F.element_at(F.array(*map(F.lit, ("fields.Image", "fields.User", "x.target_path", "OriginalFileName"))), (k % 4 + 1).cast("int"))
    path = nt_normalize(raw)
    return p.select("p_partkey", path.alias("path"), under_path(path, F.lit("c:\\data")).alias("inside"), is_path_field(field).alias("holds_path"))


QUERIES = {f.__name__: f for f in (forced_selection, rounds_compared, rejection_combinations_ledger, rejection_reasons, reported_behaviours, manifest_totals, packets_restricted, packet_owners, finding_families, pivot_menu, correlated_selection, timeline_visible, campaign_build, list_keys, record_identity, activity_span, reason_checks, local_windows, nt_paths)}

_SCOPE = "select l_suppkey as a, list_sort(list_distinct(list(l_linenumber)))::varchar || list_sort(list_distinct(list(floor(l_quantity)::bigint % 2)))::varchar as s from lineitem where l_returnflag = '{}' group by 1"
ORACLE = {
    "forced_selection": """with c as (select p_brand as b, min(p_partkey) % 3 <> 0 as usable, bool_or(p_retailprice > 1800) as chosen, bool_or(p_size = 1) as later from part group by 1), m as (select min(p_brand) as lo, max(p_brand) as hi from part)
select b as artifact, case when chosen then 2 else 1 end as priority, case when chosen then 'selected' when later then 'promoted' else 'time_range_only' end as origin from c, m where chosen or (usable and b in (lo, hi))""",
    "rounds_compared": f"""with x as ({_SCOPE.format('R')}), y as ({_SCOPE.format('A')}) select coalesce(x.a, y.a) as artifact, case when x.a is null then 'added' when y.a is null then 'removed' when x.s = y.s then 'same' else 'rescoped' end as change from x full join y on x.a = y.a""",
    "rejection_combinations_ledger": """with i as (select l_orderkey as o, string_agg(distinct (l_suppkey % 5)::varchar, ',' order by (l_suppkey % 5)::varchar) as artifacts from lineitem group by 1)
select o % 4 as technique, artifacts, count(*) as n, case when bool_or(o % 50 = 0) then 'known' else 'new' end as status from i group by 1, 2""",
    "rejection_reasons": "select o_orderpriority as reason, count(*) as n from orders group by 1",
    "reported_behaviours": "select doc_id, concat_ws(',', case when regexp_matches(text, '(?i)licen[cs]ed?') then 'licence' end, case when regexp_matches(text, '(?i)token\\s*=') then 'secret' end, case when regexp_matches(text, '[#&]{3}') then 'junk' end) as behaviours from documents",
    "manifest_totals": "select count(distinct o_custkey) as files, count(*) as records, count(*) filter (o_totalprice > 200000) as flagged from orders",
    "packets_restricted": """with s as (select distinct l_partkey as p from lineitem where l_quantity > 45), i as (select distinct l_orderkey as o, l_partkey as p from lineitem) select o as anchor, string_agg(s.p::varchar, ',' order by s.p) as refs from i left join s using (p) group by 1""",
    "packet_owners": """with g as (select l_orderkey as o, max(l_partkey) as anchor from lineitem group by 1), i as (select distinct l_orderkey as o, l_partkey as p from lineitem) select p as ref, min_by(anchor, o) as owner from i join g using (o) where p in (select p_partkey from part where p_size > 10) group by 1""",
    "finding_families": """select p_partkey as finding_id, unnest(list_filter([case when p_brand in ('Brand#11', 'Brand#12') or regexp_matches(p_name, '(?i)\\b(tin|steel|copper)\\b') then 'metal' end, case when regexp_matches(p_name, '(?i)red|green') then 'colour' end, case when p_brand in ('Brand#13', 'Brand#11') then 'brand' end], lambda x: x is not null)) as family from part""",
    "pivot_menu": f"""with {EVENTS_SQL}, p as (select event_id, k, event_type, case when k % 7 = 0 then us - 1000 when k % 5 <> 0 then us end as "pivot" from ev) select event_id as ref, "pivot" from p where "pivot" is not null and (k % 6 = 0 or event_type = 'error')""",
    "correlated_selection": f"""with {EVENTS_SQL}, e as (select user_id as c, event_id as ref, case when k % 9 <> 0 then us end as tm, case when k % 3 = 0 then 'f' when k % 3 = 1 then 'a' when k % 4 = 0 then 'g' else 'o' end as kind from ev where event_type = 'error')
select c as "case", case when bool_or(kind = 'a') and bool_or(kind = 'g') then case when bool_or(kind = 'f') then 'file_then_account_and_group' else 'account_and_group' end when count(*) >= 2 then 'compare' end as pattern, string_agg(ref::varchar, ',' order by tm nulls last, ref) as timeline from e group by 1""",
    "timeline_visible": "select l_orderkey as entry from lineitem left join supplier on s_suppkey = l_suppkey group by 1 having bool_and(coalesce(s_acctbal > 0, false))",
    "campaign_build": f"""with {EVENTS_SQL}, o as (select 'n' || (user_id % 8) as node, event_type as axis, k || '@' || (us // 86400000000) as value, case when value < 10 then 0 when value < 40 then 1 when value < 80 then 2 end as grade, us, event_id as i from ev),
r as (select * from o where grade is not null qualify row_number() over (partition by node, axis, value order by grade, us, i) = 1), l as (select axis, value, case when count(*) = 8 then 'ubiquitous' when max(grade) = 0 then 'passed' when max(grade) = 1 then 'warning' else 'context' end as kind, min(us) as first_at, string_agg(node, ',' order by us, node) as chain from r group by 1, 2 having count(*) >= 2),
s as (select 'n' || (user_id % 8) as node, k::varchar as value, min(us) as first_at from ev where event_type = 'error' group by 1, 2), w as (select distinct 'n' || (user_id % 8) as node, k::varchar as value from ev where event_type = 'signup')
select axis, value, kind, null::varchar as from_node, null::varchar as to_node, first_at, chain, case axis when 'error' then 1 when 'click' then 2 else 3 end as axis_rank from l where kind <> 'ubiquitous'
union all select 'peer', s.value, 'passed', s.node, w.node, first_at, s.node || ',' || w.node, 0 from s join w on s.value = w.value and s.node <> w.node""",
    "list_keys": """with p as (select p_partkey, p_size, split_part(p_type, ' ', 1) as t from part) select p_partkey, 'Data,' || t || ',Data#2,' || case when p_size > 25 then 'Data#3' else 'Name' end as numbered, case when p_size > 25 then 'Brand,Kind,a' else 'Brand,Kind,c' end as renamed, case when p_size > 30 then 3 when p_size > 10 then 2 else 0 end::bigint as tail from p""",
    "record_identity": f"""with {EVENTS_SQL} select event_id, case when k % 3 = 0 then '{{ab-' || k || '}}' else 'c:\\a\\' || event_type || '.exe#' || k end as identity, case when k % 8 = 3 then '10.0.0.' || k end as address, case when k % 2 = 0 then k else 0 end as number, [0.95, 0.9, 0.7, 0.5, 0.3, 0.7][k % 6 + 1]::double as confidence from ev""",
    "activity_span": """with o as (select o_orderkey as k, epoch_us(o_orderdate) as d from orders) select k as o_orderkey, case k % 4 when 0 then d + 3600000000 when 1 then null else d + 7200000000 end as first, case k % 3 when 0 then d when 1 then d + 14706000000 end as installed from o""",
    "reason_checks": """with d as (select doc_id, source, list_filter(list_transform(regexp_split_to_array(text, '[.;\\n]+'), lambda x: trim(x, ' ')), lambda x: contains(lower(x), 'licen')) as c from documents) select doc_id, doc_id % 3 <> 1 as dump, length(c[1]) as clause from d""",
    "local_windows": f"""with {EVENTS_SQL}, w as (select event_id, us - 39600000000 as s, us + k * 60000000 + greatest(0, -25200000000) as e from ev) select event_id, least(s, 1705000000000000) as start, greatest(least(e, 1705000000000000), least(s, 1705000000000000)) as "end" from w""",
    "nt_paths": """select p_partkey, case when p_partkey % 3 = 2 then 'c:\\windows\\' else 'c:\\data\\' end || lower(p_brand) as path, p_partkey % 3 <> 2 as inside, p_partkey % 4 <> 1 as holds_path from part""",
}
