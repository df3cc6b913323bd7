"""Join queries over events, documents, customers and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlane.operators import joins as op
from emberlane.operators import process
from emberlane.operators import selection as sel
from emberlane.plans.views import EVENTS_SQL, events, table

HOUR = 3_600_000_000


def nearest_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    points = e.where("event_type <> 'error'").select("event_id", "user_id", "us")
    anchors = e.where("event_type = 'error'").select("user_id", "us")
    return op.nearest_anchor(points, anchors, by=["user_id"], point="us", anchor="us", tolerance=6 * HOUR)


def nearest_unbounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    points = e.where("event_type = 'purchase'").select("event_id", "user_id", "us")
    return op.nearest_anchor(points, e.where("event_type = 'error'").select("user_id", "us"), by=["user_id"], point="us", anchor="us")


def process_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("event_id", F.when(F.col("event_id") > 0, F.floor(F.col("event_id") / 7)).cast("bigint").alias("parent"))
    return op.tree_depth(rows, rows.join(events(spark, sf_dir).where("event_type = 'error'").select("event_id"), "event_id", "left_semi"), key="event_id", parent="parent").withColumn("depth", F.col("depth").cast("bigint"))


def process_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processes within four levels of seven in a hundred error events, by ids for a third of them and by numbers that are used again for others."""
    e, k = events(spark, sf_dir), F.col("k")
    number = lambda n: F.concat((F.col("user_id") % 20).cast("string"), F.lit("-"), n % 10)
    rows = e.select("event_id", "us", F.when(k % 3 == 0, F.concat(F.lit("G"), "event_id")).when(k % 3 == 1, "-").alias("guid"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("g"), F.floor(F.col("event_id") / 5))).when(k % 5 == 0, "-").alias("parent_guid"),
        number(k).alias("number"), F.concat(F.lit("C:\\"), F.initcap("event_type")).alias("image"), F.when(k % 7 != 0, number(k + 9)).alias("parent_number"), F.when(k % 2 == 0, "c:\\click").otherwise("C:\\ERROR").alias("parent_image"))
    seeds = e.where((F.col("event_type") == "error") & (k < 7)).select("event_id")
    found = process.process_closure(rows, seeds, key="event_id", guid="guid", parent_guid="parent_guid", number="number", image="image", parent_number="parent_number", parent_image="parent_image", at="us", within=86_400_000_000)
    return found.withColumn("depth", F.col("depth").cast("bigint"))


def mft_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.floor(F.col("p_partkey") / 5).cast("bigint").alias("parent"), F.concat(F.lit("d"), F.col("p_partkey")).alias("name"))
    return op.parent_chain(rows, key="p_partkey", parent="parent", name="name", root=0, depth=12)


def process_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select(F.concat(F.lit("g"), F.col("user_id"), F.lit("-"), F.col("k")).alias("guid"), "event_type", F.col("us").alias("at"), F.col("event_id").alias("ordinal"), F.concat(F.lit("g"), F.col("user_id"), F.lit("-"), (F.col("k") + 1) % 100).alias("parent"))
    starts, stops, children = (e.where(F.col("event_type") == t) for t in ("signup", "error", "click"))
    return op.lifecycle(starts.select("guid", "at", "ordinal"), stops.select("guid", "at", "ordinal"), children.select("parent", "at"), within=48 * HOUR)


def hash_corroboration(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5(F.lower("text")).alias("h"))
    return op.corroboration(d, value="h", artifact="source", ref="doc_id")


def path_corroboration(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^https?://[^/]+(/[a-z]+/)", 1).alias("folder"), F.regexp_extract("url", r"^https?://([^/:?#]+)", 1).alias("host"))
    return op.corroboration(p, value="folder", artifact="host", ref="page_id", per_artifact=1)


def behaviour_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", "us", F.col("user_id").alias("own"), F.col("k").alias("born_of"), "value")
    seeds = e.where("value > 200").select("own", "us")
    return op.seeded_closure(e, seeds.select("own", "us"), identity="own", parent="born_of", at="us", order="event_id", within=HOUR, most=60).select("event_id", "own", "us")


def full_outer_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderkey % 11 <> 0").select("o_orderkey", F.round("o_totalprice", 2).alias("total"), F.lit(4).cast("bigint").alias("lines"))
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")), 2).cast("double").alias("total"), F.count("*").alias("lines"))
    return op.compare_tables(orders, items, key=["o_orderkey"], columns={"total": 100_000.0, "lines": 1.0})


def explained_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    alone = orders.join(items.select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey", "left_anti")
    return alone.groupBy(F.when(F.col("o_orderstatus") == "P", "pending").when(F.year("o_orderdate") < 1995, "archived").otherwise("unexplained").alias("reason")).agg(F.count("*").alias("n"))


# The planner: suppliers stand for techniques, parts for artifacts. Every fifth part is only in the second tier, and one query leaves every fourth technique without a mapping.


def _plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    techniques = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("technique"))
    mappings = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("technique"), F.col("l_partkey").alias("artifact"), F.when((F.col("l_linenumber") <= 4) & (F.col("l_partkey") % 5 != 0), 1).otherwise(2).alias("tier"), (F.col("l_linenumber") % 3 + 1).cast("bigint").alias("priority"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))
    catalog = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("artifact"), (F.col("p_size") > 10).alias("usable"))
    return techniques, mappings, catalog


def select_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    techniques, mappings, catalog = _plan(spark, sf_dir)
    return sel.selected(sel.requests_of(techniques, mappings)[0], catalog)


def unmapped_techniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    techniques, mappings, _ = _plan(spark, sf_dir)
    return sel.requests_of(techniques, mappings.where("technique % 4 <> 0"))[1]


def deferred_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    techniques, mappings, catalog = _plan(spark, sf_dir)
    requests = sel.requests_of(techniques, mappings)[0]
    return sel.deferred(requests, catalog, sel.selected(requests, catalog))


def excluded_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    techniques, mappings, catalog = _plan(spark, sf_dir)
    requests = sel.requests_of(techniques, mappings)[0]
    chosen = sel.selected(requests, catalog)
    return sel.excluded(catalog, chosen, sel.deferred(requests, catalog, chosen))


def _events_of(df: DataFrame, mod: int, skip: int) -> DataFrame:
    return df.groupBy(F.col("event_type").alias("artifact")).agg(F.when(F.max(F.length("event_type")) != skip, F.array_sort(F.collect_set("k"))).alias("events"))


def baseline_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    chosen = _events_of(e.where("event_type <> 'click' and k < 5"), 5, 6)  # names of six letters are unrestricted
    baseline = _events_of(e.where("event_type <> 'view' and k between 3 and 9"), 9, 0)
    return sel.with_baseline(chosen, baseline).select("artifact", F.array_join(F.transform("events", lambda x: x.cast("string")), ",").alias("events"), "origin")


def technique_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("technique"), F.col("l_returnflag").alias("artifact"), F.when(F.col("l_orderkey") % 997 != 0, F.array(F.col("l_linenumber").cast("bigint"))).alias("events"))
    return sel.evidence_index(rows).select("technique", "artifact", F.array_join(F.transform("events", lambda x: x.cast("string")), ",").alias("events"))


def scope_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberlane.functions.times import micros

    o = table(spark, sf_dir, "orders").select("o_custkey", F.array("o_orderpriority").alias("priorities"), micros("o_orderdate").alias("start"), micros("o_orderdate").alias("end"))
    return sel.merge_scopes(o, by="o_custkey", lists=["priorities"], start="start", end="end").withColumn("priorities", F.array_join("priorities", ","))


def os_applicability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("artifact"), (F.col("c_custkey") * 13 % 30000).cast("bigint").alias("build"))
    n = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("artifact")).agg((F.min("c_custkey") + 9000).alias("min_build"), F.when(F.min("c_custkey") % 2 == 0, F.lit(22000)).cast("bigint").alias("max_build"))
    return sel.applicable(rows, n).select("c_custkey", "applies")


def reusable_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose set of order priorities equals that of another customer of the same nation, whatever the order."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.to_json(F.array_sort(F.collect_set("o_orderpriority"))).alias("scope"))
    c = table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_nationkey", "scope")
    same = c.groupBy("c_nationkey", "scope").agg(F.count("*").alias("n"))
    return c.join(same, ["c_nationkey", "scope"]).where("n > 1").select("c_custkey", "n")


QUERIES = {f.__name__: f for f in (nearest_anchor, nearest_unbounded, process_tree, process_closure, mft_path, process_lifecycle, hash_corroboration, path_corroboration, behaviour_closure, full_outer_compare, explained_difference, select_plan, unmapped_techniques, deferred_plan, excluded_plan, baseline_upsert, technique_index, scope_merge, os_applicability, reusable_scans)}

_CORROBORATION = """{view}, u as (select distinct v, a, r from base where v is not null), few as (select * from u qualify row_number() over (partition by v, a order by r) <= {n})
select x.r as ref, string_agg(distinct y.r::varchar, ',' order by y.r::varchar) as refs from u x join few y on x.v = y.v and x.a <> y.a group by x.r"""
_PLAN = """with req as (select s_suppkey as technique, l_partkey as artifact, case when l_linenumber <= 4 and l_partkey % 5 <> 0 then 1 else 2 end as tier, (l_linenumber % 3 + 1)::bigint as priority, l_orderkey * 10 + l_linenumber as ordinal
  from supplier join lineitem on l_suppkey = s_suppkey where s_acctbal > 5000 qualify row_number() over (partition by technique, artifact, tier order by ordinal) = 1),
cat as (select p_partkey as artifact, p_size > 10 as usable from part),
sel as (select artifact, least(min(priority), 2) as priority, array_to_string(list_sort(list(distinct technique)), ',') as techniques from req join cat using (artifact) where usable and tier = 1 group by artifact),
def as (select artifact, min(priority) as priority from req join cat using (artifact) where usable and tier = 2 and artifact not in (select artifact from sel) group by artifact)"""
ORACLE = {
    "nearest_anchor": f"""with {EVENTS_SQL}, p as (select event_id, user_id, us from ev where event_type <> 'error'), a as (select distinct user_id, us as t from ev where event_type = 'error'),
b as (select p.*, x.t as before from p asof left join a x on p.user_id = x.user_id and p.us >= x.t), c as (select b.*, y.t as after from b asof left join a y on b.user_id = y.user_id and b.us <= y.t)
select event_id, user_id, us, case when least(us - before, after - us) <= 21600000000 then least(us - before, after - us) end as distance from c""",
    "nearest_unbounded": f"""with {EVENTS_SQL}, p as (select event_id, user_id, us from ev where event_type = 'purchase'), a as (select distinct user_id, us as t from ev where event_type = 'error'),
b as (select p.*, x.t as before from p asof left join a x on p.user_id = x.user_id and p.us >= x.t), c as (select b.*, y.t as after from b asof left join a y on b.user_id = y.user_id and b.us <= y.t)
select event_id, user_id, us, least(us - before, after - us) as distance from c""",
    "process_tree": """with recursive r as (select event_id, 0::bigint as depth from events where event_type = 'error' union all select e.event_id, r.depth + 1 from events e join r on e.event_id > 0 and e.event_id // 7 = r.event_id)
select event_id, min(depth) as depth from r group by event_id""",
    "process_closure": f"""with recursive {EVENTS_SQL}, p as (select event_id, us, case when k % 3 = 0 then 'g' || event_id end as g, case when event_id % 2 = 0 then 'g' || (event_id // 5) end as pg, (user_id % 20) || '-' || k % 10 as n, 'c:\\' || event_type as i,
 case when k % 7 <> 0 then (user_id % 20) || '-' || (k + 9) % 10 end as pn, case when k % 2 = 0 then 'c:\\click' else 'c:\\error' end as pi, event_type = 'error' and k < 7 as seed from ev),
e as (select a.event_id as a, b.event_id as b from p a join p b on b.pg = a.g union select a.event_id, b.event_id from p a join p b on b.pn = a.n and b.pi = a.i and b.us - a.us between 0 and 86400000000),
r as (select event_id as x, 0::bigint as depth from p where seed union select b, depth + 1 from r join e on a = x where depth < 4)
select x as event_id, min(depth) as depth from r group by x""",
    "mft_path": """with recursive r as (select p_partkey as k, p_partkey // 5 as up, 'd' || p_partkey as path from part union all select k, up // 5, 'd' || up || '/' || path from r where up <> 0)
select k as p_partkey, path from r where up = 0""",
    "process_lifecycle": f"""with {EVENTS_SQL}, g as (select 'g' || user_id || '-' || k as guid, 'g' || user_id || '-' || ((k + 1) % 100) as parent, event_type, us, event_id from ev),
s as (select guid, arg_max(us, event_id) as start_at from g where event_type = 'signup' group by guid), x as (select guid, arg_max(us, event_id) as stop_at from g where event_type = 'error' group by guid),
c as (select s.guid, count(*) as n, count(*) filter (g.us between start_at and start_at + 172800000000) as soon, max(g.us) as last from s join g on g.parent = s.guid and g.event_type = 'click' group by s.guid)
select s.guid, start_at, case when stop_at >= start_at then round((stop_at - start_at) / 1000000.0, 6) end as lifetime_seconds, coalesce(n, 0) as child_count, coalesce(soon, 0) as children_soon, last as last_child_at from s left join x using (guid) left join c using (guid)""",
    "hash_corroboration": _CORROBORATION.format(view="with base as (select doc_id as r, source as a, md5(lower(text)) as v from documents)", n=2),
    "path_corroboration": _CORROBORATION.format(view="with base as (select page_id as r, regexp_extract(url, '^https?://([^/:?#]+)', 1) as a, regexp_extract(url, '^https?://[^/]+(/[a-z]+/)', 1) as v from pages)", n=1),
    "behaviour_closure": f"""with {EVENTS_SQL}, s as (select distinct user_id, us from ev where value > 200)
select event_id, user_id as own, us from ev where exists (select 1 from s where (s.user_id = ev.user_id or s.user_id = ev.k) and abs(s.us - ev.us) <= 3600000000) order by event_id limit 60""",
    "full_outer_compare": """with o as (select o_orderkey, round(o_totalprice, 2) as total, 4 as lines from orders where o_orderkey % 11 <> 0), l as (select l_orderkey as o_orderkey, sum(l_extendedprice::decimal(18,2))::double as total, count(*) as lines from lineitem group by 1),
j as (select coalesce(o.o_orderkey, l.o_orderkey) as o_orderkey, o.total as a, l.total as b, o.lines as c, l.lines as d from o full join l using (o_orderkey))
select o_orderkey, case when a is null then 'extra' else 'missing' end as problem, '' as column from j where a is null or b is null
union all select o_orderkey, 'different', 'total' from j where abs(a - b) > 100000 union all select o_orderkey, 'different', 'lines' from j where abs(c - d) > 1""",
    "explained_difference": "select case when o_orderstatus = 'P' then 'pending' when year(o_orderdate) < 1995 then 'archived' else 'unexplained' end as reason, count(*) as n from orders where o_orderkey not in (select l_orderkey from lineitem) group by 1",
    "select_plan": _PLAN + " select * from sel",
    "unmapped_techniques": "select s_suppkey as technique from supplier where s_acctbal > 5000 and s_suppkey not in (select l_suppkey from lineitem where l_suppkey % 4 <> 0)",
    "deferred_plan": _PLAN + " select * from def",
    "excluded_plan": _PLAN + " select artifact, case when usable then 'not requested' else 'unsupported' end as reason from cat where artifact not in (select artifact from sel) and artifact not in (select artifact from def)",
    "baseline_upsert": f"""with {EVENTS_SQL}, c as (select event_type as artifact, case when length(event_type) <> 6 then list_sort(list_distinct(list(k))) end as own, true as has from ev where event_type <> 'click' and k < 5 group by event_type),
b as (select event_type as artifact, list(distinct k) as extra from ev where event_type <> 'view' and k between 3 and 9 group by event_type)
select artifact, array_to_string(case when has is null then list_sort(extra) when own is null or extra is null then own else list_sort(list_distinct(list_concat(own, extra))) end, ',') as events, case when has then 'selected' else 'baseline' end as origin from c full join b using (artifact)""",
    "technique_index": """select l_suppkey % 50 as technique, l_returnflag as artifact, case when not bool_or(l_orderkey % 997 = 0) then string_agg(distinct l_linenumber::varchar, ',' order by l_linenumber::varchar) end as events from lineitem group by 1, 2""",
    "scope_merge": "select o_custkey, string_agg(distinct o_orderpriority, ',' order by o_orderpriority) as priorities, min(epoch_us(o_orderdate)) as start, max(epoch_us(o_orderdate)) as end from orders group by 1",
    "os_applicability": """with r as (select c_mktsegment as artifact, min(c_custkey) + 9000 as lo, case when min(c_custkey) % 2 = 0 then 22000 else 1 << 30 end as hi from customer group by 1)
select c_custkey, c_custkey * 13 % 30000 between lo and hi as applies from customer join r on c_mktsegment = artifact""",
    "reusable_scans": """with o as (select o_custkey, list_sort(list_distinct(list(o_orderpriority))) as scope from orders group by 1), c as (select c_custkey, count(*) over (partition by c_nationkey, scope) as n from customer join o on c_custkey = o_custkey)
select * from c where n > 1""",
}
