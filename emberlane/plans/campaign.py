"""Cross-host queries over events: node = user_id mod 8, axis = type of event, value = k and the day of the month."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlane.functions import text as tx
from emberlane.functions.compare import ratio
from emberlane.operators import campaign as op
from emberlane.plans.views import EVENTS_SQL, events, table

NODES = 8


def observations(spark: SparkSession, sf_dir: str, nodes: int = NODES, daily: bool = True) -> DataFrame:
    e = events(spark, sf_dir)
    day = F.floor(F.col("us") / 86_400_000_000).cast("bigint")
    value = F.concat_ws("@", "k", day) if daily else F.col("k").cast("string")
    grade = F.when(F.col("value") < 10, 0).when(F.col("value") < 40, 1).when(F.col("value") < 80, 2)
    return e.select(F.concat(F.lit("n"), F.col("user_id") % nodes).alias("node"), F.col("event_type").alias("axis"), value.alias("value"), grade.alias("grade"), F.col("us").alias("at"), F.col("event_id").alias("ordinal"), F.concat(F.lit("EV#"), F.col("event_id")).alias("ref"))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.links(observations(spark, sf_dir), NODES)


def campaign_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).select("axis", "value", "nodes", "kind", "span_seconds", "first_at", F.array_join("chain", ">").alias("chain"))


def campaign_ubiquity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.links(observations(spark, sf_dir, 4, daily=False), 4).groupBy("axis", "kind").agg(F.count("*").alias("n"))


def campaign_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.links(observations(spark, sf_dir), NODES, background=F.col("ordinal") % 2 == 0).groupBy("axis", "kind").agg(F.count("*").alias("n"))


def campaign_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [F.count_if(F.col("kind") == k).alias(k) for k in ("passed", "warning", "context")]
    return _links(spark, sf_dir).agg(F.count("*").alias("links"), *kinds)


def mermaid_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.edges(_links(spark, sf_dir))


def peer_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    node = F.concat(F.lit("n"), F.col("user_id") % NODES)
    own = e.where("event_type = 'signup'").select(node.alias("node"), F.col("k").alias("value")).distinct()
    seen = e.where("event_type = 'click'").select(node.alias("node"), F.col("k").alias("value"))
    return op.peer_links(own, seen)


def ambiguous_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id")).alias("node"), F.regexp_extract("url", "^https?://([^/:?#]+)", 1).alias("host"))
    return op.unambiguous_hosts(hosts)


def verdict_per_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    findings = items.groupBy(F.col("l_orderkey").alias("finding_id")).agg(F.collect_set("l_partkey").alias("refs"))
    verdicts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("finding_id"), F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).cast("bigint").alias("rank"))
    return op.best_verdicts(findings, verdicts)


def coverage_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("n_chars")
    rank = F.when(size < 200, 0).when(size < 1000, 1).when(size < 3000, 2).otherwise(3).cast("bigint")
    return op.coverage_matrix(table(spark, sf_dir, "documents").select(F.col("source").alias("family"), F.col("lang").alias("node"), rank.alias("rank")), ["en", "de", "fr", "es"])


def network_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", "^https?://([^/:?#]+)", 1)
    address = F.concat_ws(".", F.lit("10"), F.col("page_id") % 300, F.lit("0"), F.col("page_id") % 7)
    return p.select("page_id", tx.network_key(F.concat(F.upper(host), F.lit("."))).alias("host_key"), tx.network_key(address).alias("address_key"), F.array_join(tx.embedded_hosts(F.concat(F.lit("curl "), F.col("url"), F.lit(" -x "), address)), " ").alias("embedded"))


def account_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    name = F.when(F.col("c_custkey") % 5 == 0, "NT AUTHORITY\\SYSTEM").when(F.col("c_custkey") % 5 == 1, F.concat(F.lit("CORP\\HOST"), F.col("c_custkey"), F.lit("$"))).otherwise(F.concat(F.lit("CORP\\"), F.col("c_name")))
    return c.select("c_custkey", tx.account_key(name).alias("account"))


def os_owned_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    path = F.concat(F.element_at(F.array(F.lit("C:\\Windows\\"), F.lit("D:\\Program Files\\"), F.lit("C:\\Users\\x\\"), F.lit("/winnt/")), (F.col("p_partkey") % 4 + 1).cast("int")), F.col("p_name"), F.lit(".exe"))
    return p.select("p_partkey", tx.normalize_path(path).alias("path"), tx.basename(path).alias("name"), tx.os_owned(path).alias("os_owned"))


def campaign_recurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each axis's values that link nodes."""
    o = observations(spark, sf_dir).where("grade is not null")
    linked = _links(spark, sf_dir).groupBy("axis").agg(F.count("*").alias("linked"))
    return o.groupBy("axis").agg(F.countDistinct("value").alias("values")).join(linked, "axis", "left").select("axis", "values", F.coalesce("linked", F.lit(0)).alias("linked"), ratio(F.coalesce("linked", F.lit(0)), F.col("values")).alias("share"))


QUERIES = {f.__name__: f for f in (campaign_links, campaign_ubiquity, campaign_background, campaign_stats, mermaid_edges, peer_links, ambiguous_hosts, verdict_per_ref, coverage_matrix, network_keys, account_keys, os_owned_paths, campaign_recurrence)}

_OBS = f"""with {EVENTS_SQL},
obs as (select 'n' || (user_id % 8) as node, event_type as axis, k || '@' || (us // 86400000000) as value,
  case when value < 10 then 0 when value < 40 then 1 when value < 80 then 2 end as grade, us as tm, event_id as ordinal, 'EV#' || event_id as ref from ev),
reps as (select * from obs where grade is not null qualify row_number() over (partition by node, axis, value order by grade, tm, ordinal) = 1)"""
_LINKS = f"""{_OBS},
links as (select axis, value, count(*) as nodes, case when count(*) = 8 then 'ubiquitous' when max(grade) = 0 then 'passed' when max(grade) = 1 then 'warning' else 'context' end as kind,
  round_even((max(tm) - min(tm)) / 1000000.0, 3) as span_seconds, min(tm) as first_at, string_agg(node, '>' order by tm, node) as chain from reps group by axis, value having count(*) >= 2)"""
_HOST = "regexp_extract(url, '^https?://([^/:?#]+)', 1)"
ORACLE = {
    "campaign_links": f"{_LINKS} select * from links",
    "campaign_ubiquity": f"""with {EVENTS_SQL}, best as (select event_type as axis, k, user_id % 4 as node, min(case when value < 10 then 0 when value < 40 then 1 when value < 80 then 2 end) as grade from ev where value < 80 group by all),
g as (select axis, k, count(*) as n, max(grade) as worst from best group by axis, k having count(*) >= 2)
select axis, case when n = 4 then 'ubiquitous' when worst = 0 then 'passed' when worst = 1 then 'warning' else 'context' end as kind, count(*) as n from g group by all""",
    "campaign_background": f"""{_OBS}, g as (select axis, value, count(*) as nodes, max(grade) as worst, bool_and(ordinal % 2 = 0) as bg from reps group by axis, value having count(*) >= 2)
select axis, case when nodes = 8 then 'ubiquitous' when bg then 'context' when worst = 0 then 'passed' when worst = 1 then 'warning' else 'context' end as kind, count(*) as n from g group by all""",
    "campaign_stats": f"{_LINKS} select count(*) as links, count(*) filter (kind = 'passed') as passed, count(*) filter (kind = 'warning') as warning, count(*) filter (kind = 'context') as context from links",
    "mermaid_edges": f"""{_OBS}, linked as (select axis, value from reps group by axis, value having count(*) >= 2),
steps as (select axis, node as a, lead(node) over (partition by axis, value order by tm, node) as b from reps join linked using (axis, value))
select a as from_node, b as to_node, string_agg(distinct axis, ',' order by axis) as axes from steps where b is not null group by a, b""",
    "peer_links": f"""with {EVENTS_SQL}, own as (select distinct 'n' || (user_id % 8) as node, k from ev where event_type = 'signup'), seen as (select 'n' || (user_id % 8) as node, k from ev where event_type = 'click')
select s.node as from_node, o.node as to_node, s.k as value, count(*) as n from seen s join own o on s.k = o.k and s.node <> o.node group by all""",
    "ambiguous_hosts": f"with h as (select 'p' || page_id as node, {_HOST} as host from pages) select node, case when count(*) over (partition by host) = 1 then host end as host from h",
    "verdict_per_ref": "select l_partkey as ref, min(case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end)::bigint as rank from lineitem join orders on l_orderkey = o_orderkey group by 1",
    "coverage_matrix": "with d as (select source as family, lang, case when n_chars < 200 then 0 when n_chars < 1000 then 1 when n_chars < 3000 then 2 else 3 end as r from documents) select family, "
    + ", ".join(f"coalesce(max(r) filter (lang = '{x}'), 0)::bigint as {x}" for x in ("en", "de", "fr", "es")) + " from d group by family",
    "network_keys": f"""with p as (select page_id, lower({_HOST}) as h, '10.' || (page_id % 300) || '.0.' || (page_id % 7) as a, page_id % 300 <= 255 as ok from pages)
select page_id, h as host_key, case when ok then a end as address_key, case when ok then least(h, a) || ' ' || greatest(h, a) else h end as embedded from p""",
    "account_keys": "select c_custkey, case when c_custkey % 5 > 1 then lower(c_name) end as account from customer",
    "os_owned_paths": """with p as (select p_partkey, ['c:/windows/', 'd:/program files/', 'c:/users/x/', '/winnt/'][p_partkey % 4 + 1] || lower(p_name) || '.exe' as path, p_name from part)
select p_partkey, path, lower(p_name) || '.exe' as name, p_partkey % 4 <> 2 as os_owned from p""",
    "campaign_recurrence": f"""{_LINKS}, v as (select axis, count(distinct value) as values from obs where grade is not null group by axis), l as (select axis, count(*) as linked from links group by axis)
select v.axis, v.values, coalesce(l.linked, 0) as linked, round_even(coalesce(l.linked, 0) / v.values, 4) as share from v left join l using (axis)""",
}
