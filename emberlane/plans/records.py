"""Rule, filter and projection queries over evidence records made from events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlane.functions import text as tx
from emberlane.functions import times
from emberlane.operators import rules
from emberlane.plans.views import EVENTS_SQL, events, records, table


def flag_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.tag(records(spark, sf_dir)).select("ref", F.array_join("flags", ",").alias("flags"))


def flag_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = rules.tag(records(spark, sf_dir))
    return rules.exploded(tagged, "artifact").groupBy("artifact", "flag").agg(F.count("*").alias("n"))


def canonical_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rules.canonical(records(spark, sf_dir))
    return r.select("ref", *(F.col(f"canonical.{c}").alias(c) for c in ("subject_path", "process_image", "user", "remote_ip", "remote_port")))


def noise_and_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that carry a flag other than connection noise and are not shells of the system folder."""
    tagged = rules.tag(records(spark, sf_dir))
    noise = F.coalesce(F.lower(rules.value_of("fields.Image")).endswith("\\explorer.exe"), F.lit(False))
    signal = F.size(F.array_except("flags", F.array(F.lit("outside_time_range"), F.lit("network_connection")))) > 0
    return tagged.groupBy("artifact").agg(F.count("*").alias("rows"), F.count_if(noise).alias("noise"), F.count_if(~noise & signal).alias("signal"))


def artifact_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = rules.tag(records(spark, sf_dir))
    return tagged.groupBy("artifact").agg(F.count("*").alias("rows"), F.count_if(F.size("flags") > 0).alias("flagged"), F.min("us").alias("first"), F.max("us").alias("last"), F.count_if(F.col("timestamp").isNull()).alias("untimed"))


def attention_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals by contained tokens: all of one list, or any of another."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("t"))
    has = lambda x: F.col("t").contains(x)
    signals = F.array_compact(F.array(F.when(has("licen") & has("version"), "licence"), F.when(has("token = ") | has("@mail"), "secret"), F.when(has("###") | has("&&&"), "junk")))
    return d.select("doc_id", F.array_join(signals, ",").alias("signals")).where("signals <> ''")


def behaviour_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of a record for each behaviour: three a keyword, two a flag, one a pivot."""
    r = rules.tag(records(spark, sf_dir))
    families = {"execution": (["cmd", "whoami"], ["shell_spawned"]), "persistence": (["explorer"], ["service_installed"])}
    image, out = F.lower(F.coalesce(rules.value_of("fields.Image"), F.lit(""))), []
    for name, (words, flags) in families.items():
        keywords = sum((image.rlike(w).cast("bigint") for w in words), F.lit(0).cast("bigint"))
        flagged = F.size(F.array_intersect("flags", F.array(*map(F.lit, flags)))).cast("bigint")
        out.append(F.struct(F.lit(name).alias("family"), (3 * keywords + 2 * flagged + (F.col("k") == 7).cast("bigint")).alias("score")))
    hits = r.select("ref", F.explode(F.array(*out)).alias("h")).where("h.score > 0")
    return hits.groupBy("h.family", "h.score").agg(F.count("*").alias("n"))


def entity_mention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that name one of a bounded list of entities, the benchmark items' first words."""
    names = table(spark, sf_dir, "benchmark").select(F.lower(F.element_at(F.split("text", " "), 1)).alias("name")).where("length(name) > 2").distinct()
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"[ \n]+"))).alias("name"))
    return words.join(names, "name", "left_semi").groupBy("name").agg(F.count("*").alias("n"))


def path_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^https?://[^/]+(/[^?#]*)", 1).alias("path"))
    return p.select("page_id", tx.path_matches(F.col("path"), "/en").alias("in_en"), tx.path_matches(F.col("path"), "/*/1*").alias("starts_one"), F.lower("path").endswith(".html").alias("html"))


def scope_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inclusive window; an unknown time passes."""
    e = events(spark, sf_dir).select("event_id", F.when(F.col("k") % 9 != 0, F.col("us")).alias("us"))
    return e.where(F.col("us").isNull() | F.col("us").between(1_704_500_000_000_000, 1_705_000_000_000_000)).select("event_id")


def inspector(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = rules.tag(records(spark, sf_dir))
    return r.where((F.col("artifact") == "evtx:Sysmon") & F.array_contains("flags", "shell_spawned") & F.col("event_id").isin(1, 3)).select("ref", "node")


def evidence_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.contains(F.lower(F.to_json(F.struct("doc_id", "source", "lang", "text"))), F.lit("src1"))).select("doc_id")


def ref_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    ref = F.when(F.col("k") % 10 == 0, F.concat(F.lit("EV#0"), F.col("event_id"))).when(F.col("k") % 10 == 1, F.concat(F.lit("ev#"), F.col("event_id"))).otherwise(F.concat(F.lit("EV-X#"), F.col("event_id")))
    return e.select("event_id", tx.ref_parts(ref).alias("p")).select("event_id", "p.prefix", "p.number")


def times_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    form = F.element_at(F.array(F.concat(day, F.lit("T01:02:03.1234567Z")), F.concat(day, F.lit(" 01:02:03")), F.concat(day, F.lit("T01:02:03+09:00")), day), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return o.select("o_orderkey", times.parse_micros(form).alias("us"), times.second_of(form).alias("sec"))


def filetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select("event_id", times.filetime_micros(F.when(F.col("k") > 0, F.col("us") * 10 + times.FILETIME_EPOCH + F.col("k") % 10).otherwise(0)).alias("us"))


def bitmask_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", F.array_join(tx.bit_names(F.col("k") % 16, ["data_overwrite", "data_extend", "data_truncation", "named_data"]), "|").alias("names"))


def hash_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    text = F.concat(F.lit("MD5="), F.upper(F.md5("text")), F.lit(",SHA256:"), F.sha2("text", 256), F.lit(";IMPHASH=00,md5="), F.md5("text"))
    return d.select("doc_id", F.array_join(tx.hash_set(text), ",").alias("hashes"))


def indirect_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("@res.dll,-"), F.col("p_partkey"), F.lit(";"), F.col("p_name"))).otherwise(F.col("p_name"))
    return p.select("p_partkey", tx.display_string(raw).alias("name"))


def alert_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert level to severity and confidence, and the window around the alert."""
    e = events(spark, sf_dir)
    level = F.col("k") % 16
    severity = F.when(level >= 13, "critical").when(level >= 10, "high").when(level >= 7, "medium").when(level >= 4, "low").otherwise("info")
    low, high = times.window_around(F.col("us"), 3, 2)
    return e.select("event_id", severity.alias("severity"), low.alias("window_start"), high.alias("window_end"))


def scenario_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values in order of appearance, empty ones dropped."""
    p = table(spark, sf_dir, "part")
    values = F.array_distinct(F.array_compact(F.array(*(F.when(c != "", c) for c in (F.col("p_brand"), F.split_part("p_name", F.lit(" "), F.lit(2)), F.col("p_type"), F.col("p_brand"))))))
    return p.select("p_partkey", F.array_join(values, ",").alias("entities"))


def scenario_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that hold a term, numbered within their document."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.filter(F.split("text", r"[.\n]+ ?"), lambda s: F.length(s) > 0)).alias("place", "s"))
    return d.where(F.contains(F.lower("s"), F.lit("licensed"))).select("doc_id", F.col("place").cast("bigint").alias("place"), F.length("s").cast("bigint").alias("size"))


def outbound_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest numeric leaf of an open object whose key speaks of bytes sent."""
    e = events(spark, sf_dir)
    v = F.parse_json(F.to_json(F.struct((F.col("k") * 10).alias("bytes_sent"), F.col("k").alias("BytesRecvd"), F.struct((F.col("event_id") % 1000).alias("upload_size")).alias("net"))))
    one = e.select("event_id", v.alias("v"))
    one.createOrReplaceTempView("_outbound")
    leaves = spark.sql("select event_id, e.key, e.value from _outbound, lateral variant_explode(v) e union all select event_id, f.key, f.value from _outbound, lateral variant_explode(try_variant_get(v, '$.net', 'variant')) f")
    key = F.lower(F.replace("key", F.lit("_"), F.lit("")))
    sent = key.rlike("sent|outbound|upload") & key.rlike("byte|size")
    return leaves.groupBy("event_id").agg(F.max(F.when(sent, F.try_variant_get("value", "$", "bigint"))).alias("sent"))


QUERIES = {f.__name__: f for f in (flag_rules, flag_histogram, canonical_overlay, noise_and_signal, artifact_summary, attention_match, behaviour_hits, entity_mention, path_scope, scope_time, inspector, evidence_search, ref_parse, times_parsed, filetimes, bitmask_names, hash_sets, indirect_strings, alert_flatten, scenario_entities, scenario_terms, outbound_bytes)}

_REC = f"""with {EVENTS_SQL}, rec as (select 'n' || (user_id % 8) as node, 'EV#' || event_id as ref, us, k, user_id,
 case event_type when 'click' then 'evtx:Sysmon' when 'view' then 'evtx:Security' when 'purchase' then 'evtx:System' when 'error' then 'evtx:Application' else '$UsnJrnl' end as artifact,
 case event_type when 'click' then case k % 3 when 0 then 1 when 1 then 3 else 5 end when 'view' then case k % 2 when 0 then 4624 else 1102 end when 'purchase' then case k % 2 when 0 then 7045 else 104 end when 'error' then case k % 2 when 0 then 18456 else 1000 end end as eid,
 ['C:\\Windows\\System32\\cmd.exe', 'D:\\tools\\whoami.exe', 'C:\\staging\\run.exe', 'C:\\Windows\\explorer.exe'][k % 4 + 1] as image, k * 100 as port from ev),
sys as (select *, artifact = 'evtx:Sysmon' and eid = 1 as start from rec),
tagged as (select *, list_filter([
 case when (artifact = 'evtx:Security' and eid = 1102) or (artifact = 'evtx:System' and eid = 104) then 'log_cleared' end,
 case when artifact = '$UsnJrnl' and k % 2 = 1 then 'deleted' end, case when artifact = '$UsnJrnl' and k % 2 = 0 then 'file_created' end,
 case when artifact = 'evtx:Security' and eid = 4624 then 'logon_success' end, case when artifact = 'evtx:System' and eid = 7045 then 'service_installed' end,
 case when artifact = 'evtx:Sysmon' and eid = 5 then 'process_lifecycle_closed' end, case when start and k % 4 in (0, 3) then 'shell_spawned' end,
 case when artifact = 'evtx:Application' and eid = 18456 then 'database_logon' end, case when artifact = 'evtx:Security' and eid = 4624 and k % 5 = 0 then 'remote_interactive_logon' end,
 case when artifact = 'evtx:Sysmon' and eid = 3 and port > 0 and port not in (5000, 1900) then 'uncommon_destination_port' end,
 case when start and k % 4 = 1 then 'discovery_command' end, case when start and k % 4 = 1 then 'execution_from_unusual_path' end,
 case when start and k % 4 in (1, 2) then 'execution_outside_known_volume_root' end, case when artifact = 'evtx:Sysmon' and eid = 3 then 'network_connection' end,
 case when artifact = 'evtx:Application' and eid = 1000 then 'app_crash' end], lambda x: x is not null) as flags from sys)"""
_PATH = "lower(regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1))"
ORACLE = {
    "flag_rules": f"{_REC} select ref, array_to_string(flags, ',') as flags from tagged",
    "flag_histogram": f"{_REC}, f as (select artifact, unnest(flags) as flag from tagged) select artifact, flag, count(*) as n from f group by all",
    "canonical_overlay": f"""{_REC} select ref, case when artifact = 'evtx:Sysmon' then image end as subject_path, case when artifact = 'evtx:Sysmon' then image end as process_image, 'CORP\\user' || user_id as user,
 '10.0.' || (user_id % 8) || '.' || k as remote_ip, port::varchar as remote_port from rec""",
    "noise_and_signal": f"""{_REC} select artifact, count(*) as rows, count(*) filter (k % 4 = 3) as noise, count(*) filter (k % 4 <> 3 and len(list_filter(flags, lambda x: x <> 'network_connection')) > 0) as signal from tagged group by artifact""",
    "artifact_summary": f"{_REC} select artifact, count(*) as rows, count(*) filter (len(flags) > 0) as flagged, min(us) as first, max(us) as last, count(*) as untimed from tagged group by artifact",
    "attention_match": """with d as (select doc_id, lower(text) as t from documents), s as (select doc_id, concat_ws(',', case when contains(t, 'licen') and contains(t, 'version') then 'licence' end,
 case when contains(t, 'token = ') or contains(t, '@mail') then 'secret' end, case when contains(t, '###') or contains(t, '&&&') then 'junk' end) as signals from d) select * from s where signals <> ''""",
    "behaviour_hits": f"""{_REC}, h as (select 'execution' as family, 3 * (k % 4 in (0, 1))::bigint + 2 * list_contains(flags, 'shell_spawned')::bigint + (k = 7)::bigint as score from tagged
 union all select 'persistence', 3 * (k % 4 = 3)::bigint + 2 * list_contains(flags, 'service_installed')::bigint + (k = 7)::bigint from tagged) select family, score, count(*) as n from h where score > 0 group by all""",
    "entity_mention": """with n as (select distinct lower(split_part(text, ' ', 1)) as name from benchmark where length(split_part(text, ' ', 1)) > 2), w as (select doc_id, unnest(list_distinct(regexp_split_to_array(lower(text), '[ \\n]+'))) as name from documents)
select name, count(*) as n from w where name in (select name from n) group by name""",
    "path_scope": f"""with p as (select page_id, {_PATH} as raw, case when rtrim({_PATH}, '/') = '' then {_PATH} else rtrim({_PATH}, '/') end as p from pages)
select page_id, p = '/en' or starts_with(p, '/en/') as in_en, regexp_matches(p, '^/[^/]*/1[^/]*(/|$)') as starts_one, ends_with(raw, '.html') as html from p""",
    "scope_time": f"with {EVENTS_SQL} select event_id from ev where k % 9 = 0 or us between 1704500000000000 and 1705000000000000",
    "inspector": f"{_REC} select ref, node from tagged where artifact = 'evtx:Sysmon' and list_contains(flags, 'shell_spawned') and eid in (1, 3)",
    "evidence_search": "select doc_id from documents where contains(lower(concat_ws(' ', doc_id, source, lang, text)), 'src1')",
    "ref_parse": f"with {EVENTS_SQL} select event_id, case when k % 10 > 1 or (k % 10 = 0 and false) then 'EV-X' end as prefix, case when k % 10 > 1 then event_id end as number from ev",
    "times_parsed": """with o as (select o_orderkey, epoch_us(o_orderdate) as d, o_orderkey % 4 as f from orders) select o_orderkey, case f when 0 then d + 3723123456 when 1 then d + 3723000000 when 2 then d + 3723000000 - 32400000000 end as us,
 case f when 0 then (d + 3723000000) // 1000000 end as sec from o""",
    "filetimes": f"with {EVENTS_SQL} select event_id, case when k > 0 then us end as us from ev",
    "bitmask_names": f"""with {EVENTS_SQL} select event_id, concat_ws('|', case when k % 16 & 1 > 0 then 'data_overwrite' end, case when k % 16 & 2 > 0 then 'data_extend' end, case when k % 16 & 4 > 0 then 'data_truncation' end, case when k % 16 & 8 > 0 then 'named_data' end) as names from ev""",
    "hash_sets": "select doc_id, least(md5(text), sha256(text)) || ',' || greatest(md5(text), sha256(text)) as hashes from documents",
    "indirect_strings": "select p_partkey, p_name as name from part",
    "alert_flatten": f"""with {EVENTS_SQL} select event_id, case when k % 16 >= 13 then 'critical' when k % 16 >= 10 then 'high' when k % 16 >= 7 then 'medium' when k % 16 >= 4 then 'low' else 'info' end as severity, us - 259200000000 as window_start, us + 172800000000 as window_end from ev""",
    "scenario_entities": "select p_partkey, concat_ws(',', p_brand, case when split_part(p_name, ' ', 2) not in ('', p_brand) then split_part(p_name, ' ', 2) end, case when p_type not in (p_brand, split_part(p_name, ' ', 2)) then p_type end) as entities from part",
    "scenario_terms": """with d as (select doc_id, list_filter(regexp_split_to_array(text, '[.\\n]+ ?'), lambda x: x <> '') as s from documents), e as (select doc_id, generate_subscripts(s, 1) - 1 as place, unnest(s) as s from d)
select doc_id, place::bigint as place, length(s) as size from e where contains(lower(s), 'licensed')""",
    "outbound_bytes": f"with {EVENTS_SQL} select event_id, greatest(k * 10, event_id % 1000) as sent from ev",
}
