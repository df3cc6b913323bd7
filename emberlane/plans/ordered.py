"""Window, ranking and allocation queries over events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlane.functions.times import micros
from emberlane.operators import ranking, windows
from emberlane.plans.views import EVENTS_SQL, events, table

HOUR = 3_600_000_000


def burst_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("endpoint", F.concat_ws("/", "event_type", "k"))
    found = windows.first_burst(e, key="user_id", at="us", ordinal="event_id", endpoint="endpoint", ref="event_id", width=24 * HOUR, least=4)
    return found.select("user_id", "at", F.array_join(F.transform("refs", lambda r: r.cast("string")), ",").alias("refs"))


def density_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).withColumn("signal", F.concat_ws("/", "event_type", F.col("k") % 3))
    return windows.densest_start(e, key="user_id", at="us", signal="signal", width=6 * HOUR, reference=F.lit(1_705_000_000_000_000))


def repeat_cap_soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.soft_cap(events(spark, sf_dir), group=["user_id"], repeat="event_type", order=[F.desc("value"), "event_id"], first=2, seats=12)
    return out.select("user_id", "event_id", F.col("seat").cast("bigint").alias("seat"))


def repeat_cap_hard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.hard_cap(events(spark, sf_dir), group=["user_id"], repeat="event_type", order=[F.desc("value"), "event_id"], first=2, seats=18)
    return out.select("user_id", "event_id", F.col("seat").cast("bigint").alias("seat"))


def nested_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", "event_type", "k", "value")
    return windows.nested_caps(e, levels=[(["event_type", "k"], 3), (["event_type"], 12), ([], 30)], order=[F.desc("value"), "event_id"]).select("event_id", "event_type")


def stage_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(micros("l_shipdate")).alias("at"))
    return windows.stage_durations(rows, run="l_orderkey", stage="l_linenumber", at="at").select("l_orderkey", "l_linenumber", "seconds")


def owner_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"))
    return windows.owner(rows, ref="l_partkey", who="l_orderkey", ordinal="ordinal")


def uncovered_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three or more words of a later turn that do not occur in the conversation's first turn."""
    c = table(spark, sf_dir, "conversations")
    split = lambda t: F.filter(F.split(F.lower(t), "[^a-z]+"), lambda w: w != "")
    first = c.where("turn = 0").groupBy("conv_id").agg(F.min(F.col("text")).alias("source"))
    known = first.select("conv_id", F.explode(F.array_distinct(split(F.col("source")))).alias("word")).withColumn("known", F.lit(True))
    words = c.where("turn > 0").join(first.select("conv_id"), "conv_id").select("conv_id", "turn", F.posexplode(split(F.col("text"))).alias("place", "word"))
    # a word meets the source's words by equality; the source is not carried along with every word
    flagged = words.join(known, ["conv_id", "word"], "left").select("conv_id", "turn", "place", F.col("known").isNull().alias("new"))
    return windows.islands(flagged, key=["conv_id", "turn"], place="place", flag="new", least=3).select("conv_id", "turn", F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last"), "n")


def seat_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("items"), F.count_if(F.col("c_acctbal") > 5000).alias("cap"))
    parties = c.withColumn("weight", ranking.weight_of(F.col("c_nationkey") % 3 + 1))
    return ranking.seats(parties, party="c_nationkey", weight="weight", items="items", cap="cap", limit=400)


def rank_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    tier = F.when(F.col("event_type") == "error", 0).when(F.col("value") > 100, 1).otherwise(2)
    band = F.when(F.col("us").between(1_704_500_000_000_000, 1_705_500_000_000_000), 0).when(F.col("k") % 10 == 0, 1).otherwise(2)
    return ranking.within_group_rank(e, group="event_type", keys=[tier, band, F.abs(F.col("us") - 1_705_000_000_000_000), "event_id"]).select("event_type", "event_id", "rank")


def budget_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return ranking.budget_prefix(d.select("source", "doc_id", "n_chars"), group="source", order=[F.desc("n_chars"), "doc_id"], size="n_chars", budget=60_000).select("source", "doc_id", "used")


def guaranteed_lane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that must be seen, then the largest others; time order, unknown last."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", micros("o_orderdate").alias("us"))
    sure = o.where("o_orderstatus = 'P' and o_totalprice > 450000")
    rest = o.join(sure.select("o_orderkey"), "o_orderkey", "left_anti").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)
    return sure.select("o_orderkey", F.lit(True).alias("guaranteed")).unionByName(rest.select("o_orderkey", F.lit(False).alias("guaranteed")))


def leading_technique(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.groupBy("p_brand").agg(F.max_by("p_partkey", F.struct("p_retailprice", -F.col("p_partkey"))).alias("p_partkey"))


def evenly_spaced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_type", "event_id")
    return ranking.evenly_spaced(e, group="event_type", order=["event_id"], n=7)


def chunk_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer packed into chunks of 20 lines, an order's lines together."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = items.select("o_custkey", "l_orderkey", "l_linenumber", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ordinal"), F.lit(1).alias("size"))
    return ranking.next_fit(rows, case="o_custkey", unit="l_orderkey", order="ordinal", size="size", capacity=20).select("o_custkey", "l_orderkey", "l_linenumber", "chunk")


def timeline_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by the earliest time of their refs, with their place in the timeline of their group."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min(micros("l_shipdate")).alias("us"))
    o = table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return ranking.within_group_rank(o, group="o_custkey", keys=[F.asc_nulls_last("us"), "o_orderkey"]).select("o_custkey", "o_orderkey", "rank")


QUERIES = {f.__name__: f for f in (burst_scan, density_anchor, repeat_cap_soft, repeat_cap_hard, nested_caps, stage_durations, owner_assignment, uncovered_runs, seat_allocation, rank_keys, budget_fit, guaranteed_lane, leading_technique, evenly_spaced_sample, chunk_packing, timeline_order)}

_CAP = """with {ev}, r as (select *, row_number() over (partition by user_id, event_type order by value desc, event_id) as rn from ev), s as (select user_id, event_id, row_number() over (partition by user_id order by (rn > 2), value desc, event_id) as seat from r {where})
select * from s where seat <= {seats}"""
ORACLE = {
    "burst_scan": f"""with {EVENTS_SQL}, n as (select user_id, us, event_id, event_type || '/' || k as e, row_number() over (partition by user_id order by us, event_id) as rn from ev),
w as (select a.user_id, a.us, a.rn, count(distinct b.e) as d, string_agg(b.event_id::varchar, ',' order by b.rn) as refs from n a join n b on a.user_id = b.user_id and b.rn <= a.rn and b.us >= a.us - 86400000000 group by all having count(distinct b.e) >= 4)
select user_id, us as at, refs from w qualify row_number() over (partition by user_id order by rn) = 1""",
    "density_anchor": f"""with {EVENTS_SQL}, w as (select a.user_id, a.us, count(distinct b.event_type || '/' || (b.k % 3)) as signals, count(*) as density from ev a join ev b on a.user_id = b.user_id and b.us between a.us and a.us + 21600000000 group by a.user_id, a.us, a.event_id)
select user_id, us as start, signals, density from w qualify row_number() over (partition by user_id order by signals desc, abs(us - 1705000000000000), density desc, us) = 1""",
    "repeat_cap_soft": _CAP.format(ev=EVENTS_SQL, where="", seats=12),
    "repeat_cap_hard": _CAP.format(ev=EVENTS_SQL, where="where rn <= 4", seats=18),
    "nested_caps": f"""with {EVENTS_SQL}, a as (select * from ev qualify row_number() over (partition by event_type, k order by value desc, event_id) <= 3), b as (select * from a qualify row_number() over (partition by event_type order by value desc, event_id) <= 12)
select event_id, event_type from b order by value desc, event_id limit 30""",
    "stage_durations": """with r as (select l_orderkey, l_linenumber, max(epoch_us(l_shipdate)) as t from lineitem group by 1, 2), s as (select *, t - lag(t) over w as step, l_linenumber - lag(l_linenumber) over w as gap from r window w as (partition by l_orderkey order by l_linenumber))
select l_orderkey, l_linenumber, case when gap = 1 and step >= 0 then round(step / 1000000.0, 3) end as seconds from s""",
    "owner_assignment": "select l_partkey, l_orderkey as owner from lineitem qualify row_number() over (partition by l_partkey order by l_orderkey * 10 + l_linenumber, l_orderkey) = 1",
    "uncovered_runs": """with f as (select conv_id, min(text) as source from conversations where turn = 0 group by 1), w as (select c.conv_id, c.turn, list_filter(regexp_split_to_array(lower(source), '[^a-z]+'), lambda x: x <> '') as known, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') as ws from conversations c join f using (conv_id) where turn > 0),
p as (select conv_id, turn, known, generate_subscripts(ws, 1) - 1 as place, unnest(ws) as word from w), g as (select conv_id, turn, place, place - row_number() over (partition by conv_id, turn order by place) as run from p where not list_contains(known, word))
select conv_id, turn, min(place)::bigint as first, max(place)::bigint as last, count(*) as n from g group by conv_id, turn, run having count(*) >= 3""",
    "seat_allocation": """with p as (select c_nationkey, count(*) as items, count(*) filter (c_acctbal > 5000) as cap, case c_nationkey % 3 + 1 when 1 then 4.0::double when 3 then 1.0::double else 2.0::double end as weight from customer group by 1),
e as (select p.*, unnest(range(1, least(400, greatest(items, 1, cap)) + 1)) as k from p), w as (select * from e order by case when k = 1 then 0 when k <= greatest(1, cap) then 1 else 2 end, weight / k desc, c_nationkey limit 400)
select c_nationkey, count(*) filter (k <= items) as seats, count(*) filter (k > items) as wasted from w group by 1""",
    "rank_keys": f"""with {EVENTS_SQL} select event_type, event_id, row_number() over (partition by event_type order by case when event_type = 'error' then 0 when value > 100 then 1 else 2 end,
 case when us between 1704500000000000 and 1705500000000000 then 0 when k % 10 = 0 then 1 else 2 end, abs(us - 1705000000000000), event_id) as rank from ev""",
    "budget_fit": "with s as (select source, doc_id, sum(n_chars) over (partition by source order by n_chars desc, doc_id rows unbounded preceding)::bigint as used from documents) select * from s where used <= 60000",
    "guaranteed_lane": """with sure as (select o_orderkey from orders where o_orderstatus = 'P' and o_totalprice > 450000), rest as (select o_orderkey from orders where o_orderkey not in (select o_orderkey from sure) order by o_totalprice desc, o_orderkey limit 100)
select o_orderkey, true as guaranteed from sure union all select o_orderkey, false from rest""",
    "chunk_packing": """with recursive u as (select o_custkey as c, l_orderkey as o, count(*) as n, row_number() over (partition by o_custkey order by min(l_orderkey * 10 + l_linenumber)) as i from lineitem join orders on l_orderkey = o_orderkey group by 1, 2),
w as (select c, o, i, 0::bigint as chunk, n as used from u where i = 1 union all select u.c, u.o, u.i, case when used + n > 20 then chunk + 1 else chunk end, case when used + n > 20 then n else used + n end from w join u on u.c = w.c and u.i = w.i + 1)
select c as o_custkey, l_orderkey, l_linenumber, chunk from w join lineitem on l_orderkey = o""",
    "leading_technique": "select p_brand, p_partkey from part qualify row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) = 1",
    "evenly_spaced_sample": """with p as (select event_type, event_id, row_number() over (partition by event_type order by event_id) - 1 as i, count(*) over (partition by event_type) as n from events)
select event_type, event_id from p where n <= 7 or floor(i * 7.0 / n) > floor((i - 1) * 7.0 / n)""",
    "timeline_order": """with i as (select l_orderkey, min(epoch_us(l_shipdate)) as us from lineitem group by 1) select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by us nulls last, o_orderkey) as rank from orders left join i on o_orderkey = l_orderkey""",
}
