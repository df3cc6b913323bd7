"""Behaviour of events by what their command lines say, all families in one scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlane.operators import behaviour
from emberlane.plans.views import EVENTS_SQL, events

#: Command lines that the events have by k; they hold keywords of all families, and some that only seem to.
COMMANDS = [
    "powershell.exe -nop", "cmd /c whoami", "schtasks /create /tn x", "sc  config svc start= auto", "HKLM\\Software\\Microsoft\\Windows\\CurrentVersion\\Run", "Set-MpPreference -DisableRealtimeMonitoring 1",
    "wevtutil cl Security", "nmap 10.0.0.0/8", "arp -a", "arp  --all", "mstsc /v:10.0.0.5:3389", "10.0.0.5:44500", "lsass.dmp and passwd", "credentials.json", "SELECT a, b FROM settlement", "7z a x.7z", "D:\\exfil\\x", "sync a to dropbox", "asynchronous drive",
    "vssadmin x delete shadows", "예기치 않은 재부팅", "비정상  종료", "USB\\VID_0A1b&PID_ffff", "device is now connected", "explorer.exe", "notepad readme",
]
FLAGS = [["Shell_Spawned"], [], ["log_cleared", "impact"], None, ["outside_time_range"], ["network_scan"]]


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k = events(spark, sf_dir), F.col("k")
    command = F.get(F.array(*map(F.lit, COMMANDS)), (k % len(COMMANDS)).cast("int"))
    flags = F.get(F.array(*(F.lit(None).cast("array<string>") if f is None else F.array(*map(F.lit, f)).cast("array<string>") for f in FLAGS)), (F.col("event_id") % len(FLAGS)).cast("int"))
    return e.select("event_id", F.concat(F.lit("EV#"), "event_id").alias("ref"), "us", F.concat(F.lit("user-"), "user_id", F.lit(" "), command).alias("blob"), flags.alias("flags"), (F.col("event_id") % 4 == 0).alias("network"), (F.col("value") * 100_000).cast("bigint").alias("outbound"))


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = {f.name: [] for f in behaviour.FAMILIES} | {"lateral_movement": ["USER-1", " "], "discovery": ["user-2", "10.0"]}
    return behaviour.behaviour_scores(_records(spark, sf_dir), requests)


def behaviour_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).withColumn("signals", F.array_join("signals", "|"))


def behaviour_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return behaviour.pattern_counts(_scores(spark, sf_dir))


QUERIES = {f.__name__: f for f in (behaviour_search, behaviour_patterns)}


def _texts(items) -> str:
    return "([" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]::varchar[])"


_FLAGS = "[" + ", ".join("null" if f is None else _texts(f) for f in FLAGS) + "]"
_FAMILIES = " union all ".join(f"select '{f.name}' as family, {_texts(f.keywords)} as words, {_texts(f.flags)} as fl, {_texts({'lateral_movement': ['user-1'], 'discovery': ['user-2', '10.0']}.get(f.name, []))} as pivots" for f in behaviour.FAMILIES)
_SCORED = f"""with {EVENTS_SQL}, fam as ({_FAMILIES}),
r as (select event_id, 'EV#' || event_id as ref, us, lower('user-' || user_id || ' ' || {_texts(COMMANDS)}[k % {len(COMMANDS)} + 1]) as blob, list_transform(coalesce({_FLAGS}[event_id % {len(FLAGS)} + 1], []::varchar[]), lambda x: lower(x)) as flags, event_id % 4 = 0 as network, trunc(value * 100000)::bigint as outbound, value from ev),
h as (select family, ref, us, list_filter(words, lambda w: regexp_matches(blob, w)) as hit, list_sort(list_filter(fl, lambda f: list_contains(flags, f))) as got, len(list_filter(pivots, lambda p: contains(blob, p))) as piv, network, family = 'exfiltration' and network and outbound >= 10485760 as large
  from r, fam where not list_contains(flags, 'outside_time_range')),
s as (select family, ref, us, 3 * len(hit) + 2 * len(got) + piv + case when large then 4 else 0 end as score,
  list_concat(list_concat(list_transform(hit, lambda w: 'keyword:' || w), list_transform(got, lambda f: 'flag:' || f)), list_concat(case when family = 'lateral_movement' and piv > 0 and network then ['pivot_network'] else [] end, case when large then ['large_outbound_transfer'] else [] end)) as signals
  from h where len(hit) > 0 or len(got) > 0 or large or family = 'lateral_movement' and piv > 0 and network)"""
ORACLE = {
    "behaviour_search": f"{_SCORED} select family, ref, us, score, array_to_string(signals, '|') as signals from s",
    "behaviour_patterns": f"{_SCORED} select family, signal, count(*) as n from (select family, unnest(signals) as signal from s) group by 1, 2",
}
