"""Searching records for behaviour: the keywords of all families in one scan, flags, pivots and large transfers, and a score for each family.

Keywords are patterns. A pattern needs some literal text, so all literals are looked for at
once by one automaton, and only patterns whose literal is there are tried. The automaton
is made once a task from the patterns, whose number is bounded.
"""

from __future__ import annotations

import re
import re._parser as parser
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Family:
    name: str
    techniques: tuple[str, ...]
    keywords: tuple[str, ...]
    flags: tuple[str, ...]


#: Families with their techniques, keyword patterns and flags (fixed values).
FAMILIES = (
    Family("initial_access", ("T1091", "T1200", "T1204.002", "T1078", "T1078.003"), ("vid_[0-9a-f]{4}", "pid_[0-9a-f]{4}", "usb", "removable", "device.*connect"), ("device_connected", "removable_media")),
    Family("execution", ("T1059", "T1059.001", "T1059.003", "T1105", "T1197", "T1569.002"), (r"powershell(?:\.exe)?", r"cmd(?:\.exe)?", r"certutil(?:\.exe)?", r"mshta(?:\.exe)?", r"rundll32(?:\.exe)?", r"regsvr32(?:\.exe)?"), ("shell_spawned", "script_execution", "suspicious_command", "lolbin_download")),
    Family("persistence", ("T1053.005", "T1543.003", "T1546.008", "T1547.001", "T1547.004", "T1505.003", "T1098"), (r"schtasks(?:\.exe)?", "new-service", r"sc(?:\.exe)?\s+(?:create|config)", r"\\currentversion\\run", "startup", "taskcache"), ("scheduled_task", "service_created", "persistence", "persistence_command")),
    Family("defense_evasion", ("T1562.001", "T1562.004", "T1070.001", "T1070.004", "T1070.006", "T1112", "T1548"), ("set-mppreference", "disable(?:realtime|behavior|script)", "add-mppreference", "wevtutil.*cl", "clear-eventlog", r"fodhelper(?:\.exe)?", "tamper"), ("defender_changed", "log_cleared", "security_disabled", "firewall_changed", "security_tool_config_changed", "uac_bypass_candidate")),
    Family("discovery", ("T1016", "T1018", "T1046", "T1082", "T1083"), (r"nmap(?:\.exe)?", r"masscan(?:\.exe)?", r"ipconfig(?:\.exe)?", r"systeminfo(?:\.exe)?", r"arp(?:\.exe)?\s+-a", r"netstat(?:\.exe)?", r"whoami(?:\.exe)?", r"wmic(?:\.exe)?"), ("network_scan", "system_discovery", "network_discovery")),
    Family("lateral_movement", ("T1021.001", "T1021.002", "T1219", "T1569.002"), (r"mstsc(?:\.exe)?", "psexec", r"\\psexesvc", "smb", "port.?445", "port.?3389", r":445\b", r":3389\b", "remote desktop"), ("remote_session", "lateral_movement")),
    Family("credential_access", ("T1552",), ("mimikatz", "sekurlsa", "lsass", "credential", "password", "passwd", r"credentials?\.(?:ini|txt|json)", r"default\.rdp"), ("credential_access", "sensitive_credential_file")),
    Family("collection", ("T1005", "T1074.001"), (r"select\s+.+\s+from", r"sqlcmd(?:\.exe)?", "settlements?", r"\.csv\b", "compress-archive", r"7z(?:\.exe)?\s+a", r"\\exfil(?:\\|\b)"), ("data_collection", "archive_created", "staging")),
    Family("exfiltration", ("T1041", "T1048"), (r"rclone(?:\.exe)?", "gdrive:", r"google(?:apis)?\.com", r"drive\.google\.com", r"\b(?:copy|sync)\b.+(?:gdrive|drive|s3|dropbox|onedrive)", r"mega(?:\.exe)?", "uncommon_destination_port"), ("exfiltration", "cloud_transfer", "high_outbound_transfer")),
    Family("impact", ("T1565.001", "T1657", "T1529"), ("vssadmin.*delete", r"cipher(?:\.exe)?", "wevtutil.*cl", r"shutdown(?:\.exe)?", "bugcheck", r"memory\.dmp", "ransom", r"비정상\s*종료", "재부팅", "재기동", "블루스크린", "크래시"), ("system_crash", "system_crash_recorded", "data_destroyed", "impact")),
)
#: Outbound bytes that are a large transfer (fixed value), most patterns and most characters of all of them.
LARGE, MOST_PATTERNS, MOST_CHARACTERS = 10 << 20, 10_000, 1_000_000


def needle_of(pattern: str) -> str:
    """The longest literal text that every match of a pattern has; empty if there is none."""
    best = run = ""
    for op, value in parser.parse(pattern):
        if op is parser.LITERAL:
            run += chr(value)
            best = max(best, run, key=len)
        else:
            run = ""
    return best


class Needles:
    """Patterns behind one automaton of their literals."""

    def __init__(self, patterns: list[str]):
        if len(patterns) > MOST_PATTERNS or sum(map(len, patterns)) > MOST_CHARACTERS:
            raise ValueError(f"{len(patterns)} patterns with {sum(map(len, patterns))} characters are more than a task should hold")
        self.tests = [re.compile(p) for p in patterns]
        self.always, by_needle = [], {}
        for i, p in enumerate(patterns):
            needle = needle_of(p)
            by_needle.setdefault(needle, []).append(i) if needle else self.always.append(i)
        self.automaton = ahocorasick.Automaton()
        for needle, which in by_needle.items():
            self.automaton.add_word(needle, tuple(which))
        if by_needle:
            self.automaton.make_automaton()
        self.some = bool(by_needle)

    def hits(self, text: str) -> list[int]:
        """Places of the patterns that the text has, in order."""
        tried = set(self.always)
        if self.some:
            for _, which in self.automaton.iter(text):
                tried.update(which)
        return sorted(i for i in tried if self.tests[i].search(text))


def with_hits(rows: DataFrame, patterns: list[str], *, blob: str, out: str = "hits") -> DataFrame:
    """Adds ``out``, the places of the patterns that match the text ``blob``; a null text has none."""

    @F.pandas_udf("array<int>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        needles = Needles(patterns)
        for texts in batches:
            yield texts.map(needles.hits)

    return rows.withColumn(out, found(F.coalesce(F.col(blob), F.lit(""))))


def behaviour_scores(records: DataFrame, requests: dict[str, list[str]], *, families: tuple[Family, ...] = FAMILIES) -> DataFrame:
    """(family, ref, us, score, signals) of the records that speak for a requested family.

    records: ref, us, blob (all its keys and values), flags, network (whether it names a
    remote end), outbound (bytes). requests: pivots by family. Three points a keyword, two a
    flag, one a pivot, four a large transfer (exfiltration). A pivot alone is not enough, but
    with a remote end it is for lateral movement. Records outside of the time range are left
    out. All families are looked for in one scan.
    """
    known = {f.name: f for f in families}
    unknown = sorted(set(requests) - set(known))
    if unknown:
        raise KeyError(f"no such family: {', '.join(unknown)}")
    patterns = list(dict.fromkeys(k for name in requests for k in known[name].keywords))
    inside = records.where(F.col("ref").isNotNull() & ~F.coalesce(F.array_contains("flags", "outside_time_range"), F.lit(False))).withColumn("blob", F.lower("blob"))
    rows = with_hits(inside, patterns, blob="blob").withColumn("_flags", F.transform(F.coalesce("flags", F.array().cast("array<string>")), F.lower))
    network = F.coalesce(F.col("network"), F.lit(False))
    out = []
    for name, pivots in requests.items():
        family = known[name]
        own = F.array(*(F.lit(patterns.index(k)) for k in family.keywords))
        words = F.array_intersect("hits", own)
        flags = F.array_sort(F.array_intersect("_flags", F.array(*map(F.lit, family.flags))))
        clean = [p.strip().lower() for p in pivots if p.strip()]
        pivot = sum((F.contains("blob", F.lit(p)).cast("int") for p in clean), F.lit(0)) if clean else F.lit(0)
        large = (network & (F.col("outbound") >= LARGE)) if name == "exfiltration" else F.lit(False)
        met = ((pivot > 0) & network) if name == "lateral_movement" else F.lit(False)
        score = 3 * F.size(words) + 2 * F.size(flags) + pivot + F.when(large, 4).otherwise(0)
        text = F.array(*map(F.lit, patterns))
        signals = F.concat(F.transform(words, lambda i: F.concat(F.lit("keyword:"), F.get(text, i))), F.transform(flags, lambda f: F.concat(F.lit("flag:"), f)), F.when(met, F.array(F.lit("pivot_network"))).otherwise(F.array().cast("array<string>")), F.when(large, F.array(F.lit("large_outbound_transfer"))).otherwise(F.array().cast("array<string>")))
        kept = (F.size(words) > 0) | (F.size(flags) > 0) | met | F.coalesce(large, F.lit(False))
        out.append(F.when(kept, F.struct(F.lit(name).alias("family"), score.cast("bigint").alias("score"), signals.alias("signals"))))
    return rows.select("ref", "us", F.explode_outer(F.array_compact(F.array(*out))).alias("f")).where("f is not null").select("f.family", "ref", "us", "f.score", "f.signals")


def pattern_counts(scores: DataFrame) -> DataFrame:
    """(family, signal, n): how many records show each signal of a family."""
    return scores.select("family", F.explode("signals").alias("signal")).groupBy("family", "signal").agg(F.count("*").alias("n"))


