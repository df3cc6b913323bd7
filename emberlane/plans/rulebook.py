"""All rules over records of every kind: events deal out artifacts, ids, images, command lines, ports, groups and file times, hits and near misses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlane.operators import rules
from emberlane.plans.views import EVENTS_SQL, events

#: (artifact, event id) of records without fields, some of them known to no rule.
PAIRS = [
    ("evtx:Security", n) for n in (1102, 104, 4720, 4624, 4672, 4625, 5140, 5145, 6416, 4722, 4723, 4724, 4725, 4726, 4735, 4737, 4738, 4634, 4647, 4778, 4779, 4698, 4699, 4700, 4701, 4702, 4799)
] + [("evtx:System", n) for n in (104, 1102, 7040, 7045, 1001, 1074, 6008, 20001, 10000, 7036)] + [("evtx:Defender", n) for n in (1116, 5001, 5004, 5007, 1000)] + [("evtx:PowerShell", n) for n in (4103, 4104, 400)] + [
    ("evtx:Firewall", n) for n in (2003, 2004, 2005, 2006, 2033, 2032)
] + [("evtx:BITS", n) for n in (3, 4, 59, 60, 61, 5)] + [("evtx:NetworkProfile", n) for n in (10000, 10001, 10002)] + [("evtx:Sysmon", n) for n in (5, 3, 22, 11, 2)] + [("evtx:Application", n) for n in (18453, 18454, 18456, 33205, 1000, 1001, 1002, 1003)] + [
    ("evtx:DriverFrameworks", n) for n in (2003, 2004, 2005, 2006, 2010, 2100, 2101, 2102, 2105, 2106, 2107)
] + [("evtx:KernelPnP", n) for n in (400, 410, 411, 420, 430, 401)] + [("evtx:AssignedAccess", 1), ("evtx:AssignedAccessAdmin", 2), ("evtx:AssignedAccessBroker", 3), ("evtx:Assigned", 1)] + [("evtx:RDPConnection", n) for n in (1149, 21)] + [("evtx:RDPSession", n) for n in (21, 22, 23, 24, 25, 39, 40, 41)]
IMAGES = [
    "C:\\Windows\\System32\\CMD.exe", "C:\\Windows\\notepad.exe", "C:\\Windows\\System32\\fodhelper.exe", "C:\\Windows\\System32\\whoami.exe", "E:\\x.exe", "\\\\host\\share\\x.exe", "C:\\Users\\Public\\x.exe", "C:\\Users\\bob\\AppData\\Local\\Temp\\x.exe", "C:\\staging\\x.exe", "C:\\odd.exe", "",
    "C:\\Program Files\\E\\msedge.exe", "C:\\Program Files\\E\\a\\helper.exe", "C:\\PerfLogs\\taskmgr.exe", None, " c:\\users\\x\\sdclt.exe",
]
PARENTS = ["C:\\Windows\\explorer.exe", "C:\\Program Files\\E\\msedge.exe", "C:\\Windows\\System32\\svchost.exe", "", None, "C:\\Windows\\System32\\mshta.exe", "C:\\x\\winword.exe"]
COMMANDS = [
    "certutil -URLCACHE -f http://x", "certutil -hashfile x", "type C:\\app\\db_settings.json", "type C:\\app\\readme.json", "select  * from t", "SELECT * FROM t", "reg add HKLM\\Software\\Policies\\Microsoft\\Windows Defender", "Set-MpPreference -x", "schtasks /Create /TN x", "reg add x\\CurrentVersion\\Run", None, "cat /etc/env.conf,x",
]
PORTS = ["4444", "443", "52000", " 8000", "0", "x", None, "49151", "65536"]
GROUPS = [" Administrators", "bob", "REMOTE DESKTOP USERS ", None]
LOGONS = ["10", "3", " 10 ", None]
TIMES = [None, "2024-01-01T00:00:00.1234567Z", "2024-01-01T00:00:00.0000000Z", "1601-01-01T00:00:00.0000000Z", "2023-06-01T10:00:00.5Z", "2024-02-05T00:00:00Z"]
REASONS = [["file_delete", "close"], ["file_create"], ["data_extend"], None]
WINDOW = ("2024-01-01T00:00:00Z", "2024-01-31T00:00:00Z")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.floor(F.col("event_id") / 4)
    kind = F.col("event_id") % 4
    pick = lambda items, at: F.get(F.array(*(F.lit(i).cast("string") for i in items)), (at % len(items)).cast("int"))
    third = (e % 3).cast("int")
    artifact = F.when(kind == 0, pick([a for a, _ in PAIRS], e)).when(kind == 1, "evtx:Sysmon").when(kind == 2, F.when(third == 0, "evtx:Sysmon").otherwise("evtx:Security")).otherwise(F.when(third == 0, "$UsnJrnl").otherwise("$MFT"))
    number = F.when(kind == 0, pick([n for _, n in PAIRS], e).cast("bigint")).when(kind == 1, 1).when(kind == 2, F.when(third == 0, 3).when(third == 1, F.when(e % 2 == 0, 4728).otherwise(4732)).otherwise(4624))
    fields = F.to_json(F.struct(
        F.when(kind == 1, pick(IMAGES, e)).alias("Image"), F.when(kind == 1, pick(PARENTS, F.col("k"))).alias("ParentImage"), F.when(kind == 1, pick(COMMANDS, F.col("user_id"))).alias("CommandLine"),
        F.when((kind == 2) & (third == 0), pick(PORTS, F.col("k"))).alias("DestinationPort"), F.when((kind == 2) & (third == 1), pick(GROUPS, F.col("k"))).alias("TargetUserName"), F.when((kind == 2) & (third == 2), pick(LOGONS, F.col("k"))).alias("LogonType"),
    ))
    mft = (kind == 3) & (third != 0)
    times = {"si_btime": e, "si_ctime": F.floor(e / 6), "si_mtime": F.floor(e / 36), "fn_btime": F.floor(e / 2), "fn_ctime": e + 1, "fn_mtime": F.col("k")}
    reason = F.get(F.array(*(F.lit(None).cast("array<string>") if r is None else F.array(*map(F.lit, r)) for r in REASONS)), (F.col("k") % len(REASONS)).cast("int"))
    return events(spark, sf_dir).select(
        "event_id", artifact.alias("artifact"), number.cast("bigint").alias("number"), F.try_parse_json(fields).alias("fields"), F.when((kind == 3) & (third == 0), reason).alias("reason"), F.when(mft, F.col("k") % 3 != 0).alias("allocated"),
        F.when(kind != 3, pick(TIMES, e)).alias("timestamp"), *(F.when(mft, pick(TIMES, at)).alias(n) for n, at in times.items()), F.lit(None).cast("string").alias("si_atime"),
    ).withColumnRenamed("event_id", "id").withColumnRenamed("number", "event_id")


def every_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of each record by all 43 rules."""
    tagged = rules.tag(_records(spark, sf_dir), window=WINDOW)
    return tagged.select("id", "artifact", F.array_join("flags", ",").alias("flags"))


QUERIES = {"every_rule": every_rule}


def _list(items, kind: str = "varchar") -> str:
    text = ", ".join("null" if i is None else "'" + i.replace("'", "''") + "'" if isinstance(i, str) else str(i) for i in items)
    return f"([{text}]::{kind}[])"


def _at(items, place: str, kind: str = "varchar") -> str:
    return f"{_list(items, kind)}[({place}) % {len(items)} + 1]"


_EV = lambda artifact, *numbers: f"(artifact = '{artifact}' and number in ({', '.join(map(str, numbers))}))"
_START = "artifact = 'evtx:Sysmon' and number = 1"
_ANY = lambda field, how, *words: f"({_START} and (" + " or ".join(f"{how}({field}, '{w}')" for w in words) + "))"
_SI, _FN = ("si_btime", "si_ctime", "si_mtime"), ("fn_btime", "fn_ctime", "fn_mtime")
_MFT = "artifact = '$MFT'"
_FRACTION = lambda c: f"regexp_extract(coalesce({c}, ''), '\\.([^Zz]*)', 1)"
_COUNTS = lambda c: f"(u_{c} > -11644387200000000 and {_FRACTION(c)} <> '')"
_FOLDER = "regexp_extract(trim(image), '^[a-z]:\\\\([^\\\\]+)\\\\', 1)"
_OWN = "regexp_extract(trim(parent), '^(.*[^\\\\])\\\\+[^\\\\]*$', 1)"
#: The conditions in SQL, in the order of the rules.
_SQL = {
    "timestamp_mismatch": f"{_MFT} and u_si_btime < u_fn_btime",
    "log_cleared": f"{_EV('evtx:Security', 1102)} or {_EV('evtx:System', 104)}",
    "deleted": f"{_MFT} and allocated = false or artifact = '$UsnJrnl' and list_contains(reason, 'file_delete')",
    "zero_timestamp": f"{_MFT} and (" + " or ".join(f"coalesce(u_{c} < -11644387200000000, true)" for c in (*_SI, *_FN)) + ")",
    "file_created": f"artifact = '$UsnJrnl' and list_contains(reason, 'file_create') or {_EV('evtx:Sysmon', 11)}",
    "account_created": _EV("evtx:Security", 4720),
    "privileged_group_add": f"{_EV('evtx:Security', 4728, 4732)} and trim(who) in ('administrators', 'domain admins', 'enterprise admins', 'backup operators', 'remote desktop users')",
    "logon_success": _EV("evtx:Security", 4624, 4672),
    "logon_failed": _EV("evtx:Security", 4625),
    "service_config_changed": _EV("evtx:System", 7040),
    "service_installed": _EV("evtx:System", 7045),
    "share_accessed": _EV("evtx:Security", 5140, 5145),
    "defender_disabled": _EV("evtx:Defender", 1116, 5001, 5004, 5007),
    "powershell_logged": _EV("evtx:PowerShell", 4103, 4104),
    "firewall_config_changed": _EV("evtx:Firewall", 2003, 2004, 2005, 2006, 2033),
    "bits_transfer": _EV("evtx:BITS", 3, 4, 59, 60, 61),
    "network_state_changed": _EV("evtx:NetworkProfile", 10000, 10001),
    "process_lifecycle_closed": _EV("evtx:Sysmon", 5),
    "shell_spawned": _ANY("image", "suffix", *(f"\\{n}.exe" for n in "cmd powershell pwsh explorer taskmgr mmc regedit wscript cscript rundll32 control".split())),
    "lolbin_download": _ANY("command", "contains", "-urlcache", "bitsadmin /transfer", "invoke-webrequest", "downloadstring", "downloadfile", "start-bitstransfer"),
    "uac_bypass_candidate": _ANY("image", "suffix", "\\fodhelper.exe", "\\computerdefaults.exe", "\\sdclt.exe"),
    "database_logon": _EV("evtx:Application", 18453, 18454, 18456, 33205),
    "system_crash_recorded": _EV("evtx:System", 1001, 1074, 6008),
    "remote_interactive_logon": f"{_EV('evtx:Security', 4624)} and trim(logon) = '10'",
    # a token of a path whose name holds one of the words and whose ending is that of a settings file
    "credential_config_accessed": f"""{_START} and len(list_filter(regexp_split_to_array(command, '[\\\\/:"\\s]+'), lambda t: regexp_matches(t, '^[^,;)]*\\.(json|ini|env|xml|conf|config|ya?ml)([,;)]|$)') and regexp_matches(t, 'settings|config|credential|secret|passw|database|conn_str|token|apikey|env'))) > 0""",
    "uncommon_destination_port": f"{_EV('evtx:Sysmon', 3)} and try_cast(trim(port) as int) between 1 and 49151 and try_cast(trim(port) as int) not in ({', '.join(map(str, rules.SERVICE_PORTS))})",
    "database_table_dumped": _ANY("command", "contains", "select * from"),
    "security_tool_config_changed": _ANY("command", "contains", "\\policies\\microsoft\\windows defender", "disableantispyware", "disablerealtimemonitoring", "add-mppreference", "set-mppreference"),
    "persistence_command": _ANY("command", "contains", "/create /tn", "/tr ", "register-scheduledtask", "currentversion\\run"),
    "discovery_command": _ANY("image", "suffix", *(f"\\{n}.exe" for n in "whoami arp netstat nltest systeminfo quser".split())),
    "execution_from_unusual_path": f"{_START} and (regexp_matches(image, '^([abd-z]:\\\\|\\\\\\\\)') or {_ANY('image', 'contains', chr(92) + 'appdata' + chr(92) + 'local' + chr(92) + 'temp' + chr(92), chr(92) + 'appdata' + chr(92) + 'roaming' + chr(92), chr(92) + 'windows' + chr(92) + 'temp' + chr(92), chr(92) + 'users' + chr(92) + 'public' + chr(92), chr(92) + '$recycle.bin' + chr(92), chr(92) + 'perflogs' + chr(92), ':' + chr(92) + 'temp' + chr(92))})",
    "execution_outside_known_volume_root": f"{_START} and {_FOLDER} not in ('', {', '.join(repr(r) for r in rules.VOLUME_ROOTS)})",
    "unexpected_parent_process": _ANY("parent", "suffix", *(f"\\{n}.exe" for n in "explorer userinit wscript cscript mshta winword excel powerpnt acrord32 iexplore msedge chrome firefox".split()))
    + f" and (coalesce(trim(image), '') = '' or trim(image) <> trim(parent) and not ({_OWN} not in ('', {', '.join(repr(f).replace(chr(92) * 2, chr(92)) for f in rules.SHARED_FOLDERS)}) and starts_with(trim(image), {_OWN} || chr(92))))",
    "network_connection": _EV("evtx:Sysmon", 3, 22),
    "device_connected": f"{_EV('evtx:DriverFrameworks', 2003, 2004, 2005, 2006, 2010, 2100, 2101, 2102, 2105, 2106)} or {_EV('evtx:KernelPnP', 400, 410, 411, 420, 430)} or {_EV('evtx:System', 20001, 10000)} or {_EV('evtx:Security', 6416)}",
    "kiosk_restriction_event": "artifact in ('evtx:AssignedAccess', 'evtx:AssignedAccessAdmin', 'evtx:AssignedAccessBroker')",
    "remote_session": f"{_EV('evtx:RDPConnection', 1149)} or {_EV('evtx:RDPSession', 21, 22, 23, 24, 25, 39, 40)}",
    "app_crash": _EV("evtx:Application", 1000, 1001, 1002),
    "timestamp_truncated": f"{_MFT} and " + " + ".join(f"coalesce({_COUNTS(c)} and regexp_matches({_FRACTION(c)}, '^0+$'), false)::int" for c in _SI) + " >= 2 and not (" + " or ".join(f"coalesce({_COUNTS(c)} and not regexp_matches({_FRACTION(c)}, '^0+$'), false)" for c in _SI) + ")",
    "account_modified": _EV("evtx:Security", 4722, 4723, 4724, 4725, 4726, 4735, 4737, 4738),
    "session_state_changed": _EV("evtx:Security", 4634, 4647, 4778, 4779),
    "scheduled_task_changed": _EV("evtx:Security", 4698, 4699, 4700, 4701, 4702),
    "outside_time_range": "coalesce(u_timestamp, u_si_btime, u_si_ctime, u_si_mtime) is not null and not (" + " or ".join(f"coalesce(u_{c} between 1704067200000000 and 1706659200000000, false)" for c in ("timestamp", *_SI)) + ")",
}
_US = lambda c: f"epoch_us(replace(left({c}, 19), 'T', ' ')::timestamp) + left(rpad(regexp_extract({c}, '\\.([0-9]+)', 1), 6, '0'), 6)::bigint as u_{c}"
_PLACES = {"si_btime": "e", "si_ctime": "e // 6", "si_mtime": "e // 36", "fn_btime": "e // 2", "fn_ctime": "e + 1", "fn_mtime": "k"}
ORACLE = {
    "every_rule": f"""
with {EVENTS_SQL}, b as (select *, event_id // 4 as e, event_id % 4 as kind, event_id // 4 % 3 as third from ev),
r as (select event_id as id, case kind when 0 then {_at([a for a, _ in PAIRS], 'e')} when 1 then 'evtx:Sysmon' when 2 then case when third = 0 then 'evtx:Sysmon' else 'evtx:Security' end else case when third = 0 then '$UsnJrnl' else '$MFT' end end as artifact,
  case kind when 0 then {_at([n for _, n in PAIRS], 'e', 'bigint')} when 1 then 1 when 2 then case third when 0 then 3 when 1 then case when e % 2 = 0 then 4728 else 4732 end else 4624 end end as number,
  case when kind = 1 then lower({_at(IMAGES, 'e')}) end as image, case when kind = 1 then lower({_at(PARENTS, 'k')}) end as parent, case when kind = 1 then lower({_at(COMMANDS, 'user_id')}) end as command,
  case when kind = 2 and third = 0 then {_at(PORTS, 'k')} end as port, case when kind = 2 and third = 1 then lower({_at(GROUPS, 'k')}) end as who, case when kind = 2 and third = 2 then {_at(LOGONS, 'k')} end as logon,
  case when kind = 3 and third = 0 then [{', '.join('null' if x is None else _list(x) for x in REASONS)}][k % {len(REASONS)} + 1] end as reason, case when kind = 3 and third <> 0 then k % 3 <> 0 end as allocated,
  case when kind <> 3 then {_at(TIMES, 'e')} end as timestamp, {', '.join(f"case when kind = 3 and third <> 0 then {_at(TIMES, p)} end as {c}" for c, p in _PLACES.items())} from b),
t as (select *, {', '.join(_US(c) for c in ('timestamp', *_SI, *_FN))} from r)
select id, artifact, array_to_string(list_filter([{', '.join(f"case when coalesce({c}, false) then '{n}' else '' end" for n, c in _SQL.items())}], lambda x: x <> ''), ',') as flags from t"""
}
