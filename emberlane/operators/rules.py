"""Declarative tag rules compiled to Columns, and the canonical overlay of a record.

A rule is a list of clauses, of which one must hold, and an optional extra condition.
A clause names an artifact (exact, ``prefix*`` or ``*``), event ids, and a test on one
field. ``fields.X`` reads the open VARIANT column; any other name is a column.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field as default

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlane.functions.text import first_filled
from emberlane.functions.times import parse_micros


@dataclass(frozen=True)
class Clause:
    artifact: str
    events: tuple[int, ...] = ()
    test: str = ""
    field: str = ""
    values: tuple = ()


@dataclass(frozen=True)
class Rule:
    name: str
    clauses: tuple[Clause, ...]
    extra: str = ""


def value_of(name: str) -> Column:
    """A field as text; null where it is missing."""
    if name.startswith("fields."):
        return F.try_variant_get("fields", f"$.{name[7:]}", "string")
    return F.col(name)


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _low(name: str) -> Column:
    """A field as tag() prepares it once per record: lower-case text."""
    return F.col(f"_low_{name[7:]}") if name.startswith("fields.") else F.lower(F.col(name))


def _us(name: str) -> Column:
    """A time as tag() prepares it once per record: microseconds."""
    return F.col(f"_us_{name}")


def _quoted(values: tuple) -> str:
    return "|".join("\\Q" + str(v).lower() + "\\E" for v in values)


#: Tests by name: (field, values) to a Column. Several values make one pattern, so a field is read once.
TESTS: dict[str, Callable[[str, tuple], Column]] = {
    "endswith": lambda f, v: _low(f).rlike(rf"(?:{_quoted(v)})\z"),
    "startswith": lambda f, v: _low(f).rlike(rf"\A(?:{_quoted(v)})"),
    "contains": lambda f, v: _low(f).rlike(_quoted(v)),
    "in": lambda f, v: F.trim(_low(f)).isin([str(x).strip().lower() for x in v]),
    "regex": lambda f, v: _low(f).rlike("|".join(v)),
    "equals": lambda f, v: value_of(f).eqNullSafe(F.lit(v[0])),
    "has": lambda f, v: F.arrays_overlap(F.col(f), F.array(*map(F.lit, v))),
}

SI, FN = ("si_btime", "si_ctime", "si_mtime"), ("fn_btime", "fn_ctime", "fn_mtime")
#: Microseconds of 1601-01-02, below which a file time counts as zero (fixed value).
ZERO_TIME = -11_644_387_200_000_000

# Fixed values.
PRIVILEGED_GROUPS = ["administrators", "domain admins", "enterprise admins", "backup operators", "remote desktop users"]
EPHEMERAL_FLOOR = 49152
SERVICE_PORTS = [
    20, 21, 22, 23, 25, 53, 67, 68, 69, 80, 88, 110, 123, 135, 137, 138, 139, 143, 161, 162, 389, 443, 445, 464, 465, 514, 546, 547, 587, 593, 636,
    993, 995, 1433, 1434, 1701, 1723, 1900, 3268, 3269, 3389, 3702, 5353, 5355, 5985, 5986, 8080, 8443, 1514, 5000, 5001, 5002,
]
VOLUME_ROOTS = ["windows", "winnt", "program files", "program files (x86)", "programdata", "users", "documents and settings", "$recycle.bin", "system volume information", "perflogs", "recovery", "boot", "msocache", "kiosk"]
SHARED_FOLDERS = ["c:\\windows", "c:\\windows\\system32", "c:\\windows\\syswow64", "c:\\program files", "c:\\program files (x86)", "c:\\programdata"]


def created_before_named() -> Column:
    return _us("si_btime") < _us("fn_btime")


def whole_seconds_only() -> Column:
    """Two or more creation, change or write times have only zeros after the dot, and none has another digit there."""
    fraction = lambda c: F.regexp_extract(F.col(c), r"\.([^Zz]*)", 1)
    counts = lambda c: (_us(c) > ZERO_TIME) & (fraction(c) != "")
    zero = [F.coalesce(counts(c) & fraction(c).rlike("^0+$"), F.lit(False)) for c in SI]
    other = [F.coalesce(counts(c) & ~fraction(c).rlike("^0+$"), F.lit(False)) for c in SI]
    return (sum((z.cast("int") for z in zero), F.lit(0)) >= 2) & ~_any(other)


def has_zero_time() -> Column:
    return _any([F.coalesce(_us(c) < ZERO_TIME, F.lit(True)) for c in (*SI, *FN)])


def target_is_privileged() -> Column:
    return F.trim(_low("fields.TargetUserName")).isin(PRIVILEGED_GROUPS)


def uncommon_port() -> Column:
    port = F.trim(_low("fields.DestinationPort")).try_cast("int")
    return (port > 0) & (port < EPHEMERAL_FLOOR) & ~port.isin(SERVICE_PORTS)


def outside_known_roots() -> Column:
    folder = F.regexp_extract(F.trim(_low("fields.Image")), r"^[a-z]:\\([^\\]+)\\", 1)
    return (folder != "") & ~folder.isin(VOLUME_ROOTS)


def parent_is_other_program() -> Column:
    """Unknown programs count as others; the same image and a child inside its parent's own folder do not."""
    image, parent = F.trim(_low("fields.Image")), F.trim(_low("fields.ParentImage"))
    folder = F.regexp_extract(parent, r"^(.*[^\\])\\+[^\\]*$", 1)
    inside = (folder != "") & ~folder.isin(SHARED_FOLDERS) & image.startswith(F.concat(folder, F.lit("\\")))
    return F.when(F.coalesce(image, F.lit("")).isin("") | F.coalesce(parent, F.lit("")).isin(""), True).otherwise((image != parent) & ~inside)


def outside_window(start: str | None = None, end: str | None = None) -> Column:
    """No known time lies inside the window; false when no time or no window is known."""
    if not start and not end:
        return F.lit(False)
    times = F.array_compact(F.array(*(_us(c) for c in ("timestamp", *SI, "si_atime"))))
    low, high = parse_micros(F.lit(start)), parse_micros(F.lit(end))
    inside = F.exists(times, lambda t: F.coalesce(t >= low, F.lit(True)) & F.coalesce(t <= high, F.lit(True)))
    return (F.size(times) > 0) & ~inside


#: Open fields that the extra conditions read.
READ_BY_EXTRAS = ("TargetUserName", "DestinationPort", "Image", "ParentImage")
EXTRAS: dict[str, Callable[[], Column]] = {
    "created_before_named": created_before_named,
    "whole_seconds_only": whole_seconds_only,
    "has_zero_time": has_zero_time,
    "target_is_privileged": target_is_privileged,
    "uncommon_port": uncommon_port,
    "outside_known_roots": outside_known_roots,
    "parent_is_other_program": parent_is_other_program,
}

_SYSMON, _SECURITY, _SYSTEM = "evtx:Sysmon", "evtx:Security", "evtx:System"
_IMAGE, _PARENT, _COMMAND = "fields.Image", "fields.ParentImage", "fields.CommandLine"


def _on(artifact: str, *events: int) -> Clause:
    return Clause(artifact, events)


def _start(test: str, field: str, *values: str) -> Clause:
    """A test on process starts."""
    return Clause(_SYSMON, (1,), test, field, values)


# The tag vocabulary, in its order, and what each tag means.
RULES: tuple[Rule, ...] = (
    Rule("timestamp_mismatch", (_on("$MFT"),), "created_before_named"),
    Rule("log_cleared", (_on(_SECURITY, 1102), _on(_SYSTEM, 104))),
    Rule("deleted", (Clause("$MFT", (), "equals", "allocated", (False,)), Clause("$UsnJrnl", (), "has", "reason", ("file_delete",)))),
    Rule("zero_timestamp", (_on("$MFT"),), "has_zero_time"),
    Rule("file_created", (Clause("$UsnJrnl", (), "has", "reason", ("file_create",)), _on(_SYSMON, 11))),
    Rule("account_created", (_on(_SECURITY, 4720),)),
    Rule("privileged_group_add", (_on(_SECURITY, 4728, 4732),), "target_is_privileged"),
    Rule("logon_success", (_on(_SECURITY, 4624, 4672),)),
    Rule("logon_failed", (_on(_SECURITY, 4625),)),
    Rule("service_config_changed", (_on(_SYSTEM, 7040),)),
    Rule("service_installed", (_on(_SYSTEM, 7045),)),
    Rule("share_accessed", (_on(_SECURITY, 5140, 5145),)),
    Rule("defender_disabled", (_on("evtx:Defender", 1116, 5001, 5004, 5007),)),
    Rule("powershell_logged", (_on("evtx:PowerShell", 4103, 4104),)),
    Rule("firewall_config_changed", (_on("evtx:Firewall", 2003, 2004, 2005, 2006, 2033),)),
    Rule("bits_transfer", (_on("evtx:BITS", 3, 4, 59, 60, 61),)),
    Rule("network_state_changed", (_on("evtx:NetworkProfile", 10000, 10001),)),
    Rule("process_lifecycle_closed", (_on(_SYSMON, 5),)),
    Rule("shell_spawned", (_start("endswith", _IMAGE, "\\cmd.exe", "\\powershell.exe", "\\pwsh.exe", "\\explorer.exe", "\\taskmgr.exe", "\\mmc.exe", "\\regedit.exe", "\\wscript.exe", "\\cscript.exe", "\\rundll32.exe", "\\control.exe"),)),
    Rule("lolbin_download", (_start("contains", _COMMAND, "-urlcache", "bitsadmin /transfer", "invoke-webrequest", "downloadstring", "downloadfile", "start-bitstransfer"),)),
    Rule("uac_bypass_candidate", (_start("endswith", _IMAGE, "\\fodhelper.exe", "\\computerdefaults.exe", "\\sdclt.exe"),)),
    Rule("database_logon", (_on("evtx:Application", 18453, 18454, 18456, 33205),)),
    Rule("system_crash_recorded", (_on(_SYSTEM, 1001, 1074, 6008),)),
    Rule("remote_interactive_logon", (Clause(_SECURITY, (4624,), "in", "fields.LogonType", ("10",)),)),
    Rule("credential_config_accessed", (_start("regex", _COMMAND, "(?i)(?<![^\\\\/:\"\\s])(?=[^\\\\/:\"\\s]*(?:settings|config|credential|secret|passw|database|conn_str|token|apikey|env))[^\\\\/:\"\\s]*\\.(?:json|ini|env|xml|conf|config|ya?ml)(?![^\\s\",;)])"),)),
    Rule("uncommon_destination_port", (_on(_SYSMON, 3),), "uncommon_port"),
    Rule("database_table_dumped", (_start("contains", _COMMAND, "select * from"),)),
    Rule("security_tool_config_changed", (_start("contains", _COMMAND, "\\policies\\microsoft\\windows defender", "disableantispyware", "disablerealtimemonitoring", "add-mppreference", "set-mppreference"),)),
    Rule("persistence_command", (_start("contains", _COMMAND, "/create /tn", "/tr ", "register-scheduledtask", "currentversion\\run"),)),
    Rule("discovery_command", (_start("endswith", _IMAGE, "\\whoami.exe", "\\arp.exe", "\\netstat.exe", "\\nltest.exe", "\\systeminfo.exe", "\\quser.exe"),)),
    Rule("execution_from_unusual_path", (
        _start("startswith", _IMAGE, *(f"{c}:\\" for c in "abdefghijklmnopqrstuvwxyz"), "\\\\"),
        _start("contains", _IMAGE, "\\appdata\\local\\temp\\", "\\appdata\\roaming\\", "\\windows\\temp\\", "\\users\\public\\", "\\$recycle.bin\\", "\\perflogs\\", ":\\temp\\"),
    )),
    Rule("execution_outside_known_volume_root", (_on(_SYSMON, 1),), "outside_known_roots"),
    Rule("unexpected_parent_process", (_start("endswith", _PARENT, "\\explorer.exe", "\\userinit.exe", "\\wscript.exe", "\\cscript.exe", "\\mshta.exe", "\\winword.exe", "\\excel.exe", "\\powerpnt.exe", "\\acrord32.exe", "\\iexplore.exe", "\\msedge.exe", "\\chrome.exe", "\\firefox.exe"),), "parent_is_other_program"),
    Rule("network_connection", (_on(_SYSMON, 3, 22),)),
    Rule("device_connected", (_on("evtx:DriverFrameworks", 2003, 2004, 2005, 2006, 2010, 2100, 2101, 2102, 2105, 2106), _on("evtx:KernelPnP", 400, 410, 411, 420, 430), _on(_SYSTEM, 20001, 10000), _on(_SECURITY, 6416))),
    Rule("kiosk_restriction_event", (_on("evtx:AssignedAccess"), _on("evtx:AssignedAccessAdmin"), _on("evtx:AssignedAccessBroker"))),
    Rule("remote_session", (_on("evtx:RDPConnection", 1149), _on("evtx:RDPSession", 21, 22, 23, 24, 25, 39, 40))),
    Rule("app_crash", (_on("evtx:Application", 1000, 1001, 1002),)),
    Rule("timestamp_truncated", (_on("$MFT"),), "whole_seconds_only"),
    Rule("account_modified", (_on(_SECURITY, 4722, 4723, 4724, 4725, 4726, 4735, 4737, 4738),)),
    Rule("session_state_changed", (_on(_SECURITY, 4634, 4647, 4778, 4779),)),
    Rule("scheduled_task_changed", (_on(_SECURITY, 4698, 4699, 4700, 4701, 4702),)),
    Rule("outside_time_range", (_on("*"),), "outside_window"),
)


def artifact_is(pattern: str) -> Column:
    if pattern == "*":
        return F.lit(True)
    return F.col("artifact").startswith(pattern[:-1]) if pattern.endswith("*") else F.col("artifact") == pattern


def compile_rule(rule: Rule, window: tuple[str | None, str | None] = (None, None)) -> Column:
    """The rule as one boolean Column; unknown is false."""
    clauses = []
    for c in rule.clauses:
        test = artifact_is(c.artifact)
        if c.events:
            test = test & F.col("event_id").isin(list(c.events))
        if c.test:
            test = test & TESTS[c.test](c.field, c.values)
        clauses.append(F.coalesce(test, F.lit(False)))
    out = _any(clauses)
    if rule.extra:
        extra = outside_window(*window) if rule.extra == "outside_window" else EXTRAS[rule.extra]()
        out = out & F.coalesce(extra, F.lit(False))
    return out


#: Rules as Columns, by rules, window and application: they are built once, as that takes longer than to plan them.
_COMPILED: dict[tuple, tuple[dict[str, Column], Column]] = {}


def tag(records: DataFrame, rules: tuple[Rule, ...] = RULES, window: tuple[str | None, str | None] = (None, None)) -> DataFrame:
    """Adds ``flags``, the names of the rules that hold, in the order of the rules: no join and no shuffle.

    The fields and times that rules read are taken out of a record once, before the rules.
    """
    key = (rules, window, records.sparkSession.sparkContext.applicationId)
    if key not in _COMPILED:
        used = {c.field[7:] for r in rules for c in r.clauses if c.field.startswith("fields.")} | set(READ_BY_EXTRAS)
        ready = {f"_low_{n}": F.lower(F.try_variant_get("fields", f"$.{n}", "string")) for n in sorted(used)} | {f"_us_{c}": parse_micros(F.col(c)) for c in ("timestamp", *SI, *FN, "si_atime")}
        _COMPILED[key] = ready, F.array_compact(F.array(*(F.when(compile_rule(r, window), r.name) for r in rules)))
    ready, flags = _COMPILED[key]
    tagged = records.withColumns(ready).withColumn("flags", flags)
    return tagged.select(*records.columns, "flags") if "flags" not in records.columns else tagged.select(*records.columns)


def exploded(tagged: DataFrame, *keep: str) -> DataFrame:
    """A row a flag: the columns to keep, and ``flag``.

    A plain explode lets the optimizer test the size of the list at the scan, and so compute the flags twice.
    """
    return tagged.select(*keep, F.explode_outer("flags").alias("flag")).where("flag is not null")


def canonical(records: DataFrame) -> DataFrame:
    """Adds ``canonical``, the few fields that all artifacts share under one name; empty values become null."""
    f = lambda name: F.try_variant_get("fields", f"$.{name}", "string")
    sysmon = F.col("artifact") == _SYSMON
    filled = lambda c: F.when(c != "", c)
    subject = F.when(F.col("artifact") == "registry:Amcache", first_filled(f("LowerCaseLongPath"), f("FullPath"))).when(sysmon, f("Image")).otherwise(first_filled(F.col("path"), f("Path")))
    return records.withColumn(
        "canonical",
        F.struct(
            filled(subject).alias("subject_path"),
            filled(F.col("timestamp")).alias("event_time"),
            F.when(sysmon, filled(f("Image"))).alias("process_image"),
            F.when(sysmon, filled(f("ParentImage"))).alias("parent_image"),
            F.when(sysmon, filled(f("CommandLine"))).alias("command_line"),
            filled(f("Hashes")).alias("hashes"),
            filled(f("User")).alias("user"),
            first_filled(f("DestinationIp"), f("DestAddress"), f("DestinationHostname")).alias("remote_ip"),
            first_filled(f("DestinationPort"), f("DestPort")).alias("remote_port"),
        ),
    )
