"""Truth tables of the tag rules: one record that gets a tag, one that does not."""

import json

import pytest
from pyspark.sql import functions as F

from emberlane.operators.rules import RULES, canonical, tag

COLUMNS = ["timestamp", "path", "si_btime", "si_ctime", "si_mtime", "si_atime", "fn_btime", "fn_ctime", "fn_mtime"]


def frame(spark, records):
    rows = [(i, r.get("artifact"), r.get("event_id"), r.get("allocated"), r.get("reason"), json.dumps(r.get("fields", {})), *(r.get(c) for c in COLUMNS)) for i, r in enumerate(records)]
    schema = "n int, artifact string, event_id long, allocated boolean, reason array<string>, raw string, " + ", ".join(f"{c} string" for c in COLUMNS)
    return spark.createDataFrame(rows, schema).withColumn("fields", F.try_parse_json("raw"))


def start(**fields):
    return {"artifact": "evtx:Sysmon", "event_id": 1, "fields": fields}


GOOD = {c: "2024-01-01T00:00:00.1234567Z" for c in COLUMNS if c not in ("timestamp", "path")}
CASES = [
    ("timestamp_mismatch", {"artifact": "$MFT", **GOOD, "si_btime": "2023-01-01T00:00:00.1Z"}, {"artifact": "$MFT", **GOOD}),
    ("zero_timestamp", {"artifact": "$MFT", **GOOD, "fn_mtime": None}, {"artifact": "$MFT", **GOOD}),
    ("timestamp_truncated", {"artifact": "$MFT", **GOOD, **{c: "2024-01-01T00:00:00.0000000Z" for c in ("si_btime", "si_ctime", "si_mtime")}}, {"artifact": "$MFT", **GOOD, "si_btime": "2024-01-01T00:00:00.0000000Z", "si_ctime": "2024-01-01T00:00:00Z", "si_mtime": "2024-01-01T00:00:00.0000001Z"}),
    ("deleted", {"artifact": "$UsnJrnl", "reason": ["file_delete"]}, {"artifact": "$UsnJrnl", "reason": ["file_create"]}),
    ("deleted", {"artifact": "$MFT", "allocated": False, **GOOD}, {"artifact": "$MFT", "allocated": None, **GOOD}),
    ("log_cleared", {"artifact": "evtx:System", "event_id": 104}, {"artifact": "evtx:Security", "event_id": 104}),
    ("privileged_group_add", {"artifact": "evtx:Security", "event_id": 4732, "fields": {"TargetUserName": " Administrators"}}, {"artifact": "evtx:Security", "event_id": 4732, "fields": {"TargetUserName": "bob"}}),
    ("remote_interactive_logon", {"artifact": "evtx:Security", "event_id": 4624, "fields": {"LogonType": 10}}, {"artifact": "evtx:Security", "event_id": 4624, "fields": {"LogonType": "3"}}),
    ("uncommon_destination_port", {"artifact": "evtx:Sysmon", "event_id": 3, "fields": {"DestinationPort": "4444"}}, {"artifact": "evtx:Sysmon", "event_id": 3, "fields": {"DestinationPort": "443"}}),
    ("uncommon_destination_port", {"artifact": "evtx:Sysmon", "event_id": 3, "fields": {"DestinationPort": 8000}}, {"artifact": "evtx:Sysmon", "event_id": 3, "fields": {"DestinationPort": "52000"}}),
    ("shell_spawned", start(Image="C:\\Windows\\System32\\CMD.exe"), start(Image="C:\\Windows\\notepad.exe")),
    ("lolbin_download", start(CommandLine="certutil -URLCACHE -f http://x"), start(CommandLine="certutil -hashfile x")),
    ("credential_config_accessed", start(CommandLine="type C:\\app\\db_settings.json"), start(CommandLine="type C:\\app\\readme.json")),
    ("execution_from_unusual_path", start(Image="E:\\x.exe"), start(Image="C:\\Windows\\x.exe")),
    ("execution_from_unusual_path", start(Image="C:\\Users\\Public\\x.exe"), start(Image="C:\\Users\\bob\\x.exe")),
    ("execution_outside_known_volume_root", start(Image="C:\\staging\\x.exe"), start(Image="C:\\odd.exe")),
    ("unexpected_parent_process", start(Image="C:\\Windows\\System32\\cmd.exe", ParentImage="C:\\Windows\\explorer.exe"), start(Image="C:\\Program Files\\E\\msedge.exe", ParentImage="C:\\Program Files\\E\\msedge.exe")),
    ("unexpected_parent_process", start(ParentImage="C:\\Windows\\explorer.exe"), start(Image="C:\\Program Files\\E\\a\\helper.exe", ParentImage="C:\\Program Files\\E\\msedge.exe")),
    ("device_connected", {"artifact": "evtx:KernelPnP", "event_id": 400}, {"artifact": "evtx:KernelPnP", "event_id": 401}),
    ("kiosk_restriction_event", {"artifact": "evtx:AssignedAccess"}, {"artifact": "evtx:Assigned"}),
]


@pytest.fixture(scope="module")
def tagged(spark):
    rows = tag(frame(spark, [r for _, yes, no in CASES for r in (yes, no)])).select("n", "flags").collect()
    return {r.n: r.flags for r in rows}


@pytest.mark.parametrize("i", range(len(CASES)), ids=[f"{c[0]}-{i}" for i, c in enumerate(CASES)])
def test_truth_table(i, tagged):
    assert CASES[i][0] in tagged[2 * i]
    assert CASES[i][0] not in tagged[2 * i + 1]


def test_window_rule(spark):
    times = ["2024-01-05T00:00:00Z", "2024-02-05T00:00:00Z", None]
    rows = tag(frame(spark, [{"artifact": "evtx:BITS", "timestamp": t} for t in times]), window=("2024-01-01T00:00:00Z", "2024-01-31T00:00:00Z")).orderBy("n").collect()
    assert ["outside_time_range" in r.flags for r in rows] == [False, True, False]


def test_every_event_rule(spark):
    cases = [(r.name, {"artifact": c.artifact, "event_id": c.events[0]}) for r in RULES for c in r.clauses if c.events and not c.test and not r.extra]
    rows = tag(frame(spark, [c for _, c in cases])).orderBy("n").collect()
    assert all(name in row.flags for (name, _), row in zip(cases, rows))
    assert len(RULES) == 43


def test_canonical(spark):
    row = canonical(frame(spark, [{"artifact": "registry:Amcache", "fields": {"LowerCaseLongPath": "", "FullPath": "c:\\a", "DestAddress": "10.0.0.1", "DestPort": 5}}])).first().canonical
    assert (row.subject_path, row.remote_ip, row.remote_port, row.process_image) == ("c:\\a", "10.0.0.1", "5", None)
