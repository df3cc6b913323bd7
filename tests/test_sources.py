"""Binary readers on bytes made here, JSON lines, integrity, proposals, and streams against batches."""

import json
import sqlite3
import struct

from pyspark.sql import functions as F

from emberlane.operators import joins, proposals
from emberlane.sources import binary, evidence, ntfs
from emberlane.streaming import live

EPOCH = 116_444_736_000_000_000


def record_v2(name, reason, usn=7):
    raw = name.encode("utf-16-le")
    length = -(-(60 + len(raw)) // 8) * 8
    head = struct.pack("<IHHQQqqIIIIHH", length, 2, 0, 5 | 3 << 48, 9 | 1 << 48, usn, EPOCH + 10, reason, 0, 0, 0, len(raw), 60)
    return (head + raw).ljust(length, b"\0")


def test_journal(spark, tmp_path):
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.bin").write_bytes(bytes(8192) + record_v2("a.txt", 0x100) + b"\xff" * 16 + record_v2("b.txt", 0x80000200))
    rows = ntfs.read_journal(spark, str(tmp_path / "j")).orderBy("offset").collect()
    assert [(r.name, r.file_entry, r.file_sequence, r.parent_entry, r.us, r.reason) for r in rows] == [("a.txt", 5, 3, 9, 1, ["file_create"]), ("b.txt", 5, 3, 9, 1, ["file_delete", "close"])]


def file_record(name, parent, flags=1):
    body = struct.pack("<Q4qQQIIBB", parent, *[EPOCH + 20] * 4, 0, 0, 0, 0, len(name), 1) + name.encode("utf-16-le")
    si = struct.pack("<4q", *[EPOCH + 10] * 4) + bytes(16)

    def attribute(kind, content):
        length = -(-(24 + len(content)) // 8) * 8
        return (struct.pack("<IIBBHHHIHH", kind, length, 0, 0, 0, 0, 0, len(content), 24, 0) + content).ljust(length, b"\0")

    raw = bytearray((struct.pack("<4sHHQHHHH", b"FILE", 48, 3, 0, 1, 1, 56, flags).ljust(56, b"\0") + attribute(0x10, si) + attribute(0x30, body) + attribute(0x80, b"abc") + b"\xff\xff\xff\xff").ljust(1024, b"\0"))
    for i in (1, 2):
        raw[48 + 2 * i:50 + 2 * i] = raw[512 * i - 2:512 * i]
        raw[512 * i - 2:512 * i] = b"\x01\x01"
    raw[48:50] = b"\x01\x01"
    return bytes(raw)


def test_file_table(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "t.bin").write_bytes(file_record(".", 0, 3) + file_record("dir", 0, 3) + file_record("x.txt", 1, 0) + b"BAAD".ljust(1024, b"\0"))
    rows = ntfs.read_file_table(spark, str(tmp_path / "m"))
    got = {r.record_num: r for r in rows.collect()}
    assert (got[2].name, got[2].allocated, got[2].size, got[2].si_btime, got[2].fn_btime, len(got)) == ("x.txt", False, 3, 1, 2, 3)
    paths = {r.record_num: r.path for r in joins.parent_chain(rows.where("record_num > 0"), key="record_num", parent="parent", name="name", root=0).collect()}
    assert paths == {1: "dir", 2: "dir/x.txt"}


def test_recent_and_sqlite(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.bcf").write_bytes(bytes(20) + b"".join(struct.pack("<I", len(p)) + p.encode("utf-16-le") + b"\0\0" for p in ("c:\\a.exe", "c:\\b.exe")))
    assert [r.name for r in binary.read_recent_files(spark, str(tmp_path / "r")).orderBy("offset").collect()] == ["c:\\a.exe", "c:\\b.exe"]
    (tmp_path / "s").mkdir()
    con = sqlite3.connect(tmp_path / "s" / "x.db")
    con.execute("create table t (a integer, b text)")
    con.execute("insert into t values (1, 'x'), (2, null)")
    con.commit()
    con.close()
    rows = binary.read_sqlite(spark, str(tmp_path / "s"), ["t", "missing"]).select("rowid", F.try_variant_get("fields", "$.b", "string").alias("b")).orderBy("rowid").collect()
    assert [(r.rowid, r.b) for r in rows] == [(1, "x"), (2, None)]


def test_parent_chain_ends_at_circles(spark):
    rows = spark.createDataFrame([(1, 2, "a"), (2, 1, "b"), (3, 3, "c"), (4, 99, "d")], "k long, p long, n string")
    assert {r.k: r.path for r in joins.parent_chain(rows, key="k", parent="p", name="n", root=0).collect()} == {1: "b/a", 2: "a/b", 3: "c", 4: "d"}


def test_jsonl_round_trip_and_integrity(spark, tmp_path):
    lines = [{"ref": "MFT#1", "artifact": "$MFT", "record_num": 1, "fields": {"b": 1, "a": None}}, {"ref": "USN#2", "artifact": "$MFT", "record_num": 3}, {"ref": "MFT#1", "artifact": "$MFT", "record_num": 1}, {"artifact": "$MFT"}]
    (tmp_path / "in.jsonl").write_text("\n\n".join(map(json.dumps, lines)))
    records = evidence.read_jsonl(spark, str(tmp_path / "in.jsonl"))
    first = records.where("fields is not null").select("fields_json", F.expr("is_variant_null(variant_get(fields, '$.a'))").alias("null_a")).first()
    assert json.loads(first.fields_json) == {"b": 1, "a": None} and first.null_a
    assert {(r.check, r.ref, r.n) for r in evidence.violations(records).collect()} == {("missing_ref", None, 1), ("wrong_prefix", "USN#2", 1), ("wrong_number", "USN#2", 1), ("repeated_ref", "MFT#1", 2)}
    evidence.write_jsonl(records.drop("fields"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 4


def test_proposals(spark):
    records = spark.createDataFrame([("A#1", ["x", "y"]), ("A#2", ["x"])], "ref string, fields_present array<string>")
    candidates = spark.createDataFrame([("A#1", "T1")], "ref string, technique string")
    picks = spark.createDataFrame([("A#1", "T1", "why", ["x"]), ("A#2", "T1", "", ["z"]), ("A#9", None, "r", [])], "ref string, technique string, reason string, evidence_fields array<string>")
    got = {(r.ref, r.problem) for r in proposals.pick_violations(picks, records, candidates).collect()}
    assert got == {("A#2", "no_reason"), ("A#2", "technique_not_supported"), ("A#2", "field_not_found"), ("A#9", "unknown_ref"), ("A#9", "number_of_fields")}
    links = spark.createDataFrame([(1, ["A#1", "A#2"]), (2, ["A#1", "A#1"]), (3, ["A#1", "Q#1"]), (4, None)], "connection int, refs array<string>")
    assert {(r.connection, r.problem) for r in proposals.connection_violations(links, picks).collect()} == {(2, "fewer_than_two"), (3, "not_picked"), (4, "fewer_than_two")}
    kept = proposals.unclaimed(links.where("connection < 4").withColumn("c", F.lit(1)), case="c", order="connection").collect()
    assert [r.connection for r in kept] == [1]
    families = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "family string")
    some = lambda *x: spark.createDataFrame([(v,) for v in x], "family string")
    assert {r.family: r.status for r in proposals.coverage(families, some("b", "c"), some("b", "a"), some("c", "zz")).collect()} == {"a": "searched_no_evidence", "b": "observed", "c": "verified", "d": "not_searched"}


def test_stream_over_many_batches_equals_one(spark, tmp_path):
    rows = [(i, 1000 * i, i % 3, f"e{i % 7}") for i in range(120)]
    schema = "event_id long, us long, user_id long, endpoint string"
    for b in range(4):
        spark.createDataFrame(rows[30 * b:30 * b + 30], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.user_id: r.at for r in live.run_to_end(live.first_bursts(stream, key="user_id", at="us", ordinal="event_id", endpoint="endpoint", width=10_000, least=4), "append").collect()}
    assert got == {0: 9000, 1: 10000, 2: 11000}
    assert {r.user_id: r.n for r in live.run_to_end(live.running_tally(stream, ["user_id"]), "complete").collect()} == {0: 40, 1: 40, 2: 40}


def test_parent_chain_equals_a_walk(spark):
    import random

    from emberlane.operators import joins

    rnd = random.Random(2)
    rows = [(k, rnd.choice([k // 2, k // 2, k - 1, rnd.randint(1, 70), 500]), f"n{k}") for k in range(1, 80)]
    parents = {k: p for k, p, _ in rows}
    for depth in (3, 16):
        want = {}
        for k in parents:
            met, at = [k], parents[k]
            while at in parents and at not in met and len(met) <= depth:
                met.append(at)
                at = parents[at]
            want[k] = "/".join(f"n{x}" for x in reversed(met))
        got = joins.parent_chain(spark.createDataFrame(rows, "k long, p long, n string"), key="k", parent="p", name="n", root=0, depth=depth)
        assert {r.k: r.path for r in got.collect()} == want
