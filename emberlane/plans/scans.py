"""Scans of binary artifacts. The bytes are made of given tables and written as files first, with damage at known places."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlane.functions.times import FILETIME_EPOCH
from emberlane.operators import joins
from emberlane.plans.views import EVENTS_SQL, events, table
from emberlane.sources import ntfs
from emberlane.sources.ranges import write_bytes
from emberlane.tables import new_path


def _encoded(rows: DataFrame, encode) -> DataFrame:
    """A column ``content`` with encode(row) of each row, in the order of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([encode(**r) for r in batch.to_pylist()], pa.binary())], names=["content"])

    return rows.mapInArrow(run, "content binary")


def change_record(name: bytes, *, version: int = 2, entry: int = 1, sequence: int = 1, parent: int = 5, parent_sequence: int = 1, usn: int = 0, us: int = 0, reason: int = 0, source: int = 0, attributes: int = 0x20, foreign: int = 0, inside: bytes = b"") -> bytes:
    """Bytes of a change record; ``inside`` is laid behind its name as part of it, ``foreign`` makes the ids those of another file system."""
    own, up = entry | sequence << 48, parent | parent_sequence << 48
    ids = struct.pack("<QQ", own, up) if version == 2 else struct.pack("<QQQQ", own, foreign, up, foreign)
    head = 60 if version == 2 else 76
    body = ids + struct.pack("<qqIIIIHH", usn, us * 10 + FILETIME_EPOCH, reason, source, 0, attributes, len(name), head) + name
    body += bytes(-(8 + len(body)) % 8) + inside
    return struct.pack("<IHH", 8 + len(body), version, 0) + body


def _change(event_id: int, us: int, user_id: int, k: int, event_type: str) -> bytes:
    """The record of an event, behind what is damaged or empty before it."""
    out = b"\xff" * 24 if k % 7 == 1 else b""
    if k % 29 == 2:
        out += bytes(5000 - 5000 % 8)
    name = f"{event_type}_{event_id}.log".encode("utf-16-le") + (b"\x00\xd8" if k % 13 == 0 else b"")
    kept = dict(entry=event_id * 3 + 1, sequence=user_id % 1000, parent=user_id, usn=event_id, us=us, reason=1 << k % 22 | (event_id % 2) << 31, source=k % 8, attributes=0x10 if user_id % 4 == 0 else 0x20)
    if k % 19 == 4:
        return out + struct.pack("<IHH", 64, 4, 0) + change_record(name[:8], usn=-1)[:56].ljust(56, b"\0")
    if k % 23 == 5:
        return out + change_record(name, version=3, foreign=7, **kept)
    # what looks like a record inside of one must not be read as one
    inside = change_record(b"f\0", usn=-2) if k % 11 == 6 else b""
    return out + change_record(name, version=3 if k % 17 == 3 else 2, inside=inside, **kept)


def write_journal(spark: SparkSession, sf_dir: str) -> str:
    """Path of journals that hold a change for each event, in order of their ids, one file a partition."""
    path = new_path(spark, "journal")
    rows = events(spark, sf_dir).select("event_id", "us", "user_id", "k", "event_type")
    write_bytes(_encoded(rows.repartitionByRange("event_id").sortWithinPartitions("event_id"), _change), path)
    return path


def journal_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ntfs.read_journal(spark, write_journal(spark, sf_dir))
    return rows.select("ref", "usn", "version", "file_entry", "file_sequence", "parent_entry", "us", F.array_join("reason", ",").alias("reasons"), F.array_join("source", ",").alias("sources"), "is_directory", "name", "name_raw")


def journal_damage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ntfs.journal_gaps(spark, write_journal(spark, sf_dir)).groupBy("gap").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


def file_record(number: int, names: list[tuple[str, int]], *, parent: int = 5, flags: int = 1, si: list[int] | None = None, fn: list[int] | None = None, name_size: int = 0, data: bytes | None = None, away: int | None = None, signature: bytes = b"FILE", sector: int = 512, slot: int = 1024, torn: bool = False) -> bytes:
    """Bytes of a file record; ``away`` is the size of data that lie elsewhere, ``torn`` spoils the end of its first sector."""

    def held(kind: int, content: bytes) -> bytes:
        length = -(-(24 + len(content)) // 8) * 8
        return (struct.pack("<IIBBHHHIHH", kind, length, 0, 0, 0, 0, 0, len(content), 24, 0) + content).ljust(length, b"\0")

    body = held(0x10, struct.pack("<4q", *(si or [0] * 4)) + bytes(16))
    for name, space in names:
        body += held(0x30, struct.pack("<Q4qqqIIBB", parent | 1 << 48, *(fn or [0] * 4), 0, name_size, 0, 0, len(name), space) + name.encode("utf-16-le"))
    if data is not None:
        body += held(0x80, data)
    if away is not None:
        body += struct.pack("<IIBBHHHQQHHIQQQ", 0x80, 72, 1, 0, 64, 0, 0, 0, 0, 64, 0, 0, away, away, away) + bytes(8)
    count = slot // sector + 1
    first = 48 + -(-2 * count // 8) * 8
    raw = bytearray((struct.pack("<4sHHQHHHHIIQHHI", signature, 48, count, 0, 1, 1, first, flags, first + len(body) + 8, slot, 0, 9, 0, number).ljust(first, b"\0") + body + b"\xff" * 8).ljust(slot, b"\0"))
    for i in range(1, count):
        raw[48 + 2 * i:50 + 2 * i] = raw[sector * i - 2:sector * i]
        raw[sector * i - 2:sector * i] = b"\x07\x00"
    raw[48:50] = b"\x07\x00"
    if torn:
        raw[sector - 1] = 0xEE
    return bytes(raw)


def _part_record(p_partkey: int, p_size: int) -> bytes:
    key = p_partkey
    at = FILETIME_EPOCH + (1_600_000_000 + key) * 10_000_000
    kind = {0: dict(away=key * 1000), 1: dict(data=b"d" * (key % 50)), 2: {}}[key % 3]
    names = [(f"PART~{key % 10}", 2), (f"part number {key}.dat", 1)]
    record = file_record(key + 100, names, parent=key // 6 + 100 if key >= 6 else 5, flags=(key % 4 != 0) | (key % 2 == 0) << 1, si=[at, at + 10, 0 if key % 10 == 0 else at + 20, at + 30], fn=[at + 40, at + 50, at + 60, at + 70], name_size=key * 7, signature=b"BAAD" if key % 41 == 1 else b"FILE", torn=key % 37 == 0, **kind)
    return record + bytes(1024) * (p_size % 2)  # slots that are not in use


def write_file_table(spark: SparkSession, sf_dir: str) -> str:
    """Path of file tables with a record for each part."""
    path = new_path(spark, "file-table")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    write_bytes(_encoded(rows.repartitionByRange("p_partkey").sortWithinPartitions("p_partkey"), _part_record), path)
    return path


def file_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ntfs.read_file_table(spark, write_file_table(spark, sf_dir))
    paths = joins.parent_chain(rows, key="record_num", parent="parent", name="name", root=5)
    return rows.join(paths, "record_num").select("record_num", ntfs.volume_path(F.col("path")).alias("path"), "allocated", "is_directory", "size", "si_btime", "si_mtime", "si_ctime", "si_atime", "fn_btime", "fn_ctime")


QUERIES = {"journal_scan": journal_scan, "journal_damage": journal_damage, "file_table_scan": file_table_scan}

_NAMES = "[" + ", ".join(f"'{n or ''}'" for n in ntfs.REASONS) + "]"
ORACLE = {
    "journal_scan": f"""
with {EVENTS_SQL},
named as (select *, event_type || '_' || event_id || '.log' as plain from ev where k % 19 <> 4 and k % 23 <> 5)
select 'USN#' || event_id as ref, event_id as usn, case when k % 17 = 3 then 3 else 2 end as version, event_id * 3 + 1 as file_entry, user_id % 1000 as file_sequence, user_id as parent_entry, us,
  array_to_string(list_filter([{_NAMES}[(k % 22)::int + 1], case when event_id % 2 = 1 then 'close' else '' end], lambda x: x <> ''), ',') as reasons,
  array_to_string(list_filter([case when k & 1 > 0 then 'data_management' else '' end, case when k & 2 > 0 then 'auxiliary_data' else '' end, case when k & 4 > 0 then 'replication_management' else '' end], lambda x: x <> ''), ',') as sources,
  user_id % 4 = 0 as is_directory, case when k % 13 = 0 then plain || chr(65533) else plain end as name,
  case when k % 13 = 0 then regexp_replace(lower(hex(encode(plain))), '(..)', '\\100', 'g') || '00d8' end as name_raw
from named""",
    "journal_damage": f"""
with {EVENTS_SQL},
made as (select *, 2 * (len(event_type) + 1 + len(event_id::varchar) + 4) + case when k % 13 = 0 then 2 else 0 end as name_bytes from ev)
select 'unreadable' as gap, count(*) as n, sum(24)::bigint as bytes from made where k % 7 = 1 having count(*) > 0
union all select 'unsupported', count(*), sum(case when k % 19 = 4 then 64 else ceil((76 + name_bytes) / 8)::bigint * 8 end)::bigint from made where k % 19 = 4 or k % 23 = 5 having count(*) > 0""",
    "file_table_scan": """
with recursive t as (select p_partkey as key, case when p_partkey >= 6 then p_partkey // 6 end as up, 'part number ' || p_partkey || '.dat' as name from part where p_partkey % 37 <> 0),
chain as (select key, up, name as path from t union all select c.key, t.up, t.name || chr(92) || c.path from chain c join t on t.key = c.up),
longest as (select key, arg_max(path, len(path)) as path from chain group by key)
select key + 100 as record_num, 'C:' || chr(92) || path as path, key % 4 <> 0 as allocated, key % 2 = 0 as is_directory,
  case key % 3 when 0 then key * 1000 when 1 then key % 50 else key * 7 end as size,
  (1600000000 + key) * 1000000 as si_btime, (1600000000 + key) * 1000000 + 1 as si_mtime, case when key % 10 <> 0 then (1600000000 + key) * 1000000 + 2 end as si_ctime, (1600000000 + key) * 1000000 + 3 as si_atime,
  (1600000000 + key) * 1000000 + 4 as fn_btime, (1600000000 + key) * 1000000 + 6 as fn_ctime
from longest""",
}
