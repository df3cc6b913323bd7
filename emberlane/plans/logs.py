"""Scans of event logs. The logs are made of the events first: templates, names by reference, damaged and undeclared chunks."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlane.functions.times import FILETIME_EPOCH
from emberlane.plans.views import EVENTS_SQL, events
from emberlane.sources import event_log
from emberlane.sources.ranges import write_bytes
from emberlane.tables import new_path

#: An element of a template: (name, attributes, content); content and attribute values are texts or holes (index, type).
Tree = tuple[str, dict, list]


class ChunkWriter:
    """Bytes of a chunk: names and templates are written where they are first used, and pointed to from then on."""

    def __init__(self):
        self.out = bytearray(event_log.CHUNK_HEAD)
        self.names: dict[str, int] = {}
        self.templates: dict[int, int] = {}
        self.numbers: list[int] = []

    def name(self, text: str) -> None:
        at = self.names.get(text)
        if at is None:
            at = self.names[text] = len(self.out) + 4
            self.out += struct.pack("<IIHH", at, 0, 0, len(text)) + text.encode("utf-16-le") + b"\0\0"
        else:
            self.out += struct.pack("<I", at)

    def piece(self, part) -> None:
        if isinstance(part, str):
            self.out += struct.pack("<BBH", 0x05, 0x01, len(part)) + part.encode("utf-16-le")
        else:
            self.out += struct.pack("<BHB", 0x0E if part[1] != 0x01 else 0x0D, *part)

    def element(self, tree: Tree) -> None:
        name, attributes, content = tree
        self.out += struct.pack("<BHI", 0x41 if attributes else 0x01, 0xFFFF, 0)
        self.name(name)
        if attributes:
            self.out += bytes(4)
            for key, value in attributes.items():
                self.out += b"\x06"
                self.name(key)
                self.piece(value)
        if not content:
            self.out += b"\x03"
            return
        self.out += b"\x02"
        for part in content:
            self.element(part) if len(part) == 3 and isinstance(part, tuple) else self.piece(part)
        self.out += b"\x04"

    def record(self, number: int, filetime: int, key: int, tree: Tree, values: list[tuple[int, bytes]]) -> None:
        at = len(self.out)
        self.out += struct.pack("<IIQQ", 0x2A2A, 0, number, filetime) + b"\x0f\x01\x01\x00"
        to = self.templates.get(key)
        self.out += struct.pack("<BBII", 0x0C, 1, key, to or len(self.out) + 10)
        if to is None:
            self.templates[key] = begin = len(self.out)
            self.out += struct.pack("<I16sI", 0, uuid.UUID(int=key).bytes_le, 0) + b"\x0f\x01\x01\x00"
            self.element(tree)
            self.out += b"\0"
            struct.pack_into("<I", self.out, begin + 20, len(self.out) - begin - 24)
        self.out += struct.pack("<I", len(values)) + b"".join(struct.pack("<HBB", len(raw), kind, 0) for kind, raw in values) + b"".join(raw for _, raw in values) + b"\0"
        size = len(self.out) - at + 4
        self.out += struct.pack("<I", size)
        struct.pack_into("<I", self.out, at + 4, size)
        self.numbers.append(number)

    def bytes(self, *, spoiled: bool = False) -> bytes:
        free = len(self.out)
        struct.pack_into("<8sQQQQIII", self.out, 0, b"ElfChnk\0", self.numbers[0], self.numbers[-1], self.numbers[0], self.numbers[-1], 128, free, free)
        struct.pack_into("<I", self.out, 52, zlib.crc32(self.out[event_log.CHUNK_HEAD:free]))
        struct.pack_into("<I", self.out, 124, zlib.crc32(self.out[128:event_log.CHUNK_HEAD], zlib.crc32(self.out[:120])))
        if spoiled:
            self.out[free // 2] ^= 0x55
        return bytes(self.out).ljust(event_log.CHUNK, b"\0")


def file_head(chunks: int) -> bytes:
    return struct.pack("<8sQQQIHHHH", b"ElfFile\0", 0, max(chunks - 1, 0), 0, 128, 1, 3, 4096, chunks).ljust(event_log.FILE_HEAD, b"\0")


def event_tree(body: Tree) -> Tree:
    system = ("System", {}, [("Provider", {"Name": (0, 1)}, []), ("EventID", {}, [(1, 6)]), ("Channel", {}, [(2, 1)]), ("Computer", {}, [(3, 1)])])
    return ("Event", {"xmlns": "http://schemas.microsoft.com/win/2004/08/events/event"}, [system, body])


#: Templates by k mod 3: named data with a name that repeats, unnamed data, user data.
TEMPLATES = {
    1: event_tree(("EventData", {}, [("Data", {"Name": "User"}, [(4, 1)]), ("Data", {"Name": "Code"}, [(5, 0x14)]), ("Data", {"Name": "User"}, [(6, 0x13)]), ("Data", {"Name": "When"}, [(7, 0x11)])])),
    2: event_tree(("EventData", {}, [("Data", {}, [(4, 1)]), ("Data", {}, [(5, 0x0A)]), ("Binary", {}, [(6, 0x0E)])])),
    3: event_tree(("UserData", {}, [("EventXML", {}, [("Account", {}, [(4, 1)]), ("Active", {}, [(5, 0x0D)]), ("Session", {}, ["s-", (6, 8)])])])),
}


def _values(event_id: int, us: int, user_id: int, k: int, event_type: str) -> tuple[int, list[tuple[int, bytes]]]:
    text = lambda s: (1, s.encode("utf-16-le"))
    head = [text(f"Provider-{event_type}"), (6, struct.pack("<H", 1000 + k)), text("Log/" + event_type if k % 4 else ""), text(f"HOST-{user_id % 8}")]
    kind = k % 3 + 1
    if kind == 1:
        sid = bytes([1, 2]) + (5).to_bytes(6, "big") + struct.pack("<II", 21, user_id)
        return kind, [*head, text(f"CORP\\u{user_id}"), (0x14, struct.pack("<I", event_id)), (0x13, sid), (0x11, struct.pack("<Q", us * 10 + FILETIME_EPOCH))]
    if kind == 2:
        return kind, [*head, text(f"é <{event_id}> & more"), (0x0A, struct.pack("<Q", event_id * 10**9)), (0x0E, struct.pack(">H", k))]
    return kind, [*head, text(f"u{user_id}"), (0x0D, struct.pack("<i", k % 2)), (8, struct.pack("<I", event_id))]


#: Events of a chunk; of the chunks one in ten is spoiled; most chunks of a log, which bounds what a task holds.
EVENTS_PER_CHUNK, SPOILED, MOST_CHUNKS = 100, 7, 128


def _log_files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    chunks: list[bytes] = []
    writer, group, first = ChunkWriter(), None, None

    def log() -> pa.RecordBatch:
        """The chunks so far as one log; its last chunk is not counted by the head, and one that holds nothing follows."""
        content = b"".join([file_head(len(chunks) - 1), *chunks, bytes(event_log.CHUNK)])
        chunks.clear()
        return pa.RecordBatch.from_arrays([pa.array([f"log-{first:012d}.evtx"]), pa.array([content], pa.binary())], names=["name", "content"])

    for batch in batches:
        for r in batch.to_pylist():
            if r["event_id"] // EVENTS_PER_CHUNK != group:
                if group is not None:
                    chunks.append(writer.bytes(spoiled=group % 10 == SPOILED))
                if len(chunks) >= MOST_CHUNKS:
                    yield log()
                writer, group = ChunkWriter(), r["event_id"] // EVENTS_PER_CHUNK
                first = first if chunks else group
            kind, values = _values(**r)
            writer.record(r["event_id"], r["us"] * 10 + FILETIME_EPOCH, kind, TEMPLATES[kind], values)
    if group is not None:
        chunks.append(writer.bytes(spoiled=group % 10 == SPOILED))
        yield log()


def write_event_logs(spark: SparkSession, sf_dir: str) -> str:
    """Path of logs that hold each event once, some a partition."""
    path = new_path(spark, "event-logs")
    rows = events(spark, sf_dir).select("event_id", "us", "user_id", "k", "event_type")
    placed = rows.repartitionByRange(F.floor(F.col("event_id") / EVENTS_PER_CHUNK)).sortWithinPartitions("event_id")
    write_bytes(placed.mapInArrow(_log_files, "name string, content binary"), path, name="name")
    return path


def event_log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_log.read_event_logs(spark, write_event_logs(spark, sf_dir), artifact="evtx:Application")
    return rows.select("record_num", "us", "event_id", "channel", "computer", F.array_join(F.transform(F.map_entries("fields"), lambda e: F.concat(e.key, F.lit("="), e.value)), "|").alias("fields"))


QUERIES = {"event_log_scan": event_log_scan}
ORACLE = {
    "event_log_scan": f"""
with {EVENTS_SQL}
select event_id as record_num, us, 1000 + k as event_id, case when k % 4 <> 0 then 'Log/' || event_type else 'Application' end as channel, 'HOST-' || user_id % 8 as computer,
  'Provider=Provider-' || event_type || case k % 3
    when 0 then '|User=CORP\\u' || user_id || '|Code=0x' || lpad(lower(hex(event_id)), 8, '0') || '|User#2=S-1-5-21-' || user_id || '|When=' || strftime(make_timestamp(us), '%Y-%m-%d %H:%M:%S.%f')
    when 1 then '|Data[0]=é <' || event_id || '> & more|Data[1]=' || event_id::hugeint * 1000000000 || '|Binary=' || to_base64(unhex(lpad(hex(k), 4, '0')))
    else '|Account=u' || user_id || '|Active=' || case when k % 2 = 1 then 'True' else 'False' end || '|Session=s-' || event_id end as fields
from ev where event_id // 100 % 10 <> 7"""
}
