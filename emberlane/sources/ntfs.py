"""Change journals and master file tables, read by ranges of bytes.

Records of a journal have no fixed size, so where a range's first record begins depends on
what stands before. A record is 4,096 bytes long at most, so a reader that has come to the
bytes before a range stands at one of 512 places; all of them are followed until they run
together, as readers of damaged data do within a few records. If they don't before the
range begins, the reader starts twice as far back, at last at the head of the file. Rows
are therefore those of one pass from the head, however the file is cut.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlane.functions.text import bit_names
from emberlane.functions.times import filetime_micros
from emberlane.sources.ranges import RangeSource, Read, read_ranges

#: Names of the bits of a change record's reason and source, lowest first (fixed values).
REASONS = [
    "data_overwrite", "data_extend", "data_truncation", None, "named_data_overwrite", "named_data_extend", "named_data_truncation", None, "file_create", "file_delete", "ea_change", "security_change",
    "rename_old_name", "rename_new_name", "indexable_change", "basic_info_change", "hard_link_change", "compression_change", "encryption_change", "object_id_change", "reparse_point_change", "stream_change",
]
SOURCES = ["data_management", "auxiliary_data", "replication_management"]
#: Bytes of a record's head by version, greatest record, step, attributes that tell a folder (fixed values).
HEADS, GREATEST, STEP, FOLDER = {2: 60, 3: 76}, 4096, 8, 0x10000010
#: Bytes that are read before a range, bytes read at a time, and rows of a batch.
BEFORE, PIECE, ROWS = 1 << 16, 4 << 20, 20_000
_LOW48 = (1 << 48) - 1

RECORD, ZERO, UNREADABLE, UNSUPPORTED, END = range(5)


def step(data: bytes, at: int) -> tuple[int, int]:
    """What stands at a place of the data, which are read up to the file's end or well beyond it: (kind, bytes)."""
    left = len(data) - at
    if left < STEP:
        return END, 0
    length, major = struct.unpack_from("<IH", data, at)
    if length == 0:
        return ZERO, STEP
    if length < STEP or length > GREATEST or length % STEP or major not in (2, 3, 4):
        return UNREADABLE, STEP
    if major == 4:
        return UNSUPPORTED, length
    head = HEADS[major]
    if length < head:
        return UNREADABLE, STEP
    if left < length:
        return END, 0
    if major == 3 and (data[at + 16:at + 24] != bytes(8) or data[at + 32:at + 40] != bytes(8)):
        return UNSUPPORTED, length
    size, name = struct.unpack_from("<HH", data, at + head - 4)
    if size % 2 or name < head or name + size > length:
        return UNREADABLE, STEP
    return RECORD, length


def first_place(read: Read, start: int) -> int:
    """Where the reader that began at the head of the file stands when it first comes to ``start`` or beyond; -1 if it ended before."""
    back = BEFORE
    while True:
        base = max(0, start - start % STEP - back)
        data = read(base, start - base + 2 * GREATEST)
        # nothing is known of the places but that they are multiples of the step
        places = {0} if base == 0 else set(range(0, GREATEST, STEP))
        ended = False
        while places and min(places) < start - base:
            at = min(places)
            places.discard(at)
            kind, size = step(data, at)
            if kind == END:
                ended = True
            elif kind == ZERO:
                places.add(_after_zeros(data, at, start - base))
            else:
                places.add(at + size)
        if base == 0 and ended:
            return -1
        if len(places) == 1 and not ended:
            return base + places.pop()
        back *= 2


def _after_zeros(data: bytes, at: int, limit: int) -> int:
    """The next place whose eight bytes are not all zero, or the first at the limit or beyond."""
    width, first = 1024, at
    while at < limit:
        words = np.frombuffer(data, "<u8", min(width, (len(data) - at) // STEP), at)
        some = np.flatnonzero(words)
        if len(some):
            found = at + STEP * int(some[0])
            return found if found > first else first + STEP
        if len(words) < width:
            return at + STEP * max(1, len(words))
        at += STEP * width
        width = min(2 * width, 1 << 17)
    return at


def looks_like_file_table(head: bytes) -> bool:
    """Whether file records follow each other at a fixed distance where change records should stand."""
    at = min((i for i in (head.find(b"FILE"), head.find(b"BAAD")) if i >= 0), default=-1)
    return 0 <= at < 4096 and any(head[at + n:at + n + 4] in (b"FILE", b"BAAD") and head[at + 2 * n:at + 2 * n + 4] in (b"FILE", b"BAAD") for n in (1024, 2048, 4096))


def name_of(raw: bytes) -> tuple[str, str | None]:
    """Text of UTF-16 bytes; where a surrogate stands alone U+FFFD takes its place and the bytes come as hex digits too."""
    try:
        return raw.decode("utf-16-le"), None
    except UnicodeDecodeError:
        return raw.decode("utf-16-le", "replace"), raw.hex()


_COLUMNS = "file string, gap string, offset bigint, length bigint, version int, file_entry bigint, file_sequence bigint, parent_entry bigint, parent_sequence bigint, usn bigint, filetime bigint, mask bigint, source_mask bigint, attributes bigint, name string, name_raw string"
_KINDS = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 9, pa.string(), pa.string()]
_NAMES = [c.split()[0] for c in _COLUMNS.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names=_NAMES)


def _record(file: str, data: bytes, at: int, offset: int) -> tuple:
    length, major = struct.unpack_from("<IH", data, at)
    wide = 8 if major == 2 else 16
    own, = struct.unpack_from("<Q", data, at + 8)
    parent, = struct.unpack_from("<Q", data, at + 8 + wide)
    usn, filetime, reason, source, _, attributes, size, name = struct.unpack_from("<qqIIIIHH", data, at + 8 + 2 * wide)
    text, raw = name_of(data[at + name:at + name + size])
    return file, None, offset, length, major, own & _LOW48, own >> 48, parent & _LOW48, parent >> 48, usn, filetime, reason, source, attributes, text, raw


class JournalSource(RangeSource):
    """Change records, and with ``gap`` set the stretches without one: unreadable, unsupported, empty, file_table, tail."""

    columns = _COLUMNS

    @classmethod
    def name(cls) -> str:
        return "change_journal"

    @staticmethod
    def scan(file: str, read: Read, size: int, start: int, end: int) -> Iterator[pa.RecordBatch]:
        def gap(kind: str, at: int, length: int) -> tuple:
            return (file, kind, at, length, *[None] * 12)

        if size == 0:
            yield _batch([gap("empty", 0, 0)])
            return
        if looks_like_file_table(read(0, 4 * GREATEST)):
            if start == 0:
                yield _batch([gap("file_table", 0, size)])
            return
        at = first_place(read, start) if start else 0
        rows: list[tuple] = []
        bad = -1  # where an unreadable stretch began
        while 0 <= at < end:
            base, limit = at, min(at + PIECE, end)
            data = read(base, limit - base + 2 * GREATEST)
            while at < limit:
                kind, n = step(data, at - base)
                if kind == UNREADABLE:
                    bad = at if bad < 0 else bad
                    at += n
                    continue
                if bad >= 0:
                    rows.append(gap("unreadable", bad, at - bad))
                    bad = -1
                if kind == RECORD:
                    rows.append(_record(file, data, at - base, at))
                elif kind == ZERO:
                    n = _after_zeros(data, at - base, limit - base) - (at - base)
                elif kind == UNSUPPORTED:
                    rows.append(gap("unsupported", at, n))
                else:
                    rows.append(gap("tail", at, size - at))
                    at = -1
                    break
                at += n
                if len(rows) >= ROWS:
                    yield _batch(rows)
                    rows = []
        if bad >= 0:
            rows.append(gap("unreadable", bad, at - bad))
        if rows:
            yield _batch(rows)


def read_journal(spark: SparkSession, path: str, glob: str | None = None, *, split: int | None = None) -> DataFrame:
    """Change records of the journals below a path, by ranges of ``split`` bytes.

    A record's usn is its number. A name with a lone surrogate has its bytes in name_raw.
    Times are null where the record has none. Files that are no journal have no records.
    """
    raw = read_ranges(spark, JournalSource, path, glob, split).where("gap is null")
    reasons = F.concat(bit_names(F.col("mask"), REASONS), F.when(F.shiftright("mask", 31).bitwiseAND(F.lit(1)) == 1, F.array(F.lit("close"))).otherwise(F.array().cast("array<string>")))
    folder = F.col("attributes").bitwiseAND(F.lit(FOLDER)) != 0
    made = {"us": filetime_micros(F.col("filetime")), "reason": reasons, "source": bit_names(F.col("source_mask"), SOURCES), "is_directory": folder, "ref": F.concat(F.lit("USN#"), F.col("usn"))}
    return raw.withColumns(made).drop("gap", "length", "filetime", "mask", "source_mask", "attributes")


def journal_gaps(spark: SparkSession, path: str, glob: str | None = None, *, split: int | None = None) -> DataFrame:
    """(file, gap, offset, length): what is not a change record, neighbouring unreadable stretches as one, whatever the split; zeros are no gap.

    Kinds: unreadable; unsupported (a version without a name, or ids of another file
    system; one row a record); tail (a record that the file's end cuts); empty and
    file_table (a file that is no journal).
    """
    raw = read_ranges(spark, JournalSource, path, glob, split).where("gap is not null").select("file", "gap", "offset", "length")
    order = Window.partitionBy("file", "gap").orderBy("offset")
    begins = F.coalesce((F.col("gap") != "unreadable") | (F.col("offset") > F.lag(F.col("offset") + F.col("length")).over(order)), F.lit(True))
    runs = raw.withColumn("begins", begins).withColumn("run", F.count_if("begins").over(order))
    return runs.groupBy("file", "gap", "run").agg(F.min("offset").alias("offset"), F.sum("length").alias("length")).drop("run")


#: Sizes that a file record may have; the first record says which, else it is the default (fixed values).
SLOTS, SLOT = (512, 1024, 2048, 4096), 1024
_TABLE = "file string, offset bigint, fault string, record_num bigint, allocated boolean, is_directory boolean, size bigint, name string, parent bigint, " + ", ".join(f"{k}_{t} bigint" for k in ("si", "fn") for t in ("btime", "mtime", "ctime", "atime"))
_TABLE_NAMES = [c.split()[0] for c in _TABLE.split(", ")]
_TABLE_KINDS = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.string(), *[pa.int64()] * 9]


def restored(slot: bytearray) -> bytes | None:
    """A record with its sector ends put back from the update sequence, whose length tells the size of a sector; null where they do not match."""
    at, count = struct.unpack_from("<HH", slot, 4)
    if count < 2 or at + 2 * count > len(slot) or len(slot) % (count - 1):
        return None
    sector = len(slot) // (count - 1)
    mark = slot[at:at + 2]
    for i in range(1, count):
        if slot[sector * i - 2:sector * i] != mark:
            return None
        slot[sector * i - 2:sector * i] = slot[at + 2 * i:at + 2 * i + 2]
    return bytes(slot)


def _file_record(file: str, offset: int, number: int, record: bytes) -> tuple:
    """Row of a restored record; of its names the longest counts, of its unnamed data the size, else the size beside the name."""
    own, = struct.unpack_from("<I", record, 0x2C)
    first, flags = struct.unpack_from("<HH", record, 20)
    si, fn, name, parent, size, named = [None] * 4, [None] * 4, None, None, None, 0
    while first + 16 <= len(record):
        kind, length, away, name_size = struct.unpack_from("<IIBB", record, first)
        if kind == 0xFFFFFFFF or length < 16 or first + length > len(record):
            break
        if not away and length >= 24:
            n, at = struct.unpack_from("<IH", record, first + 16)
            body = record[first + at:first + at + n]
            if kind == 0x10 and len(body) >= 32:
                si = list(struct.unpack_from("<4q", body))
            elif kind == 0x30 and len(body) >= 66 and len(body) >= 66 + 2 * body[64]:
                text = body[66:66 + 2 * body[64]].decode("utf-16-le", "replace")
                if name is None or len(text) > len(name):
                    name, parent = text, int.from_bytes(body[:6], "little")
                    fn, named = list(struct.unpack_from("<4q", body, 8)), struct.unpack_from("<q", body, 48)[0]
            elif kind == 0x80 and not name_size and size is None:
                size = n
        elif away and kind == 0x80 and not name_size and size is None and length >= 56:
            size = struct.unpack_from("<q", record, first + 48)[0]
        first += length
    return file, offset, None, own or number, bool(flags & 1), bool(flags & 2), named if size is None else size, name, parent, *si, *fn


class FileTableSource(RangeSource):
    """File records, and with ``fault`` set those that cannot be restored."""

    columns = _TABLE

    @classmethod
    def name(cls) -> str:
        return "file_table"

    @staticmethod
    def scan(file: str, read: Read, size: int, start: int, end: int) -> Iterator[pa.RecordBatch]:
        head = read(0, 48)
        slot = struct.unpack_from("<I", head, 28)[0] if len(head) == 48 and head[:4] in (b"FILE", b"BAAD") else SLOT
        slot = slot if slot in SLOTS else SLOT
        rows: list[tuple] = []
        at = -(-start // slot) * slot
        while at < end and at + slot <= size:
            data = read(at, max(PIECE // slot, 1) * slot)
            for i in range(0, len(data) - slot + 1, slot):
                if at + i >= end:
                    break
                if data[i:i + 4] in (b"FILE", b"BAAD"):
                    record = restored(bytearray(data[i:i + slot]))
                    number = (at + i) // slot
                    rows.append(_file_record(file, at + i, number, record) if record else (file, at + i, "update_sequence", number, *[None] * 13))
                if len(rows) >= ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _TABLE_KINDS)], names=_TABLE_NAMES)
                    rows = []
            at += len(data) - len(data) % slot
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _TABLE_KINDS)], names=_TABLE_NAMES)


_TIMES = [f"{k}_{t}" for k in ("si", "fn") for t in ("btime", "mtime", "ctime", "atime")]


def read_file_table(spark: SparkSession, path: str, glob: str | None = None, *, split: int | None = None) -> DataFrame:
    """File records that have a name, with their times in microseconds; paths come from operators.joins.parent_chain."""
    return read_ranges(spark, FileTableSource, path, glob, split).where("fault is null and name is not null").drop("fault").withColumns({t: filetime_micros(F.col(t)) for t in _TIMES})


def file_table_faults(spark: SparkSession, path: str, glob: str | None = None, *, split: int | None = None) -> DataFrame:
    """(file, offset, fault) of the records whose sector ends do not match their update sequence."""
    return read_ranges(spark, FileTableSource, path, glob, split).where("fault is not null").select("file", "offset", "fault")


def volume_path(path: Column, volume: str = "C:") -> Column:
    """A chain of names as a path of the volume."""
    return F.concat_ws("\\", F.lit(volume), F.translate(path, "/", "\\"))
