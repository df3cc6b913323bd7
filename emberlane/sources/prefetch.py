"""Prefetch files: one record a file, with the compressed container of newer systems.

Python takes the bytes apart; paths, the program's own path and repeated hashes are Columns.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlane.functions.times import FILETIME_EPOCH

#: Places by version and bytes of the information block: run times, their number, run count, bytes of a metric and of a volume (fixed values).
LAYOUTS = {
    (17, 68): (0x24, 1, 0x3C, 20, 40),
    (23, 156): (0x2C, 1, 0x44, 32, 104),
    (26, 224): (0x2C, 8, 0x7C, 32, 104),
    (30, 224): (0x2C, 8, 0x7C, 32, 96),
    (30, 220): (0x2C, 8, 0x7C, 32, 96),
    (30, 216): (0x2C, 8, 0x74, 32, 96),
    (30, 212): (0x2C, 8, 0x74, 32, 96),
    (31, 224): (0x2C, 8, 0x7C, 32, 96),
}
#: Bytes of the head, most bytes of a file, most runs, earliest run (1995), most characters of a program's name (fixed values).
HEAD, MOST_BYTES, MOST_RUNS, EARLIEST, NAME = 84, 64 << 20, 1_000_000, FILETIME_EPOCH + 7_889_184_000_000_000, 29
#: Devices that are volumes in use; copies of them are not (fixed values).
DEVICE = r"(?i)^\\(DEVICE\\HARDDISKVOLUME[0-9]+|VOLUME\{[^}]*\})$"
#: Output of one block, and symbols of its code (fixed values).
BLOCK, SYMBOLS = 65536, 512


class Unreadable(Exception):
    """A file that is no record; the text says why."""


@lru_cache(maxsize=32)
def _code(raw: bytes) -> tuple[memoryview, memoryview]:
    """Symbol and length of a canonical code by the next 15 bits; the code is told by 512 lengths of four bits."""
    halves = np.frombuffer(raw, np.uint8)
    lengths = np.stack((halves & 15, halves >> 4), axis=1).reshape(-1)
    order = np.lexsort((np.arange(SYMBOLS), lengths))
    used = order[lengths[order] > 0]
    spans = 1 << (15 - lengths[used].astype(np.int64))
    if not len(used) or spans.sum() > 1 << 15:
        raise Unreadable("no prefix code")
    symbols = np.full(1 << 15, -1, np.int16)
    symbols[:spans.sum()] = np.repeat(used, spans)
    sizes = np.zeros(1 << 15, np.int16)
    sizes[:spans.sum()] = np.repeat(lengths[used], spans)
    return memoryview(symbols), memoryview(sizes)


def expand(data: bytes, size: int) -> bytes:
    """The ``size`` bytes that LZ77 with Huffman codes holds: blocks with a code of their own, matches that reach into earlier blocks."""
    out, at = bytearray(), 0
    while len(out) < size:
        if at + 260 > len(data):
            raise Unreadable("cut in a code")
        symbols, sizes = _code(data[at:at + 256])
        at += 256
        bits = struct.unpack_from("<H", data, at)[0] << 16 | struct.unpack_from("<H", data, at + 2)[0]
        at, spare = at + 4, 16  # bits hold 32 - (16 - spare) at least; spare counts down to the next word
        end = min(size, len(out) + BLOCK)
        while len(out) < end:
            symbol = symbols[bits >> 17]
            if symbol < 0:
                raise Unreadable("no such code")
            n = sizes[bits >> 17]
            bits = bits << n & 0xFFFFFFFF
            spare -= n
            if spare < 0:
                if at + 1 >= len(data):
                    raise Unreadable("cut")
                bits |= (data[at] | data[at + 1] << 8) << -spare
                at, spare = at + 2, spare + 16
            if symbol < 256:
                out.append(symbol)
                continue
            symbol -= 256
            length, width = symbol & 15, symbol >> 4
            if length == 15:
                if at >= len(data):
                    raise Unreadable("cut in a length")
                length, at = data[at], at + 1
                if length == 255:
                    length, = struct.unpack_from("<H", data.ljust(at + 2, b"\0"), at)
                    at += 2
                    if length == 0:
                        length, = struct.unpack_from("<I", data.ljust(at + 4, b"\0"), at)
                        at += 4
                    length -= 15
                    if length < 0:
                        raise Unreadable("a length that is too short")
                length += 15
            length += 3
            back = (bits >> (32 - width) if width else 0) + (1 << width)
            bits = bits << width & 0xFFFFFFFF
            spare -= width
            if spare < 0:
                if at + 1 >= len(data):
                    raise Unreadable("cut")
                bits |= (data[at] | data[at + 1] << 8) << -spare
                at, spare = at + 2, spare + 16
            if back > len(out):
                raise Unreadable("a match before the start")
            length = min(length, size - len(out))
            if back >= length:
                out += out[len(out) - back:len(out) - back + length]
            else:
                part = bytes(out[-back:])
                out += (part * (length // back + 1))[:length]
    return bytes(out)


def uncompressed(raw: bytes) -> bytes:
    """The bytes of a prefetch file, whether in a container or not."""
    if raw[:3] != b"MAM":
        return raw
    if raw[:4] != b"MAM\x04" or len(raw) < 8:
        raise Unreadable("another container")
    size, = struct.unpack_from("<I", raw, 4)
    if not 0 < size <= MOST_BYTES:
        raise Unreadable(f"a size of {size}")
    return expand(raw[8:], size)


def record_of(raw: bytes) -> tuple:
    """(version, name, path hash, run count, run times, loaded files, volumes, skipped entries); entries that reach beyond the file are skipped and counted."""
    data = uncompressed(raw)
    if len(data) < HEAD + 36 or data[4:8] != b"SCCA":
        raise Unreadable("no prefetch file")
    version, = struct.unpack_from("<I", data)
    name = data[16:76].decode("utf-16-le", "replace").split("\0", 1)[0]
    path_hash, = struct.unpack_from("<I", data, 0x4C)
    metrics, n_metrics, _, _, strings, n_strings, volumes_at, n_volumes, _ = struct.unpack_from("<9I", data, HEAD)
    layout = LAYOUTS.get((version, metrics - HEAD))
    if layout is None:
        raise Unreadable(f"layout {version}/{metrics - HEAD}")
    if len(data) < metrics:
        raise Unreadable("cut in the head")
    times_at, n_times, count_at, metric, volume = layout
    times = [t for t in struct.unpack_from(f"<{n_times}q", data, HEAD + times_at) if t > 0]
    runs, = struct.unpack_from("<I", data, HEAD + count_at)
    if runs > MOST_RUNS:
        raise Unreadable(f"{runs} runs")
    if any(t < EARLIEST for t in times):
        raise Unreadable("a run before 1995")
    loaded, skipped = [], 0
    for i in range(n_metrics):
        at = metrics + i * metric
        if at + metric > len(data):
            skipped += n_metrics - i
            break
        to, n = struct.unpack_from("<II", data, at + (8 if metric == 20 else 12))
        if to + 2 * n > n_strings or strings + to + 2 * n > len(data):
            skipped += 1
            continue
        loaded.append(data[strings + to:strings + to + 2 * n].decode("utf-16-le", "replace").rstrip("\0"))
    volumes = []
    for i in range(n_volumes):
        at = volumes_at + i * volume
        if at + 40 > len(data):
            skipped += n_volumes - i
            break
        to, n, created, serial, _, _, _, folders = struct.unpack_from("<IIqIIIII", data, at)
        if volumes_at + to + 2 * n > len(data):
            skipped += 1
            continue
        path = data[volumes_at + to:volumes_at + to + 2 * n].decode("utf-16-le", "replace").rstrip("\0")
        volumes.append({"device": path, "serial": serial, "created": (created - FILETIME_EPOCH) // 10 if created > 0 else None, "folders": folders})
    return version, name, path_hash, runs, [(t - FILETIME_EPOCH) // 10 for t in times], loaded, volumes, skipped


_SCHEMA = "file string, fault string, version int, name string, path_hash bigint, run_count bigint, run_times array<bigint>, loaded array<string>, volumes array<struct<device: string, serial: bigint, created: bigint, folders: bigint>>, skipped int, compressed boolean"
_VOLUME = pa.struct([("device", pa.string()), ("serial", pa.int64()), ("created", pa.int64()), ("folders", pa.int64())])
_KINDS = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(_VOLUME), pa.int32(), pa.bool_()]


def scanned(files: DataFrame) -> DataFrame:
    """Records of files (path, content), and with ``fault`` set those that are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = content.as_py() or b""
                try:
                    rows.append((path, None, *record_of(raw), raw[:3] == b"MAM"))
                except (Unreadable, struct.error, IndexError) as e:
                    rows.append((path, str(e) or "cut", *[None] * 8, raw[:3] == b"MAM"))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names=[c.split()[0] for c in "file fault version name path_hash run_count run_times loaded volumes skipped compressed".split()])

    return files.select("path", F.col("content").cast("binary")).mapInArrow(run, _SCHEMA)


def resolved(rows: DataFrame, volume: str = "C:") -> DataFrame:
    """Records with paths: if exactly one live volume is named, its device becomes ``volume``.

    path is that of the loaded file with the program's name, or, for a name as long as a
    name can be, of the one .EXE that begins with it; null if it is not exactly one.
    hash_differs tells that the file's name ends in another hash. Of files with one hash in
    one folder the first by name stays.
    """
    live = F.array_distinct(F.transform(F.filter("volumes", lambda v: v.device.rlike(DEVICE)), lambda v: F.upper(v.device)))
    device = F.when(F.size(live) == 1, F.get(live, F.lit(0)))
    drive = lambda p: F.when(F.upper(p).startswith(F.concat("_device", F.lit("\\"))), F.concat(F.lit(volume), F.substring(p, F.length("_device") + 1, F.length(p)))).otherwise(p)
    base = lambda p: F.upper(F.element_at(F.split(p, r"[\\/]"), -1))
    wanted = F.upper("name")
    exact = F.filter("loaded", lambda p: base(p) == wanted)
    begun = F.filter("loaded", lambda p: base(p).startswith(wanted) & base(p).endswith(".EXE"))
    own = F.when(F.size(exact) == 1, F.get(exact, F.lit(0))).when((F.size(exact) == 0) & (F.length("name") >= NAME) & (F.size(begun) == 1), F.get(begun, F.lit(0)))
    told = F.regexp_extract("file", r"-([0-9A-Fa-f]+)\.[^-/]*$", 1)
    made = rows.where("fault is null").withColumn("_device", device).withColumn("path", F.when(own.isNotNull(), drive(own))).withColumn("loaded", F.transform("loaded", drive))
    made = made.withColumn("hash_differs", F.when(told != "", F.conv(told, 16, 10).cast("bigint") != F.col("path_hash")).otherwise(F.lit(False)))
    first = Window.partitionBy(F.regexp_replace("file", "[^/]*$", ""), "path_hash").orderBy("file")
    return made.withColumn("_n", F.row_number().over(first)).where("_n = 1").withColumn("us", F.get("run_times", F.lit(0))).drop("_n", "_device", "fault")


def read_prefetch(spark: SparkSession, path: str, glob: str = "*.pf", *, volume: str = "C:") -> DataFrame:
    """Records of the prefetch files below a folder. Spark's driver lists the files; for very many of them see read_packed."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return resolved(scanned(files), volume)


def read_packed(spark: SparkSession, path: str, *, volume: str = "C:") -> DataFrame:
    """Records of prefetch files that were packed: a Parquet table of (path, content), a row a file.

    Files of a few kilobytes cost far more to list, open and move than to read, so the files of
    many machines are kept in tables; a task reads a stretch of one, and the driver lists only tables.
    """
    return resolved(scanned(spark.read.schema("path string, content binary").parquet(path)), volume)
