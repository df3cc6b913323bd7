"""Binary files read by ranges of bytes, a partition each, and files of bytes written by tasks.

A format says how a range is read: ``scan(read, size, start, end)`` gives the Arrow batches
of what begins in [start, end) of a file, where ``read(at, n)`` gives bytes from any place.
It has to give the same rows however a file is cut. Files are opened by pyarrow.fs in the
task, so paths may be local (also without a scheme), hdfs, s3 or gs.
"""

from __future__ import annotations

import fnmatch
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of a range, unless the option ``split`` says otherwise.
SPLIT = 64 << 20
#: A partition takes short ranges together, up to so many bytes, or more where there would be more than so many partitions.
TOGETHER, PARTITIONS = 2 << 20, 128
Read = Callable[[int, int], bytes]


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the path in it."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


@dataclass
class ByteRange:
    path: str
    start: int
    end: int
    size: int


@dataclass
class ByteRanges(InputPartition):
    """Ranges that one task reads, one after the other."""

    ranges: list[ByteRange]


def bundled(ranges: list[ByteRange], split: int) -> list[ByteRanges]:
    """Neighbouring ranges together, as a task for each of many small files would cost more than reading them; none has more than ``split`` bytes."""
    most = min(split, max(TOGETHER, sum(r.end - r.start for r in ranges) // PARTITIONS))
    out: list[ByteRanges] = []
    held = most
    for r in ranges:
        if held + r.end - r.start > most:
            out.append(ByteRanges([]))
            held = 0
        out[-1].ranges.append(r)
        held += max(r.end - r.start, 1)
    return out


class RangeReader(DataSourceReader):
    def __init__(self, options: dict, scan: Callable[[str, Read, int, int, int], Iterator[pa.RecordBatch]]):
        self.path, self.glob, self.split, self.scan = options["path"], options.get("glob", "*"), int(options.get("split", SPLIT)), scan

    def partitions(self) -> list[ByteRanges]:
        """Ranges of all files below the path, hidden ones left out. An empty file has one range, so that it can be told of."""
        store, at = store_of(self.path)
        info = store.get_file_info(at)
        files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True))
        out = []
        for f in sorted(files, key=lambda f: f.path):
            if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")) and fnmatch.fnmatch(f.base_name, self.glob):
                out += [ByteRange(f.path, a, min(a + self.split, f.size), f.size) for a in range(0, max(f.size, 1), self.split)]
        return bundled(out, self.split) or [ByteRanges([])]

    def read(self, partition: ByteRanges) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(self.path)
        for r in partition.ranges:
            with store.open_input_file(r.path) as file:
                yield from self.scan(r.path, lambda at, n, r=r, file=file: file.read_at(max(0, min(n, r.size - at)), at) if at < r.size else b"", r.size, r.start, r.end)


class RangeSource(DataSource):
    """Base of the formats: ``columns`` is the schema, ``scan`` reads a range."""

    columns = ""

    def schema(self) -> str:
        return self.columns

    def reader(self, schema) -> RangeReader:  # noqa: ARG002
        return RangeReader(dict(self.options), type(self).scan)

    @staticmethod
    def scan(file: str, read: Read, size: int, start: int, end: int) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError


@dataclass
class Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class BytesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, each: bool):
        self.path, self.each, self.run = path, each, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, at = store_of(self.path)
        store.create_dir(at, recursive=True)
        # an attempt has names of its own; only those that commit are given their final ones
        task = TaskContext.get()
        own = f"{at}/_{self.run}-{task.partitionId():05d}-{task.taskAttemptId()}"
        if self.each:
            moves = []
            for batch in batches:
                for name, content in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                    with store.open_output_stream(f"{own}-{len(moves)}") as out:
                        out.write(content.as_py() or b"")
                    moves.append((f"{own}-{len(moves)}", f"{at}/{name}"))
            return Written(moves)
        with store.open_output_stream(own) as out:
            for batch in batches:
                for content in batch.column(0).cast(pa.binary()):
                    out.write(content.as_py() or b"")
        return Written([(own, f"{at}/part-{task.partitionId():05d}-{self.run}.bin")])

    def commit(self, messages: list[Written | None]) -> None:
        store, _ = store_of(self.path)
        for made, final in [x for m in messages if m for x in m.moves]:
            store.move(made, final)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = store_of(self.path)
        for made, _ in [x for m in messages if m for x in m.moves]:
            store.delete_file(made)


class BytesSink(DataSource):
    """Sink ``bytefiles``: the column ``content`` of a partition's rows, one behind the other, in one file, or with ``name`` before it a file of each row."""

    @classmethod
    def name(cls) -> str:
        return "bytefiles"

    def schema(self) -> str:
        return "content binary"

    def writer(self, schema, overwrite: bool) -> BytesWriter:  # noqa: ARG002
        return BytesWriter(self.options["path"], len(schema.fields) == 2)


def write_bytes(rows: DataFrame, path: str, content: str = "content", name: str | None = None) -> None:
    """Writes the bytes of each partition, in the order of its rows, to one file below path, or with ``name`` each row to the file of that name; other files that are there stay."""
    rows.sparkSession.dataSource.register(BytesSink)
    rows.select(*([rows[name].alias("name")] if name else []), rows[content].alias("content")).write.format("bytefiles").mode("append").save(path)


def read_ranges(spark, source: type[RangeSource], path: str, glob: str | None = None, split: int | None = None) -> DataFrame:
    spark.dataSource.register(source)
    reader = spark.read.format(source.name())
    for key, value in (("glob", glob), ("split", split)):
        if value is not None:
            reader = reader.option(key, value)
    return reader.load(path)
