"""Operator 4: token ids in files coded by a static range asymmetric numeral system.

One frequency table, counted over all ids of the corpus, is shared by all blocks. A
block holds whole documents and decodes alone: its symbols are dealt over lanes, each a
coder with a 64-bit state, whose 32-bit words interleave in one stream. Checkpoints
hold the states and the stream's place at every so many rows of symbols, so that a
block can be decoded from several places at once; a checksum covers ids and header.

The container is a Parquet table with one row a block, written through Spark: its
commit makes the files whole or absent when executors are lost, and any store will do.

Block bytes (little-endian): magic ``RB01``, lanes u32, rows between checkpoints u32,
symbols u64, documents u32, checkpoints u32, crc32 of the ids as u32 each; then per
document its count u64; per checkpoint the stream's place u64 and the states u64 each;
then the stream as u32 words.

Defined cases: a null text counts as empty and has the end id only; rows with a null
doc_id come first; equal doc_ids are ordered by their ids; an empty table gives no
blocks; other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlane.llm import bpe
from emberlane.llm.common import drop_table, materialize, shared_dir, shuffle_width, table

#: log2 of the sum of all frequencies; lower bound of a state.
SCALE, LOW = 20, np.uint64(1 << 31)
_MAGIC, _HEAD = b"RB01", struct.Struct("<4sIIQIII")


def quantize(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**SCALE; a symbol that occurs gets 1 at least."""
    total, space = int(counts.sum()), 1 << SCALE
    if total == 0:
        return np.zeros(len(counts), np.uint64)
    seen = np.flatnonzero(counts)
    if len(seen) > space:
        raise ValueError("more symbols than frequencies")
    out = np.zeros(len(counts), np.int64)
    out[seen] = np.maximum(1, counts[seen].astype(np.float64) * space / total).astype(np.int64)
    left = space - int(out.sum())
    order = seen[np.argsort(-counts[seen], kind="stable")]
    if left > 0:
        out[order[0]] += left
    while left < 0:  # take from the most frequent, one share each round
        give = np.minimum(out[order] - 1, np.maximum(1, -left // len(order)))
        give[np.cumsum(give) > -left] = 0
        if not give.any():
            give[np.argmax(out[order])] = min(-left, int(out[order].max()) - 1)
        out[order] -= give
        left = space - int(out.sum())
    return out.astype(np.uint64)


class Coder:
    """Encodes and decodes blocks by one frequency table."""

    def __init__(self, frequencies: np.ndarray):
        self.freq = frequencies.astype(np.uint64)
        self.start = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.freq)[:-1].astype(np.uint64)))
        self.symbol = np.repeat(np.arange(len(self.freq)), self.freq.astype(np.int64)).astype(np.uint16)

    def encode(self, ids: np.ndarray, documents: list[int], *, lanes: int = 4096, every: int = 128) -> bytes:
        n = len(ids)
        rows = -(-n // lanes)
        freq, start = self.freq[ids], self.start[ids]
        state = np.full(lanes, LOW, np.uint64)
        words, marks, written = [], [], 0
        for row in range(rows - 1, -1, -1):
            part = slice(row * lanes, min(n, (row + 1) * lanes))
            f, x = freq[part], state[:part.stop - part.start]
            full = x >= f << np.uint64(63 - SCALE)
            if full.any():
                words.append((x[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
                written += len(words[-1])
                x = np.where(full, x >> np.uint64(32), x)
            whole = x // f
            state[:part.stop - part.start] = (whole << np.uint64(SCALE)) + (x - whole * f) + start[part]
            if row % every == 0:
                marks.append((written, state.copy()))
        stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
        head = _HEAD.pack(_MAGIC, lanes, every, n, len(documents), len(marks), zlib.crc32(ids.astype("<u4").tobytes()))
        places = b"".join(struct.pack("<Q", written - at) + s.astype("<u8").tobytes() for at, s in reversed(marks))
        return head + np.array(documents, "<u8").tobytes() + places + stream.tobytes()

    def decode(self, block: bytes, *, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts of the documents). With first and last, only the ids between two checkpoints."""
        magic, lanes, every, n, n_docs, n_marks, crc = _HEAD.unpack_from(block)
        if magic != _MAGIC:
            raise ValueError("not a block")
        at = _HEAD.size
        documents = np.frombuffer(block, "<u8", n_docs, at)
        at += 8 * n_docs
        step = 8 * (lanes + 1)
        stream = np.frombuffer(block, "<u4", offset=at + step * n_marks).astype(np.uint64)
        last = n_marks if last is None else min(last, n_marks)
        out = np.zeros(n, np.uint16)
        if first < last:
            place = struct.unpack_from("<Q", block, at + step * first)[0]
            state = np.frombuffer(block, "<u8", lanes, at + step * first + 8).astype(np.uint64)
            for row in range(first * every, min(last * every, -(-n // lanes))):
                part = slice(row * lanes, min(n, (row + 1) * lanes))
                x = state[:part.stop - part.start]
                slot = x & np.uint64((1 << SCALE) - 1)
                ids = self.symbol[slot.astype(np.int64)]
                out[part] = ids
                x = self.freq[ids] * (x >> np.uint64(SCALE)) + slot - self.start[ids]
                empty = np.flatnonzero(x < LOW)
                if len(empty):
                    x[empty] = (x[empty] << np.uint64(32)) | stream[place:place + len(empty)]
                    place += len(empty)
                state[:part.stop - part.start] = x
        if first == 0 and last == n_marks:
            if zlib.crc32(out.astype("<u4").tobytes()) != crc:
                raise ValueError("checksum of a block is wrong")
            return out, documents
        return out[first * every * lanes:last * every * lanes], documents


def count_ids(tokens: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs: a histogram a partition, summed by id; one number per id reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            packed = batch.column(0).drop_null().cast(pa.large_binary())
            ends = np.frombuffer(packed.buffers()[1], np.int64)[packed.offset:packed.offset + len(packed) + 1] if len(packed) else [0, 0]
            if ends[-1] > ends[0]:  # the values stand one after another
                total += np.bincount(np.frombuffer(packed.buffers()[2], "<u2", (ends[-1] - ends[0]) // 2, int(ends[0])), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    out = np.zeros(size, np.int64)
    for row in tokens.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[row.id] = row.n
    return out


def write(tokens: DataFrame, frequencies: np.ndarray, path: str, *, key: str = "doc_id", end_id: int | None = None, block_tokens: int = 1 << 20) -> None:
    """Writes (key, ids) in ascending order of key as blocks under ``path``.

    The partitions are ranges of the key; a block holds consecutive whole documents,
    ``block_tokens`` ids or a little more.
    """
    spark = tokens.sparkSession
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(frequencies) if f], "id int, frequency long").coalesce(1).write.parquet(f"{path}/frequencies")
    tail = b"" if end_id is None else struct.pack("<H", end_id)
    kind = tokens.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, number, first = Coder(frequencies), TaskContext.get().partitionId(), 0, 0
        keys, parts, size = [], [], 0

        def block() -> pa.RecordBatch:
            ids = bpe.ids_of(b"".join(parts))
            lengths = [len(p) // 2 for p in parts]
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([first], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([keys]), pa.array([coder.encode(ids, lengths)], pa.binary())],
                names=["part", "block", "first", "n_tokens", "keys", "data"],
            )

        for batch in batches:
            for k, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                keys.append(k)
                parts.append((packed or b"") + tail)
                size += len(parts[-1]) // 2
                if size >= block_tokens:
                    yield block()
                    number, first, keys, parts, size = number + 1, first + size, [], [], 0
        if keys:
            yield block()

    ordered = tokens.select(key, "ids").repartitionByRange(shuffle_width(spark), F.col(key).asc_nulls_first()).sortWithinPartitions(F.col(key).asc_nulls_first(), "ids")
    ordered.mapInArrow(run, f"part int, block bigint, first bigint, n_tokens bigint, keys array<{kind}>, data binary").write.parquet(f"{path}/blocks")


def read_frequencies(spark: SparkSession, path: str) -> np.ndarray:
    """The shared table of ``path``: one entry per symbol of the vocabulary, at most 65,536."""
    rows = spark.read.parquet(f"{path}/frequencies").collect()
    out = np.zeros(max((r.id for r in rows), default=-1) + 1, np.uint64)
    for row in rows:
        out[row.id] = row.frequency
    return out


def read(spark: SparkSession, path: str, *, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of each document, decoded from the blocks; start counts the ids of all documents before it."""
    frequencies = read_frequencies(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    kind = blocks.schema["keys"].dataType.elementType.simpleString()
    # one row a partition of the writer, as many as the shuffle has partitions: the ids that came before it
    sizes = sorted(blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before = np.zeros(max((r.part for r in sizes), default=-1) + 1, np.int64)
    total = 0
    for row in sizes:
        before[row.part], total = total, total + row.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(frequencies)
        for batch in batches:
            for part, first, keys, data in zip(*(batch.column(i).to_pylist() for i in range(4))):
                ids, lengths = coder.decode(data)
                ends = np.cumsum(lengths).astype(np.int64)
                begins = ends - lengths.astype(np.int64)
                wide = ids.astype("<u4").tobytes()
                crcs = [zlib.crc32(wide[4 * b:4 * e]) for b, e in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(2).type.value_type), pa.array(begins + first + before[part]), pa.array(lengths.astype(np.int64)), pa.array(crcs, pa.int64())], names=["k", "s", "n", "c"])

    return blocks.select("part", "first", "keys", "data").mapInArrow(run, f"`{key}` {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def op4_rans_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = "byte_bpe_50k.json"
    tokens = materialize(bpe.encode(table(spark, sf_dir, "documents"), vocabulary), name="tokens")
    counts = count_ids(tokens, len(bpe.codec(vocabulary).table))
    counts[0] += tokens.count()
    path = f"{shared_dir(spark)}/rans-{uuid.uuid4().hex}"
    write(tokens, quantize(counts), path, end_id=0)
    drop_table(tokens)
    return read(spark, path)


QUERIES = {"op4_rans_files": op4_rans_files}
ORACLE: dict[str, str] = {}
