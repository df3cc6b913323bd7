"""Operator 7: packing documents into windows by Karmarkar-Karp multiway differencing.

A document's ids are cut into full windows and a rest shorter than a window. Full
windows are sequences of their own. The rests are gathered, about ``group_pieces`` at
a time inside a partition, and every few of them are cut finely to serve as filling.
Differencing then spreads the pieces over k windows: it starts from one partial
partition per piece and always merges the two with the largest imbalance, the fullest
windows of one with the emptiest of the other. k starts at the least that could hold
the ids and rises whenever the fullest window exceeds the capacity.

A partition packs alone and without a shuffle, so a lost task is packed again from its
own rows; at most one group in each partition is smaller than the rest.

Defined cases: a null text counts as empty and has the end id only; repeated rows are
packed once each; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from emberlane.llm import bpe
from emberlane.llm.common import slices, table


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: the places of ``sizes`` dealt over k windows of near-equal sums.

    A partial partition keeps its windows that hold something, fullest first; the
    others are empty. Its imbalance is the fullest window less the emptiest.
    """
    heap = [(-size if k > 1 else 0, place, [(size, [place])]) for place, size in enumerate(sizes)]
    heapq.heapify(heap)
    tick = len(sizes)
    while len(heap) > 1:
        own, other = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        both = len(own) + len(other) - k  # so many of the emptiest of each meet one of the other's
        if both > 0:
            meet = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(own[-both:], reversed(other[-both:]))]
            own = own[:-both] + meet + other[:-both]
        else:
            own = own + other
        own.sort(key=lambda w: -w[0])
        heapq.heappush(heap, ((own[-1][0] if len(own) == k else 0) - own[0][0], tick, own))
        tick += 1
    return [w[1] for w in heap[0][2]] if heap else []


#: Ids that a window must have to spare on average; with less, differencing hardly ever succeeds.
SPARE = 2


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """As few windows as differencing can fill without exceeding the capacity, tried from the least likely number up."""
    total = sum(sizes)
    k = 1 if total <= capacity else -(-total // (capacity - SPARE))
    while True:
        windows = difference(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in windows):
            return windows
        k += max(1, k // 200)


def _filling(size: int, least: int = 8) -> list[int]:
    """A rest cut into halves of what is left, down to ``least``: pieces that can level windows of any imbalance."""
    out = []
    while size > least:
        half = max(least, size // 3)
        out.append(half)
        size -= half
    return out + [size] * (size > 0)


def packer(vocabulary: str, *, capacity: int = 2048, end_id: int = 1, group_pieces: int = 256, fill_every: int = 10) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task does to pack batches of (key, text)."""
    tail = np.array([end_id], "<u2").tobytes()
    names = ["k", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe.codec(vocabulary)
        sequence = TaskContext.get().partitionId() << 40
        rests: list[tuple] = []
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal rows
            columns = list(zip(*rows)) or [()] * len(names)
            types = [key_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            rows = []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        def level() -> None:
            nonlocal sequence, rests
            pieces = []
            for i, (k, packed, start, total) in enumerate(rests):
                at, size = start, total - start
                for cut in _filling(size) if i % fill_every == 0 else [size]:
                    pieces.append((k, packed, at, cut, total))
                    at += cut
            for window in windows_of([p[3] for p in pieces], capacity):
                offset = 0
                for i in sorted(window):
                    k, packed, at, cut, total = pieces[i]
                    rows.append((k, at, cut, packed[2 * at:2 * (at + cut)], total, sequence, offset))
                    offset += cut
                sequence += 1
            rests = []

        key_type = None
        for batch in batches:
            key_type = batch.column(0).type
            for part in slices(batch, 1, rows=1024, size=1 << 21):
                for k, packed in zip(part.column(0).to_pylist(), own.encode(part.column(1).to_pylist())):
                    packed += tail
                    total = len(packed) // 2
                    for at in range(0, total - capacity + 1, capacity):
                        rows.append((k, at, capacity, packed[2 * at:2 * (at + capacity)], total, sequence, 0))
                        sequence += 1
                    if total % capacity:
                        rests.append((k, packed, total - total % capacity, total))
                    if len(rests) >= group_pieces:
                        level()
                if len(rows) >= 2048:
                    yield flush()
        if rests:
            level()
        if rows:
            yield flush()

    return run


def _schema(df: DataFrame, key: str, ids: str) -> str:
    return f"`{key}` {df.schema[key].dataType.simpleString()}, start bigint, length bigint, {ids}, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(df: DataFrame, vocabulary: str, *, key: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """One row a piece: key, start, length, ids (packed as 16-bit integers), doc_tokens, sequence_id, offset. Options are those of ``packer``."""
    return df.select(key, text).mapInArrow(packer(vocabulary, **options), _schema(df, key, "ids binary"))


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crcs = [zlib.crc32(bpe.ids_of(x).astype("<u4").tobytes()) for x in batch.column(3).to_pylist()]
        columns = [*batch.columns[:3], pa.array(crcs, pa.int64()), *batch.columns[4:]]
        yield pa.RecordBatch.from_arrays(columns, names=["k", "s", "l", "c", "d", "q", "o"])


def digests(pieces: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """The pieces with the crc32 of their ids in place of the ids."""
    return pieces.mapInArrow(_digested, _schema(pieces, key, "ids_crc32 bigint"))


def packed_digests(df: DataFrame, vocabulary: str, *, key: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """``digests`` of ``pack`` in one pass: with two, each core would have two Python workers, which stay and take turns with both passes."""
    run = packer(vocabulary, **options)
    return df.select(key, text).mapInArrow(lambda batches: _digested(run(batches)), _schema(df, key, "ids_crc32 bigint"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digests(table(spark, sf_dir, "documents"), "byte_bpe_50k.json")


QUERIES = {"op7_packing": op7_packing}
ORACLE: dict[str, str] = {}
