"""Operator 13: passages that an earlier document holds, by suffix arrays with bucket-pointer refinement.

Every place of a document from which LENGTH bytes are left is a suffix, and suffixes are
sorted up to that depth. The first buckets are by q-grams: a suffix goes to the bucket of
the q-gram of least hash among those of its first LENGTH bytes, so equal suffixes share a
bucket, and neighbours mostly do too: they travel together, as a run. A bucket that only
one document reaches is settled at once. The others are refined in tasks, a bucket in one
place: suffixes are sorted by the pairs (own bucket pointer, pointer of the suffix some
bytes later), and the pointers so updated are what the next round sorts by, so the depth
goes 8, 16, 32, 50; buckets of one suffix are left alone. A suffix is repeated if its last
bucket holds a smaller document.

Documents lie in packs of some MB, in a table bucketed by pack, so answers join the text
without a shuffle of it. What a pack sends is made unique there first: a passage that all
documents share is one row of each pack. A q-gram of more than HOT runs, whatever
follows it, would make one large bucket: its suffixes are dealt out one by one instead.

Packs tell each other hashes of 128 bits of these runs before any text. A run that a smaller
document has whole is repeated whole, and one whose bucket holds no other run is not at
all; so only different runs of one bucket are sent as text, each by the pack of its
smallest document. The text on the way does not grow with the copies of a passage.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlane.llm.common import drop_table, materialize, shared_dir, shuffle_width, table

#: Bytes of a passage, of the q-grams of the first buckets, and q-grams in a passage.
LENGTH, GRAM = 50, 16
WINDOW = LENGTH - GRAM + 1
#: Most suffixes in a run (bits of a mask), bytes of a pack, bytes worked on at a time, runs of a hot q-gram.
RUN, PACK, SLICE, HOT = 64, 2 << 20, 1 << 17, 4096
#: (offset, depth): a round sorts by pointers at ``offset`` and makes buckets equal to ``depth`` bytes.
ROUNDS = ((8, 16), (16, 32), (18, 50))
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)

_PACK = "pack bigint, docs binary, bounds binary, text binary"


def packs_of(docs: DataFrame) -> DataFrame:
    """Table of packs (pack, docs, bounds, text) of documents (doc, text), bucketed by pack in the shared folder."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0

        def pack():
            bounds = np.cumsum([0, *map(len, texts)], dtype=np.int64)
            row = [[number], [np.array(ids, "<i8").tobytes()], [bounds.tobytes()], [b"".join(texts)]]
            return pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), *(pa.array(c, pa.binary()) for c in row[1:])], names=["pack", "docs", "bounds", "text"])

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1)):
                if held > PACK:
                    yield pack()
                    number, ids, texts, held = number + 1, [], [], 0
                raw = text.as_py() or b""
                ids.append(doc.as_py())
                texts.append(raw)
                held += len(raw) + 16
        if ids:
            yield pack()

    name = f"packs_{uuid.uuid4().hex}"
    at = f"{shared_dir(spark)}/{name}"
    rows = docs.select("doc", F.col("text").cast("binary")).mapInArrow(run, _PACK)
    rows.write.format("parquet").option("compression", "zstd").option("path", at).bucketBy(2 * shuffle_width(spark), "pack").saveAsTable(name)
    out = spark.table(name)
    out._emberlane_at = at
    return out


def _keys(part: np.ndarray) -> np.ndarray:
    """Least hash of the q-grams in each run of LENGTH bytes."""
    with np.errstate(over="ignore"):
        word = np.ndarray(len(part) - 7, "<u8", part, strides=(1,))
        x = word[:-8] * np.uint64(0x9E3779B97F4A7C15)
        x += word[8:] * np.uint64(0xC2B2AE3D27D4EB4F)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
    width = 1
    while 2 * width <= WINDOW:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    rest = WINDOW - width
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def runs_of(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, count, key) of the runs of suffixes with the same least q-gram; documents end at bounds."""
    valid = np.ones(len(data), bool)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        valid[max(a, b - LENGTH + 1):b] = False
    out = []
    for at in range(0, len(data) - LENGTH + 1, SLICE):
        key = _keys(data[at:at + SLICE + LENGTH - 1])
        ok = valid[at:at + len(key)]
        goes_on = np.zeros(len(key), bool)
        goes_on[1:] = (key[1:] == key[:-1]) & ok[1:] & ok[:-1]
        cuts = np.flatnonzero(~goes_on)
        count = np.diff(np.append(cuts, len(key)))
        cuts, count = cuts[ok[cuts]], count[ok[cuts]]
        parts = -(-count // RUN)
        if len(parts) and parts.max() > 1:  # the same q-gram again and again
            nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            count = np.minimum(np.repeat(count, parts) - nth * RUN, RUN)
            cuts = np.repeat(cuts, parts) + nth * RUN
        out.append((cuts + at, count, key[cuts]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(c) for c in zip(*out))


def _hashes(text: bytes, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of 64 bits of each text of ``size`` bytes (8 at least) from ``first``."""
    data = np.frombuffer(text + bytes(8), np.uint8)
    word = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    with np.errstate(over="ignore"):
        a, b = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        for at in range(0, int(size.max(initial=0)), 8):
            x = word[first + np.minimum(at, size - 8)]  # the last bytes again and again in shorter texts
            a = (a ^ x) * np.uint64(0xD6E8FEB86659FD93)
            a ^= a >> np.uint64(29)
            b = (b + x) * np.uint64(0xFF51AFD7ED558CCD)
            b ^= b >> np.uint64(33)
        a, b = a * np.uint64(0xC4CEB9FE1A85EC53), b * np.uint64(0x7FB5D329728EA185)
    return a ^ (a >> np.uint64(32)), b ^ (b >> np.uint64(31))


def _begins(*columns: np.ndarray) -> np.ndarray:
    """Marks of the rows of sorted columns that differ from the one before."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


@dataclass
class Entries:
    """Distinct texts of a pack, in order of their slots: as rows (bucket, fingerprint, text, least doc), or by column."""

    held: bytes
    bucket: np.ndarray
    low: np.ndarray
    first: np.ndarray
    size: np.ndarray
    doc: np.ndarray
    digest: np.ndarray

    def __len__(self) -> int:
        return len(self.bucket)

    def __getitem__(self, i: int | slice):
        if isinstance(i, slice):
            return [self[k] for k in range(*i.indices(len(self)))]
        at = int(self.first[i])
        return int(self.bucket[i]), int(self.low[i]), self.held[at:at + int(self.size[i])], int(self.doc[i])

    def texts(self, which: np.ndarray) -> bytes:
        return b"".join(self.held[a:a + n] for a, n in zip(self.first[which].tolist(), self.size[which].tolist()))


class Pack:
    """A pack with its runs; ``slots`` are the distinct (bucket << 32 | fingerprint) of them."""

    def __init__(self, docs: bytes, bounds: bytes, text: bytes, buckets: int):
        self.docs, self.bounds, self.text, self.buckets = np.frombuffer(docs, "<i8"), np.frombuffer(bounds, "<i8"), text, buckets
        self.first, self.count, key = runs_of(np.frombuffer(text, np.uint8), self.bounds)
        self.doc = self.docs[np.searchsorted(self.bounds, self.first, side="right") - 1]
        slot = (key % np.uint64(buckets) << np.uint64(32)) | (key // np.uint64(buckets) & np.uint64(0xFFFFFFFF))
        self.slots, self.slot = np.unique(slot, return_inverse=True)

    def posts(self) -> tuple[np.ndarray, np.ndarray]:
        """What each slot tells of its runs: the logarithm of their number, and 128 if two documents have some."""
        n = np.bincount(self.slot, minlength=len(self.slots))
        low, high = np.full(len(n), np.iinfo(np.int64).max), np.full(len(n), np.iinfo(np.int64).min)
        np.minimum.at(low, self.slot, self.doc)
        np.maximum.at(high, self.slot, self.doc)
        return np.log2(np.maximum(n, 1)).astype(np.uint8) | np.where(low < high, 128, 0).astype(np.uint8)

    def shared(self, codes: np.ndarray) -> tuple[Entries, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct texts of runs in slots of code 1, and of single suffixes in those of code 2.

        Returns entries in order of their slots, and first, count and entry of each run or suffix.
        """
        code = codes[self.slot]
        one, two = np.flatnonzero(code == 1), np.flatnonzero(code == 2)
        n = self.count[two]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        first = np.concatenate((self.first[one], np.repeat(self.first[two], n) + nth)).astype(np.int64)
        count = np.concatenate((self.count[one], np.ones(len(nth), np.int64))).astype(np.int64)
        doc = np.concatenate((self.doc[one], np.repeat(self.doc[two], n)))
        a, b = _hashes(self.text, first, count + LENGTH - 1)
        slot = (a % np.uint64(self.buckets) << np.uint64(32)) | (b & np.uint64(0xFFFFFFFF))
        slot[:len(one)] = self.slots[self.slot[one]]
        order = np.lexsort((b, a, slot))
        begins = _begins(slot[order], a[order], b[order])
        at, entry = np.flatnonzero(begins), np.empty(len(order), np.int64)
        entry[order] = np.cumsum(begins) - 1
        least = np.minimum.reduceat(doc[order], at) if len(at) else doc
        own = order[at]
        entries = Entries(self.text, (slot[own] >> np.uint64(32)).astype(np.int64), slot[own].astype("<u4"), first[own], count[own] + LENGTH - 1, least, np.stack((a[own], b[own]), axis=1))
        return entries, first, count, entry


def _cut(sorted_buckets: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of the runs of equal values."""
    if not len(sorted_buckets):
        return []
    at = np.flatnonzero(np.append(True, sorted_buckets[1:] != sorted_buckets[:-1]))
    return list(zip(sorted_buckets[at].tolist(), at.tolist(), [*at[1:].tolist(), len(sorted_buckets)]))


def _answered(answers: list | None, kind: str) -> np.ndarray:
    """Answers of all buckets of a pack, in the order of its slots or entries."""
    return np.frombuffer(b"".join(a["answer"] for a in sorted(answers or [], key=lambda a: a["bucket"])), kind)


def _post(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, docs, bounds, text in zip(*(c for c in batch.columns)):
                own = Pack(docs.as_py(), bounds.as_py(), text.as_py(), buckets)
                weight, low = own.posts(), (own.slots & np.uint64(0xFFFFFFFF)).astype("<u4")
                cut = _cut((own.slots >> np.uint64(32)).astype(np.int64))
                columns = [[b for b, _, _ in cut], [pack.as_py()] * len(cut), [low[i:j].tobytes() for _, i, j in cut], [weight[i:j].tobytes() for _, i, j in cut]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "pack", "low", "weight"])

    return run


def _meet(rows: pa.Table) -> pa.Table:
    """For each slot of one bucket: 0 if one document alone has it, else 1, or 2 if it has many runs."""
    lows = [np.frombuffer(x, "<u4") for x in rows["low"].to_pylist()]
    low, weight = np.concatenate(lows), np.frombuffer(b"".join(rows["weight"].to_pylist()), np.uint8)
    values, of = np.unique(low, return_inverse=True)
    n, runs, several = np.bincount(of), np.bincount(of, 2.0 ** (weight & 127)), np.bincount(of, weight >> 7)
    code = np.where((n > 1) | (several > 0), np.where(runs > HOT, 2, 1), 0).astype(np.uint8)[of]
    ends = np.cumsum([len(x) for x in lows])
    answers = [code[e - len(x):e].tobytes() for e, x in zip(ends.tolist(), lows)]
    return pa.table([rows["pack"], rows["bucket"], pa.array(answers, pa.binary())], names=["pack", "bucket", "answer"])


def _tell(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, docs, bounds, text, codes in zip(*(c for c in batch.columns)):
                own, _, _, _ = Pack(docs.as_py(), bounds.as_py(), text.as_py(), buckets).shared(_answered(codes.as_py(), "u1"))
                rows = [(b, pack.as_py(), own.low[i:j].tobytes(), own.digest[i:j].tobytes(), own.doc[i:j].tobytes()) for b, i, j in _cut(own.bucket)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), *[pa.binary()] * 3))], names=["bucket", "pack", "low", "digests", "docs"])

    return run


def _sort_out(rows: pa.Table) -> pa.Table:
    """For each entry of one bucket: 0 if a smaller document has it whole, 1 if its slot has no other text, 2 if it has to be sent."""
    low = np.frombuffer(b"".join(rows["low"].to_pylist()), "<u4")
    a, b = np.frombuffer(b"".join(rows["digests"].to_pylist()), "<u8").reshape(-1, 2).T
    docs = np.frombuffer(b"".join(rows["docs"].to_pylist()), "<i8")
    order = np.lexsort((b, a, low))
    text, slot = _begins(low[order], a[order], b[order]), _begins(low[order])
    least = np.minimum.reduceat(docs[order], np.flatnonzero(text))[np.cumsum(text) - 1]
    several = np.add.reduceat(text.astype(np.int64), np.flatnonzero(slot))[np.cumsum(slot) - 1] > 1
    answer = np.empty(len(order), np.uint8)
    answer[order] = np.where(docs[order] > least, 0, np.where(several, 2, 1))
    ends = np.cumsum([len(x) // 4 for x in rows["low"].to_pylist()]).tolist()
    return pa.table([rows["pack"], rows["bucket"], pa.array([answer[i:j].tobytes() for i, j in zip([0, *ends], ends)], pa.binary())], names=["pack", "bucket", "answer"])


def _send(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack, docs, bounds, text, codes, kinds in zip(*(c for c in batch.columns)):
                own, _, _, _ = Pack(docs.as_py(), bounds.as_py(), text.as_py(), buckets).shared(_answered(codes.as_py(), "u1"))
                sent, rows = np.flatnonzero(_answered(kinds.as_py(), "u1") == 2), []
                for b, i, j in _cut(own.bucket[sent]):
                    part = sent[i:j]
                    rows.append((b, pack.as_py(), own.low[part].tobytes(), own.doc[part].tobytes(), own.size[part].astype("<u4").tobytes(), own.texts(part)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), *[pa.binary()] * 4))], names=["bucket", "pack", "low", "docs", "sizes", "texts"])

    return run


def suffix_classes(texts: list[bytes]) -> np.ndarray:
    """Bucket pointers, at depth LENGTH, of the suffixes of each text that have LENGTH bytes, text after text."""
    data = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    size = np.array([len(t) for t in texts])
    left = np.repeat(np.cumsum(size), size) - np.arange(size.sum())
    word = np.ndarray(len(data) - 8, "<u8", data, strides=(1,))
    pointer, alone = np.full(len(left), -1, np.int64), np.zeros(len(left), bool)
    who = np.flatnonzero(left >= 8)
    order = np.argsort(word[who], kind="stable")
    value = word[who[order]]
    last = np.append(value[1:] != value[:-1], True)
    ends = np.flatnonzero(last)
    size_of = np.diff(np.append(-1, ends))
    pointer[who[order]] = np.repeat(ends, size_of)
    alone[who[order]] = np.repeat(size_of == 1, size_of)
    for offset, depth in ROUNDS:
        who = np.flatnonzero((left >= depth) & ~alone)
        if not len(who):
            continue
        pair = pointer[who] << 32 | pointer[who + offset]
        order = np.argsort(pair, kind="stable")
        who, pair = who[order], pair[order]
        parent = pair >> 32
        ends = np.flatnonzero(np.append(pair[1:] != pair[:-1], True))
        size_of = np.diff(np.append(-1, ends))
        parents = np.flatnonzero(np.append(parent[1:] != parent[:-1], True))
        after = np.repeat(parents, np.diff(np.append(-1, parents))) - np.repeat(ends, size_of)
        pointer[who] = parent - after
        alone[who] = np.repeat(size_of == 1, size_of)
    return pointer[left >= LENGTH]


def _refine(rows: pa.Table) -> pa.Table:
    """For each entry of one bucket: a mask of its suffixes that a smaller document than the entry's has."""
    low = np.frombuffer(b"".join(rows["low"].to_pylist()), "<u4")
    docs = np.frombuffer(b"".join(rows["docs"].to_pylist()), "<i8")
    counts = [len(x) // 4 for x in rows["sizes"].to_pylist()]
    sizes = np.frombuffer(b"".join(rows["sizes"].to_pylist()), "<u4").astype(np.int64)
    joined = b"".join(rows["texts"].to_pylist())
    ends = np.cumsum(sizes)
    of: dict[bytes, int] = {}
    entry = np.array([of.setdefault(joined[e - n:e], len(of)) for e, n in zip(ends.tolist(), sizes.tolist())], np.int64)
    texts = list(of)
    least = np.full(len(texts), np.iinfo(np.int64).max)
    np.minimum.at(least, entry, docs)
    gram = np.zeros(len(texts), np.int64)
    gram[entry] = low
    _, group, members = np.unique(gram, return_inverse=True, return_counts=True)
    several = np.flatnonzero(members[group] > 1)
    mask = np.zeros(len(texts), np.uint64)
    if len(several):
        own = [texts[i] for i in several.tolist()]
        n = np.array([len(t) - LENGTH + 1 for t in own])
        cls, doc = suffix_classes(own), np.repeat(least[several], n)
        order = np.lexsort((doc, cls))
        begins = np.append(True, cls[order][1:] != cls[order][:-1])
        smallest = np.empty(len(doc), np.int64)
        smallest[order] = doc[order][begins][np.cumsum(begins) - 1]
        at = np.cumsum(n) - n
        bit = (smallest < doc).astype(np.uint64) << (np.arange(len(doc)) - np.repeat(at, n)).astype(np.uint64)
        mask[several] = np.bitwise_or.reduceat(bit, at)
    answer = np.where(docs > least[entry], ALL, mask[entry]).astype("<u8")
    stops = np.cumsum(counts)
    return pa.table([rows["pack"], rows["bucket"], pa.array([answer[e - n:e].tobytes() for e, n in zip(stops.tolist(), counts)], pa.binary())], names=["pack", "bucket", "answer"])


def repeated_starts(own: Pack, codes: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Marks of the places of a pack where a passage begins that a smaller document has."""
    entries, first, count, entry = own.shared(codes)
    begins = np.zeros(len(own.text) + 1, np.int32)
    if not len(entries):
        return begins[:-1].astype(bool)
    least = entries.doc[entry]
    mask = np.where(own.docs[np.searchsorted(own.bounds, first, side="right") - 1] > least, ALL, masks[entry])
    whole = mask == ALL
    np.add.at(begins, first[whole], 1)
    np.add.at(begins, first[whole] + count[whole], -1)
    marks = np.cumsum(begins[:-1]) > 0
    part = np.flatnonzero(~whole & (mask != 0))
    for t in range(RUN):
        here = part[(mask[part] >> np.uint64(t)) & np.uint64(1) == 1]
        marks[first[here] + t] = True
    return marks


def _take_out(buckets: int, key: str):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, docs, bounds, text, codes, kinds, answers in zip(*(c for c in batch.columns)):
                own, kind_of = Pack(docs.as_py(), bounds.as_py(), text.as_py(), buckets), _answered(kinds.as_py(), "u1")
                masks = np.where(kind_of == 0, ALL, np.uint64(0))
                masks[kind_of == 2] = _answered(answers.as_py(), "<u8")
                marks = repeated_starts(own, _answered(codes.as_py(), "u1"), masks)
                place = np.arange(len(marks))
                gone = place - np.maximum.accumulate(np.where(marks, place, -LENGTH)) < LENGTH if len(marks) else marks
                data, rows = np.frombuffer(own.text, np.uint8), []
                for doc, a, b in zip(own.docs.tolist(), own.bounds[:-1].tolist(), own.bounds[1:].tolist()):
                    cut = gone[a:b]
                    edges = np.flatnonzero(np.diff(cut, prepend=False, append=False).astype(bool)) if cut.any() else ()
                    spans = [{"start": i, "length": j - i} for i, j in zip(edges[::2].tolist(), edges[1::2].tolist())] if len(edges) else []
                    rows.append((doc, b - a, spans, (data[a:b][~cut] if spans else data[a:b]).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), kind, pa.binary()))], names=[key, "n_bytes", "spans", "kept"])

    return run


def _unshuffled(rows: DataFrame, name: str) -> DataFrame:
    """rows written as a table; the shuffle files behind it go at once, not when the driver collects its garbage."""
    conf, key = rows.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return materialize(rows, name=name)
    finally:
        conf.set(key, before)


def repeated_passages(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Takes out of each text every byte of a passage of LENGTH bytes that a document of smaller key has too.

    Returns (key, n_bytes, spans, kept): bytes of the text, the removed runs as (start,
    length) in bytes, and the remaining bytes. Passages lie within one row. A null text is
    empty; texts below LENGTH bytes are kept whole; rows with the same key are no sources
    for each other, and rows without a key are kept whole and no sources; other columns
    are not returned. A text must fit the memory of a task several times.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text"))
    packs = packs_of(named.where("doc is not null"))
    buckets = 4 * shuffle_width(spark)
    answer = "pack bigint, bucket bigint, answer binary"

    def by_pack(answers: DataFrame, name: str) -> DataFrame:
        rows = answers.groupBy("pack").agg(F.collect_list(F.struct("bucket", "answer")).alias(name))
        return _unshuffled(rows, name).hint("shuffle_hash")

    posts = packs.mapInArrow(_post(buckets), "bucket bigint, pack bigint, low binary, weight binary")
    codes = by_pack(posts.groupBy("bucket").applyInArrow(_meet, answer), "codes")
    told = packs.join(codes, "pack").mapInArrow(_tell(buckets), "bucket bigint, pack bigint, low binary, digests binary, docs binary")
    kinds = by_pack(told.groupBy("bucket").applyInArrow(_sort_out, answer), "kinds")
    sent = packs.join(codes, "pack").join(kinds, "pack").mapInArrow(_send(buckets), "bucket bigint, pack bigint, low binary, docs binary, sizes binary, texts binary")
    masks = by_pack(sent.groupBy("bucket").applyInArrow(_refine, answer), "masks")
    every = packs.join(codes, "pack", "left").join(kinds, "pack", "left").join(masks, "pack", "left")
    kind = f"`{key}` bigint, n_bytes bigint, spans array<struct<start: bigint, length: bigint>>, kept binary"
    out = every.mapInArrow(_take_out(buckets, key), kind)
    whole = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    unnamed = named.where("doc is null").select(F.col("doc").alias(key), F.octet_length(whole).cast("bigint").alias("n_bytes"), F.expr("cast(array() as array<struct<start: bigint, length: bigint>>)").alias("spans"), whole.alias("kept"))
    return out.unionByName(unnamed)


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["length"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op13_suffix_dedup": op13_suffix_dedup}
ORACLE = {
    "op13_suffix_dedup": """
with raw as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
bytes as (select doc_id, unnest(range(0, len(h) // 2)) as p, h from raw),
cut as (select doc_id, p, h[2 * p + 1:2 * p + 2] as byte, case when len(h) >= 2 * (p + 50) then h[2 * p + 1:2 * (p + 50)] end as s from bytes),
least as (select s, min(doc_id) as d from cut where s is not null group by s having count(distinct doc_id) > 1),
marked as (select c.doc_id, c.p, c.byte, max(case when l.d < c.doc_id then c.p end) over (partition by c.doc_id order by c.p) as m from cut c left join least l on l.s = c.s),
gone as (select doc_id, p, byte, coalesce(p - m < 50, false) as g from marked),
edges as (select *, g and not lag(g, 1, false) over (partition by doc_id order by p) as e from gone),
sums as (select doc_id, count(*) filter (g) as n_removed, count(*) filter (e) as n_spans, string_agg(byte, '' order by p) filter (not g) as kept from edges group by doc_id)
select r.doc_id, (len(r.h) // 2)::bigint as n_bytes, coalesce(s.n_removed, 0)::bigint as n_removed, coalesce(s.n_spans, 0)::bigint as n_spans,
  sha256(unhex(coalesce(s.kept, ''))) as kept_sha256
from raw r left join sums s on s.doc_id = r.doc_id"""
}
