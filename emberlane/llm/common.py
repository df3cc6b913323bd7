"""What the operators of this subpackage share: reading, materialising, word hashes."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words: space and the controls from tab to carriage return.
WORD_SPACE = np.zeros(256, bool)
WORD_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset a local session gets a temporary one; a cluster must set it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="emberlane-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def materialize(df: DataFrame, *, name: str = "step") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: no lineage, and it outlives executors."""
    at = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._emberlane_at = at
    return out


def drop_table(df: DataFrame) -> None:
    """Deletes what materialize() wrote, once nothing will read it again."""
    at = getattr(df, "_emberlane_at", None)
    if at:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: A key is hot if it has more than so many rows, and more than this share of the rows.
HOT_ROWS, HOT_SHARE = 1000, 0.001


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """Joins rows with a table that has one row a key and in ``n`` the number of the key's rows, of ``total`` in all.

    Hot keys meet their row by a broadcast, so that no task has to read all rows of one
    key. As their rows are no more than all rows, there are at most 1 / HOT_SHARE of them.
    """
    hot = F.col(n) > max(HOT_ROWS, int(HOT_SHARE * total))
    met = rows.join(F.broadcast(counted.where(hot)), keys, "left")
    return met.where(F.col(n).isNotNull()).unionByName(met.where(F.col(n).isNull()).select(*rows.columns).join(counted.where(~hot), keys))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(column: str, parts: int):
    """crc32 of a key written as text, modulo parts: the fold that decides what is held out."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """About ``rows`` rows at most, chosen by a hash of ``key``, the same ones on every run."""
    n = df.count()
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 60)) < max(1, (1 << 60) * rows // n))


def slices(batch: pa.RecordBatch, column: int, *, rows: int = 128, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most ``rows`` rows and, unless one row has more, ``size`` bytes in a column."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > first and (i - first >= rows or held + n > size):
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += n
    if first < batch.num_rows:
        yield batch.slice(first)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int, base: int, key: str) -> np.ndarray:
    have = _POWERS.get(key)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(have)
        if len(have) <= 1 << 22:
            _POWERS[key] = have
    return have[:n]


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each text, all in one array.

    Returns (hashes, text number of each word, bytes of each word).
    A word is a run of bytes other than WORD_SPACE; equal words have equal hashes.
    """
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    space = WORD_SPACE[data]
    inside = ~space
    start = np.flatnonzero(inside & np.concatenate(([True], space[:-1])))
    end = np.flatnonzero(space & np.concatenate(([False], inside[:-1])))
    if len(start) == 0:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    with np.errstate(over="ignore"):
        # prefix sums of byte * base**place; the place of a word's first byte is divided out
        place = np.arange(len(data), dtype=np.int64) & 0xFFFF
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(1 << 16, _BASE, "up")[place])))
        raw = (sums[end] - sums[start]) * _powers(1 << 16, _INVERSE, "down")[place[start]]
        crossing = np.flatnonzero(place[start] > place[end - 1])
        hashes = _mix(raw ^ (end - start).astype(np.uint64))
    for i in np.concatenate((crossing, np.flatnonzero(end - start >= 0x10000))):
        hashes[i] = np.uint64(_slow_hash(data[start[i]:end[i]].tobytes()))
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.searchsorted(bounds, start, side="right"), end - start


def _slow_hash(word: bytes) -> int:
    """The hash of one word, for those that the windowed sums of hash_words cannot give."""
    data = np.frombuffer(word, np.uint8)
    with np.errstate(over="ignore"):
        powers = np.full(len(data), _BASE, np.uint64)
        powers[0] = 1
        raw = ((data.astype(np.uint64) + np.uint64(1)) * np.cumprod(powers)).sum(dtype=np.uint64)
        return int(_mix(np.array([raw ^ np.uint64(len(data))], np.uint64))[0])


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, by place of the first."""
    n = len(words) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width if n > 0 else 0):
            out = _mix(out * np.uint64(0xD6E8FEB86659FD93) + words[k:k + n] + np.uint64(k + 1))
    return out
