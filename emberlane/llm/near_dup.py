"""Operator 9: near-duplicate documents by an inverted join on signature coordinates.

1. A text becomes its words, the set of hashes of its five-word shingles, and a MinHash
   signature of COORDINATES values. Texts of equal words form one class; only the class
   with its least doc_id goes on, and the others come back by a join at the end.
2. Every signature is posted under each (coordinate, value) pair. Two documents that
   agree in MATCHES coordinates share one of the COORDINATES - MATCHES + 1 rarest pairs
   of either (prefix filter), and pairs that one document holds alone can be skipped.
3. A posting list is merged inside a task: matching coordinates are counted, values that
   one document holds are skipped, and where there are MATCHES or more the documents fall
   into one candidate cluster. A long list is cut into chunks that share its least
   document, and then only its documents that are still in different clusters are
   compared (``tiles.clusters_of``), so the work of a group of copies grows in proportion
   to its size. A chunk gives a spanning forest of its matches, never all its pairs.
4. Within a cluster the full shingle sets are compared, in the same way: the true links
   are those with 100 * intersection >= SIMILAR * union. Their components are the groups.

The chance that 64 coordinates miss a link of similarity 0.75 is about 5 in a million,
and less above; links of lower similarity are never made.

Defined cases: a null text and a text without words have an empty set and no link; a
text with fewer than five words is one shingle; rows with a null doc_id are no link's
end and are kept, with a null component; repeated rows are all returned, as members of
one group; rows that share a doc_id count as one document; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlane.llm.common import drop_table, hash_words, join_counted, materialize, slices, table, window_hashes
from emberlane.llm.tiles import Rows, clusters_of, forest, sides

WORDS, SIMILAR = 5, 75
COORDINATES, MATCHES = 64, 32
#: Documents on one side of a tile, and about how many bytes of shingles.
TILE, TILE_BYTES = 256, 8 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_ODD = _rng.integers(0, 1 << 31, COORDINATES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFT = _rng.integers(0, 1 << 32, COORDINATES, dtype=np.uint64).astype(np.uint32)


def shingle_sets(texts: list[str | None]) -> list[tuple[int, np.ndarray, bytes]]:
    """(number of words, sorted distinct shingle hashes, digest of the word sequence) of each text."""
    raw = [(t or "").encode().lower() for t in texts]
    words, owner, _ = hash_words(raw)
    starts = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
    windows = window_hashes(words, WORDS)
    out = []
    for a, b in zip(starts, starts[1:]):
        own = words[a:b]
        shingles = np.unique(windows[a:b - WORDS + 1] if b - a >= WORDS else window_hashes(own, max(1, b - a)))
        with np.errstate(over="ignore"):  # two sums over (word, place), as a 128-bit digest
            place = np.arange(1, b - a + 1, dtype=np.uint64)
            one = (own * (place * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1))).sum(dtype=np.uint64)
            two = ((own ^ (own >> np.uint64(29))) * (place * np.uint64(0xC2B2AE3D27D4EB4F) | np.uint64(1))).sum(dtype=np.uint64)
        out.append((b - a, shingles, int(one).to_bytes(8, "little") + int(two).to_bytes(8, "little")))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values of one non-empty set."""
    low = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    out = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        h = (low[None, at:at + 2048] ^ _SHIFT[:, None]) * _ODD[:, None]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        np.minimum(out, h.min(axis=1), out=out)
    return out


def digest(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, words, sig): set size, digest of the words (null without words) and signature as bytes."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, sigs = [], [], []
            for part in slices(batch, 1):
                for n, shingles, words in shingle_sets(part.column(1).to_pylist()):
                    sizes.append(len(shingles) if n else 0)
                    digests.append(words if n else None)
                    sigs.append(signature(shingles).tobytes() if n else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(sigs, pa.binary())], names=["k", "n", "w", "s"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_shingles bigint, words binary, sig binary")


def match_tile(docs: np.ndarray, side: np.ndarray, sigs: list[bytes]) -> Rows:
    """A spanning forest of the pairs that agree in MATCHES coordinates or more."""
    one, two = sides(side)
    if not len(one) or not len(two):
        return []
    values = np.frombuffer(b"".join(sigs), "<u2").reshape(len(sigs), COORDINATES)
    left, right = values[one], values[two]
    count = np.zeros((len(one), len(two)), np.uint8)
    ordered = np.sort(values, axis=0)
    for k in np.flatnonzero((ordered[1:] == ordered[:-1]).any(axis=0)):  # a coordinate without a repeated value is skipped
        count += left[:, k, None] == right[None, :, k]
    linked = count >= MATCHES
    linked &= docs[one][:, None] != docs[two][None, :]
    return forest(linked, docs[one], docs[two])


def verify_tile(docs: np.ndarray, side: np.ndarray, sets: list[bytes]) -> Rows:
    """A spanning forest of the pairs whose full shingle sets are similar enough."""
    one, two = sides(side)
    if not len(one) or not len(two):
        return []
    arrays = [np.frombuffer(s, "<u8") for s in sets]
    sizes = np.array([len(x) for x in arrays], np.int64)
    flat = np.concatenate(arrays)
    owner = np.repeat(np.arange(len(arrays)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    fresh = np.concatenate(([True], flat[1:] != flat[:-1]))
    column = np.cumsum(fresh) - 1
    shared = np.bincount(column)[column] > 1  # a hash of one document meets no other
    owner = owner[shared]
    _, column = np.unique(column[shared], return_inverse=True)
    common = np.zeros((len(one), len(two)), np.float32)
    for first in range(0, int(column.max()) + 1 if len(column) else 0, 4096):
        some = (column >= first) & (column < first + 4096)
        width = int(min(4096, column.max() + 1 - first))
        holds = np.zeros((len(arrays), width), np.float32)
        holds[owner[some], column[some] - first] = 1
        common += holds[one] @ holds[two].T
    common = np.rint(common).astype(np.int64)
    linked = 100 * common >= SIMILAR * (sizes[one][:, None] + sizes[two][None, :] - common)
    linked &= docs[one][:, None] != docs[two][None, :]
    return forest(linked, docs[one], docs[two])


def candidate_clusters(reps: DataFrame) -> DataFrame:
    """(v, component): documents of (doc, sig) that matches in the posting lists of their prefixes connect."""

    @F.pandas_udf("array<bigint>")
    def postings(sigs):
        """One hash for each (coordinate, value)."""
        values = np.frombuffer(b"".join(sigs), "<u4").reshape(len(sigs), COORDINATES).astype(np.uint64)
        with np.errstate(over="ignore"):
            x = (values + (np.arange(COORDINATES, dtype=np.uint64) << np.uint64(32)) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(32)
        return pd.Series(list(x.view(np.int64)))

    @F.pandas_udf("binary")
    def short(sigs):
        """The low halves of the values: enough to count matches by."""
        return sigs.map(lambda s: np.frombuffer(s, "<u4").astype("<u2").tobytes())

    posted = materialize(reps.select("doc", F.explode(postings("sig")).alias("e")), name="posted")
    frequent = posted.groupBy("e").agg(F.count("*").alias("n")).where("n > 1")
    held = join_counted(posted, frequent, ["e"], "n", posted.count())
    # pairs that a document holds alone come first in its order and match nothing
    by_doc = Window.partitionBy("doc")
    ranked = held.withColumn("shared", F.count("*").over(by_doc)).withColumn("place", F.row_number().over(by_doc.orderBy("n", "e")))
    prefix = ranked.where((F.col("shared") >= MATCHES) & (F.col("place") + COORDINATES - F.col("shared") <= COORDINATES - MATCHES + 1)).select("doc", "e")
    found = clusters_of(prefix, "e", lambda rows: rows.join(reps.select("doc", short("sig").alias("sig")), "doc"), "sig", match_tile, TILE)
    drop_table(posted)
    return found


def true_clusters(clusters: DataFrame, texts: DataFrame) -> DataFrame:
    """(v, component) of the links within clusters (v, component), confirmed on the full sets of texts (doc, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 5):
                sets = [s.astype("<u8").tobytes() for _, s, _ in shingle_sets(part.column(5).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(sets, pa.binary())], names=["cluster", "doc", "n", "anchor", "per", "shingles"])

    def with_sets(rows: DataFrame) -> DataFrame:
        return rows.join(texts, "doc").select("cluster", "doc", "n", "anchor", "per", "text").mapInArrow(run, "cluster bigint, doc bigint, n bigint, anchor bigint, per bigint, shingles binary")

    sized = texts.select("doc", F.octet_length("text").alias("bytes")).join(clusters.select(F.col("v").alias("doc"), F.col("component").alias("cluster")), "doc")
    return clusters_of(sized, "cluster", with_sets, "shingles", verify_tile, TILE, TILE_BYTES)


def near_duplicates(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id, kept) of each row."""
    docs = docs.select(F.col(key).cast("bigint").alias("doc"), F.col(text).alias("text"))
    digests = materialize(digest(docs, key="doc"), name="digests")
    worded = digests.where("words is not null and doc is not null")
    classes = worded.groupBy("words").agg(F.min("doc").alias("rep"), F.count("*").alias("n"))
    first = worded.join(classes.select("words", F.col("rep").alias("doc")), ["words", "doc"])
    # rows repeated under one id count once
    reps = materialize(first.select("doc", "sig").distinct(), name="reps")
    clusters = candidate_clusters(reps)
    own_text = materialize(docs.join(clusters.select(F.col("v").alias("doc")), "doc", "left_semi").groupBy("doc").agg(F.min("text").alias("text")), name="texts")
    groups = true_clusters(clusters, own_text)
    for done in (reps, clusters, own_text):
        drop_table(done)
    rep_group = classes.join(groups.withColumnRenamed("v", "rep"), "rep", "left").select("words", "n", F.coalesce("component", "rep").alias("component_id"))
    linked = join_counted(worded.select("words", "doc", "n_shingles"), rep_group, ["words"], "n", digests.count()).select("doc", "n_shingles", "component_id")
    alone = digests.where("words is null or doc is null").select("doc", "n_shingles", F.col("doc").alias("component_id"))
    out = linked.unionByName(alone).select(F.col("doc").alias(key), "n_shingles", "component_id")
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op9_minhash_dedup": op9_minhash_dedup}
ORACLE = {
    "op9_minhash_dedup": """
with recursive low as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
words as (select doc_id, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from low),
sets as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) end as s from words),
posts as (select doc_id, hash(unnest(s)) as h from sets),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as n from posts a join posts b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from shared join sets x on x.doc_id = a join sets y on y.doc_id = b where 100 * n >= 75 * (len(x.s) + len(y.s) - n)),
pairs as (select a, b from links union all select b, a from links),
reach as (select distinct doc_id as v, doc_id as r from documents union select b, r from reach join pairs on a = v)
select d.doc_id, len(s.s) as n_shingles, c.component_id, d.doc_id = c.component_id as kept
from documents d join sets s using (doc_id) join (select v, min(r) as component_id from reach group by v) c on c.v = d.doc_id"""
}
