"""Operator 1: language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point. An n-gram's
vector binds the vectors of its letters, permuted by place, by multiplication. A
document's vector bundles those of all its n-grams by addition, and the language whose
prototype has the largest cosine with it is predicted. A prototype bundles the unit
vectors of the documents of its language.

A batch counts its distinct n-grams by document, binds each n-gram once and bundles by
one matrix product. Words are padded by one space; case is folded.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; ties go
to the language first in the alphabet; without any labelled row all are ``und``; rows
are kept as they come, repeated ones too; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlane.llm.common import bounded_sample, fold, table

#: Components of a vector; letters of an n-gram; sharpness of scores.
DIMENSIONS, LETTERS, SHARPNESS = 1024, 3, 24.0
_SPACE_POINT = 32
#: 1 for a letter, by code point; filled as code points are met.
_KIND = np.zeros(0x110000, np.uint8)
_SEEN = np.zeros(0x110000, bool)
_VECTORS: dict[int, np.ndarray] = {}


def letter_vector(point: int) -> np.ndarray:
    """The random vector of a letter: the same on every worker."""
    if point not in _VECTORS:
        if len(_VECTORS) > 20_000:
            _VECTORS.clear()
        bits = np.random.Generator(np.random.PCG64(point + 1)).integers(0, 2, DIMENSIONS, dtype=np.int8)
        _VECTORS[point] = bits * np.int8(2) - np.int8(1)
    return _VECTORS[point]


def bind(points: np.ndarray) -> np.ndarray:
    """Vectors of n-grams, one a row of code points: the letter at place i is rotated i times."""
    letters, where = np.unique(points, return_inverse=True)
    base = np.stack([letter_vector(int(p)) for p in letters])
    where = where.reshape(points.shape)
    out = base[where[:, 0]]
    for place in range(1, points.shape[1]):
        out = out * np.roll(base, place, axis=1)[where[:, place]]
    return out


def _letters_of(text: str) -> np.ndarray:
    """Code points of the lower-case text; a run of anything but letters is one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    fresh = points[~_SEEN[points]]
    for p in set(fresh.tolist()):
        _KIND[p] = chr(p).isalpha()
        _SEEN[p] = True
    letter = _KIND[points].astype(bool)
    if not letter.any():
        return points[:0]
    keep = letter | np.concatenate(([False], letter[:-1]))
    out = np.where(letter, points, _SPACE_POINT)[keep]
    head = [] if out[0] == _SPACE_POINT else [_SPACE_POINT]
    tail = [] if out[-1] == _SPACE_POINT else [_SPACE_POINT]
    return np.concatenate((head, out, tail)).astype(np.int64)


def bundle(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors of the texts, which of them have a letter)."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    has = np.zeros(len(texts), bool)
    for at in range(0, len(texts), 128):
        parts = [_letters_of(t or "") for t in texts[at:at + 128]]
        own = [i for i, p in enumerate(parts) if len(p)]
        if not own:
            continue
        for i in own:
            has[at + i] = True
        flat = np.concatenate([parts[i] for i in own])
        owner = np.repeat(np.arange(len(own)), [len(parts[i]) for i in own])
        letters, dense = np.unique(flat, return_inverse=True)
        a = len(letters)
        n = len(flat) - LETTERS + 1
        same = owner[:n] == owner[LETTERS - 1:] if n > 0 else np.zeros(0, bool)
        code = np.zeros(max(n, 0), np.int64)
        for place in range(LETTERS if n > 0 else 0):
            code = code * a + dense[place:place + n]
        code, owner = code[same], owner[:n][same]
        if a**LETTERS <= 1 << 22:
            used = np.flatnonzero(np.bincount(code, minlength=1))
            column = np.zeros(a**LETTERS, np.int64)
            column[used] = np.arange(len(used))
            column = column[code]
        else:
            used, column = np.unique(code, return_inverse=True)
        digits = np.stack([letters[used // a**(LETTERS - 1 - place) % a] for place in range(LETTERS)], axis=1)
        for first in range(0, len(used), 8192):  # in slices, so that a batch of many scripts stays small
            some = (column >= first) & (column < first + 8192)
            width = min(8192, len(used) - first)
            counts = np.bincount(owner[some] * width + column[some] - first, minlength=len(own) * width).reshape(len(own), width)
            out[[at + i for i in own]] += counts.astype(np.float32) @ bind(digits[first:first + width]).astype(np.float32)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1), has


def learn(rows: DataFrame, *, text: str = "text", label: str = "lang") -> dict[str, np.ndarray]:
    """Prototypes by language. Each task bundles its own rows; one vector a language and task is summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            vectors, has = bundle(batch.column(0).to_pylist())
            labels = np.array(batch.column(1).to_pylist(), object)
            for one in set(labels[has].tolist()):
                sums[one] = sums.get(one, 0) + vectors[has & (labels == one)].astype(np.float64).sum(axis=0)
        names = sorted(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array([n for n in names for _ in range(DIMENSIONS)], pa.string()), pa.array(list(range(DIMENSIONS)) * len(names), pa.int32()), pa.array(np.concatenate([sums[n] for n in names]) if names else np.zeros(0))],
            names=["lang", "place", "value"],
        )

    found = rows.where(F.col(label).isNotNull()).select(text, label).mapInArrow(run, "lang string, place int, value double").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    out: dict[str, np.ndarray] = {}
    for row in found.collect():  # languages times DIMENSIONS numbers
        out.setdefault(row.lang, np.zeros(DIMENSIONS))[row.place] = round(row.value, 6)
    return {lang: v / (np.linalg.norm(v) or 1) for lang, v in sorted(out.items())}


def predict(df: DataFrame, prototypes: dict[str, np.ndarray], *, text: str = "text", key: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, carried columns, lang_pred, score): the nearest prototype and the softmax of its cosine among all."""
    langs = list(prototypes)
    profile = np.stack(list(prototypes.values()), axis=1).astype(np.float32) if langs else None
    kept = df.select(key, *carry, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors, has = bundle(batch.column(batch.num_columns - 1).to_pylist())
            names, scores = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            if langs:
                cosine = vectors @ profile
                best = cosine.argmax(axis=1)
                weight = np.exp(SHARPNESS * (cosine - cosine.max(axis=1, keepdims=True)))
                scores = np.where(has, 1 / weight.sum(axis=1), 0.0)
                names = [langs[b] if h else "und" for b, h in zip(best.tolist(), has.tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores.astype(np.float64))], names=[f"c{i}" for i in range(batch.num_columns + 1)])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{schema}, lang_pred string, score double")


def op1_language(spark: SparkSession, sf_dir: str, *, sample_rows: int = 20_000) -> DataFrame:
    """Prototypes come from at most about ``sample_rows`` rows outside the held-out fold; every row is predicted."""
    documents = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)))
    known = documents.where(~F.col("held_out") & F.col("lang").isNotNull())
    return predict(documents, learn(bounded_sample(known, "doc_id", sample_rows)), carry=("held_out",))


QUERIES = {"op1_language": op1_language}
ORACLE: dict[str, str] = {}
