"""Operator 6: quality rules with a linear-chain conditional random field over lines.

Each line with a word is a place of the chain and is described by features of its shape:
symbols, capitals, repeated words, word length, line length, closing mark, repeats of an
earlier line. Viterbi decoding marks each line as content or boilerplate, and the share
of the words that lie in content lines decides whether a document is kept. Two base
rules come first: too few words, or too many words in repeated three-word windows.

The field is fitted to a bounded set of documents with a quality label. A line has its
document's label unless its shape is typical of documents of the other one, so a document
has lines of both labels (``label_lines``). Without labelled rows fixed weights serve.

Defined cases: null or empty texts have no words and fail; a text without line breaks
is one line; rows are kept as they come, repeated ones too; a document with several
labels counts as good if one says so; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlane.llm.common import bounded_sample, hash_words, slices, table, window_hashes

#: Base rules: least words, and the percentage of words in repeated windows above which a text fails.
MIN_WORDS, MAX_REPEATED, WINDOW = 50, 50, 3
#: Characters counted as symbols.
SYMBOLS = "#*$%&|<>"
#: Least share of words in content lines.
MIN_CONTENT = 0.5
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LETTERS, _ASCII = _UPPER + _UPPER.lower(), bytes(range(128))
_CLOSED = re.compile(r"[.!?…:;,\"'”’)]\s*\Z")

FEATURES = (
    "bias", "symbols over 1%", "symbols over 4%", "capitals over 30%", "capitals over 70%", "marks over 8%", "digits over 15%",
    "distinct words under 60%", "distinct words under 35%", "same word again over 20%", "average word under 2.5", "average word over 12",
    "fewer than 4 words", "fewer than 10 words", "over 60 words", "ends with a mark", "repeats an earlier line", "no letter", "bar between words", "exclamations over 10% of words",
)


def _tail(line: str) -> str:
    """The last character that is no white space, and what follows it."""
    return line[len(line.rstrip()) - 1:]


def line_features(line: str, repeated: bool) -> np.ndarray:
    raw = line.encode()
    words = raw.split()  # at the six ASCII spaces only
    n, size = len(words), max(1, len(line))
    rest = raw.translate(None, _ASCII).decode()  # characters beyond ASCII
    lowered = rest.lower()
    letters = len(raw) - len(raw.translate(None, _LETTERS)) + sum(map(str.isalpha, rest))
    upper = len(raw) - len(raw.translate(None, _UPPER)) + sum(a != b for a, b in zip(rest, lowered))
    capitals = upper / max(1, letters) if len(lowered) == len(rest) else 0.0
    symbols = sum(map(line.count, SYMBOLS)) / size
    marks = sum(map(line.count, "!?.,;:-_=+~/\\")) / size
    digits = sum(map(line.count, "0123456789")) / size
    distinct = len(set(words)) / n
    again = sum(a == b for a, b in zip(words, words[1:])) / n
    average = (len(line) - sum(map(line.count, " \t\n\x0b\x0c\r"))) / n
    return np.array([
        1, symbols > 0.01, symbols > 0.04, capitals > 0.3, capitals > 0.7, marks > 0.08, digits > 0.15,
        n >= 10 and distinct < 0.6, n >= 10 and distinct < 0.35, again > 0.2, average < 2.5, average > 12,
        n < 4, n < 10, n > 60, bool(_CLOSED.search(_tail(line))), repeated, letters == 0, line.count(" | ") * 4 > n, line.count("!") * 10 > n,
    ], np.float32)


def lines_of(text: str) -> tuple[list[str], list[bool]]:
    """Lines with a word, and whether each equals an earlier one."""
    seen: set[str] = set()
    lines, repeats = [], []
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            lines.append(line)
            repeats.append(line in seen)
            seen.add(line)
    return lines, repeats


@dataclass(frozen=True)
class Field:
    """Weights of the features for content (minus boilerplate), and transition scores [from, to]; 0 boilerplate, 1 content."""

    weights: np.ndarray
    transitions: np.ndarray

    def viterbi(self, features: np.ndarray) -> np.ndarray:
        """The best labels of a chain; content wins ties."""
        score = features @ self.weights
        best = np.array([0.0, score[0]])
        back = np.zeros((len(score), 2), np.int8)
        for i in range(1, len(score)):
            paths = best[:, None] + self.transitions
            from_one = paths[1] >= paths[0]
            back[i] = from_one
            best = np.where(from_one, paths[1], paths[0]) + np.array([0.0, score[i]])
        labels = np.zeros(len(score), np.int8)
        labels[-1] = best[1] >= best[0]
        for i in range(len(score) - 1, 0, -1):
            labels[i - 1] = back[i, labels[i]]
        return labels


#: Serves when no row is labelled: symbols, capitals and repeats speak against content.
DEFAULT = Field(np.array([2, -1, -3, -1, -3, -1, -1, -1.5, -2, -3, -1, -1, -.5, 0, .5, .5, -1, -2, -3, -2], float), np.array([[0.5, -0.5], [-0.5, 0.5]]))


def expectations(x: np.ndarray, mask: np.ndarray, w: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chance of content at each place, chance of each pair of labels at each place but the first) of chains x[chain, place, feature], by forward and backward sums."""
    n, length = mask.shape
    emit = np.stack((np.zeros((n, length)), x @ w), axis=2)
    alpha, beta = np.zeros((n, length, 2)), np.zeros((n, length, 2))
    alpha[:, 0] = emit[:, 0]
    for i in range(1, length):
        moved = np.logaddexp(alpha[:, i - 1, 0, None] + t[0], alpha[:, i - 1, 1, None] + t[1]) + emit[:, i]
        alpha[:, i] = np.where(mask[:, i, None] > 0, moved, alpha[:, i - 1])
    for i in range(length - 2, -1, -1):
        ahead = emit[:, i + 1] + beta[:, i + 1]
        back = np.logaddexp(ahead[:, 0, None] + t[:, 0], ahead[:, 1, None] + t[:, 1])
        beta[:, i] = np.where(mask[:, i + 1, None] > 0, back, 0)
    total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    one = np.exp(alpha[:, :, 1] + beta[:, :, 1] - total[:, None]) * mask
    joint = np.exp(alpha[:, :-1, :, None] + t + (emit[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]) * mask[:, 1:, None, None]
    return one, joint


def fit_chains(chains: list[tuple[np.ndarray, np.ndarray, int]], *, steps: int = 120) -> Field:
    """Maximum likelihood of a conditional random field over (features, a label for each line, number of such chains), by gradient steps on all chains at once."""
    if not chains or len({int(v) for _, y, _ in chains for v in y}) < 2:
        return DEFAULT
    n, length, width = len(chains), max(len(y) for _, y, _ in chains), chains[0][0].shape[1]
    x, y, mask = np.zeros((n, length, width)), np.zeros((n, length), int), np.zeros((n, length))
    for i, (f, labels, _) in enumerate(chains):
        x[i, :len(f)], y[i, :len(f)], mask[i, :len(f)] = f, labels, 1
    count = np.array([c for _, _, c in chains], float)
    w, t = np.zeros(width), np.zeros((2, 2))
    moments = [np.zeros(width + 4), np.zeros(width + 4)]
    gold_w = np.einsum("nlf,nl->f", x, y * mask * count[:, None])
    gold_t = np.zeros((2, 2))
    np.add.at(gold_t, (y[:, :-1], y[:, 1:]), mask[:, 1:] * count[:, None])
    for step in range(1, steps + 1):
        one, joint = expectations(x, mask, w, t)
        gradient = np.concatenate((gold_w - np.einsum("nlf,nl->f", x, one * count[:, None]) - 0.5 * w, (gold_t - np.einsum("nlab,n->ab", joint, count) - 0.5 * t).ravel())) / count.sum()
        moments[0] = 0.9 * moments[0] + 0.1 * gradient
        moments[1] = 0.99 * moments[1] + 0.01 * gradient**2
        move = 0.15 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        w, t = w + move[:width], t + move[width:].reshape(2, 2)
    return Field(w, t)


def label_lines(chains: list[tuple[np.ndarray, int, int]], *, least: int = 20, sure: float = 0.8) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """A label for each line of chains (features, label of the document, number of such chains).

    A line has its document's label unless lines of its shape, ``least`` of them or more,
    stand with a chance of ``sure`` in documents of the other label, both labels counted as
    equally frequent: good documents hold boilerplate and poor ones sentences.
    """
    lines = np.concatenate([f for f, _, _ in chains]).astype(bool)
    of = np.repeat([y for _, y, _ in chains], [len(f) for f, _, _ in chains])
    weight = np.repeat([float(c) for _, _, c in chains], [len(f) for f, _, _ in chains])
    _, shape = np.unique(np.packbits(lines, axis=1), axis=0, return_inverse=True)
    good, poor = (np.bincount(shape.ravel(), weight * (of == y), minlength=shape.max() + 1) for y in (1, 0))
    rate = [(g + 0.5) / max(1.0, g.sum()) for g in (good, poor)]
    typical = (rate[0] / (rate[0] + rate[1]))[shape.ravel()]
    known = (good + poor)[shape.ravel()] >= least
    labels = np.where(known & (typical >= sure), 1, np.where(known & (typical <= 1 - sure), 0, of))
    cuts = np.cumsum([len(f) for f, _, _ in chains])[:-1]
    return [(f, own, c) for (f, _, c), own in zip(chains, np.split(labels, cuts))]


#: Lines to a chain in training; a longer text is trained in stretches, and every line counts.
STRETCH = 32


def fit(labelled: DataFrame, *, text: str = "text", label: str = "quality", most_chains: int = 6_000) -> Field:
    """Fits the field to a bounded set of labelled rows.

    Spark counts the distinct chains of line features; at most ``most_chains`` of them,
    chosen by a hash, reach the driver, a few bytes a line.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, labels = [], []
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines, repeats = lines_of(t or "")
                for i in range(0, len(lines), STRETCH):
                    rows = np.stack([line_features(a, b) for a, b in zip(lines[i:i + STRETCH], repeats[i:i + STRETCH])])
                    out.append(np.packbits(rows.astype(bool), axis=1).tobytes())
                    labels.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(labels, pa.int32())], names=["bits", "y"])

    counted = labelled.select(text, F.col(label).cast("int")).mapInArrow(run, "bits binary, y int").groupBy("bits", "y").agg(F.count("*").alias("n"))
    rows = counted.orderBy(F.xxhash64("bits", "y"), "bits", "y").limit(most_chains).collect()
    if len({r.y for r in rows}) < 2:
        return DEFAULT
    width = -(-len(FEATURES) // 8)
    chains = [(np.unpackbits(np.frombuffer(r.bits, np.uint8).reshape(-1, width), axis=1)[:, :len(FEATURES)].astype(np.float32), r.y, r.n) for r in rows]
    return fit_chains(label_lines(chains))


def measure(df: DataFrame, field: Field, *, text: str = "text", key: str = "doc_id", carry: tuple[str, ...] = (), min_content: float = MIN_CONTENT) -> DataFrame:
    """(key, carried columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept)."""
    columns = df.select(key, *carry, text)

    def content_share(t: str) -> float:
        lines, repeats = lines_of(t)
        if not lines:
            return 0.0
        labels = field.viterbi(np.stack([line_features(a, b) for a, b in zip(lines, repeats)]))
        sizes = np.array([len(line.encode().split()) for line in lines], float)
        return float((sizes * labels).sum() / max(1.0, sizes.sum()))

    def numbers(texts: list[str]) -> Iterator[tuple]:
        raw = [t.encode() for t in texts]
        hashes, owner, _ = hash_words(raw)
        starts = np.searchsorted(owner, np.arange(len(texts) + 1))
        for t, r, a, b in zip(texts, raw, starts[:-1].tolist(), starts[1:].tolist()):
            n = b - a
            windows = window_hashes(hashes[a:b], WINDOW)
            again = 0
            if len(windows):
                _, where, count = np.unique(windows, return_inverse=True, return_counts=True)
                twice = count[where] > 1
                covered = np.zeros(n, bool)
                for shift in range(WINDOW):
                    covered[shift:shift + len(twice)] |= twice
                again = int(covered.sum())
            spaces = sum(map(r.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
            failed = n < MIN_WORDS or 100 * again > MAX_REPEATED * n
            share = content_share(t)
            yield n, len(t) - spaces, sum(map(t.count, SYMBOLS)), sum(lines_of(t)[1]), again, failed, share, not failed and share >= min_content

    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.num_columns - 1, rows=64):
                rows = list(numbers([t or "" for t in part.column(part.num_columns - 1).to_pylist()]))
                made = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=[f"c{i}" for i in range(part.num_columns - 1 + len(made))])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema.fields[:-1])
    return columns.mapInArrow(run, f"{schema}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, content_share double, kept boolean")


def labelled_rows(documents: DataFrame, labels: DataFrame, *, sample_rows: int = 6_000) -> DataFrame:
    """At most about ``sample_rows`` documents with a quality label."""
    own = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    return documents.select("doc_id", "text").join(bounded_sample(own, "doc_id", sample_rows), "doc_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return measure(documents, fit(labelled_rows(documents, table(spark, sf_dir, "labels"))))


QUERIES = {"op6_quality": op6_quality}
ORACLE: dict[str, str] = {}
