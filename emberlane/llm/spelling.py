"""Operator 12: spelling variants of words, by a permuterm index.

A word w is marked by a terminator and all its rotations w[i:] $ w[:i] are sorted. Take a
code point c out of x c y: the rotation that starts behind it is y $ x c, and y $ x is the
prefix range that skips c. The range holds y $ x d for each word x d y that replaces c, and
y $ x itself, a rotation of the word x y that lacks it. So near words are those whose
rotations lie in one prefix range with at most one further code point, and a scan of the
sorted rotations meets all of them. A range holds one word for each code point and the one
without it: at most 91 words, however many there are.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlane.llm.common import materialize, shuffle_width, table

#: Least code points of a word, least occurrences, how much commoner a form is, one run in so many is altered.
LEAST, OCCURRENCES, TIMES, ALTERED = 7, 2, 10, 31
TERMINATOR = "$"
#: Distinct words that a task holds before it hands their counts on.
HELD = 200_000
_RUN = re.compile("[A-Za-zÀ-ÿ]{%d,}" % LEAST)


def altered(run: str, seed: int) -> str:
    """The run, or in one of ALTERED cases the run without one code point; ``seed`` is the crc32 of what stands before it."""
    h = zlib.crc32(run.encode(), seed)
    if h % ALTERED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(word, n) of the words of at least LEAST code points that occur OCCURRENCES times in all texts; a null text has no words, a null key counts as an empty one."""

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for name, raw in zip(batch.column(0), batch.column(1)):
                raw = raw.as_py()
                if raw is None:
                    continue
                seed = zlib.crc32(f"{name.as_py() or ''}:".encode())
                # bytes.lower() changes A to Z alone
                for word, n in Counter(_RUN.findall(raw.lower().decode())).items():
                    word = altered(word, seed)
                    if len(word) >= LEAST:
                        held[word] += n
                if len(held) > HELD:
                    yield rows(held)
                    held = Counter()
        if held:
            yield rows(held)

    found = docs.select(F.col(key).cast("string"), F.col(text).cast("binary")).mapInArrow(run, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURRENCES)


def rotations(words: DataFrame) -> DataFrame:
    """(rotation, n): all rotations of each word with its terminator."""
    turned = F.transform(F.sequence(F.lit(0), F.char_length("word")), lambda i: F.concat(F.substring("word", i + 1, F.char_length("word")), F.lit(TERMINATOR), F.substring("word", F.lit(1), i)))
    return words.select(F.explode(turned).alias("rotation"), "n")


def word_of(rotation: str) -> str:
    tail, _, head = rotation.partition(TERMINATOR)
    return head + tail


def range_members(longer: list[tuple[str, int]], shorter: tuple[str, int] | None) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words, occurrences of the commonest, that word) of the words of one prefix range.

    longer: rotations with one code point behind the prefix; shorter: the one that is the
    prefix. Taking out any of several equal code points in a row gives the same word, so
    that pair counts only where the code point differs from the one before it.
    """
    words = [(-n, word_of(r), r[-1] != r[-2]) for r, n in longer]
    order = sorted(words)
    short = (-shorter[1], word_of(shorter[0])) if shorter else None
    for n, word, first in words:
        near = len(words) - 1
        best = next(((m, w) for m, w, _ in order if w != word), None)
        if short and first:
            near += 1
            best = min(best, short) if best else short
        if best:
            yield word, near, -best[0], best[1]
    if short:
        own = [(m, w) for m, w, first in order if first]
        if own:
            yield short[1], len(own), -own[0][0], own[0][1]


def scan(rows: Iterator[tuple[str, int]]) -> Iterator[tuple[str, int, int, str]]:
    """Near words of each prefix range of sorted rotations; the ranges that are open are prefixes of each other."""
    open_: list[list] = []  # prefix, longer, shorter
    for rotation, n in rows:
        while open_ and not rotation.startswith(open_[-1][0]):
            _, longer, shorter = open_.pop()
            if len(longer) + (shorter is not None) > 1:
                yield from range_members(longer, shorter)
        if rotation[-1] != TERMINATOR:
            if open_ and len(open_[-1][0]) == len(rotation) - 1:
                open_[-1][1].append((rotation, n))
            else:
                open_.append([rotation[:-1], [(rotation, n)], None])
        open_.append([rotation, [], (rotation, n)])
    for _, longer, shorter in open_:
        if len(longer) + (shorter is not None) > 1:
            yield from range_members(longer, shorter)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words with a near word; best is the commonest one, of equal ones the smallest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = scan(pair for batch in batches for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        out: list[tuple] = []
        for row in found:
            out.append(row)
            if len(out) == 20_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    # a prefix range starts with LEAST code points or more, so it never lies on both sides of a border
    placed = rotations(words).repartitionByRange(shuffle_width(words.sparkSession), F.substring("rotation", 1, LEAST)).sortWithinPartitions("rotation")
    pairs = placed.mapInArrow(run, "word string, near bigint, best_n bigint, best string")
    of = pairs.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("least"), "best")).alias("b"))
    return of.select("word", "n_near", (-F.col("b.least")).alias("best_n"), F.col("b.best").alias("best"))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "near", "best_n", "best"])


def roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, root): where the forms (word, form) lead. A form is TIMES as common as its word and none occurs over ``most`` times, which bounds the steps; each join doubles them."""
    steps = max(1, math.ceil(math.log(max(most, 2), TIMES)))
    now = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        now = now.join(now.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return now


def spelling_variants(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of ``word_counts``.

    form is the commonest word that differs by exactly one inserted, deleted or replaced
    code point (of equally common ones the smallest), if it occurs TIMES as often, else
    null with form_n; root is where forms lead, the word itself without one; n_near is the
    number of near words. Repeated rows count as often as they stand; without words there
    are no rows.
    """
    words = materialize(word_counts(docs, text=text, key=key), name="words")
    near = materialize(near_words(words), name="near-words")
    formed = F.col("best_n") >= TIMES * F.col("n")
    all_ = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n"))
    all_ = materialize(all_, name="forms")
    most = all_.agg(F.max("n")).first()[0] or 1
    led = roots(materialize(all_.where("form is not null").select("word", "form"), name="led"), most)
    return all_.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {"op12_spelling_variants": op12_spelling_variants}
ORACLE = {
    "op12_spelling_variants": """
with recursive crc as (select list(v order by i) as t from (
  select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: xor(c >> 1, (c & 1) * 3988292384)) as v from range(256) r(i))),
runs as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) as run from documents),
own as (select doc_id, run, count(*) as k from runs where len(run) >= 7 group by 1, 2),
hashed as (select run, k, xor(4294967295, list_reduce([4294967295::bigint] || flatten(list_transform(string_split(doc_id || ':' || run, ''),
  lambda c: case when ord(c) < 128 then [ord(c)::bigint] else [192 + (ord(c) >> 6)::bigint, 128 + (ord(c) & 63)::bigint] end)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) as h from own, crc),
results as (select k, case when h % 31 = 0 then run[:(h % len(run))] || run[(h % len(run)) + 2:] else run end as word from hashed),
words as (select word, sum(k)::bigint as n from results where len(word) >= 7 group by word having sum(k) >= 2),
places as (select word, n, unnest(range(1, len(word) + 1)) as i from words),
keys as (select word, n, i, word[:i - 1] || '$' || word[i + 1:] as k, word[:i - 1] || word[i + 1:] as d from places),
pairs as (select a.word, b.word as w, b.n from keys a join keys b on a.k = b.k and a.word <> b.word
  union select a.word, b.word, b.n from keys a join words b on a.d = b.word
  union select b.word, a.word, a.n from keys a join words b on a.d = b.word),
near as (select word, count(*) as n_near, max(n) as best_n from pairs group by word),
best as (select p.word, min(w) as best from pairs p join near using (word) where p.n = best_n group by p.word),
forms as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when best_n >= 10 * w.n then best end as form, case when best_n >= 10 * w.n then best_n end as form_n
  from words w left join near using (word) left join best using (word)),
led as (select word, word as at, form as next from forms union all select l.word, f.word, f.form from led l join forms f on f.word = l.next)
select f.word, form, l.at as root, n, n_near, form_n from forms f join led l on l.word = f.word and l.next is null"""
}
