"""Operator 2: toxicity by a weighted finite-state pattern grammar.

Words are read as classes: insult, threat, target, modal, negation, reporting verb and
any other. Small transducers read those classes, from the left and from the right - for
insults told of a target, for negation, for reported speech, for threats announced and
threats with a target - and their composition turns each insult or threat into a weight
that depends on the clause around it; a word alone counts for half. The evidence of a document is the
sum over its matched clauses, and a logistic curve fitted to labelled rows turns it
into a score.

Insult words, and beginnings of words, beyond the seed list are learned from the
labelled sample: one counts when nearly all documents with it are toxic and its
neighbours differ from document to document, so that words of one much-copied document
are not taken for insults.

Defined cases: a null or empty text has no evidence and gets the score of no evidence;
without labelled rows a fixed curve serves; rows are kept as they come, repeated ones
too; a document with several labels is toxic if one says so; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlane.llm.common import bounded_sample, fold, table

INSULT, THREAT, TARGET, MODAL, NEGATION, REPORT, OTHER = "insult", "threat", "target", "modal", "negation", "report", "other"

#: Seed lexicon: class and weight of a word.
SEED: dict[str, tuple[str, float]] = {
    **dict.fromkeys(
        "idiot idiots moron morons imbecile cretin dumbass asshole bastard bitch scum vermin subhuman scumbag dickhead retard retarded".split(), (INSULT, 1.2)
    ),
    **dict.fromkeys("stupid loser losers worthless pathetic disgusting trash garbage clown clowns filth coward fool pig pigs freak ugly dumb".split(), (INSULT, 1.0)),
    **dict.fromkeys("idiota imbécil estúpido estúpida gilipollas basura connard salaud crétin imbécile abruti ordure dummkopf arschloch abschaum trottel".split(), (INSULT, 1.0)),
    **dict.fromkeys("kill hurt beat destroy murder stab shoot strangle punch burn hang rape".split(), (THREAT, 1.0)),
    **dict.fromkeys("you your you're youre u ur yourself they them their he him she her these those".split(), (TARGET, 1.0)),
    **dict.fromkeys("will gonna shall going should must i'll we'll".split(), (MODAL, 1.0)),
    **dict.fromkeys("not never no isn't aren't wasn't weren't don't doesn't didn't hardly neither nor".split(), (NEGATION, 1.0)),
    **dict.fromkeys("said says say wrote writes called calls quoted reported reports claimed claims alleged described denied".split(), (REPORT, 1.0)),
}
#: How soon further evidence adds nothing: it counts as 1 - exp(-SATURATION * evidence).
SATURATION = 1.5
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
#: A colon goes on with the clause, as in "he said: ...".
_CLAUSE_END = re.compile(r"[.!?;\n]")


@dataclass(frozen=True)
class Transducer:
    """States are 0..n-1. step[(state, class)] is the next state, by default step[(state, OTHER)]; gain[(state, class)] is a factor, by default 1."""

    step: dict[tuple[int, str], int]
    gain: dict[tuple[int, str], float]

    def next(self, state: int, kind: str) -> int:
        return self.step.get((state, kind), self.step.get((state, OTHER), state))

    def factor(self, state: int, kind: str) -> float:
        return self.gain.get((state, kind), 1.0)


#: An insult is told of somebody: a target named before in the clause raises it, and alone it counts for half.
AIMED = Transducer({(0, TARGET): 1}, {(0, INSULT): 0.5, (1, INSULT): 1.5, (1, THREAT): 1.2})
#: A negation holds for the next three words.
NEGATED = Transducer({(0, NEGATION): 3, (1, OTHER): 0, (2, OTHER): 1, (3, OTHER): 2, **{(s, NEGATION): 3 for s in (1, 2, 3)}}, {(s, k): 0.2 for s in (1, 2, 3) for k in (INSULT, THREAT)})
#: A reporting verb holds for the rest of the clause, or for what stands before it.
REPORTED = Transducer({(0, REPORT): 1}, {(1, INSULT): 0.3, (1, THREAT): 0.3})
#: A threat counts when it is announced: a modal within two words before it; otherwise it is a plain verb.
ANNOUNCED = Transducer({(0, MODAL): 2, (1, OTHER): 0, (2, OTHER): 1, (1, MODAL): 2, (2, MODAL): 2}, {(0, THREAT): 0.0, (1, THREAT): 1.5, (2, THREAT): 1.5})
#: From the right: an insult that a target follows is told of it.
CALLED = Transducer({(0, TARGET): 1}, {(1, INSULT): 1.3})
#: From the right: a threat counts in full if a target is the next word, as in "will hurt you".
HIT = Transducer({(0, TARGET): 1, (1, TARGET): 1, (1, OTHER): 0}, {(0, THREAT): 0.1})
#: The composed grammar: machines that read a clause from the left, and machines that read it from the right.
GRAMMAR, GRAMMAR_BACK = (AIMED, NEGATED, REPORTED, ANNOUNCED), (REPORTED, CALLED, HIT)


def _gains(machines: tuple[Transducer, ...], kinds: list[str]) -> list[float]:
    """The factor of each word under the product machine, whose states are tuples of states."""
    states, out = [0] * len(machines), []
    for kind in kinds:
        gain = 1.0
        if kind in (INSULT, THREAT):
            for machine, state in zip(machines, states):
                gain *= machine.factor(state, kind)
        out.append(gain)
        states = [m.next(s, kind) for m, s in zip(machines, states)]
    return out


def clause_weight(kinds: list[str], weights: list[float]) -> float:
    """Runs the composed grammar over one clause in both directions."""
    left, right = _gains(GRAMMAR, kinds), _gains(GRAMMAR_BACK, kinds[::-1])[::-1]
    return sum(w * a * b for kind, w, a, b in zip(kinds, weights, left, right) if kind in (INSULT, THREAT))


class Scorer:
    """Finds the clauses that hold an insult or a threat and weighs them."""

    def __init__(self, lexicon: dict[str, tuple[str, float]]):
        import ahocorasick

        self.lexicon = lexicon
        self.find = ahocorasick.Automaton()
        for word, (kind, _) in lexicon.items():
            if kind in (INSULT, THREAT):
                self.find.add_word(word.rstrip("*"), (len(word.rstrip("*")), word[-1] == "*"))
        self.find.make_automaton()

    def clauses(self, text: str) -> list[tuple[int, int]]:
        """Spans of the lower-case text's clauses in which a trigger stands as a whole word or begins one."""
        out, done = [], -1
        for last, (size, stem) in self.find.iter(text):
            first = last + 1 - size
            if first < done or first and text[first - 1].isalpha() or not stem and text[last + 1:last + 2].isalpha():
                continue
            begin = self._back(text, first)
            end = _CLAUSE_END.search(text, last)
            done = end.start() if end else len(text)
            out.append((begin, done))
        return out

    @staticmethod
    def _back(text: str, at: int) -> int:
        """Where the clause of ``at`` begins, looking back in growing steps."""
        low, width = at, 256
        while low > 0:
            low, high = max(0, at - width), low
            found = max(text.rfind(c, low, high) for c in ".!?;\n")
            if found >= 0:
                return found + 1
            width *= 4
        return 0

    def evidence(self, text: str | None) -> float:
        text = (text or "").lower()
        total = 0.0
        for begin, end in self.clauses(text):
            entries = [next((self.lexicon[k] for k in keys_of(w) if k in self.lexicon), (OTHER, 0.0)) for w in _WORD.findall(text, begin, end)]
            total += clause_weight([e[0] for e in entries], [e[1] for e in entries])
        return total


#: Characters of the beginnings that are learned; a key that ends with * is a beginning.
STEMS = (4, 5)


def keys_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


def learn_words(labelled: DataFrame, *, text: str = "text", label: str = "toxic", documents: int = 5, purity: float = 0.9) -> list[str]:
    """Words and beginnings that nearly only toxic documents hold, with other neighbours in at least half of them.

    Neighbours are hashed into 64 places, so 24 different ones are enough in any case.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = {}

        def flush() -> pa.RecordBatch:
            masks = np.array([v[2] for v in found.values()], np.uint64).view(np.int64)
            out = pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([v[0] for v in found.values()], pa.int64()), pa.array([v[1] for v in found.values()], pa.int64()), pa.array(masks)], names=["word", "toxic", "clean", "mask"])
            found.clear()
            return out

        for batch in batches:
            for t, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = _WORD.findall((t or "").lower())
                for key in {k for w in set(words) for k in keys_of(w)}:
                    found.setdefault(key, [0, 0, 0])[0 if toxic else 1] += 1
                if toxic:
                    for before, w, after in zip(["", *words], words, [*words[1:], ""]):
                        bit = 1 << zlib.crc32(f"{before} {after}".encode()) % 64
                        for key in keys_of(w):
                            found[key][2] |= bit
                if len(found) > 100_000:  # partial counts: they are summed by word below
                    yield flush()
        yield flush()

    words = labelled.select(text, F.col(label).cast("int")).mapInArrow(run, "word string, toxic bigint, clean bigint, mask bigint").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.expr("bit_count(bit_or(mask))").alias("neighbours"))
    pure = words.where((F.col("toxic") >= documents) & (F.col("toxic") >= purity * (F.col("toxic") + F.col("clean"))) & (F.col("neighbours") >= F.least(F.lit(24), F.greatest(F.lit(documents), F.col("toxic") / 2))) & (F.length("word") >= 3))
    return sorted(r.word for r in pure.select("word").collect())  # few words of a bounded sample


def with_evidence(df: DataFrame, lexicon: dict[str, tuple[str, float]], *, text: str = "text") -> DataFrame:
    """Adds ``evidence``, the summed weight of the matched clauses of the whole text."""

    @F.pandas_udf("double")
    def evidence(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Scorer(lexicon)
        for texts in batches:
            yield texts.map(own.evidence)

    return df.withColumn("evidence", evidence(F.coalesce(F.col(text), F.lit(""))))


def fit_curve(points: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Logistic intercept and slope over (evidence, toxic rows, clean rows), by Newton's steps with a light ridge."""
    if not points or not sum(p[1] for p in points) or not sum(p[2] for p in points):
        return -3.0, 5.0
    x = 1 - np.exp(-SATURATION * np.array([p[0] for p in points]))
    n1, n0 = np.array([p[1] for p in points], float), np.array([p[2] for p in points], float)
    design, w = np.stack((np.ones_like(x), x), axis=1), np.array([-3.0, 5.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        gradient = design.T @ (n1 - (n1 + n0) * p) - np.array([0.0, 0.05]) * w
        hessian = (design * ((n1 + n0) * p * (1 - p))[:, None]).T @ design + np.diag([1e-6, 0.05])
        step = np.linalg.solve(hessian, gradient)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(max(w[1], 0.0))


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, tuple[str, float]]
    intercept: float
    slope: float


def fit(labelled: DataFrame, *, text: str = "text", label: str = "toxic") -> Model:
    """Learns insult words and the curve from a bounded set of labelled rows."""
    lexicon = SEED | {w: (INSULT, 1.0) for w in learn_words(labelled, text=text, label=label) if w not in SEED}
    bins = with_evidence(labelled, lexicon, text=text).groupBy(F.round(F.least("evidence", F.lit(5.0)), 1).alias("x")).agg(F.count_if(F.col(label) == 1).alias("n1"), F.count_if(F.col(label) == 0).alias("n0"))
    return Model(lexicon, *fit_curve(sorted((r.x, r.n1, r.n0) for r in bins.collect())))  # 51 bins at most


def score(df: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """Adds evidence, score and predicted."""
    odds = F.lit(model.intercept) + F.lit(model.slope) * (1 - F.exp(-SATURATION * F.col("evidence")))
    scored = with_evidence(df, model.lexicon, text=text).withColumn("score", 1 / (1 + F.exp(-odds)))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def labelled_rows(documents: DataFrame, labels: DataFrame, *, sample_rows: int = 16_000) -> DataFrame:
    """At most about ``sample_rows`` labelled documents outside the held-out fold."""
    own = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = bounded_sample(own.where(fold("doc_id", 5) != 0), "doc_id", sample_rows)
    return documents.select("doc_id", "text").join(known, "doc_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit(labelled_rows(documents, table(spark, sf_dir, "labels")))
    rows = documents.select("doc_id", "text", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"))
    return score(rows, model).select("doc_id", "held_out", "score", "predicted")


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLE: dict[str, str] = {}
