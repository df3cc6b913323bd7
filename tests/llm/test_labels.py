"""Operators 1, 2 and 6: language, toxicity, quality."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from emberlane.llm import language, quality, toxicity
from tests.llm.tests_support import texts_of


def test_op1_held_out_accuracy(spark, sf_dir):
    rows = language.op1_language(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_op1_bundles_by_hand():
    vectors, has = language.bundle(["ab", "", None, "12"])
    assert has.tolist() == [True, False, False, False]
    grams = [" ab", "ab "]
    by_hand = np.zeros(language.DIMENSIONS)
    for g in grams:
        bound = np.ones(language.DIMENSIONS)
        for place, c in enumerate(g):
            bound *= np.roll(language.letter_vector(ord(c)), place)
        by_hand += bound
    assert np.allclose(vectors[0], by_hand / np.linalg.norm(by_hand), atol=1e-6)


def test_op1_odd_rows(odd_docs, no_docs):
    known = odd_docs.where("text = 'a' or length(text) > 100")
    prototypes = language.learn(known)
    rows = {r.doc_id: r for r in language.predict(odd_docs, prototypes).collect()}
    assert rows[0].lang_pred == rows[1].lang_pred == rows[2].lang_pred == "und" and rows[0].score == 0
    assert language.predict(odd_docs, {}).where("lang_pred <> 'und'").count() == 0
    assert language.learn(no_docs) == {}
    assert language.predict(no_docs, prototypes).count() == 0


def test_grammar_weighs_clauses():
    s = toxicity.Scorer(toxicity.SEED)
    plain, aimed, negated, reported = (s.evidence(t) for t in ("what an idiot.", "you are an idiot.", "you are not an idiot.", "he said you are an idiot."))
    assert negated < reported < plain < aimed
    assert s.evidence("i will hurt you") > 1 > s.evidence("the hurt will heal") == 0.0
    assert s.evidence("Fine. No idiots here; idiotic? idiot") == s.evidence("Fine. no idiots here") + s.evidence("idiot")
    assert s.evidence(None) == s.evidence("") == s.evidence("a nice day") == 0


def test_reported_speech_and_lone_words():
    s = toxicity.Scorer(toxicity.SEED)
    said = s.evidence("you are an idiot")
    assert s.evidence("He said: you are an idiot.") < 0.5 * said and s.evidence("You are an idiot, he said.") < 0.5 * said
    assert s.evidence("the idiot board") < 0.5 * said
    assert s.evidence("they will hurt things") < 0.2 * s.evidence("they will hurt you")


def test_clauses_equal_a_walk_by_hand():
    """The product machine in both directions against the factors read off the words one by one."""
    kinds = [toxicity.INSULT, toxicity.THREAT, toxicity.TARGET, toxicity.MODAL, toxicity.NEGATION, toxicity.REPORT, toxicity.OTHER]
    rnd = random.Random(12)
    for _ in range(300):
        clause = rnd.choices(kinds, k=rnd.randint(1, 9))
        total = 0.0
        for i, kind in enumerate(clause):
            if kind not in (toxicity.INSULT, toxicity.THREAT):
                continue
            before, after, insult = clause[:i], clause[i + 1:], kind == toxicity.INSULT
            w = 1.0
            w *= (1.5 if insult else 1.2) if toxicity.TARGET in before else (0.5 if insult else 1.0)
            w *= 0.2 if toxicity.NEGATION in before[-3:] else 1.0
            for side in (before, after):
                w *= 0.3 if toxicity.REPORT in side else 1.0
            if insult:
                w *= 1.3 if toxicity.TARGET in after else 1.0
            else:
                w *= 1.5 if toxicity.MODAL in before[-2:] else 0.0
                w *= 1.0 if after[:1] == [toxicity.TARGET] else 0.1
            total += w
        assert abs(toxicity.clause_weight(clause, [1.0] * len(clause)) - total) < 1e-9


def test_op2_held_out(spark, sf_dir):
    rows = toxicity.op2_toxicity(spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    assert len(rows) == len(texts_of(spark, sf_dir))


def test_op2_catches_labelled_documents(spark):
    sf = "/root/testdata/sf0.1"
    rows = toxicity.op2_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic = [r for r in rows if r.toxic]
    clean = [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in toxic) > 0.8 * len(toxic)
    assert sum(r.predicted for r in clean) < 0.03 * len(clean)


def test_op2_odd_rows(spark, odd_docs, no_docs):
    model = toxicity.fit(no_docs.withColumn("toxic", F.lit(1)))
    assert toxicity.score(odd_docs.drop("score"), model).count() == odd_docs.count()
    assert toxicity.score(no_docs.drop("score"), model).count() == 0
    rows = toxicity.score(spark.createDataFrame([(1, "you idiot, you moron"), (2, None)], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [r.predicted for r in rows] == [1, 0]


def base_by_hand(text):
    space = " \t\n\x0b\x0c\r"
    words, now = [], ""
    for c in text + " ":
        if c in space:
            if now:
                words.append(now)
            now = ""
        else:
            now += c
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    covered = {i + d for i, w in enumerate(windows) if many[w] > 1 for d in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(space):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_op6_base(spark, sf_dir, odd_docs, no_docs):
    want = texts_of(spark, sf_dir)
    for r in quality.op6_quality(spark, sf_dir).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_by_hand(want[r.doc_id])
        assert not (r.base_failed and r.kept)
    odd = quality.measure(odd_docs, quality.DEFAULT).join(odd_docs.select("doc_id", "text").distinct(), "doc_id").collect()
    assert all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_by_hand(r.text or "") for r in odd)
    assert quality.measure(no_docs, quality.DEFAULT).count() == 0


def test_op6_lines_of_unicode_space(spark):
    """A line of white space other than the six ASCII ones has a word."""
    texts = ["\xa0", "one\n\u3000\ntwo", "\x85\n\x1c\x1d\x1e\x1f", "good words here\n" * 30 + "\xa0 \u2003"]
    df = spark.createDataFrame([(i, t, i % 2) for i, t in enumerate(texts)], "doc_id long, text string, quality int")
    field = quality.fit(df)
    for r in quality.measure(df, field).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_by_hand(texts[r.doc_id])
    few = quality.FEATURES.index("fewer than 4 words")
    assert quality.line_features("a\xa0b c d", False)[few] and not quality.line_features("a b c d", False)[few]


def test_op6_letters_of_long_lines():
    """Letters and capitals are counted over the whole line, whatever its length and period."""
    shouting, none = (quality.FEATURES.index(f) for f in ("capitals over 70%", "no letter"))
    for line in ("A 1234567 ", "1234567 A ", "1234567 É "):
        for times in (1, 39, 40, 79, 80, 400, 4001):
            bits = quality.line_features(line * times, False)
            assert bits[shouting] and not bits[none]
    rnd = np.random.default_rng(8)
    for size in (5, 399, 800, 5000):
        line = "".join(rnd.choice(list("aAbB1 .éÉßΣ漢٣🙂"), size))
        share = sum(c != c.lower() for c in line) / max(1, sum(map(str.isalpha, line)))
        bits = quality.line_features(line + "x", False)
        assert bits[shouting] == (share > 0.7) and not bits[none]


def test_op6_keeps_good_documents(spark, sf_dir):
    rows = quality.op6_quality(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("not base_failed").collect()
    good = [r for r in rows if r.quality == 1]
    assert sum(r.kept for r in good) >= 0.97 * len(good)
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in bad) <= 0.3 * len(bad)


def test_viterbi_equals_all_paths():
    rnd = np.random.default_rng(3)
    for _ in range(20):
        field = quality.Field(rnd.normal(size=4), rnd.normal(size=(2, 2)))
        x = rnd.normal(size=(6, 4))
        score = lambda y: sum(x[i] @ field.weights for i in range(6) if y[i]) + sum(field.transitions[a, b] for a, b in zip(y, y[1:]))
        best = max(([int(c) for c in f"{k:06b}"] for k in range(64)), key=score)
        assert field.viterbi(x).tolist() == best
    assert quality.fit_chains([]) is quality.DEFAULT


def test_expectations_equal_all_paths():
    """Chances by forward and backward sums equal those counted over all label sequences, for chains of several lengths."""
    rnd = np.random.default_rng(3)
    for _ in range(10):
        x, w, t = rnd.normal(size=(2, 5, 3)), rnd.normal(size=3), rnd.normal(size=(2, 2))
        mask = np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0]], float)
        one, joint = quality.expectations(x, mask, w, t)
        for c, n in enumerate((5, 3)):
            paths = list(itertools.product((0, 1), repeat=n))
            chance = np.exp([sum(x[c, i] @ w * y for i, y in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:])) for p in paths])
            chance /= chance.sum()
            assert np.allclose(one[c, :n], np.array(paths).T @ chance) and not one[c, n:].any()
            for i in range(1, n):
                by_hand = [[sum(q for p, q in zip(paths, chance) if (p[i - 1], p[i]) == (a, b)) for b in (0, 1)] for a in (0, 1)]
                assert np.allclose(joint[c, i - 1], by_hand)


def test_op6_mixed_documents_get_mixed_labels(spark):
    """Good documents with a line of symbols and poor ones with a sentence teach the field to change its label inside a document."""
    rnd = random.Random(6)
    sentence = lambda: " ".join("w%d" % rnd.randint(0, 99) for _ in range(14)).replace("w", "ab") + "."
    junk = lambda: " ".join(rnd.choice(("$$$", "##", "BUY", "NOW", "100", "***")) for _ in range(9))
    rows = [("\n".join([*(sentence() for _ in range(7)), junk()]), 1) for _ in range(60)] + [("\n".join([*(junk() for _ in range(7)), sentence()]), 0) for _ in range(60)]
    field = quality.fit(spark.createDataFrame(rows, "text string, quality int"))
    lines = [*(sentence() for _ in range(4)), *(junk() for _ in range(4)), *(sentence() for _ in range(3))]
    labels = field.viterbi(np.stack([quality.line_features(line, False) for line in lines]))
    assert labels.tolist() == [1] * 4 + [0] * 4 + [1] * 3
    texts = ["\n".join(lines), "\n".join(lines[:2] + lines[4:8] * 3)]
    kept = quality.measure(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), field).orderBy("doc_id").collect()
    for r, t in zip(kept, texts):
        own = [(len(x.split()), field.viterbi(np.stack([quality.line_features(y, False) for y in t.split("\n")]))[i]) for i, x in enumerate(t.split("\n"))]
        share = sum(n for n, y in own if y) / sum(n for n, _ in own)
        assert abs(r.content_share - share) < 1e-9 and r.kept == (not r.base_failed and share >= 0.5)
