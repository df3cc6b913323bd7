"""Operator 12."""

import random
import re
import zlib
from collections import Counter

from emberlane.llm import spelling


def by_hand(docs):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}

    def near(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    out = {}
    for w, n in words.items():
        others = [(-words[o], o) for o in words if near(w, o)]
        best = min(others, default=None)
        form = best[1] if best and -best[0] >= 10 * n else None
        out[w] = [form, n, len(others), words[form] if form else None]
    rows = set()
    for w, (form, n, k, m) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n, k, m))
    return rows


def rows_of(df):
    rows = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(rows) == len(set(rows))
    return {tuple(r) for r in rows}


def test_op12_brute_force(spark):
    rnd = random.Random(12)
    base = ["".join(rnd.choice("abé") for _ in range(rnd.randint(7, 9))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "ÿÀ×÷ÿÀ×", "zzzzzzz"]
    docs = []
    for i in range(300):
        words = rnd.choices(base, [1 / (k + 1) ** 2 for k in range(len(base))], k=40)
        for j in range(0, len(words), 7):
            w, at = words[j], rnd.randrange(len(words[j]))
            words[j] = rnd.choice([w[:at] + w[at + 1:], w[:at] + rnd.choice("abé") + w[at:], w[:at] + rnd.choice("abé") + w[at + 1:]])
        docs.append((i, rnd.choice([" ", "-", "1", "\n"]).join(words).replace("a", rnd.choice("aA"))))
    docs += [(None, "aaaaaaa " * 30), (7, None), (8, ""), (9, "zzzzzzz" * 3000), (9, "zzzzzzz" * 3000), (9, "zzzzzzz" * 3000)]
    # a chain of forms: 5, 60, 700 occurrences
    docs += [(1000 + i, ("chained" + " chainex" * (i < 60) + " chaimex" * (i < 5))) for i in range(700)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "'w' as word", "1 as n")
    assert rows_of(spelling.spelling_variants(df)) == by_hand(docs)


def test_op12_of_the_given_tables(spark, sf_dir, same_as_sql):
    same_as_sql(spelling.op12_spelling_variants, spelling.ORACLE["op12_spelling_variants"])


def test_no_words(spark, odd_docs, no_docs):
    assert spelling.spelling_variants(no_docs).count() == 0
    assert spelling.spelling_variants(odd_docs).count() >= 0


def test_ranges_nest():
    """One scan meets replacements and indels, whatever lies between."""
    words = {"abcdefg": 3, "abcdefgh": 2, "abcdefx": 9, "bcdefgh": 5, "aabcdefg": 1}
    turned = sorted((w[i:] + "$" + w[:i], n) for w, n in words.items() for i in range(len(w) + 1))
    near = Counter()
    for word, n, _, _ in spelling.scan(iter(turned)):
        near[word] += n
    assert near == {"abcdefg": 3, "abcdefgh": 2, "abcdefx": 1, "bcdefgh": 1, "aabcdefg": 1}
