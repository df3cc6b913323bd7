"""Objects in free text against a walk over its characters."""

import random
import time

from pyspark.sql import functions as F

from emberlane.functions.modeltext import extract_object, first_object


def by_hand(text):
    start = text.find("{")
    depth, inside, escaped = 0, False, False
    for i in range(max(start, 0), len(text)) if start >= 0 else ():
        c = text[i]
        if inside:
            escaped, inside = (c == "\\" and not escaped), inside and (escaped or c != '"')
        elif c == '"':
            inside = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0:
                return text[start:i + 1]
    return None


def test_first_object_equals_a_walk(spark):
    rnd = random.Random(3)
    texts = ["".join(rnd.choice('{}{}""\\a 🙂\n') for _ in range(rnd.randint(0, 25))) for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", first_object(F.col("t")).alias("o")).collect()
    assert {r.i: r.o for r in rows} == {i: by_hand(t) for i, t in enumerate(texts)} and sum(r.o is not None for r in rows) > 300


def test_a_megabyte_in_linear_time(spark):
    texts = ["{" * 500_000 + "}" * 500_000, '{"a": "' + '\\"' * 400_000 + '"}', "x" * 1_000_000 + '{"a": 1}', '{"a": "' + "{" * 1_000_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    df.select(F.length(first_object(F.col("t")))).collect()
    began = time.time()
    got = [r[0] for r in df.select(F.length(first_object(F.col("t")))).collect()]
    assert got == [1_000_000, 800_009, 8, None] and time.time() - began < 15


def test_problems(spark):
    cases = [(None, "empty"), ("", "empty"), (" \n", "empty"), ("3", "not_an_object"), ("```json\n[1]\n```", "not_an_object"), ("a {b", "cut_off"), ("a {b}", "not_found"), ("a", "not_found"), ('3 of {"x": 1}', None), ('[1] {"x": 1}', None), ('"t" {"x": 1}', None), ('"a\\"{"', "not_an_object"), ('```\n["{"]\n```', "not_an_object"), ('```\n{"x": {}}\n```', None), ('a {"x": 1} b', None)]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i long, t string").select("i", extract_object(F.col("t")).alias("o")).select("i", "o.problem", F.col("o.object").isNull().alias("none")).collect()
    assert {r.i: (r.problem, r.none) for r in rows} == {i: (p, p is not None) for i, (_, p) in enumerate(cases)}
