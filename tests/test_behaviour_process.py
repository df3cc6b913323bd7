"""Behaviour patterns, descent of processes, and places in very large groups, against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from emberlane.operators import behaviour, process, ranking


def test_needles_are_parts_of_every_match():
    assert [behaviour.needle_of(p) for p in ("usb", r"device.*connect", r"cmd(?:\.exe)?", r"a|b", r"(?:a)b?c", r"\\exfil(?:\\|\b)", "x{3}yz")] == ["usb", "connect", "cmd", "", "a", "\\exfil", "yz"]


def test_hits_equal_a_search_of_each_pattern():
    rnd = random.Random(1)
    patterns = [k for f in behaviour.FAMILIES for k in f.keywords] + ["a|b", "[xy]z"]
    parts = [re.sub(r"\(\?:[^)]*\)\?|\\b|\.\*|\\s[+*]|\[[^]]*\]\{4\}|[?]|\(\?:([^)|]*)[^)]*\)|\.\+", r"\1 ", p).replace("\\\\", "\\").replace("\\.", ".") for p in patterns] + [" ", "-a", "conn", "exe"]
    needles = behaviour.Needles(patterns)
    met = set()
    for _ in range(3000):
        text = "".join(rnd.choice(parts) + rnd.choice(["", " ", "x"]) for _ in range(rnd.randint(0, 6)))
        want = [i for i, p in enumerate(patterns) if re.search(p, text)]
        assert needles.hits(text) == want
        met.update(want)
    assert len(met) > 0.8 * len(patterns)
    with pytest.raises(ValueError):
        behaviour.Needles(["x"] * 10_001)


def test_unknown_families_are_errors(spark):
    rows = spark.createDataFrame([], "ref string, us long, blob string, flags array<string>, network boolean, outbound long")
    with pytest.raises(KeyError):
        behaviour.behaviour_scores(rows, {"none": []})
    assert behaviour.behaviour_scores(rows, {"impact": []}).count() == 0


def test_families_flag_and_pivot_rules(spark):
    rows = spark.createDataFrame([("a", 1, None, None, None, None), ("b", 2, "at HOST1", [], True, 0), ("c", 3, "at host1", [], False, 0), ("d", 4, "x", ["Exfiltration"], True, behaviour.LARGE), (None, 5, "usb", [], True, 0), ("e", 6, "usb", ["outside_time_range"], True, 0), ("f", 7, "x", None, False, behaviour.LARGE)], "ref string, us long, blob string, flags array<string>, network boolean, outbound long")
    got = {(r.family, r.ref, r.score, tuple(r.signals)) for r in behaviour.behaviour_scores(rows, {"lateral_movement": [" host1 ", ""], "exfiltration": ["x"], "initial_access": []}).collect()}
    assert got == {("lateral_movement", "b", 1, ("pivot_network",)), ("exfiltration", "d", 7, ("flag:exfiltration", "large_outbound_transfer"))}


def test_process_closure_brute_force(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(400):
        pick = lambda *x: rnd.choice(x)
        rows.append((i, pick(None, "-", "", f"G{rnd.randint(0, 120)}"), pick(None, "-", f"g{rnd.randint(0, 120)} "), pick(None, str(rnd.randint(0, 5))), pick(None, "A", "b"), pick(None, str(rnd.randint(0, 5))), pick("a", " B"), pick(None, rnd.randint(0, 2000))))
    columns = "k long, g string, pg string, n string, i string, pn string, pi string, t long"
    clean = lambda s: (s or "").strip().lower() or None
    time = {r[0]: -(1 << 62) if r[7] is None else r[7] for r in rows}
    for depth in (1, 2, 4):
        want = {k: 0 for k in range(0, 400, 90)}
        level = set(want)
        for d in range(1, depth + 1):
            parents = [r for r in rows if r[0] in level]
            level = set()
            for c in rows:
                if c[0] in want:
                    continue
                for p in parents:
                    by_guid = clean(p[1]) not in (None, "-") and clean(p[1]) == clean(c[2])
                    by_number = clean(p[3]) and clean(p[4]) and (clean(p[3]), clean(p[4])) == (clean(c[5]), clean(c[6])) and 0 <= time[c[0]] - time[p[0]] <= 120
                    if by_guid or by_number:
                        level.add(c[0])
            want |= {k: d for k in level}
        df = spark.createDataFrame(rows, columns)
        seeds = df.where("k % 90 = 0").select("k")
        got = process.process_closure(df, seeds, key="k", guid="g", parent_guid="pg", number="n", image="i", parent_number="pn", parent_image="pi", at="t", within=120, depth=depth)
        assert {r.k: r.depth for r in got.collect()} == want


def test_places_in_groups_over_many_tasks(spark):
    rows = spark.range(20_000).selectExpr("case when id % 10 < 8 then 'big' when id % 10 = 8 then null else 's' || id % 7 end as g", "hash(id) % 1000 as v", "id")
    out = ranking.numbered(rows, group="g", order=[F.desc("v"), "id"], place="p", size="n")
    assert all("Window" not in line or "_g" in line for line in out._jdf.queryExecution().executedPlan().toString().split("\n"))
    got = {r.id: (r.p, r.n) for r in out.collect()}
    groups = {}
    for r in rows.collect():
        groups.setdefault(r.g, []).append((-r.v, r.id))
    assert got == {i: (p, len(m)) for m in groups.values() for p, (_, i) in enumerate(sorted(m), 1)}
    assert ranking.numbered(rows.limit(0), group="g", order=["id"]).count() == 0


def test_walk_of_odd_objects(spark):
    import json

    from emberlane.operators import openobject

    values = ['{"a.b": {"": [[], {}, [null, "x"]]}, "A": 1e400}', "[]", "{}", "7", "null", '"t"', None, '{"a": ' * 30 + '"end"' + "}" * 30]
    rows = spark.createDataFrame(list(enumerate(values)), "id long, t string").selectExpr("id", "try_parse_json(t) as v", "'x' as path")
    got = {}
    for r in openobject.walk(rows, key="id", value="v").collect():
        got.setdefault(r.id, set()).add((r.path, r.kind, r.text))
    assert got[1] == {("", "array", None)} and got[2] == {("", "object", None)} and got[3] == {("", "scalar", "7")} and got[4] == {("", "null", None)} and got[5] == {("", "scalar", "t")} and 6 not in got
    assert (".".join(["a"] * 30), "scalar", "end") in got[7] and len(got[7]) == 31
    assert 0 not in got or {p for p, _, _ in got[0]} >= {"a.b", "a.b.", "a.b.[2][1]"}
    assert json.loads(values[2]) == {} and openobject.walk(rows.limit(0), key="id", value="v").count() == 0
