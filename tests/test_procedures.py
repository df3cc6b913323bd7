"""Findings reviewed by hand, and small cases of fields and names."""

import pytest
from pyspark.sql import functions as F

from emberlane.functions import fields as fx
from emberlane.operators import attention, review, selection

FINDING = "finding_id string, technique string, statement string, refs array<string>, input_refs array<string>, claims array<struct<ref: string, field: string, value: string>>, assertions array<struct<predicate: string, subject_ref: string, subject: string, object_ref: string, object: string, tolerance: double>>"


def test_review_by_hand(spark):
    records = spark.createDataFrame([("A#1", "log", {"fields.Name": "x", "when": "2024-01-01T00:00:00Z", "kids": "P1, p2"}), ("B#2", "file", {"path": "C:\\A\\..\\B\\f"})], "ref string, artifact string, data map<string,string>")
    support = spark.createDataFrame([("T1", "log"), ("T2", "file")], "technique string, artifact string")
    both = ["A#1", "B#2"]
    rows = [
        ("nulls", None, None, None, None, None, None),
        ("good", "T1", "x", ["A#1"], both, [("A#1", "Name", "X"), ("A#1", "Name", "x")][1:], [("spawned", "A#1", "kids", None, "P2", None), ("within", "A#1", "when", None, "2024-01-01T00:00:01Z", None), ("under_path", "B#2", "path", None, "c:/b", None)]),
        ("lost", None, None, ["A#9"], both, [("A#1", "Name", "x")], None),
        ("unseen", None, None, ["B#2"], ["A#1"], [("A#1", "Name", "x")], None),
        ("claim", None, None, ["A#1"], both, [("A#1", "Name", "x"), ("A#1", "gone", "x")], [("count", None, "1", None, "1.0", None)]),
        ("assert", None, None, ["A#1"], both, [("A#1", "fields.Name", "x")], [("count", None, "1", None, "1.0", None), ("before", "A#1", "when", "A#1", "no such", None)]),
        ("other", "T2", None, ["A#1"], both, [("A#1", "Name", "x")], None),
        ("words", None, "saw 123456 at B", ["A#1"], both, [("A#1", "Name", "x")], []),
    ]
    out = {r.finding_id: (r.verdict, r.reason, r.checks, r.checks_passed) for r in review.review(spark.createDataFrame(rows, FINDING), records, support).collect()}
    assert out == {
        "nulls": ("unverifiable", "nothing_to_check", 0, 0),
        "good": ("passed", None, 4, 4),
        "lost": ("rejected", "ref_not_found", 0, 0),
        "unseen": ("rejected", "ref_not_in_input", 0, 0),
        "claim": ("rejected", "claim_mismatch", 2, 1),
        "assert": ("rejected", "assertion_contradicted", 3, 2),
        "other": ("rejected", "technique_unsupported", 1, 1),
        "words": ("unverifiable", "statement_ungrounded", 1, 1),
    }


def test_an_unknown_name_is_an_error(spark):
    catalog = spark.createDataFrame([("log:A",), ("log:B",), ("$X",)], "artifact string")
    assert sorted(r.artifact for r in selection.forced_names(["log", "$X"], catalog).collect()) == ["$X", "log:A", "log:B"]
    with pytest.raises(ValueError, match="lig"):
        selection.forced_names(["log", "lig"], catalog)


def test_fields_by_hand(spark):
    df = spark.range(1).select(
        fx.first_clause(F.lit("1st.  2 moved files 2 ; moved again"), ["MOVED"]).alias("clause"),
        fx.flag_dump(F.lit("(a_b), and c_d."), ["a_b", "c_d"]).alias("dump"),
        fx.numbered_keys(F.array(*map(F.lit, "kkjk"))).alias("keys"),
        fx.without_empty_tail(F.array(F.lit(""), F.lit("x"), F.lit(""), F.lit(None).cast("string"))).alias("tail"),
        fx.without_empty_tail(F.array(F.lit(""))).alias("none"),
        fx.record_blob(F.lit('{"A": "X\\\\y", "n": {"B": 1}}')).alias("blob"),
    )
    r = df.first()
    assert r.clause == "2 moved files 2" and r.dump and r["keys"] == ["k", "k#2", "j", "k#3"] and r.tail == ["", "x"] and r.none == []
    assert r.blob == 'a x\\y n {"b":1}'


def test_tokens_and_grounding_by_hand(spark):
    """Kinds, order, endings of the sentence, numbers by value and file names without dots."""
    from emberlane.operators import verify

    cases = [
        ("T1059.001 ran C:\\Dir\\a.exe에서 and (shell.aspx), 2024-01-02 03:04:05 at 12:30, 0x1F of 4821바이트 on build 19045.6466 and Node.js.", [("path", "c:/dir/a.exe"), ("file", "shell.aspx"), ("file", "node.js"), ("number", "0x1f"), ("number", "4821")]),
        ("\\\\host\\share\\x and \\\\host\\share\\x, a.exe.b.dll-x 123 12345 12345", [("path", "//host/share/x"), ("file", "a.exe.b.dll"), ("number", "12345")]),
        ("", []), (None, None),
    ]
    df = spark.createDataFrame([(t,) for t, _ in cases], "s string").select(verify.statement_tokens(F.col("s")).alias("t"))
    got = [None if r.t is None else [tuple(x) for x in r.t] for r in df.collect()]
    assert got == [want for _, want in cases]
    known = [("1234", "size 01234567", False), ("1234", "size 01234.", True), ("0x4d2", "n=1234", True), ("1234", "0x04D2", True), ("123456789012345678901234567890", "0123456789012345678901234567890", True), ("0x1", "0x10", False), ("4821", "4821바이트", True)]
    for token, evidence, grounded in known:
        row = spark.range(1).select(verify.ungrounded(F.array(F.struct(F.lit("number").alias("kind"), F.lit(token).alias("token"))), F.lit(evidence)).alias("m")).first()
        assert (row.m == []) == grounded, (token, evidence)
    files = [("node.js", "C:\\nodejs\\x", True), ("a.b", "ab", False), ("report.exe", "report.txt", False), ("x.dll", None, False)]
    for token, evidence, grounded in files:
        row = spark.range(1).select(verify.ungrounded(F.array(F.struct(F.lit("file").alias("kind"), F.lit(token).alias("token"))), F.lit(evidence)).alias("m")).first()
        assert (row.m == []) == grounded, (token, evidence)


def test_tokens_of_a_long_run_take_linear_time(spark):
    """A megabyte without a space or a dot."""
    import time

    from emberlane.operators import verify

    texts = ["x" * 1_000_000, "é" * 500_000 + "a", "a." * 300_000, "\\" * 300_000, "0" * 800_000, "C:" * 300_000]
    df = spark.createDataFrame([(t,) for t in texts], "s string").coalesce(1)
    df.select(F.size(verify.statement_tokens(F.col("s")))).collect()
    began = time.time()
    df.select(F.size(verify.ungrounded(verify.statement_tokens(F.col("s")), F.col("s")))).collect()
    assert time.time() - began < 20


def test_lists_and_long_addresses(spark):
    from emberlane.functions.compare import typed_equal
    from emberlane.functions.text import network_key

    row = lambda *columns: tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())
    same = lambda a, b, path=False: typed_equal(F.lit(a), F.lit(b), F.lit(path), 1.0)
    assert row(same("a", '["a","b"]'), same("c", '["a","b"]'), same("1", "[1.0, 2]"), same("C:/X", '["c:\\\\x"]', True), same("[a", "[a"), same('["a"]', '["a"]'), same("2024-01-01T00:00:00Z", '["x","2024-01-01T00:00:00.5Z"]')) == (True, False, True, True, True, True, True)
    hosts = {"0:0:0:0:0:0:0:1": None, "::1": None, "::": None, "0::0": None, "::ffff:127.0.0.1": None, "::FFFF:10.0.0.1": "10.0.0.1", "2001:0DB8:0:0:1:0:0:1": "2001:db8::1:0:0:1", "2001:db8::0:1": "2001:db8::1", "fe80::1%eth0": "fe80::1", "[2001:db8::5]": "2001:db8::5", "1:2:3:4:5:6:7:8": "1:2:3:4:5:6:7:8", "::ffff:999.0.0.1": None, "1::2::3": None, "12345::1": None, "Host.": "host", "10.0.0.256": None, "": None, "a:b:c": None}
    assert row(*(network_key(F.lit(h)) for h in hosts)) == tuple(hosts.values())


def test_a_finding_is_judged_before_its_claims_are_rows(spark):
    """What holds for a whole finding is computed below the explosion of its claims, not once a claim."""
    records = spark.createDataFrame([("A#1", "log", {"a": "1"})], "ref string, artifact string, data map<string,string>")
    support = spark.createDataFrame([("T1", "log")], "technique string, artifact string")
    rows = spark.range(10).selectExpr("cast(id as string) finding_id", "'T1' technique", "'saw 12345' statement", "array('A#1') refs", "array('A#1') input_refs", "array(struct('A#1' ref, 'a' field, '1' value)) claims", "cast(null as array<struct<predicate: string, subject_ref: string, subject: string, object_ref: string, object: string, tolerance: double>>) assertions")
    plan = review.review(rows, records, support)._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate explode(t#", 1) if "Generate explode(t#" in plan else (plan, "")
    assert "regexp_extract_all" not in above and "regexp_extract_all" in below


def test_tasks_of_picks_grow_in_number_and_a_candidate_twice_is_one(spark):
    """Rows are dealt out by number, which Spark does not lessen; the same candidate twice does not double a problem."""
    from emberlane.operators.proposals import pick_violations
    from emberlane.tables import dealt

    assert dealt(spark.range(1000), 1000, "id", each=10).rdd.getNumPartitions() == 100
    picks = spark.createDataFrame([("A", 1, " ", ["x"]), ("A", 2, "r", ["x"])], "ref string, technique long, reason string, evidence_fields array<string>")
    known = spark.createDataFrame([("A", ["x"])], "ref string, fields_present array<string>")
    may = spark.createDataFrame([("A", 1), ("A", 1)], "ref string, technique long")
    out = pick_violations(picks, known, may)
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, out.collect())) == [("A", "no_reason"), ("A", "technique_not_supported")]


def test_signals_are_matched_once(spark):
    """The optimizer must not test at the scan what the exploded list holds: that would match twice."""
    records = spark.range(2).selectExpr("id", "concat('a ', id) as text", "array('x') as flags")
    rows = attention.matches(records, [attention.Signal("s", every=("A", "1")), attention.Signal("f", flags=("x",))])
    assert sorted((r.id, r.signal, r.tokens) for r in rows.collect()) == [(0, "f", ["x"]), (1, "f", ["x"]), (1, "s", ["A", "1"])]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Filter") == 1 and plan.index("Filter") < plan.index("Generate")
