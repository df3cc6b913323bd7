"""Documents of rules, signals and families, and lookups by reference."""

import json

import pytest
from pyspark.sql import functions as F

from emberlane.operators import attention, behaviour, rules
from emberlane.plans import knowledge as knowledge_plans
from emberlane.sources import knowledge, reflayout


def test_documents_give_the_same_values(spark, tmp_path):
    signals = (attention.Signal("a", every=("x", "y"), score=2), attention.Signal("b", flags=("f",)))
    for kind, values in (("rules", rules.RULES), ("families", behaviour.FAMILIES), ("signals", signals)):
        (tmp_path / f"{kind}.json").write_text(knowledge.to_document(values, kind))
        assert knowledge.load(spark, str(tmp_path / f"{kind}.json"), kind) == values
    rows = spark.createDataFrame([("X and y", ["f"])], "text string, flags array<string>")
    assert sorted(r.signal for r in attention.matches(rows, list(knowledge.load(spark, str(tmp_path / "signals.json"), "signals"))).collect()) == ["a", "b"]
    yaml = pytest.importorskip("yaml")
    (tmp_path / "s.yaml").write_text(yaml.safe_dump(json.loads(knowledge.to_document(signals, "signals"))))
    assert knowledge.load(spark, str(tmp_path / "s.yaml"), "signals") == signals


@pytest.mark.parametrize("document,place", [
    ({"rules": []}, "an object with the keys"), ({"version": 2, "rules": []}, "version"), ({"version": 1, "rules": [], "more": 1}, "an object with the keys"), ({"version": 1, "rules": {}}, "a list is needed"),
    ({"version": 1, "rules": [{"name": "a", "clauses": [], "wieght": 1}]}, r"rules\[0\].wieght: no such key"), ({"version": 1, "rules": [{"clauses": []}]}, r"rules\[0\].name: missing"), ({"version": 1, "rules": [{"name": 7, "clauses": []}]}, r"rules\[0\].name: str is needed"),
    ({"version": 1, "rules": [{"name": "a", "clauses": [{"artifact": "x", "tset": "in"}]}]}, r"clauses\[0\].tset: no such key"), ({"version": 1, "rules": [{"name": "a", "clauses": [{"artifact": "x", "events": ["1"]}]}]}, r"events\[0\]: int is needed"),
    ({"version": 1, "rules": [{"name": "a", "clauses": []}, {"name": "a", "clauses": []}]}, "there twice"), ({"version": 1, "rules": [{"name": "a", "clauses": [{"artifact": "x", "test": "regex", "field": "f", "values": ["("]}]}]}, "no pattern"), ({"version": 1, "rules": [{"name": "a", "clauses": [], "extra": "none"}]}, "extra: none is not known"),
])
def test_faults_name_their_place(document, place):
    with pytest.raises(knowledge.KnowledgeError, match=place):
        knowledge.from_document(document, "rules")


def test_a_lookup_reads_one_file_of_many(spark, tmp_path):
    at = str(tmp_path / "layout")
    rows = spark.range(5000).select(F.concat(F.when(F.col("id") % 2 == 0, "MFT").otherwise("USN"), F.lit("#"), "id").alias("ref"), F.col("id").alias("v")).unionByName(spark.createDataFrame([("no ref", -1), (None, -2), ("MFT#01", -3)], "ref string, v long"))
    reflayout.write_layout(rows, at, width=100)
    found = reflayout.lookup(spark, at, ["MFT#1234", "no ref", "USN#x"], width=100)
    assert [(r.ref, r.v) for r in found.collect()] == [("MFT#1234", 1234)]
    scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numFiles").value() == 1 and len(spark.read.parquet(at).inputFiles()) > 90
    assert reflayout.lookup(spark, at, [], width=100).count() == 0
    wanted = spark.createDataFrame([("MFT#2",), ("USN#3",), ("USN#2",), ("MFT#01",), (None,), ("MFT#2",)], "ref string")
    assert sorted((r.ref, r.v) for r in reflayout.lookup_all(spark, at, wanted, width=100).collect()) == [("MFT#2", 2), ("USN#3", 3)]
    assert spark.read.parquet(at).count() == 5003


def test_flags_of_a_document_are_computed_once(spark, sf_dir):
    plan = knowledge_plans.rules_of_a_document(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("log_cleared") == 1
