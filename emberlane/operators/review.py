"""Reviewing findings end to end: every check against the records that a finding cites, the verdict, and the story that rests on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlane.functions.compare import assertion, is_path_field, typed_equal
from emberlane.functions.fields import lookup
from emberlane.functions.text import nt_normalize
from emberlane.functions.times import parse_micros
from emberlane.operators.verify import statement_tokens, ungrounded

#: The checks in their order, and what a failure of each is called.
CHECKS = ("ref_not_found", "ref_not_in_input", "claim_mismatch", "assertion_contradicted", "technique_unsupported", "statement_ungrounded")


def cited_refs() -> Column:
    """refs, then those of claims, then those of assertion endpoints, each once, in order."""
    claimed = F.transform("claims", lambda c: c.ref)
    asserted = F.flatten(F.transform("assertions", lambda a: F.array(a.subject_ref, a.object_ref)))
    return F.array_distinct(F.array_compact(F.concat("refs", claimed, asserted)))


def _first(items: Column, failed) -> Column:
    """The place of the first item that fails; null where none does."""
    return F.array_min(F.transform(items, lambda x, i: F.when(failed(x), i)))


def review(findings: DataFrame, records: DataFrame, support: DataFrame, *, tolerance_seconds: float = 1.0) -> DataFrame:
    """(finding_id, verdict, reason, checks, checks_passed, missing, also_supports).

    findings: finding_id, technique, statement, refs, input_refs (array<string>), claims
    (array<struct<ref, field, value>>), assertions (array<struct<predicate, subject_ref, subject,
    object_ref, object, tolerance>>; without a ref an endpoint is the text itself). records: ref,
    artifact, data (map of dotted names to text). support: technique, artifact.
    Records reach a finding by one join on what it cites, and all checks are one projection over
    that row. The first failing check rejects and later ones do not count; a finding without claims
    and assertions, or with tokens in its statement that no cited record holds, is unverifiable.
    A technique that ``support`` does not name is not checked. Null lists are empty ones.
    """
    empty = {f.name: f.dataType for f in findings.schema if f.name in ("refs", "input_refs", "claims", "assertions")}
    clean = findings.select(*(F.coalesce(F.col(c), F.array().cast(empty[c])).alias(c) if c in empty else F.col(c) for c in findings.columns)).withColumn("cited", cited_refs())
    shown = support.groupBy("artifact").agg(F.collect_set("technique").alias("shows"))
    each = clean.select("finding_id", F.explode("cited").alias("ref")).join(records.select("ref", "artifact", "data"), "ref").join(shown, "artifact", "left")
    held = each.groupBy("finding_id").agg(F.map_from_entries(F.collect_list(F.struct("ref", F.struct("artifact", "data", "shows")))).alias("known"))
    shows = support.groupBy("technique").agg(F.collect_set("artifact").alias("shown_by"))
    row = clean.join(held, "finding_id", "left").join(shows, "technique", "left")
    row = row.withColumn("known", F.coalesce("known", F.map_from_arrays(F.array(), F.array()).cast(held.schema["known"].dataType)))
    data = lambda ref: F.try_element_at("known", ref)["data"]

    def end(ref: Column, text: Column) -> Column:
        found = lookup(data(ref), text)
        return F.when(ref.isNull(), text).when(F.map_contains_key("known", ref) & found["present"], found["value"])

    claimed = F.transform("claims", lambda c, i: F.struct(F.lit(2).alias("check"), i.alias("pos"), c.field.alias("what"), c.value.alias("a"), end(F.coalesce(c.ref, F.lit("")), c.field).alias("b"), F.lit(tolerance_seconds).alias("tolerance")))
    asserted = F.transform("assertions", lambda a, i: F.struct(F.lit(3).alias("check"), i.alias("pos"), a.predicate.alias("what"), end(a.subject_ref, a.subject).alias("a"), end(a.object_ref, a.object).alias("b"), F.coalesce(a.tolerance, F.lit(tolerance_seconds)).alias("tolerance")))
    artifacts = F.array_distinct(F.array_compact(F.transform("cited", lambda r: F.try_element_at("known", r)["artifact"])))
    also = F.array_sort(F.array_distinct(F.flatten(F.array_compact(F.transform("cited", lambda r: F.try_element_at("known", r)["shows"])))))
    values = F.flatten(F.transform("cited", lambda r: F.coalesce(F.map_values(data(r)), F.array().cast("array<string>"))))
    haystack = F.array_join(F.concat("cited", F.array_compact(F.transform("claims", lambda c: c.value)), values), "\n")
    row = row.select(
        "finding_id", F.array_remove(also, F.col("technique")).alias("also"), F.size("claims").alias("n2"), F.size("assertions").alias("n3"),
        _first(F.col("cited"), lambda r: ~F.map_contains_key("known", r)).alias("c0"),
        _first(F.col("cited"), lambda r: ~F.array_contains("input_refs", r)).alias("c1"),
        F.when(F.col("shown_by").isNotNull() & (F.size(artifacts) > 0) & ~F.arrays_overlap(artifacts, "shown_by"), 0).alias("c4"),
        F.transform(ungrounded(statement_tokens(F.coalesce("statement", F.lit(""))), haystack), lambda t: t.token).alias("missing"),
        F.concat(claimed, asserted).alias("t"),
    )
    # one row a claim or assertion, so that comparisons are compiled; rows of a finding are in one place already.
    # What holds for a finding is a column of its own before that: beside an explosion it would be computed anew for each of its rows
    kept = ["also", "n2", "n3", "c0", "c1", "c4", "missing"]
    row = row.select("finding_id", *kept, F.explode_outer("t").alias("t")).select("finding_id", *kept, "t.*")
    of_path = F.col("what").isin("under_path", "outside_path", "same_path")
    row = row.select("*", parse_micros(F.col("a")).alias("ta"), parse_micros(F.col("b")).alias("tb"), F.when(of_path, nt_normalize(F.col("a"))).alias("pa"), F.when(of_path, nt_normalize(F.col("b"))).alias("pb"))
    times, paths = (F.col("ta"), F.col("tb")), (F.col("pa"), F.col("pb"))
    same = typed_equal(F.col("a"), F.col("b"), is_path_field(F.col("what")), F.col("tolerance"), times)
    holds = F.when(F.col("check") == 2, F.coalesce(same, F.lit(False))).when(F.col("check") == 3, assertion(F.col("what"), F.col("a"), F.col("b"), F.col("tolerance"), times, paths))
    place = lambda check: F.min(F.when((F.col("check") == check) & ~F.col("holds"), F.col("pos"))).alias(f"c{check}")
    row = row.select("finding_id", *kept, "check", "pos", holds.alias("holds")).groupBy("finding_id").agg(*(F.first(c).alias(c) for c in kept), place(2), place(3))
    failed = F.coalesce(*(F.when(F.col(f"c{i}").isNotNull(), F.lit(i)) for i in range(5)))
    row = row.withColumn("failed", failed)
    claims, asserted = F.col("n2"), F.col("n3")
    reached = lambda i: F.col("failed").isNull() | (F.col("failed") >= i)
    checks = F.when(reached(2), claims).otherwise(0) + F.when(reached(3), asserted).otherwise(0)
    passed = F.when(reached(2), F.coalesce("c2", claims)).otherwise(0) + F.when(reached(3), F.coalesce("c3", asserted)).otherwise(0)
    verdict = F.when(F.col("failed").isNotNull(), "rejected").when((claims + asserted == 0) | (F.size("missing") > 0), "unverifiable").otherwise("passed")
    reason = F.when(F.col("failed").isNotNull(), F.element_at(F.array(*map(F.lit, CHECKS)), F.col("failed") + 1)).when(claims + asserted == 0, "nothing_to_check").when(F.size("missing") > 0, CHECKS[5])
    also = F.when(reason == CHECKS[4], F.col("also"))  # what the cited artifacts would show, where they do not show the finding's own technique
    return row.select("finding_id", verdict.alias("verdict"), reason.alias("reason"), checks.cast("bigint").alias("checks"), passed.cast("bigint").alias("checks_passed"), "missing", also.alias("also_supports"))


def story_review(sentences: DataFrame, findings: DataFrame) -> DataFrame:
    """(sentence_id, verdict): a sentence's own verdict, revised by the verdicts of the findings that cite its refs.

    sentences: sentence_id, refs, verdict; findings: refs, verdict (passed, rejected, unverifiable).
    One that was supported is contradicted by a rejected ref, stays supported if findings that
    passed hold all its refs, with a warning if an unverifiable one holds any, and is insufficient otherwise.
    """
    holds = lambda v: F.bool_or(F.col("v") == v)
    refs = findings.select(F.col("verdict").alias("v"), F.explode("refs").alias("ref")).groupBy("ref").agg(holds("passed").alias("p"), holds("rejected").alias("r"), holds("unverifiable").alias("w"))
    each = sentences.select("sentence_id", "verdict", F.explode_outer(F.array_distinct("refs")).alias("ref")).join(refs, "ref", "left")
    sums = each.groupBy("sentence_id", "verdict").agg(F.count("ref").alias("n"), F.coalesce(F.bool_or("r"), F.lit(False)).alias("r"), F.coalesce(F.bool_or("w"), F.lit(False)).alias("w"), F.count_if(F.col("p") | F.col("w")).alias("held"))
    revised = F.when(F.col("r"), "contradicted").when((F.col("n") > 0) & (F.col("held") == F.col("n")), F.when(F.col("w"), "supported_with_warning").otherwise("supported")).otherwise("insufficient")
    return sums.select("sentence_id", F.when(F.col("verdict") == "supported", revised).otherwise(F.col("verdict")).alias("verdict"))
