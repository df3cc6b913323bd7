"""Checking what findings claim against records, and the verdicts that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlane.functions.text import let, normalize_path

def cited(findings: DataFrame) -> DataFrame:
    """(finding_id, ref, pos): refs, then those of claims, each once, in order. findings: finding_id, refs, claim_refs."""
    every = F.array_distinct(F.concat("refs", F.coalesce("claim_refs", F.array())))
    return findings.select("finding_id", F.posexplode(every).alias("pos", "ref"))


def first_missing(citations: DataFrame, known: DataFrame) -> DataFrame:
    """(finding_id, ref): the first cited ref that is not known."""
    return citations.join(known, "ref", "left_anti").groupBy("finding_id").agg(F.min_by("ref", "pos").alias("ref"))


def claims_checked(claims: DataFrame, records: DataFrame, equal: Column) -> DataFrame:
    """(finding_id, checks, checks_passed, reason): claims in order up to the first that fails.

    claims: finding_id, pos, ref, claimed; records: ref, observed, present.
    """
    joined = claims.join(records, "ref", "left")
    reason = F.when(F.col("present").isNull(), "record_not_found").when(~F.col("present"), "field_not_found").when(~F.coalesce(equal, F.lit(False)), "value_mismatch")
    judged = joined.withColumn("reason", reason)
    first = F.min(F.when(F.col("reason").isNotNull(), F.col("pos")))
    return judged.groupBy("finding_id").agg(F.count("*").alias("checks"), F.coalesce(first.cast("bigint"), F.count("*")).alias("checks_passed"), F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("pos"))).alias("reason"))


def verdicts(checks: DataFrame) -> DataFrame:
    """(finding_id, verdict, failed, checks, checks_passed): the first failing check decides, and only checks up to it count.

    checks: finding_id, check_order, outcome (passed, rejected, unverifiable), checks, checks_passed.
    """
    own = checks.groupBy("finding_id").agg(F.collect_list(F.struct("check_order", "outcome", "checks", "checks_passed")).alias("_all"))  # a few checks each
    failed = F.array_min(F.transform(F.filter("_all", lambda c: c.outcome == "rejected"), lambda c: c.check_order))
    counted = F.filter("_all", lambda c: F.col("failed").isNull() | (c.check_order <= F.col("failed")))
    total = lambda name: F.aggregate("_counted", F.lit(0).cast("bigint"), lambda n, c: n + c[name])
    verdict = F.when(F.col("failed").isNotNull(), "rejected").when(F.exists("_all", lambda c: c.outcome == "unverifiable"), "unverifiable").otherwise("passed")
    return own.withColumn("failed", failed).withColumn("_counted", counted).select("finding_id", verdict.alias("verdict"), "failed", total("checks").alias("checks"), total("checks_passed").alias("checks_passed"))


def supported(findings: DataFrame, support: DataFrame) -> DataFrame:
    """Adds ``supported``: some cited artifact is known to show the technique; a finding without a technique is."""
    known = support.groupBy("technique").agg(F.collect_set("artifact").alias("_known"))
    joined = findings.join(known, "technique", "left")
    return joined.withColumn("supported", F.col("technique").isNull() | F.coalesce(F.arrays_overlap("artifacts", "_known"), F.lit(False))).drop("_known")


#: What is read of a sentence. Each pattern begins only where a run of its characters does, so that a long run is read once.
_TECHNIQUE = r"\bT[0-9]{4}(?:\.[0-9]{3})?\b"
_PATH = r"(?:(?<![A-Za-z])[A-Za-z]:[\\/]|(?<!\\)\\\\[^\s\\/]++[\\/])[^\s,;\"'()\[\]<>]*+"
_FILE = r"(?<![^\s,;:\"'()\[\]<>\\/])[^\s,;:\"'()\[\]<>\\/]+\.[A-Za-z0-9]{1,8}"
_TIME = r"[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}(?:[T ][0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?(?:\.[0-9]+)?Z?)?|(?<![0-9])[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?(?:\.[0-9]+)?"
_NUMBER = r"0[xX][0-9A-Fa-f]+|[0-9]{4,}"
_WHOLE_NUMBER = r"(?<![0-9a-z])(?:0x[0-9a-f]++|[0-9]++)(?![0-9a-z])"
#: Least letters of a file name that is looked for without its dots (fixed value).
LEAST_COMPACT = 4


def statement_tokens(text: Column) -> Column:
    """(kind, token) of the paths, file names and numbers of a sentence, each once, in order; compared in lower case with slashes.

    Technique ids are blanked first and times before numbers, which have four digits or are
    hex. A file name's ending has a letter. What ends a token but belongs to the sentence
    is cut off. Time is in proportion to the text.
    """
    clean = lambda t: F.regexp_replace(t, r"(?<![^A-Za-z0-9_$.\-)\]}])[^A-Za-z0-9_$.\-)\]}]++$", "")
    all_of = lambda t, pattern: F.filter(F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), clean), lambda x: x != "")
    kinds = lambda tokens, kind: F.transform(tokens, lambda t: F.named_struct(F.lit("kind"), F.lit(kind), F.lit("token"), normalize_path(t)))
    plain = F.regexp_replace(text, _TECHNIQUE, " ")
    pathless = F.regexp_replace(plain, _PATH, " ")
    files = F.filter(all_of(pathless, _FILE), lambda t: t.rlike(r"(?s)^.+\.(?=[0-9]*[A-Za-z])[A-Za-z0-9]{1,8}$"))
    rest = F.regexp_replace(F.regexp_replace(pathless, _FILE, " "), _TIME, " ")
    return F.array_distinct(F.concat(kinds(all_of(plain, _PATH), "path"), kinds(files, "file"), kinds(all_of(rest, _NUMBER), "number")))


def number_key(token: Column) -> Column:
    """One text for equal whole numbers, decimal or hex (up to 16 digits)."""
    return let(F.lower(token), _number_key)


def _number_key(low: Column) -> Column:
    """The same of a token in lower case."""
    bare = lambda t: F.when(t.startswith("0"), F.regexp_replace(t, "^0+(?=.)", "")).otherwise(t)
    of_hex = let(bare(F.substr(low, F.lit(3))), lambda d: F.when(F.length(d) <= 16, F.conv(d, 16, 10)).otherwise(low))
    return F.when(low.startswith("0x"), of_hex).otherwise(bare(low))


def ungrounded(tokens: Column, evidence: Column, numbers: Column | None = None) -> Column:
    """The tokens (kind, token) that the evidence does not explain.

    A number has to stand in it as a number of equal value; a path or file name as part of
    it, a file name also with all dots left out. ``numbers`` are the number_key of those that
    count, if they are not all whole numbers of the evidence.
    """
    folded = lambda t: F.replace(t.token, F.lit("."), F.lit(""))
    known = lambda t, e: F.when(t.kind == "number", F.array_contains(e.numbers, number_key(t.token))).otherwise(F.contains(e.text, t.token) | ((t.kind == "file") & (F.length(folded(t)) >= LEAST_COMPACT) & F.contains(e.compact, folded(t))))
    counted = lambda low: F.transform(F.regexp_extract_all(low, F.lit(_WHOLE_NUMBER), F.lit(0)), _number_key) if numbers is None else numbers
    held = lambda low, text: F.named_struct(F.lit("text"), text, F.lit("compact"), F.replace(text, F.lit("."), F.lit("")), F.lit("numbers"), counted(low))
    # the evidence may be long: it is lower-cased once, and slashes do not change its numbers
    read = let(F.lower(F.replace(evidence, F.lit("\\"), F.lit("/"))), lambda low: let(normalize_path(low, lowered=True), lambda text: held(low, text)))
    return let(read, lambda e: F.filter(tokens, lambda t: ~F.coalesce(known(t, e), F.lit(False))))
