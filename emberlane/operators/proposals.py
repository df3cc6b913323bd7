"""Externally proposed picks, connections and requests: admissibility, assembly of findings, loop-back windows, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlane.tables import dealt


def pick_violations(picks: DataFrame, records: DataFrame, candidates: DataFrame) -> DataFrame:
    """(ref, problem): picks of unknown records, without a reason, with a technique that the record cannot show, or with fields that it does not have.

    picks: ref, technique, reason, evidence_fields; records: ref, fields_present; candidates: ref, technique.
    """
    may = candidates.groupBy("ref").agg(F.collect_set("technique").alias("_may"))  # a record may show a few techniques
    allowed = F.coalesce(F.array_contains("_may", F.col("technique")), F.lit(False))
    joined = dealt(picks, picks.count(), "ref").join(records, "ref", "left").join(may, "ref", "left")
    problems = F.array_compact(
        F.array(
            F.when(F.col("fields_present").isNull(), "unknown_ref"),
            F.when(F.coalesce(F.trim("reason"), F.lit("")) == "", "no_reason"),
            F.when(F.col("technique").isNotNull() & ~allowed, "technique_not_supported"),
            F.when(~F.coalesce(F.size("evidence_fields"), F.lit(0)).between(1, 4), "number_of_fields"),
            F.when(F.size(F.array_except("evidence_fields", F.coalesce("fields_present", F.array()))) > 0, "field_not_found"),
        )
    )
    return joined.select("ref", F.explode(problems).alias("problem"))


def connection_violations(connections: DataFrame, picks: DataFrame) -> DataFrame:
    """(connection, problem): fewer than two different refs, or refs that were not picked."""
    each = connections.select("connection", F.explode_outer(F.array_distinct("refs")).alias("ref")).join(picks.select("ref", F.lit(True).alias("_p")).distinct(), "ref", "left")
    sums = each.groupBy("connection").agg(F.count("ref").alias("n"), F.count_if(F.col("ref").isNotNull() & F.col("_p").isNull()).alias("bad"))
    return sums.select("connection", F.explode(F.array_compact(F.array(F.when(F.col("n") < 2, "fewer_than_two"), F.when(F.col("bad") > 0, "not_picked")))).alias("problem"))


def request_dispositions(requests: DataFrame, known_refs: DataFrame, catalog: DataFrame, *, most_hours: int = 24) -> DataFrame:
    """Adds ``disposition``: the first reason that turns a request down, else accepted."""
    r = requests.join(known_refs.select(F.col("ref").alias("based_on_ref"), F.lit(True).alias("_ref")).distinct(), "based_on_ref", "left").join(catalog.select("artifact", F.lit(True).alias("_art")).distinct(), "artifact", "left")
    reason = (
        F.when(F.col("_ref").isNull(), "unknown_ref")
        .when((F.col("type") == "artifact") & F.col("_art").isNull(), "unknown_artifact")
        .when((F.col("type") == "pivot_window") & ~F.coalesce(F.col("window_hours").between(1, most_hours), F.lit(False)), "window_out_of_range")
        .otherwise("accepted")
    )
    return r.withColumn("disposition", reason).drop("_ref", "_art")


def widened(start: Column, end: Column, pivot: Column, hours: Column, collected: Column) -> tuple[Column, Column]:
    """A window that also holds the pivot's, never past the time of collection and never narrower."""
    hour = 3_600_000_000
    return F.least(start, pivot - hours * hour), F.greatest(end, F.least(pivot + hours * hour, collected))


def claims_of(fields: list[str], most: int = 4) -> Column:
    """The first few filled fields of a list, in its order, as (field, value)."""
    pairs = F.array(*(F.when(F.col(f).cast("string") != "", F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"))) for f in fields))
    return F.slice(F.array_compact(pairs), 1, most)


def without_fields(fields: Column, dropped: list[str]) -> Column:
    """A map without some keys: what is shown to a proposer."""
    return F.map_filter(fields, lambda k, _: ~k.isin(dropped))


def coverage(families: DataFrame, observed: DataFrame, searched: DataFrame, verified: DataFrame) -> DataFrame:
    """(family, status): not_searched < searched_no_evidence < observed < verified; the strongest wins."""
    ranks = families.select("family", F.lit(0).alias("rank"))
    for rank, rows in ((1, searched), (2, observed), (3, verified)):
        ranks = ranks.unionByName(rows.select("family", F.lit(rank).alias("rank")))
    top = ranks.groupBy("family").agg(F.max("rank").alias("rank"))
    names = F.array(*map(F.lit, ("not_searched", "searched_no_evidence", "observed", "verified")))
    return top.join(families.select("family"), "family", "left_semi").select("family", F.element_at(names, F.col("rank") + 1).alias("status"))


def numbered(findings: DataFrame, *, case: str, order: list, prefix: str = "F") -> DataFrame:
    """Adds ids F1, F2, … in order within a case."""
    return findings.withColumn("finding_id", F.concat(F.lit(prefix), F.row_number().over(Window.partitionBy(case).orderBy(*order))))


def unclaimed(connections: DataFrame, *, case: str, order: str) -> DataFrame:
    """Connections whose refs no earlier kept connection of the case has used: a greedy choice, one case at a time."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in connections.schema.fields)

    def walk(frame):
        used, keep = set(), []
        for refs in frame.sort_values(order)["refs"]:
            fresh = len(refs) >= 2 and not used & set(refs)
            keep.append(fresh)
            if fresh:
                used |= set(refs)
        return frame.sort_values(order)[keep]

    return connections.groupBy(case).applyInPandas(walk, kinds)


def story_kept(sentences: DataFrame, findings: DataFrame) -> DataFrame:
    """(sentences kept, dropped): those whose refs all belong to findings that were not rejected."""
    good = findings.where("verdict <> 'rejected'").select(F.explode("refs").alias("ref")).distinct().withColumn("_g", F.lit(True))
    each = sentences.select("sentence", F.explode_outer("refs").alias("ref")).join(good, "ref", "left")
    return each.groupBy("sentence").agg(F.count_if(F.col("ref").isNull() | F.col("_g").isNull()).alias("bad")).withColumn("kept", F.col("bad") == 0)


def packets_restricted(packets: DataFrame, shipped: DataFrame) -> DataFrame:
    """(anchor, refs): the refs of a packet that were delivered, in order; null where none is left.

    packets: anchor, refs (array); shipped: ref.
    """
    each = packets.select("anchor", F.posexplode("refs").alias("pos", "ref")).join(shipped.select("ref").distinct(), "ref", "left_semi")
    left = each.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "ref"))), lambda x: x.ref).alias("refs"))
    return packets.select("anchor").join(left, "anchor", "left")


def packet_owners(packets: DataFrame, shipped: DataFrame) -> DataFrame:
    """(ref, owner): the first packet, by ordinal, that claims a delivered record; a packet claims its anchor first. packets: ordinal, anchor, refs."""
    claims = packets.select("ordinal", "anchor", F.explode(F.array_distinct(F.concat(F.array("anchor"), F.coalesce("refs", F.array())))).alias("ref"))
    return claims.join(shipped.select("ref").distinct(), "ref", "left_semi").groupBy("ref").agg(F.min_by("anchor", F.struct("ordinal", "anchor")).alias("owner"))


#: Families become expressions, so their table must be short.
MOST_FAMILIES = 1000


def finding_families(findings: DataFrame, families: DataFrame) -> DataFrame:
    """(finding_id, family): families of a finding's technique, and those with a keyword in its statement.

    findings: finding_id, technique, statement; families: family, techniques (array), keyword
    (a pattern, or null). The table of families is short; its patterns become one projection.
    """
    rows = families.orderBy("family").limit(MOST_FAMILIES + 1).collect()
    if len(rows) > MOST_FAMILIES:
        raise ValueError(f"a table of families has {MOST_FAMILIES} rows at most")
    by_word = [F.when(F.col("statement").rlike("(?i)" + r.keyword), F.lit(r.family)) for r in rows if r.keyword]
    by_technique = [F.when(F.col("technique").isin(list(r.techniques)), F.lit(r.family)) for r in rows if r.techniques]
    return findings.select("finding_id", F.explode(F.array_distinct(F.array_compact(F.array(*by_technique, *by_word)))).alias("family"))


def pivot_menu(records: DataFrame, cited: DataFrame) -> DataFrame:
    """(ref, pivot): the earliest time of records that were cited or carry a flag. records: ref, flags, times (array); cited: ref."""
    known = records.withColumn("pivot", F.array_min("times")).where("pivot is not null")
    flagged = F.size("flags") > 0
    return known.where(flagged).select("ref", "pivot").unionByName(known.where(~F.coalesce(flagged, F.lit(False))).join(cited.select("ref").distinct(), "ref", "left_semi").select("ref", "pivot"))


def correlated(selected: DataFrame) -> DataFrame:
    """(case, pattern, timeline): what the records that a person picked show together. selected: case, ref, at, kind.

    kind: file_times, account_created, group_add or another. The refs stand by time, unknown last.
    """
    has = lambda k: F.bool_or(F.col("kind") == k)
    sums = selected.groupBy("case").agg(has("file_times").alias("f"), has("account_created").alias("a"), has("group_add").alias("g"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(F.col("at").isNull().alias("late"), "at", "ref"))).alias("line"))
    both = F.col("a") & F.col("g")
    pattern = F.when(both & F.col("f"), "file_then_account_and_group").when(both, "account_and_group").when(F.col("n") >= 2, "compare")
    return sums.select("case", pattern.alias("pattern"), F.transform("line", lambda x: x.ref).alias("timeline"))


def timeline_visible(entries: DataFrame, allowed: DataFrame) -> DataFrame:
    """Entries with refs that are all allowed. entries: entry, refs."""
    each = entries.select("entry", F.explode(F.array_distinct("refs")).alias("ref")).join(allowed.select("ref", F.lit(1).alias("_ok")).distinct(), "ref", "left")
    return each.groupBy("entry").agg((F.count("_ok") == F.count("*")).alias("_all")).where("_all").select("entry")


def candidate_techniques(records: DataFrame, rules: DataFrame, *, key: str, scope: str) -> DataFrame:
    """(key, techniques): techniques that a record may show, sorted: those of its family in its scope, or where it has no family those of the scope that have none.

    records: key, scope, family; rules: scope, family, technique. The rules of a (scope,
    family) are gathered first, so a record meets one row. Records that no rule fits are
    left out.
    """
    known = rules.groupBy(F.col(scope).alias("_scope"), F.col("family").alias("_family")).agg(F.array_sort(F.collect_set("technique")).alias("techniques"))
    return records.join(known, (F.col(scope) == F.col("_scope")) & F.col("family").eqNullSafe(F.col("_family"))).select(key, "techniques")
