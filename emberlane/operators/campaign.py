"""Links between hosts: values that several of them observed, and addresses that one is seen to use of another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Grades from best to worst.
PASSED, WARNING, CONTEXT = 0, 1, 2


def representatives(observations: DataFrame) -> DataFrame:
    """The best observation of each (node, axis, value): by grade, then time with unknown last, then place in the input.

    observations: node, axis, value, grade, at, ordinal, ref. Rejected ones (null grade) are left out.
    """
    first = F.min_by(F.struct("grade", "at", "ref", "ordinal"), F.struct("grade", F.col("at").isNull(), "at", "ordinal"))
    return observations.where("grade is not null").groupBy("node", "axis", "value").agg(first.alias("r")).select("node", "axis", "value", "r.*")


def links(observations: DataFrame, total_nodes: int, background: Column | None = None) -> DataFrame:
    """One row a (axis, value) that two or more nodes observed.

    kind is ``ubiquitous`` when three or more nodes exist and all have the value,
    ``context`` when every observation is background, else by the worst grade
    ``passed``, ``warning`` or ``context``.
    """
    reps = representatives(observations)
    own = F.lit(False) if background is None else background
    grouped = (
        reps.withColumn("own", own)
        .groupBy("axis", "value")
        .agg(
            F.count("*").alias("nodes"),
            F.max("grade").alias("worst"),
            F.bool_and("own").alias("background"),
            F.min("at").alias("first_at"),
            F.max("at").alias("last_at"),
            F.count("at").alias("times"),
            F.array_sort(F.collect_list(F.struct(F.col("at").isNull().alias("late"), "at", "node", "ref"))).alias("seen"),
        )
        .where("nodes >= 2")
    )
    kind = F.when((F.lit(total_nodes) >= 3) & (F.col("nodes") == total_nodes), "ubiquitous").when(F.col("background"), "context").when(F.col("worst") == PASSED, "passed").when(F.col("worst") == WARNING, "warning").otherwise("context")
    span = F.when(F.col("times") >= 2, F.bround((F.col("last_at") - F.col("first_at")) / 1_000_000, 3))
    return grouped.select("axis", "value", F.col("nodes").cast("bigint").alias("nodes"), kind.alias("kind"), span.alias("span_seconds"), "first_at", F.transform("seen", lambda s: s.node).alias("chain"), F.transform("seen", lambda s: s.at).alias("times"))


def peer_links(own: DataFrame, seen: DataFrame) -> DataFrame:
    """(from_node, to_node, value, n): a node observed an address that another has for its own."""
    return seen.alias("s").join(own.alias("o"), (F.col("s.value") == F.col("o.value")) & (F.col("s.node") != F.col("o.node"))).groupBy(F.col("s.node").alias("from_node"), F.col("o.node").alias("to_node"), F.col("s.value").alias("value")).agg(F.count("*").alias("n"))


def unambiguous_hosts(hosts: DataFrame) -> DataFrame:
    """Clears a host name that more than one node claims."""
    claims = hosts.groupBy("host").agg(F.countDistinct("node").alias("claims"))
    return hosts.join(claims, "host", "left").select("node", F.when(F.col("claims") == 1, F.col("host")).alias("host"))


def edges(found: DataFrame) -> DataFrame:
    """(from_node, to_node, axes): neighbours in the chains of links, both with a known time, and the axes that join them."""
    pair = found.select("axis", F.explode(F.transform(F.sequence(F.lit(1), F.size("chain") - 1), lambda i: F.struct(F.element_at("chain", i).alias("a"), F.element_at("chain", i + 1).alias("b"), F.element_at("times", i).alias("ta"), F.element_at("times", i + 1).alias("tb")))).alias("e"))
    return pair.where("e.ta is not null and e.tb is not null").groupBy(F.col("e.a").alias("from_node"), F.col("e.b").alias("to_node")).agg(F.array_join(F.array_sort(F.collect_set("axis")), ",").alias("axes"))


def best_verdicts(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(ref, rank): the best verdict of the findings that cite a record. findings: finding_id, refs; verdicts: finding_id, rank."""
    return findings.select("finding_id", F.explode("refs").alias("ref")).join(verdicts, "finding_id").groupBy("ref").agg(F.min("rank").alias("rank"))


def coverage_matrix(rows: DataFrame, nodes: list[str]) -> DataFrame:
    """Strongest status of each family on each node: rows family, node, rank to a column a node, 0 where nothing is known."""
    return rows.groupBy("family").pivot("node", nodes).agg(F.max("rank")).na.fill(0)


def build(observations: DataFrame, own: DataFrame, seen: DataFrame, *, nodes: int, axes: list[str], background: Column | None = None) -> DataFrame:
    """(axis, value, kind, from_node, to_node, first_at, chain, axis_rank): links between hosts and addresses that one used of another.

    They read in the order of first_at with unknown last, axis_rank, value and hosts. A peer
    link has the axis ``peer`` and the first time at which it was seen. own: node, value; seen: node, value, at.
    """
    found = links(observations, nodes, background).where("kind <> 'ubiquitous'").select("axis", "value", "kind", F.lit(None).cast("string").alias("from_node"), F.lit(None).cast("string").alias("to_node"), "first_at", F.array_join("chain", ",").alias("chain"))
    s, o = seen.groupBy("node", "value").agg(F.min("at").alias("at")).alias("s"), own.distinct().alias("o")
    pairs = s.join(o, (F.col("s.value") == F.col("o.value")) & (F.col("s.node") != F.col("o.node")))
    peers = pairs.select(F.lit("peer").alias("axis"), F.col("s.value").alias("value"), F.lit("passed").alias("kind"), F.col("s.node").alias("from_node"), F.col("o.node").alias("to_node"), F.col("s.at").alias("first_at"), F.concat_ws(",", "s.node", "o.node").alias("chain"))
    rank = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for i, a in enumerate(axes) for x in (a, i))), F.col("axis")), F.lit(len(axes)))
    return found.unionByName(peers).withColumn("axis_rank", rank)
