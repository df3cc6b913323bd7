"""Joins that need more than one equality: nearest in time, recursive closures, corroboration, comparison of two tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberlane.tables import written


def nearest_anchor(points: DataFrame, anchors: DataFrame, *, by: list[str], point: str, anchor: str, tolerance: int | None = None) -> DataFrame:
    """Adds ``distance``, the time to the nearest anchor before or after each point; null beyond ``tolerance``.

    Both sides are laid in one order per key and the last anchor before and the first
    after are carried along; no pair is formed. With a tolerance, time is also cut into
    buckets of that width, so that a key with very many rows is spread over tasks: an
    anchor is laid into its own bucket and the two beside it.
    """
    keys = list(by)
    p = points.withColumn("_t", F.col(point)).withColumn("_anchor", F.lit(None).cast("bigint"))
    a = anchors.select(*by, F.col(anchor).alias("_t")).distinct().withColumn("_anchor", F.col("_t"))
    if tolerance:
        p = p.withColumn("_bucket", F.floor(F.col("_t") / tolerance))
        a = a.withColumn("_bucket", F.explode(F.array(*(F.floor(F.col("_t") / tolerance) + d for d in (-1, 0, 1)))))
        keys.append("_bucket")
    both = p.withColumn("_is_point", F.lit(True)).unionByName(a.withColumn("_is_point", F.lit(False)), allowMissingColumns=True)
    before = F.last("_anchor", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_t").rangeBetween(Window.unboundedPreceding, 0))
    # the other way round, as a frame that grows is carried along and one that shrinks is read again for every row
    after = F.last("_anchor", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(F.desc("_t")).rangeBetween(Window.unboundedPreceding, 0))
    distance = F.least(F.col("_t") - before, after - F.col("_t"))
    if tolerance:
        distance = F.when(distance <= tolerance, distance)
    return both.withColumn("distance", distance).where("_is_point").select(*points.columns, "distance")


def tree_depth(rows: DataFrame, roots: DataFrame, *, key: str, parent: str, depth: int | None = None) -> DataFrame:
    """(key, depth): rows reached from the roots through parents, level by level, at their least depth; all levels, or the first ``depth``.

    Each level is one join of the edges with the level before, written to the shared folder.
    """
    edges = written(rows.select(F.col(key).alias("k"), F.col(parent).alias("p")).where("k is not null and p is not null").distinct(), "edges")
    level = written(roots.select(F.col(key).alias("k")).distinct().withColumn("depth", F.lit(0)), "level")
    reached = level
    while not level.isEmpty() and (depth is None or level.first().depth < depth):
        found = edges.join(level.select(F.col("k").alias("p"), "depth"), "p").groupBy("k").agg((F.first("depth") + 1).alias("depth"))
        level = written(found.join(reached, "k", "left_anti"), "level")
        reached = reached.unionByName(level)
    return reached.select(F.col("k").alias(key), "depth")


def parent_chain(rows: DataFrame, *, key: str, parent: str, name: str, root: int, depth: int = 16) -> DataFrame:
    """(key, path): names from the root down; a missing or own parent, a circle or more than ``depth`` levels above the row end the chain.

    Each round joins a chain with the chain of the row that it has come to, so that chains
    double: as many joins as the depth has binary digits, each written to the shared folder.
    """
    up = F.when((F.col(parent) != root) & (F.col(parent) != F.col(key)), F.col(parent))
    now = written(rows.select(F.col(key).alias("k"), F.array(key).alias("met"), F.array(name).alias("names"), up.alias("next")), "chains")
    for _ in range(depth.bit_length()):
        ahead = now.where(F.get("names", F.lit(0)).isNotNull()).select(F.col("k").alias("next"), F.col("met").alias("_met"), F.col("names").alias("_names"), F.col("next").alias("_next"))
        moved = now.where("next is not null").join(ahead, "next", "left")
        # places of the part ahead that were met before: the chain ends in front of the first
        again = F.array_min(F.filter(F.transform("_met", lambda k, i: F.when(F.array_contains("met", k), i)), lambda i: i.isNotNull()))
        fresh = F.coalesce(F.col("_again"), F.size("_met"))
        longer = moved.withColumn("_again", again).select(
            "k",
            F.when(F.col("_met").isNull(), F.col("met")).otherwise(F.concat("met", F.slice("_met", F.lit(1), fresh))).alias("met"),
            F.when(F.col("_met").isNull(), F.col("names")).otherwise(F.concat("names", F.slice("_names", F.lit(1), fresh))).alias("names"),
            F.when(F.col("_again").isNull(), F.col("_next")).alias("next"),
        )
        now = written(now.where("next is null").unionByName(longer), "chains")
    return now.select(F.col("k").alias(key), F.array_join(F.reverse(F.slice("names", 1, depth + 1)), "/").alias("path"))


def lifecycle(starts: DataFrame, stops: DataFrame, children: DataFrame, *, key: str = "guid", at: str = "at", within: int = 2_000_000) -> DataFrame:
    """Start joined with its last stop and its children: lifetime, number of children, those soon after the start, last child."""
    last = lambda df, n: df.groupBy(key).agg(F.max_by(at, "ordinal").alias(n))
    born = last(starts, "start_at")
    ended = last(stops, "stop_at")
    parents = born.select(F.col(key).alias("parent"), F.col("start_at").alias("_start"))
    offspring = children.join(parents, "parent").groupBy(F.col("parent").alias(key)).agg(F.count("*").alias("child_count"), F.count_if(F.col(at).between(F.col("_start"), F.col("_start") + within)).alias("children_soon"), F.max(at).alias("last_child_at"))
    joined = born.join(ended, key, "left").join(offspring, key, "left")
    lifetime = F.when(F.col("stop_at") >= F.col("start_at"), F.bround((F.col("stop_at") - F.col("start_at")) / 1_000_000, 6))
    return joined.select(key, "start_at", lifetime.alias("lifetime_seconds"), F.coalesce("child_count", F.lit(0)).alias("child_count"), F.coalesce("children_soon", F.lit(0)).alias("children_soon"), "last_child_at")


def corroboration(rows: DataFrame, *, value: str, artifact: str, ref: str, per_artifact: int = 2) -> DataFrame:
    """(ref, refs): for each record, the first records of other artifacts that share a value, a few per artifact.

    The few of every (value, artifact) are found first, so a common value never pairs all its rows.
    """
    known = rows.where(F.col(value).isNotNull()).select(F.col(value).alias("v"), F.col(artifact).alias("a"), F.col(ref).alias("r")).distinct()
    few = known.withColumn("n", F.row_number().over(Window.partitionBy("v", "a").orderBy("r"))).where(F.col("n") <= per_artifact)
    pairs = known.alias("x").join(few.alias("y"), (F.col("x.v") == F.col("y.v")) & (F.col("x.a") != F.col("y.a")))
    return pairs.groupBy(F.col("x.r").alias("ref")).agg(F.array_join(F.array_sort(F.collect_set(F.col("y.r").cast("string"))), ",").alias("refs"))


def seeded_closure(rows: DataFrame, seeds: DataFrame, *, identity: str, parent: str, at: str, order: str, within: int, most: int) -> DataFrame:
    """Rows of a seed's identity, or children of it, within some time of a seed; the first ``most`` by order.

    A row meets the nearest seed of its identity and of its parent, each by one order of
    both sides, so an identity with very many rows and seeds forms no pairs.
    """
    s = seeds.where(F.col(identity).isNotNull()).select(F.col(identity).alias("_key"), F.col(at).alias("_seed"))

    def near(df: DataFrame, key: str, out: str) -> DataFrame:
        met = nearest_anchor(df.withColumn("_key", F.col(key)), s, by=["_key"], point=at, anchor="_seed", tolerance=within)
        return met.withColumn(out, F.col("distance").isNotNull() & F.col("_key").isNotNull()).drop("_key", "distance")

    hit = near(near(rows, identity, "_own"), parent, "_born").where("_own or _born").select(*rows.columns)
    return hit.orderBy(order).limit(most)


def compare_tables(left: DataFrame, right: DataFrame, *, key: list[str], columns: dict[str, float]) -> DataFrame:
    """(key, problem, column): rows missing on a side, and values that differ by more than the column's tolerance."""
    l = left.select(*key, *(F.col(c).alias(f"l_{c}__") for c in columns), F.lit(True).alias("_l"))
    r = right.select(*key, *(F.col(c).alias(f"r_{c}__") for c in columns), F.lit(True).alias("_r"))
    both = l.join(r, key, "full_outer")
    missing = F.when(F.col("_l").isNull(), F.array(F.struct(F.lit("extra").alias("problem"), F.lit("").alias("column")))).when(F.col("_r").isNull(), F.array(F.struct(F.lit("missing").alias("problem"), F.lit("").alias("column"))))
    differs = [F.when(~F.coalesce(F.abs(F.col(f"l_{c}__") - F.col(f"r_{c}__")) <= tolerance, F.col(f"l_{c}__").eqNullSafe(F.col(f"r_{c}__"))), F.struct(F.lit("different").alias("problem"), F.lit(c).alias("column"))) for c, tolerance in columns.items()]
    return both.select(*key, F.explode(F.coalesce(missing, F.array_compact(F.array(*differs)))).alias("p")).select(*key, "p.problem", "p.column")


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)
