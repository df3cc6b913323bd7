"""Planning a scan: techniques to artifacts, deferral, exclusion, baseline and scopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def requests_of(techniques: DataFrame, mappings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests, techniques without a mapping). The first request of each (technique, artifact, tier) counts."""
    found = techniques.join(mappings, "technique")
    first = found.withColumn("_n", F.row_number().over(Window.partitionBy("technique", "artifact", "tier").orderBy("ordinal"))).where("_n = 1").drop("_n")
    return first, techniques.join(mappings.select("technique").distinct(), "technique", "left_anti")


def selected(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """(artifact, priority, techniques): usable artifacts of the first tier, at their strongest priority."""
    usable = requests.where("tier = 1").join(catalog.where("usable"), "artifact")
    return usable.groupBy("artifact").agg(F.least(F.min("priority"), F.lit(2)).alias("priority"), F.array_join(F.array_sort(F.collect_set("technique")), ",").alias("techniques"))


def deferred(requests: DataFrame, catalog: DataFrame, chosen: DataFrame) -> DataFrame:
    later = requests.where("tier = 2").join(catalog.where("usable"), "artifact").join(chosen, "artifact", "left_anti")
    return later.groupBy("artifact").agg(F.min("priority").alias("priority"))


def excluded(catalog: DataFrame, chosen: DataFrame, later: DataFrame) -> DataFrame:
    """Every catalogued artifact that is neither chosen nor deferred, with the reason."""
    taken = chosen.select("artifact").unionByName(later.select("artifact"))
    return catalog.join(taken, "artifact", "left_anti").select("artifact", F.when(F.col("usable"), "not requested").otherwise("unsupported").alias("reason"))


def with_baseline(chosen: DataFrame, baseline: DataFrame) -> DataFrame:
    """Upsert of (artifact, events): a chosen artifact restricted to events gets the baseline's too, an unrestricted one stays, a missing one is added."""
    c, b = chosen.select("artifact", F.col("events").alias("own"), F.lit(True).alias("has")), baseline.select("artifact", F.col("events").alias("extra"))
    both = c.join(b, "artifact", "full_outer")
    events = F.when(F.col("has").isNull(), F.col("extra")).when(F.col("own").isNull() | F.col("extra").isNull(), F.col("own")).otherwise(F.array_sort(F.array_union("own", "extra")))
    return both.select("artifact", events.alias("events"), F.when(F.col("has"), "selected").otherwise("baseline").alias("origin"))


def evidence_index(requests: DataFrame) -> DataFrame:
    """(technique, artifact, events): united event ids; unrestricted anywhere is unrestricted."""
    return requests.groupBy("technique", "artifact").agg(F.when(F.bool_or(F.col("events").isNull()), None).otherwise(F.array_sort(F.array_distinct(F.flatten(F.collect_list("events"))))).alias("events"))


def merge_scopes(scopes: DataFrame, *, by: str, lists: list[str], start: str, end: str) -> DataFrame:
    """One scope a key: united lists, least start, greatest end. A scope that omits a key does not widen it."""
    united = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in lists]
    return scopes.groupBy(by).agg(*united, F.min(start).alias(start), F.max(end).alias(end))


def applicable(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``applies``: the build lies in the rule's range; open ends are open."""
    joined = rows.join(rules, "artifact", "left")
    return joined.withColumn("applies", (F.col("build") >= F.coalesce("min_build", F.lit(0))) & (F.col("build") <= F.coalesce("max_build", F.lit(1 << 30))))


def forced_names(names: list[str], catalog: DataFrame) -> DataFrame:
    """(artifact, ordinal): catalogued artifacts named exactly, or by a group that they begin with (``group:``). A name that finds none is an error.

    The names are a short list from a user.
    """
    named = lambda n: (F.col("artifact") == n) | F.col("artifact").startswith(f"{n}:")
    ordinal = F.coalesce(*(F.when(named(n), F.lit(i).cast("bigint")) for i, n in enumerate(names)), F.lit(None).cast("bigint"))
    found = catalog.select("artifact").distinct().withColumn("ordinal", ordinal).where("ordinal is not null")
    met = catalog.agg(*(F.max(named(n)).alias(f"n{i}") for i, n in enumerate(names)), F.lit(0)).first()
    missing = sorted({n for i, n in enumerate(names) if not met[i]})
    if missing:
        raise ValueError(f"no such artifact: {', '.join(missing)}")
    return found


def with_forced(chosen: DataFrame, forced: DataFrame, later: DataFrame, catalog: DataFrame) -> DataFrame:
    """(artifact, priority, origin): what was chosen, and forced artifacts that can be read: promoted with their deferred scope, or added with only a time range. Those chosen already stay as they are."""
    new = forced.select("artifact").distinct().join(catalog.where("usable").select("artifact"), "artifact", "left_semi").join(chosen, "artifact", "left_anti").join(later.select("artifact", F.lit(True).alias("_later")), "artifact", "left")
    return chosen.select("artifact", "priority", F.lit("selected").alias("origin")).unionByName(new.select("artifact", F.lit(1).alias("priority"), F.when(F.col("_later"), "promoted").otherwise("time_range_only").alias("origin")))


def selection_stats(chosen: DataFrame, later: DataFrame, left_out: DataFrame) -> DataFrame:
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return n(chosen, "selected").join(n(later, "deferred"), F.lit(True)).join(n(left_out, "excluded"), F.lit(True))  # one row each


def rounds_compared(first: DataFrame, second: DataFrame) -> DataFrame:
    """(artifact, change): added, removed, rescoped or same between two rounds. Both: artifact, scope (a scope_key)."""
    both = first.select("artifact", F.col("scope").alias("a"), F.lit(True).alias("_a")).join(second.select("artifact", F.col("scope").alias("b"), F.lit(True).alias("_b")), "artifact", "full_outer")
    return both.select("artifact", F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("rescoped").alias("change"))
