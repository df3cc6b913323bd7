"""Open objects of any depth as rows: every member with its path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlane.tables import written


def _kind(value: Column) -> Column:
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), "object").when(F.schema_of_variant(value).startswith("ARRAY"), "array").otherwise("scalar")


def walk(rows: DataFrame, *, key: str, value: str) -> DataFrame:
    """(key, path, name, kind, text): all members of the VARIANT ``value`` of each row, at every depth, in no order.

    path has a dot before the name of an object's member and [i] for the i-th of an array,
    kind is object, array, scalar or null, text is that of a scalar. A value that is a scalar
    itself is one row with an empty path; a null value has no row, an empty object or array
    one. Levels are walked one after the other, each by one explosion of the objects and
    arrays of the level before, without a shuffle; a level is written, so that the walk ends
    where no more are found.
    """
    text = lambda v: F.try_variant_get(v, "$", "string")
    kind = lambda v: F.when(F.is_variant_null(v), "null").otherwise(_kind(v))
    top = rows.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.lit("").alias("path"), F.lit("").alias("name"), F.col(value).alias("v"))
    level = written(top.withColumn("kind", kind(F.col("v"))), "members")
    found = [level]
    while True:
        open_ = level.where("kind in ('object', 'array')")
        if open_.isEmpty():
            break
        open_.createOrReplaceTempView("_open_members")
        below = rows.sparkSession.sql("select k, path as up, kind as of, e.pos as pos, e.key as name, e.value as v from _open_members, lateral variant_explode(v) e")
        rows.sparkSession.catalog.dropTempView("_open_members")
        path = F.when(F.col("of") == "array", F.concat("up", F.lit("["), "pos", F.lit("]"))).when(F.col("up") == "", F.col("name")).otherwise(F.concat("up", F.lit("."), "name"))
        level = written(below.select("k", path.alias("path"), F.coalesce("name", F.col("pos").cast("string")).alias("name"), "v").withColumn("kind", kind(F.col("v"))), "members")
        found.append(level)
    out = found[0]
    for one in found[1:]:
        out = out.unionByName(one)
    return out.select(F.col("k").alias(key), "path", "name", "kind", F.when(F.col("kind") == "scalar", text(F.col("v"))).alias("text"))


def _blob_part() -> Column:
    """Name and text of a member; numbers of array places are no names."""
    in_array = F.col("path").endswith("]")
    return F.concat_ws(" ", F.when(~in_array & (F.col("path") != ""), F.col("name")), F.col("text"))


def _in_order(kept: Column, what: str) -> Column:
    """A column of the members where ``kept`` holds, as a list in the order of their paths."""
    return F.transform(F.array_sort(F.collect_list(F.when(kept, F.struct("path", what)))), lambda x: x[what])


def strings(members: DataFrame, *, key: str) -> DataFrame:
    """(key, blob): names of members and texts of scalars in lower case, in the order of their paths; numbers of array places are no names."""
    each = members.select(key, "path", _blob_part().alias("p")).where("p <> ''")
    return each.groupBy(key).agg(F.lower(F.array_join(_in_order(F.lit(True), "p"), " ")).alias("blob"))


def scalars(members: DataFrame, *, key: str) -> DataFrame:
    """(key, values): texts of the scalars at any depth, in the order of their paths."""
    return members.where("kind = 'scalar'").groupBy(key).agg(_in_order(F.lit(True), "text").alias("values"))


def texts(members: DataFrame, *, key: str) -> DataFrame:
    """(key, blob, values): strings and scalars of the keys that have both; the members are read and dealt out once."""
    part = F.col("p") != ""
    each = members.select(key, "path", "kind", "text", _blob_part().alias("p")).where(part | (F.col("kind") == "scalar"))
    both = each.groupBy(key).agg(_in_order(part, "p").alias("_parts"), _in_order(F.col("kind") == "scalar", "text").alias("values"))
    return both.where((F.size("_parts") > 0) & (F.size("values") > 0)).select(key, F.lower(F.array_join("_parts", " ")).alias("blob"), "values")


def largest_number(members: DataFrame, names: list[str], *, key: str) -> DataFrame:
    """(key, most): the greatest number of zero or more, given as a number or as text, of the members with one of the names, in any case, at any depth."""
    number = F.col("text").try_cast("decimal(38,0)")
    named = members.where((F.col("kind") == "scalar") & F.lower("name").isin([n.lower() for n in names]))
    return named.where(number >= 0).groupBy(key).agg(F.max(number).alias("most"))
