"""Typed comparison of a claimed and an observed value, both given as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlane.functions.text import display_string, normalize_path
from emberlane.functions.times import parse_micros


def scalar_equal(a: Column, b: Column) -> Column:
    """Truth values first, then numbers, then trimmed text."""
    truth = lambda c: F.when(F.lower(F.trim(c)).isin("true", "false"), F.lower(F.trim(c)) == "true")
    number = lambda c: F.trim(c).try_cast("double")
    return (
        F.when(truth(a).isNotNull() & truth(b).isNotNull(), truth(a) == truth(b))
        .when(number(a).isNotNull() & number(b).isNotNull(), number(a) == number(b))
        .otherwise(F.trim(a) == F.trim(b))
    )


def typed_equal(claimed: Column, observed: Column, is_path: Column, tolerance_seconds: float | Column, times: tuple[Column, Column] | None = None) -> Column:
    """Times within a tolerance, paths normalised, indirect strings by their display part, else scalars; any element of an observed list, a JSON array.

    A time and something else are different. ``times`` are both as microseconds, where they are columns already.
    """
    ta, tb = times or (parse_micros(claimed), parse_micros(observed))

    def one(seen: Column, t: Column) -> Column:
        return (
            F.when(ta.isNotNull() & t.isNotNull(), F.abs(ta - t) <= tolerance_seconds * 1_000_000)
            .when(ta.isNotNull() | t.isNotNull(), False)
            .when(is_path, normalize_path(claimed) == normalize_path(seen))
            .otherwise(scalar_equal(claimed, seen) | (display_string(seen) == claimed))
        )

    listed = F.when(observed.startswith("["), F.from_json(observed, "array<string>"))
    return F.when(claimed.isNull() | observed.isNull(), False).when(F.coalesce(F.size(listed) > 0, F.lit(False)) & F.coalesce(F.exists(listed, lambda x: one(x, parse_micros(x))), F.lit(False)), True).otherwise(one(observed, tb))


#: Fields that hold paths, by name or ending (fixed values).
PATH_FIELDS = ["path", "target_path", "source_path", "image_path", "image", "imagepath", "imageloaded", "parentimage", "sourceimage", "targetimage", "targetfilename", "originalfilename", "currentdirectory", "processname", "parentprocessname", "newprocessname", "lowercaselongpath"]


def is_path_field(field: Column) -> Column:
    leaf = F.lower(F.element_at(F.split(field, r"\."), -1))
    return leaf.isin(PATH_FIELDS) | leaf.endswith("_path") | leaf.endswith("filename")


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """Null where the whole is zero; halves are rounded to even."""
    return F.bround(F.try_divide(part.cast("double"), whole.cast("double")), digits)


def assertion(predicate: Column, subject: Column, object_: Column, tolerance_seconds: Column, times: tuple[Column, Column] | None = None, paths: tuple[Column, Column] | None = None) -> Column:
    """Whether a typed assertion holds between two endpoints given as text, lists with commas; a missing endpoint or unknown predicate rejects. ``times`` and ``paths`` are both endpoints read as such, where they are columns already."""
    from emberlane.functions.text import hash_set, nt_normalize, under_path

    ps, po = paths or (nt_normalize(subject), nt_normalize(object_))
    inside = under_path(ps, po)  # "c:\\data\\..\\x" is not under "c:\\data"
    ts, to = times or (parse_micros(subject), parse_micros(object_))
    number = lambda c: F.trim(c).try_cast("double")
    low = lambda c: F.lower(F.trim(c))
    items = F.split(subject, ",")
    held = (
        F.when(predicate == "equals", typed_equal(object_, subject, F.lit(False), tolerance_seconds, (to, ts)))
        .when(predicate == "contains", F.lower(subject).contains(F.lower(object_)))
        .when(predicate == "list_contains", F.exists(items, lambda x: low(x).contains(F.lower(object_))))
        .when(predicate == "under_path", inside)
        .when(predicate == "outside_path", ~inside)
        .when(predicate == "same_path", ps == po)
        .when(predicate == "same_hash", F.arrays_overlap(hash_set(subject), hash_set(object_)))
        .when(predicate == "before", ts < to)
        .when(predicate == "after", ts > to)
        .when(predicate == "within", F.abs(ts - to) <= tolerance_seconds * 1_000_000)
        .when(predicate == "spawned", F.exists(items, lambda x: low(x) == low(object_)))
        .when(predicate == "duration", F.abs(number(subject) - number(object_)) <= tolerance_seconds)
        .when(predicate == "count", number(subject) == number(object_))
    )
    return F.coalesce(held, F.lit(False))
