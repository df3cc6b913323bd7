"""Fields of a record by name, keys of maps and lists, and small conversions, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlane.functions.times import parse_micros


def lookup(data: Column, name: Column) -> Column:
    """(present, value) of a dotted name in a map: the name as given, else with or without a leading ``fields.``.

    A field that is there with a null is present.
    """
    other = F.when(name.startswith("fields."), F.regexp_replace(name, r"^fields\.", "")).otherwise(F.concat(F.lit("fields."), name))
    own, by_other = F.map_contains_key(data, name), F.map_contains_key(data, other)
    value = F.when(own, F.try_element_at(data, name)).otherwise(F.try_element_at(data, other))
    return F.struct(F.coalesce(own | by_other, F.lit(False)).alias("present"), value.alias("value"))


def record_blob(document: Column) -> Column:
    """All keys and values of a JSON object in lower case; a nested member counts with its own keys and values, as JSON text."""
    members = F.map_entries(F.from_json(document, "map<string,string>"))
    return F.lower(F.array_join(F.transform(members, lambda m: F.concat_ws(" ", m.key, m.value)), " "))


def scope_key(**parts: Column) -> Column:
    """One text for a scope, whatever the order and repeats of its lists; parts in the order of their names."""
    return F.to_json(F.struct(*(F.array_sort(F.array_distinct(c)).alias(n) for n, c in sorted(parts.items()))))


def numbered_keys(keys: Column) -> Column:
    """Repeated keys as ``k``, ``k#2``, ``k#3`` in order."""
    seen = lambda k, i: F.size(F.filter(F.slice(keys, F.lit(1), i + 1), lambda x: x == k))
    return F.transform(keys, lambda k, i: F.when(seen(k, i) == 1, k).otherwise(F.concat(k, F.lit("#"), seen(k, i).cast("string"))))


def renamed_keys(data: Column, names: Column) -> Column:
    """Keys of a map by a table of new names; one that is there already is never overwritten, and the first of several wins."""
    keys = F.map_keys(data)
    new = F.transform(keys, lambda k: F.try_element_at(names, k))

    def rename(k: Column, _: Column) -> Column:
        to = F.try_element_at(names, k)
        first = F.array_position(new, to) == F.array_position(keys, k)
        return F.when(to.isNotNull() & ~F.array_contains(keys, to) & first, to).otherwise(k)

    return F.transform_keys(data, rename)


def without_empty_tail(items: Column) -> Column:
    """A list without the nulls and empty texts at its end."""
    last = F.array_max(F.transform(items, lambda x, i: F.when(x.isNotNull() & (x != ""), i + 1)))
    return F.slice(items, F.lit(1), F.coalesce(last, F.lit(0)))


def flag_dump(reason: Column, flags: list[str]) -> Column:
    """A reason that says nothing but flags and words that join them."""
    tokens = F.filter(F.transform(F.split(F.trim(reason), r"[\s,;/|]+"), lambda t: F.regexp_replace(t, r"^[\"'`()\[\]{}.:]+|[\"'`()\[\]{}.:]+$", "")), lambda t: t != "")
    return F.forall(tokens, lambda t: t.isin(flags) | F.lower(t).isin("and", "or", "+", "-", "~"))


def process_identity(guid: Column, image: Column, pid: Column) -> Column:
    """The GUID, or image and number where there is none."""
    known = F.trim(guid).isNotNull() & ~F.trim(guid).isin("", "-")
    return F.when(known, F.lower(F.trim(guid))).otherwise(F.concat(F.lower(image), F.lit("#"), pid.cast("string")))


def activity_times(own: Column, others: list[Column]) -> Column:
    """Microseconds of a record's own time if it has one, else of the other times that can be read."""
    return F.when(own.isNotNull(), F.array_compact(F.array(parse_micros(own)))).otherwise(F.array_compact(F.array(*map(parse_micros, others))))


def install_date_micros(text: Column) -> Column:
    """A time that may also be written ``MM/dd/yyyy`` with or without a clock."""
    day = F.when(text.rlike(r"^[0-9]{2}/[0-9]{2}/[0-9]{4}$"), F.concat(text, F.lit(" 00:00:00"))).when(text.rlike(r"^[0-9]{2}/[0-9]{2}/[0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2}$"), text)
    iso = F.concat(F.substring(day, 7, 4), F.lit("-"), F.substring(day, 1, 2), F.lit("-"), F.substring(day, 4, 2), F.lit("T"), F.substring(day, 12, 8), F.lit("Z"))
    return F.coalesce(parse_micros(text), parse_micros(iso))


def int_or_zero(value: Column) -> Column:
    return F.coalesce(F.trim(value).try_cast("bigint"), F.lit(0).cast("bigint"))


#: Confidence of a severity (fixed values); any other counts as medium.
CONFIDENCE = {"critical": 0.95, "high": 0.9, "medium": 0.7, "low": 0.5, "informational": 0.3}


def confidence_of(severity: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in CONFIDENCE.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(severity)), F.lit(CONFIDENCE["medium"]))


def first_clause(text: Column, keywords: list[str]) -> Column:
    """The first clause of a text that holds one of the keywords; null where none does."""
    clauses = F.transform(F.split(text, r"[.;\n]+"), lambda c: F.trim(c))
    return F.get(F.filter(clauses, lambda c: F.lower(c).rlike("|".join("\\Q" + k.lower() + "\\E" for k in keywords))), F.lit(0))


def self_address(event_id: Column, initiated: Column, source: Column) -> Column:
    """A host's own address, told by a connection that it opened itself."""
    return F.when((event_id == 3) & (F.lower(F.trim(initiated)) == "true"), source)
