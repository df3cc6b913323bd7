"""The JSON object in a free text, as language models write it: bare, in a code fence, or between sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlane.functions.text import let

_FENCE = r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$"
#: Runs without a mark, and single marks with the backslash before them.
_TOKEN = r'(?s)[^"\\{}\[\]]++|\\?.'


def _closed_after(text: Column, opening: str, closing: str) -> Column:
    """Characters up to the mark that closes the first one, or, for a text that begins with a quote, up to the end of that string; null where none does.

    The text is cut into runs and marks once, and the depth, whether a string is open, and
    the length so far are carried over them: time in proportion to the text.
    """
    state = lambda depth, inside, size, end: F.named_struct(F.lit("depth"), depth.cast("int"), F.lit("inside"), inside, F.lit("size"), size.cast("int"), F.lit("end"), end.cast("int"))

    def step(at: Column, token: Column) -> Column:
        mark, escaped = F.right(token, F.lit(1)), (F.length(token) == 2) & token.startswith("\\")
        single = (F.length(token) == 1) | escaped
        quote = single & (mark == '"') & ~(at.inside & escaped)
        size = at.size + F.length(token)
        change = F.when(at.inside | ~single, 0).when(mark.isin(*opening), 1).when(mark.isin(*closing), -1).otherwise(0)
        closed = (at.depth == 1) & (change == -1) | (at.depth == 0) & at.inside & quote
        return F.when(at.end.isNotNull(), at).otherwise(state(at.depth + change, F.when(quote, ~at.inside).otherwise(at.inside), size, F.when(closed, size)))

    return F.aggregate(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), state(F.lit(0), F.lit(False), F.lit(0), F.lit(None)), step, lambda at: at.end)


def first_object(text: Column) -> Column:
    """From the first opening brace to the one that closes it; braces and quotes in strings do not count; null without a brace, or where none closes it."""
    start = F.locate("{", text)
    tail = F.substring(text, start, F.length(text))
    return F.when(start > 0, let(_closed_after(tail, "{", "}"), lambda n: F.when(n.isNotNull(), F.substring(tail, F.lit(1), n))))


def _whole_value(text: Column) -> Column:
    """Whether a text is one JSON value from end to end that is no object: parse_json alone reads a value and leaves what follows."""
    ends = F.when(text.rlike(r'^["\[]'), _closed_after(text, "[{", "]}") == F.length(text)).otherwise(text.rlike(r"^(?:true|false|null|-?[0-9][0-9.eE+-]*+)$"))
    return F.coalesce(ends, F.lit(False)) & F.try_parse_json(text).isNotNull()


def extract_object(text: Column) -> Column:
    """(object, problem): the VARIANT object of a text, or why there is none: empty, not_an_object, cut_off (a brace that is never closed) or not_found.

    Tried are the whole text, the text in a fence around it, and the first object in it;
    the first that is JSON decides.
    """
    clean = F.regexp_replace(text, r"^\s++|(?<!\s)\s++$", "")
    body = F.when(text.rlike(_FENCE), F.regexp_extract(text, _FENCE, 1))
    answer = lambda v, problem: F.named_struct(F.lit("object"), v, F.lit("problem"), problem)
    none = F.lit(None).cast("variant")
    other = lambda name: answer(none, F.lit(name))
    # a text that is an object from end to end is its own first object
    between = let(first_object(text), lambda part: F.when(F.try_parse_json(part).isNotNull(), answer(F.try_parse_json(part), F.lit(None).cast("string"))).when(part.isNull() & text.contains("{"), other("cut_off")).otherwise(other("not_found")))
    return F.when(F.coalesce(clean, F.lit("")) == "", other("empty")).when(_whole_value(clean) | F.coalesce(_whole_value(body), F.lit(False)), other("not_an_object")).otherwise(between)
