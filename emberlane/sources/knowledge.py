"""Rules, signals and families as documents: typed, with every unknown or missing key an error that names its place.

A document is JSON (or YAML, where PyYAML is there): {"version": 1, "rules": [...]}, or
"signals" or "families". It is read through Spark, so it may lie in any store, and becomes
the same values that the operators take as Python: they compile them to Columns.
"""

from __future__ import annotations

import dataclasses
import json
import re
import types
import typing
from typing import Any

from pyspark.sql import SparkSession

from emberlane.operators.attention import Signal
from emberlane.operators.behaviour import Family
from emberlane.operators.rules import EXTRAS, Rule

#: Lists of a document and what their members are.
KINDS = {"rules": Rule, "signals": Signal, "families": Family}
VERSION = 1


class KnowledgeError(ValueError):
    """A document that is not as it should be; the text begins with the place."""


def typed(kind: Any, data: Any, at: str) -> Any:
    """data as a value of a type: dataclasses from objects, tuples from lists, and plain values; nothing is converted silently."""
    if dataclasses.is_dataclass(kind):
        if not isinstance(data, dict):
            raise KnowledgeError(f"{at}: an object is needed, not {type(data).__name__}")
        hints, fields = typing.get_type_hints(kind), {f.name: f for f in dataclasses.fields(kind)}
        unknown = sorted(set(data) - set(fields))
        if unknown:
            raise KnowledgeError(f"{at}.{unknown[0]}: no such key")
        missing = [n for n, f in fields.items() if n not in data and f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING]
        if missing:
            raise KnowledgeError(f"{at}.{missing[0]}: missing")
        return kind(**{n: typed(hints[n], v, f"{at}.{n}") for n, v in data.items()})
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if kind is tuple or origin is tuple:
        if not isinstance(data, list):
            raise KnowledgeError(f"{at}: a list is needed, not {type(data).__name__}")
        return tuple(typed(args[0] if args else Any, v, f"{at}[{i}]") for i, v in enumerate(data))
    if origin in (typing.Union, types.UnionType):
        if data is None and type(None) in args:
            return None
        return typed(next(a for a in args if a is not type(None)), data, at)
    if kind is Any:
        if isinstance(data, (dict, list)):
            raise KnowledgeError(f"{at}: a plain value is needed")
        return data
    if type(data) is not kind:
        raise KnowledgeError(f"{at}: {kind.__name__} is needed, not {type(data).__name__}")
    return data


def plain(value: Any) -> Any:
    """The document of a value: what ``typed`` makes the value of again; defaults are left out."""
    if dataclasses.is_dataclass(value):
        return {f.name: plain(getattr(value, f.name)) for f in dataclasses.fields(value) if getattr(value, f.name) != f.default}
    return [plain(v) for v in value] if isinstance(value, tuple) else value


def _parsed(text: str, path: str) -> Any:
    if path.endswith((".yaml", ".yml")):
        import yaml

        return yaml.safe_load(text)
    try:
        return json.loads(text)
    except json.JSONDecodeError as e:
        raise KnowledgeError(f"{path}: {e}") from e


def from_document(data: Any, kind: str, at: str = "") -> tuple:
    """The members of the list ``kind`` of a document; names are there once, patterns compile, and tests beside a rule's clauses are known."""
    at = at or kind
    if not isinstance(data, dict) or set(data) != {"version", kind}:
        raise KnowledgeError(f"{at}: an object with the keys version and {kind} is needed")
    if data["version"] != VERSION:
        raise KnowledgeError(f"{at}.version: {data['version']} is not {VERSION}")
    out = typed(tuple[KINDS[kind], ...], data[kind], f"{at}.{kind}")
    seen: set[str] = set()
    for i, v in enumerate(out):
        here, name = f"{at}.{kind}[{i}]", v.name
        if name in seen:
            raise KnowledgeError(f"{here}: {name} is there twice")
        seen.add(name)
        patterns = v.keywords if isinstance(v, Family) else [p for c in v.clauses if c.test == "regex" for p in c.values] if isinstance(v, Rule) else ()
        for p in patterns:
            try:
                re.compile(p)
            except re.error as e:
                raise KnowledgeError(f"{here}: {p!r} is no pattern: {e}") from e
        if isinstance(v, Rule) and v.extra and v.extra not in EXTRAS and v.extra != "outside_window":
            raise KnowledgeError(f"{here}.extra: {v.extra} is not known")
    return out


def load(spark: SparkSession, path: str, kind: str) -> tuple:
    """Rules, signals or families of the document at a path."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise KnowledgeError(f"{path}: one document is needed")
    return from_document(_parsed(rows[0].value, path), kind, path)


def to_document(values: tuple, kind: str) -> str:
    return json.dumps({"version": VERSION, kind: [plain(v) for v in values]}, ensure_ascii=False, indent=1)
