"""Registry hives: cells as a table, then a walk from the root by joins.

Bins of a hive begin at multiples of 4 KiB and tell their own place, so cells are read by
ranges of bytes. Keys, the lists that name their subkeys, values and data are then rows,
and the tree is walked by joins of a frontier with the edges, a level a job where many keys
are met and some levels a job below few, each job's new keys written. What a key or a value
names in its own bin is put beside it as the bin is read; only the rest is joined. A key is left out with all below it unless it is in scope or a key
below it can be. A key that several lists name, or a list above itself, is met once, on
its shortest path.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlane.functions.times import FILETIME_EPOCH, filetime_micros
from emberlane.sources.ranges import RangeSource, Read, read_ranges
from emberlane.tables import written

#: Bytes of a hive's head and of the steps of its bins, bytes of a segment of large data, deepest level (fixed values).
HEAD, STEP, SEGMENT, DEEPEST = 4096, 4096, 16344, 512
#: Levels that one job walks, below as many walked one by one, from a frontier of at most so many keys.
LEVELS, FEW = 8, 1000

_COLUMNS = "file string, cell bigint, kind string, name string, filetime bigint, parent bigint, subkeys bigint, n_values bigint, list bigint, refs array<bigint>, type bigint, size bigint, raw binary"
_NAMES = [c.split()[0] for c in _COLUMNS.split(", ")]
_KINDS = [pa.string(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 5, pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary()]
_NONE = 0xFFFFFFFF


_NK, _VK = struct.Struct("<HqIIIIIIII"), struct.Struct("<HIIIH")
_KIND, _LIST, _REFS, _SIZE, _RAW = (_NAMES.index(n) for n in ("kind", "list", "refs", "size", "raw"))


def _name(data: bytes, at: int, n: int, narrow: int) -> str:
    raw = data[at:at + n]
    return raw.decode("latin-1") if narrow else raw.decode("utf-16-le", "replace")


def cell_row(file: str, cell: int, data: bytes) -> tuple:
    """A cell by its signature: key (nk), value (vk), lists of subkeys (lf, lh, li, ri), large data (db); others are bytes."""
    kind = data[:2]
    if kind == b"nk" and len(data) >= 76:
        flags, filetime, _, parent, n_subkeys, _, subkeys, _, n_values, values = _NK.unpack_from(data, 2)
        name = _name(data, 76, data[72] | data[73] << 8, flags & 0x20)
        return (file, cell, "nk", name, filetime, parent, subkeys if n_subkeys and subkeys != _NONE else None, n_values, values if n_values and values != _NONE else None, None, None, None, None)
    if kind == b"vk" and len(data) >= 20:
        n, size, at, type_, flags = _VK.unpack_from(data, 2)
        here = size >> 31
        size &= 0x7FFFFFFF
        return (file, cell, "vk", _name(data, 20, n, flags & 1), None, None, None, None, None if here else at, None, type_, size, data[8:8 + min(size, 4)] if here else None)
    if kind in (b"lf", b"lh", b"li", b"ri") and len(data) >= 4:
        n, = struct.unpack_from("<H", data, 2)
        step = 2 if kind in (b"lf", b"lh") else 1
        n = min(n, (len(data) - 4) // (4 * step))
        return (file, cell, "ri" if kind == b"ri" else "list", *[None] * 6, list(struct.unpack_from(f"<{n * step}I", data, 4)[::step]), None, None, None)
    if kind == b"db" and len(data) >= 8:
        n, at = struct.unpack_from("<HI", data, 2)
        return (file, cell, "db", None, None, None, None, n, at, None, None, None, data)
    return (file, cell, "data", *[None] * 9, data)


def _places(n: int, raw: bytes) -> list[int]:
    n = min(n, len(raw) // 4)
    return list(struct.unpack_from(f"<{n}I", raw))


def with_neighbours(row: tuple, cells: dict[int, tuple]) -> tuple:
    """A key with the places of its values in refs, a value with its bytes in raw, if all that they name is in these cells of their bin; list is null then."""
    if row[_KIND] not in ("nk", "vk") or row[_LIST] is None:
        return row
    data = lambda at: cells[at][_RAW] if at in cells and cells[at][_KIND] == "data" else None
    raw = data(row[_LIST])
    if row[_KIND] == "nk":
        return row if raw is None else (*row[:_LIST], None, _places(row[_LIST - 1], raw), *row[_REFS + 1:])
    large = cells.get(row[_LIST])
    if large is not None and large[_KIND] == "db":
        pieces = [data(at) for at in _places(large[_LIST - 1], data(large[_LIST]) or b"")]
        raw = b"".join(p[:SEGMENT] for p in pieces) if pieces and None not in pieces else None
    return row if raw is None else (*row[:_LIST], None, *row[_REFS:_RAW], raw[:row[_SIZE]])


class HiveSource(RangeSource):
    """The root's place, and the cells in use."""

    columns = _COLUMNS

    @classmethod
    def name(cls) -> str:
        return "registry_hive"

    @staticmethod
    def scan(file: str, read: Read, size: int, start: int, end: int) -> Iterator[pa.RecordBatch]:
        head = read(0, 48)
        rows: list[tuple] = []
        if head[:4] != b"regf" or len(head) < 48:
            return
        if start == 0:
            rows.append((file, struct.unpack_from("<I", head, 36)[0], "root", *[None] * 10))
        at = max(HEAD, -(-start // STEP) * STEP)
        while at < end:
            bin_head = read(at, 32)
            if bin_head[:4] != b"hbin" or len(bin_head) < 32 or struct.unpack_from("<I", bin_head, 4)[0] != at - HEAD:
                at += STEP
                continue
            length = struct.unpack_from("<I", bin_head, 8)[0]
            data = read(at, length)
            place, cells = 32, {}
            while place + 8 <= len(data):
                n, = struct.unpack_from("<i", data, place)
                if abs(n) < 8 or place + abs(n) > len(data):
                    break
                if n < 0:
                    cells[at - HEAD + place] = cell_row(file, at - HEAD + place, data[place + 4:place - n])
                place += abs(n)
            rows += [with_neighbours(row, cells) for row in cells.values()]
            at += max(STEP, length - length % STEP)
            if len(rows) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names=_NAMES)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names=_NAMES)


def read_cells(spark: SparkSession, path: str, glob: str | None = None, *, split: int | None = None) -> DataFrame:
    """Cells of the hives below a path; ``cell`` is the place that other cells name."""
    return written(read_ranges(spark, HiveSource, path, glob, split), "cells")


def edges_of(cells: DataFrame) -> DataFrame:
    """(file, parent, child): keys and the keys that their lists name, through lists of lists too."""
    keys = cells.where("kind = 'nk' and subkeys is not null").select("file", F.col("cell").alias("parent"), F.col("subkeys").alias("at"))
    lists = lambda kind: cells.where(F.col("kind") == kind).select("file", F.col("cell").alias("at"), F.explode("refs").alias("to"))
    through = keys.join(lists("ri"), ["file", "at"]).select("file", "parent", F.col("to").alias("at"))
    return keys.unionByName(through).join(lists("list"), ["file", "at"]).select("file", "parent", F.col("to").alias("child")).distinct()


def _patterns(prefix: str) -> tuple[str, str]:
    """Patterns of the paths in the scope of a prefix, and of those and the paths above it; ``*`` stands for any part of one segment."""
    parts = [re.escape(p).replace(r"\*", "[^\n]*") for p in prefix.lower().replace("\\", "/").strip("/").split("/")]
    into = "(?:\\z|\n)"
    for p in reversed(parts[1:]):
        into = rf"(?:\z|\n{p}{into})"
    return "\n".join(parts) + "(?:\\z|\n)", parts[0] + into


def scope_tests(path: Column, prefixes: list[str]) -> tuple[Column, Column]:
    """Columns for a path of segments joined by a line feed: in scope, and worth walking into. Without prefixes all is in scope."""
    if not prefixes:
        return F.lit(True), F.lit(True)
    inside, into = (r"\A(?:" + "|".join(p) + ")" for p in zip(*map(_patterns, prefixes)))
    return tuple(F.coalesce(F.lower(path).rlike(p), F.lit(False)) for p in (inside, into))


def named_edges(cells: DataFrame) -> DataFrame:
    """(file, parent, child, own): the edges with the name of the key below, as a table."""
    keys = cells.where("kind = 'nk'").select("file", F.col("cell").alias("child"), F.col("name").alias("own"))
    return written(edges_of(cells).join(keys, ["file", "child"]), "named-edges")


def walk(cells: DataFrame, hive: str, prefixes: list[str] = (), *, deepest: int = DEEPEST, aliases: DataFrame | None = None, named: DataFrame | None = None) -> DataFrame:
    """(file, cell, path, depth, in_scope) of the keys that are reached from the root, at most ``deepest`` levels below it.

    hive names the root. aliases (file, name, alias) lets a key right below the root be
    matched by a second name, as the control set in use by CurrentControlSet. Segments of a
    path are joined by a backslash. named is what named_edges gives, where several walks share it.
    """
    named = named_edges(cells) if named is None else named
    top = cells.where("kind = 'root'").select("file", "cell").join(cells.where("kind = 'nk'").select("file", "cell"), ["file", "cell"])
    level = written(top.select("file", "cell", F.lit(hive).alias("path"), F.lit(hive).alias("scope"), F.lit(0).alias("depth")), "keys")
    reached, done = level, 0
    while done < deepest and (size := level.count()):
        rows, met = level, None
        steps = min(LEVELS if size <= FEW and done >= LEVELS else 1, deepest - done)
        for step in range(steps):
            below = rows.withColumnRenamed("cell", "parent").join(named, ["file", "parent"])
            alias = F.lit(None)
            if aliases is not None and done + step == 0:
                below = below.join(F.broadcast(aliases), (below.file == aliases.file) & (F.lower(below.own) == F.lower(aliases.name)), "left").select(*(below[c] for c in below.columns), "alias")
                alias = F.col("alias")
            found = below.select("file", F.col("child").alias("cell"), F.concat("path", F.lit("\n"), "own").alias("path"), F.concat("scope", F.lit("\n"), F.coalesce(alias, "own")).alias("scope"), (F.col("depth") + 1).alias("depth"))
            # the control set in use may be meant by its own name too
            rows = found.where(scope_tests(F.col("scope"), prefixes)[1] | scope_tests(F.col("path"), prefixes)[1])
            met = rows if met is None else met.unionByName(rows)
        least = met.groupBy("file", "cell").agg(F.min(F.struct("depth", "path", "scope")).alias("m")).select("file", "cell", "m.path", "m.scope", "m.depth")
        fresh = written(least.join(reached, ["file", "cell"], "left_anti"), "keys")
        reached, done = reached.unionByName(fresh), done + steps
        level = fresh.where(F.col("depth") == done)
    inside = scope_tests(F.col("scope"), prefixes)[0] | scope_tests(F.col("path"), prefixes)[0]
    return reached.select("file", "cell", F.translate("path", "\n", "\\").alias("path"), "depth", inside.alias("in_scope"))


def met_again(cells: DataFrame, keys: DataFrame) -> DataFrame:
    """(file, cell, n): reached keys that more than one list of a reached key names, or the root if one does: circles and doubles."""
    seen = keys.select("file", F.col("cell").alias("parent"))
    named = edges_of(cells).join(seen, ["file", "parent"]).groupBy("file", F.col("child").alias("cell")).agg(F.count("*").alias("n"))
    root = cells.where("kind = 'root'").select("file", "cell", F.lit(1).alias("top"))
    return named.join(root, ["file", "cell"], "left").where("n + coalesce(top, 0) > 1").join(keys.select("file", "cell"), ["file", "cell"], "left_semi").select("file", "cell", "n")


def value_json(kind: int, raw: bytes) -> str:
    """A value as JSON: text to its first NUL, numbers, lists of texts without empty ones at the end, times, else hex digits."""
    text = lambda: raw[:len(raw) - len(raw) % 2].decode("utf-16-le", "replace")
    if kind in (1, 2):
        return json.dumps(text().split("\0", 1)[0])
    if kind == 7:
        items = text().split("\0")
        while items and not items[-1]:
            items.pop()
        return json.dumps(items)
    if kind in (4, 5) and len(raw) >= 4:
        return str(int.from_bytes(raw[:4], "little" if kind == 4 else "big"))
    if kind == 11 and len(raw) >= 8:
        return str(int.from_bytes(raw[:8], "little"))
    if kind == 16 and len(raw) == 8 and 0 < int.from_bytes(raw, "little") < 1 << 62:
        micros = (int.from_bytes(raw, "little") - FILETIME_EPOCH) // 10
        return json.dumps({"micros": micros})
    return json.dumps(raw.hex())


def values_of(cells: DataFrame, keys: DataFrame, only: str = "true") -> DataFrame:
    """(file, cell, place, name, type, value) of the values of keys (file, cell): value is JSON, null where its data is missing. only is a test on name and type."""
    own = cells.where("kind = 'nk' and n_values > 0").join(keys.select("file", "cell"), ["file", "cell"], "left_semi").select("file", F.col("cell").alias("key"), F.col("list").alias("at"), "n_values", "refs")
    placed = own.select("file", "key", F.posexplode("refs").alias("place", "cell"))
    # where bins tell all there is nothing to look for among the data
    apart = not cells.where("kind in ('nk', 'vk') and list is not null").isEmpty()
    data = cells.where("kind = 'data'").select("file", F.col("cell").alias("at"), "raw")
    # a list of values is a cell of places, which may be longer than the number of values
    many = lambda raw, n: F.least(n, F.floor(F.octet_length(raw) / 4))
    if apart:
        far = own.where("at is not null").join(data, ["file", "at"]).where(many(F.col("raw"), F.col("n_values")) > 0)
        placed = placed.unionByName(far.select("file", "key", F.posexplode(_words(F.col("raw"), many(F.col("raw"), F.col("n_values")))).alias("place", "cell")))
    values = cells.where("kind = 'vk'").where(only).select("file", "cell", "name", "type", "size", F.col("list").alias("at"), F.col("raw").alias("bytes"))
    full = met = placed.join(values, ["file", "cell"])
    if apart:
        large = cells.where("kind = 'db'").select("file", F.col("cell").alias("at"), F.col("list").alias("of"), F.col("n_values").alias("n"))
        parts = large.join(data.withColumnRenamed("at", "of"), ["file", "of"]).select("file", "at", F.posexplode(_words(F.col("raw"), many(F.col("raw"), F.col("n")))).alias("i", "part"))
        joined = parts.join(data.select("file", F.col("at").alias("part"), F.substring("raw", 1, SEGMENT).alias("piece")), ["file", "part"]).groupBy("file", "at").agg(F.array_sort(F.collect_list(F.struct("i", "piece"))).alias("p"))
        whole = joined.select("file", "at", F.aggregate("p", F.lit(b"").cast("binary"), lambda a, s: F.concat(a, s.piece)).alias("raw"))
        held = met.where("at is not null").drop("bytes").join(data.unionByName(whole), ["file", "at"], "left").withColumn("bytes", F.expr("substring(raw, 1, cast(size as int))"))
        full = met.where("at is null").unionByName(held.select(met.columns))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [None if raw is None else value_json(kind, raw) for kind, raw in zip(b.column(4).to_pylist(), b.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(out, pa.string())], names=["file", "cell", "place", "name", "type", "value"])

    return full.select("file", F.col("key").alias("cell"), F.col("place").cast("bigint").alias("place"), "name", "type", "bytes").mapInArrow(decode, "file string, cell bigint, place bigint, name string, type bigint, value string")


def _words(raw: Column, n: Column) -> Column:
    """The first n little-endian words of four bytes."""
    digits = F.hex(raw)
    byte = lambda at: F.substring(digits, 2 * at + 1, F.lit(2))
    return F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.conv(F.concat(*(byte(4 * i + k) for k in (3, 2, 1, 0))), 16, 10).cast("bigint"))


def current_control_sets(cells: DataFrame, hive: str, named: DataFrame | None = None) -> DataFrame:
    """(file, name, alias): the control set that Select\\Current names, to be found as CurrentControlSet."""
    select = walk(cells, hive, [f"{hive}/Select"], deepest=1, named=named).where("in_scope")
    number = values_of(cells, select, "lower(name) = 'current' and type = 4").select("file", F.format_string("controlset%03d", F.col("value").cast("bigint")).alias("name"))
    return number.groupBy("file").agg(F.min("name").alias("name")).withColumn("alias", F.lit("CurrentControlSet"))


def read_hive(spark: SparkSession, path: str, hive: str, prefixes: list[str] = (), glob: str | None = None, *, split: int | None = None) -> DataFrame:
    """(file, cell, path, us, fields): keys in scope with their values, a VARIANT object by name; the value without a name is "(default)"; of equal names the last counts."""
    cells = read_cells(spark, path, glob, split=split)
    named = named_edges(cells)
    aliases = written(current_control_sets(cells, hive, named), "control-sets") if any("currentcontrolset" in p.lower() for p in prefixes) else None
    keys = written(walk(cells, hive, list(prefixes), aliases=aliases, named=named).where("in_scope"), "keys-in-scope")
    last = Window.partitionBy("file", "cell", "name").orderBy(F.desc("place"))
    # dealt out by key once, for the window and the grouping
    values = values_of(cells, keys).where("value is not null").repartition("file", "cell").withColumn("name", F.when(F.col("name") == "", "(default)").otherwise(F.col("name"))).withColumn("n", F.row_number().over(last)).where("n = 1")
    fields = values.groupBy("file", "cell").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("m")).select("file", "cell", F.to_variant_object(F.transform_values("m", lambda _, v: F.parse_json(v))).alias("fields"))
    times = cells.where("kind = 'nk'").select("file", "cell", filetime_micros(F.col("filetime")).alias("us"))
    return keys.join(times, ["file", "cell"]).join(fields, ["file", "cell"], "left").select("file", "cell", "path", "us", F.coalesce("fields", F.parse_json(F.lit("{}"))).alias("fields"))

