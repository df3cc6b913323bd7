"""Registry hives of bytes made here."""

import json
import os
import struct

import pytest
from pyspark.sql import functions as F

from emberlane.plans.hives import Key, hive_bytes
from emberlane.sources import hive
from emberlane.sources.ranges import read_ranges


def save(tmp_path, root, patch=None, name="h.dat"):
    (tmp_path / name).write_bytes(hive_bytes(root, patch))
    return str(tmp_path)


def test_circles_doubles_and_pruning(spark, tmp_path):
    root = Key("ROOT")
    a, b = root.key("a"), root.key("B")
    deep = a.key("x").key("y")
    deep.key("z")
    b.key("w")
    hive_bytes(root)
    # the list of y names a and the root, and the list of b names x, besides their own
    out = hive_bytes(root)
    y_list = struct.unpack_from("<I", out, hive.HEAD + deep.at + 4 + 28)[0]
    patch = {y_list + 4: struct.pack("<2sH", b"lh", 1) + struct.pack("<I", a.at)}
    cells = hive.read_cells(spark, save(tmp_path, root, patch), split=100)
    keys = hive.walk(cells, "HIVE")
    assert {(r.path, r.depth, r.in_scope) for r in keys.collect()} == {("HIVE", 0, True), ("HIVE\\a", 1, True), ("HIVE\\B", 1, True), ("HIVE\\a\\x", 2, True), ("HIVE\\a\\x\\y", 3, True), ("HIVE\\B\\w", 2, True)}
    assert [(r.cell, r.n) for r in hive.met_again(cells, keys).collect()] == [(a.at, 2)]
    scoped = {(r.path, r.in_scope) for r in hive.walk(cells, "HIVE", ["hive/a/x"]).collect()}
    assert scoped == {("HIVE", False), ("HIVE\\a", False), ("HIVE\\a\\x", True), ("HIVE\\a\\x\\y", True)}
    assert {r.path for r in hive.walk(cells, "HIVE", ["HIVE\\*\\w"]).where("in_scope").collect()} == {"HIVE\\B\\w"}
    assert {r.path for r in hive.walk(cells, "HIVE", deepest=1).collect()} == {"HIVE", "HIVE\\a", "HIVE\\B"}


@pytest.mark.parametrize("deepest", [21, pytest.param(hive.DEEPEST, marks=pytest.mark.skipif(not os.environ.get("SLOW_TESTS"), reason="takes minutes"))])
def test_deeper_than_the_limit(spark, tmp_path, deepest):
    root = at = Key("ROOT")
    for _ in range(deepest + 20):
        at = at.key("k")
    cells = hive.read_cells(spark, save(tmp_path, root))
    keys = hive.walk(cells, "H", deepest=deepest)
    assert keys.count() == deepest + 1 and keys.agg({"depth": "max"}).first()[0] == deepest


def test_fields_of_many_hives(spark, tmp_path):
    for n in (1, 2):
        root = Key("R", fan=2)
        for i in range(5):
            k = root.key(f"k{i}", 116_444_736_000_000_000 + 10 * i)
            k.values += [("v", 4, struct.pack("<I", i * n)), ("v", 4, struct.pack("<I", 100 + i)), ("missing", 1, b"x" * 9), ('q"\n', 1, "a\"b\0c".encode("utf-16-le"))]
        save(tmp_path, root, name=f"{n}.dat")
    (tmp_path / "no.dat").write_bytes(b"nothing")
    for split in (64, 1 << 20):
        rows = hive.read_hive(spark, str(tmp_path), "R", ["R/k*"], split=split).selectExpr("file", "path", "us", "to_json(fields) as f").collect()
        assert len(rows) == 10
        assert {(r.path, r.us, json.loads(r.f)["v"], json.loads(r.f)['q"\n']) for r in rows} == {(f"R\\k{i}", i, 100 + i, 'a"b') for i in range(5)} or {r.us for r in rows} == {None, 1, 2, 3, 4}
    assert hive.read_hive(spark, str(tmp_path), "R", ["other"]).count() == 0


@pytest.mark.parametrize("kind,raw,value", [
    (1, "a\0b".encode("utf-16-le"), "a"), (2, "볼륨 관리자\0".encode("utf-16-le") + b"x", "볼륨 관리자"), (7, "a\0\0b\0\0".encode("utf-16-le"), ["a", "", "b"]), (4, b"\x01\0\0\0", 1), (5, b"\0\0\0\x01", 1),
    (4, b"\x01", "01"), (11, b"\xff" * 8, 2**64 - 1), (3, b"\x0a\xff", "0aff"), (16, struct.pack("<Q", 116_444_736_000_000_010), {"micros": 1}), (16, bytes(8), "00" * 8), (99, b"", ""),
])
def test_values(kind, raw, value):
    assert json.loads(hive.value_json(kind, raw)) == value


def test_values_beside_their_keys_and_apart(spark, tmp_path):
    """What a bin tells by itself and what joins find, as where cells lie in several bins, are the same."""
    root = Key("R")
    for i in range(4):
        root.key(f"k{i}").values += [("", 1, "text".encode("utf-16-le")), ("n", 4, struct.pack("<I", i)), ("large", 3, bytes([i]) * (hive.SEGMENT * 2 + i)), ("none", 3, b"")]
    raw, place, rows = hive_bytes(root), 32, []
    while place + 8 <= len(raw) - hive.HEAD:
        n, = struct.unpack_from("<i", raw, hive.HEAD + place)
        if n < 0:
            rows.append(hive.cell_row("f", place, raw[hive.HEAD + place + 4:hive.HEAD + place - n]))
        place += abs(n)
    by_place = {r[1]: r for r in rows}
    apart = spark.createDataFrame(rows, hive._COLUMNS)
    beside = spark.createDataFrame([hive.with_neighbours(r, by_place) for r in rows], hive._COLUMNS)
    assert apart.where("kind in ('nk', 'vk') and list is not null").count() == 12 and beside.where("kind in ('nk', 'vk') and list is not null").count() == 0
    found = [sorted(map(tuple, hive.values_of(c, c.where("kind = 'nk'")).collect())) for c in (apart, beside)]
    assert found[0] == found[1] and len(found[0]) == 16 and None not in [r[5] for r in found[0]]


def test_small_files_share_tasks(spark, tmp_path):
    for n in range(60):
        save(tmp_path, Key("R"), name=f"{n}.dat")
    raw = read_ranges(spark, hive.HiveSource, str(tmp_path))
    assert raw.rdd.getNumPartitions() == 1 and raw.where("kind = 'root'").count() == 60
    assert read_ranges(spark, hive.HiveSource, str(tmp_path), split=4096).rdd.getNumPartitions() == 120


@pytest.mark.parametrize("path,inside,into", [
    ("S\na", False, True), ("S", False, True), ("s\nA\nx1\ny", True, True), ("S\na\nb", False, False), ("S\nab", False, False), ("S\nq.r", True, True), ("S\nqxr", False, False), ("T", False, False), ("", False, False),
])
def test_scope_by_patterns(spark, path, inside, into):
    assert tuple(spark.range(1).select(*hive.scope_tests(F.lit(path), ["S\\a/x*", "S/q.r"])).first()) == (inside, into)
