"""Prefetch files and their compression, on bytes made here."""

import random
import struct

import pytest

from emberlane.plans.prefetches import compress, prefetch_bytes
from emberlane.sources import prefetch

AT = prefetch.EARLIEST + 10


@pytest.mark.parametrize("seed", range(6))
def test_compression_round_trip(seed):
    rnd = random.Random(seed)
    words = [bytes(rnd.randrange(256) for _ in range(rnd.randint(1, 40))) for _ in range(30)]
    data = b"".join(rnd.choices(words, k=[1, 20, 300, 5000, 9000, 2][seed])) + bytes([0, 80_000, 10, 300, 0, 70_000][seed])
    packed = compress(data)
    with pytest.raises(prefetch.Unreadable):
        prefetch.uncompressed(packed[:len(packed) * 2 // 3])
    assert prefetch.uncompressed(packed) == data and (len(data) < 3000 or len(packed) < len(data) + 2000)


def test_codes_of_several_lengths():
    """A code by hand: two symbols of one and two bits, the rest of fifteen."""
    lengths = [0] * 512
    lengths[ord("a")], lengths[ord("b")], lengths[256] = 1, 2, 2
    table = bytes(lengths[i] | lengths[i + 1] << 4 for i in range(0, 512, 2))
    bits = "0" + "0" + "10" + "0" + "11"  # a a b a, then a match of three at a distance of one
    word = int(bits.ljust(16, "0"), 2)
    assert prefetch.expand(table + struct.pack("<HH", word, 0), 7) == b"aabaaaa"
    with pytest.raises(prefetch.Unreadable):
        prefetch.expand(bytes(256) + bytes(4), 3)
    with pytest.raises(prefetch.Unreadable):
        prefetch.expand(table + struct.pack("<HH", int("11".ljust(16, "0"), 2), 0), 3)
    with pytest.raises(prefetch.Unreadable):
        prefetch.expand(table[:100], 3)


def test_layouts_and_faults():
    for version, block in prefetch.LAYOUTS:
        raw = prefetch_bytes(version, block, "A.EXE", 7, runs=3, times=[AT, AT + 10], loaded=[r"\D\A.EXE", "é"], volumes=[("v", 5, AT, 2), ("w", 6, 0, 0)], beyond=2)
        got = prefetch.record_of(raw)
        assert got[:4] == (version, "A.EXE", 7, 3) and got[4][0] == (AT - prefetch.FILETIME_EPOCH) // 10 and got[5] == [r"\D\A.EXE", "é"]
        assert [(v["device"], v["serial"], v["folders"], v["created"] is None) for v in got[6]] == [("v", 5, 2, False), ("w", 6, 0, True)] and got[7] == 2
    raw = prefetch_bytes(30, 224, "A.EXE", 7, runs=3, times=[AT], loaded=[], volumes=[])
    for bad in (b"", b"MAM\x05" + raw, b"MAM\x04\0\0\0\0", raw[:50], b"x" + raw[1:4] + b"NONE" + raw[8:], struct.pack("<I", 99) + raw[4:], prefetch_bytes(30, 224, "A", 1, runs=2_000_000, times=[], loaded=[], volumes=[]), prefetch_bytes(30, 224, "A", 1, runs=1, times=[5], loaded=[], volumes=[])):
        with pytest.raises((prefetch.Unreadable, struct.error)):
            prefetch.record_of(bad)


def test_paths_and_repeats(spark, tmp_path):
    long = "A" * 29
    dev = r"\DEVICE\HARDDISKVOLUME2"
    make = lambda name, h, loaded, volumes: prefetch_bytes(30, 212, name, h, runs=1, times=[], loaded=loaded, volumes=[(v, 1, 0, 0) for v in volumes])
    files = {
        "ONE.EXE-00000001.pf": make("ONE.EXE", 1, [dev + r"\x\One.exe", dev + r"\y\two.exe"], [dev, r"\DEVICE\HARDDISKVOLUMESHADOWCOPY3"]),
        "TWO.EXE-00000002.pf": make("TWO.EXE", 2, [dev + r"\x\TWO.EXE", dev + r"\y\TWO.EXE"], [dev]),
        "LONG-00000003.pf": make(long, 3, [dev + rf"\x\{long}BC.EXE.CONFIG", dev + rf"\x\{long}BC.EXE"], [dev, r"\DEVICE\HARDDISKVOLUME9"]),
        "AGAIN-00000009.pf": make("ONE.EXE", 1, [], [dev]),
        "BAD-00000001.pf": b"no",
    }
    for name, raw in files.items():
        (tmp_path / name).write_bytes(compress(raw) if len(raw) > 2 else raw)
    rows = {r.file.rsplit("/", 1)[1]: r for r in prefetch.read_prefetch(spark, str(tmp_path)).collect()}
    assert set(rows) == {"AGAIN-00000009.pf", "TWO.EXE-00000002.pf", "LONG-00000003.pf"}
    assert rows["TWO.EXE-00000002.pf"].path is None and rows["TWO.EXE-00000002.pf"].loaded == [r"C:\x\TWO.EXE", r"C:\y\TWO.EXE"]
    assert rows["LONG-00000003.pf"].path == dev + rf"\x\{long}BC.EXE" and rows["AGAIN-00000009.pf"].hash_differs


def test_packed_files_give_the_records_of_a_folder(spark, tmp_path):
    """One table of many files, read without a file for each; the folder's files give the same records."""
    files = {}
    for k in range(40):
        raw = prefetch_bytes(30, 212, f"P{k}.EXE", k, runs=k, times=[AT], loaded=[rf"\DEVICE\HARDDISKVOLUME1\x\P{k}.EXE"], volumes=[(r"\DEVICE\HARDDISKVOLUME1", k, 0, 0)])
        files[f"P{k}.EXE-{k:08X}.pf"] = raw if k % 3 == 0 else compress(raw)[:None if k % 7 else 100]
    (tmp_path / "folder").mkdir()
    for name, raw in files.items():
        (tmp_path / "folder" / name).write_bytes(raw)
    spark.createDataFrame(list(files.items()), "path string, content binary").repartition(3).write.parquet(str(tmp_path / "packed"))
    plain = lambda rows: sorted((r.file.rsplit("/", 1)[-1], r.name, r.path, r.run_count, r.compressed) for r in rows.collect())
    got = plain(prefetch.read_packed(spark, str(tmp_path / "packed")))
    assert got == plain(prefetch.read_prefetch(spark, str(tmp_path / "folder"))) and len(got) == 36 and got[1][2] == r"C:\x\P1.EXE"
