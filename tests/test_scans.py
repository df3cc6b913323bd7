"""Scans by ranges of bytes give the rows of one pass, whatever the split."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from emberlane.plans import scans
from emberlane.sources import ntfs


def journal(seed, n):
    """Bytes with records of both versions, damage, zeros, foreign ids, records inside of records, and a cut tail."""
    rnd = random.Random(seed)
    out = bytearray()
    for i in range(n):
        name = "".join(rnd.choice("abcé漢.") for _ in range(rnd.randint(0, 40))).encode("utf-16-le")
        kind = rnd.random()
        if kind < 0.1:
            out += bytes(rnd.randrange(256) for _ in range(8 * rnd.randint(1, 30)))
        elif kind < 0.15:
            out += bytes(8 * rnd.choice((1, 1023, 1024, 1025, 3072, rnd.randint(1, 3000))))
        elif kind < 0.2:
            out += scans.change_record(name, version=3, foreign=9, usn=i)
        elif kind < 0.25:
            out += struct.pack("<IHH", 64, 4, 0) + bytes(56)
        elif kind < 0.5:
            out += scans.change_record(name, version=rnd.choice((2, 3)), usn=i, inside=b"".join(scans.change_record(b"x\0", usn=-1) for _ in range(rnd.randint(1, 20))))
        else:
            out += scans.change_record(name + (b"\x00\xdc" if rnd.random() < 0.1 else b""), version=rnd.choice((2, 3)), usn=i)
    return bytes(out + scans.change_record(b"t\0" * 20, usn=n)[:-8])


def one_pass(data):
    """(records, unreadable stretches, unsupported, tail) of a walk from the head."""
    at, records, bad, unsupported, tail = 0, [], [], [], []
    while at < len(data):
        kind, n = ntfs.step(data, at)
        if kind == ntfs.END:
            tail.append((at, len(data) - at))
            break
        if kind == ntfs.RECORD:
            records.append(at)
        elif kind == ntfs.UNSUPPORTED:
            unsupported.append((at, n))
        elif kind == ntfs.UNREADABLE:
            if bad and sum(bad[-1]) == at:
                bad[-1] = (bad[-1][0], bad[-1][1] + n)
            else:
                bad.append((at, n))
        at += n
    return records, bad, unsupported, tail


@pytest.mark.parametrize("split", [64, 1000, 1 << 15, 1 << 26])
def test_journal_by_ranges(spark, tmp_path, split):
    data = journal(1, 60 if split < 1000 else 900)
    (tmp_path / "a.bin").write_bytes(data)
    records, bad, unsupported, tail = one_pass(data)
    assert len(records) > 20 and bad and unsupported and tail
    rows = ntfs.read_journal(spark, str(tmp_path), split=split).collect()
    assert sorted(r.offset for r in rows) == records and all(r.usn >= 0 for r in rows)
    gaps = {}
    for r in ntfs.journal_gaps(spark, f"file://{tmp_path}", "*.bin", split=split).collect():
        gaps.setdefault(r.gap, []).append((r.offset, r.length))
    assert {k: sorted(v) for k, v in gaps.items()} == {"unreadable": bad, "unsupported": unsupported, "tail": tail}


def test_two_chains_that_never_meet(spark, tmp_path):
    """Two interleaved chains of records: only the head of the file tells which one is real."""

    def record(usn):
        head = bytearray(scans.change_record(b"n\0", usn=usn).ljust(2048, b"\xff"))
        struct.pack_into("<I", head, 0, 4096)
        return bytes(head)

    data = b"".join(record(i) for i in range(200)) + bytes(4096)
    (tmp_path / "a.bin").write_bytes(data)
    got = sorted(r.usn for r in ntfs.read_journal(spark, str(tmp_path), split=50_000).collect())
    assert got == list(range(0, 200, 2))


def test_no_journals(spark, tmp_path):
    (tmp_path / "empty.bin").write_bytes(b"")
    (tmp_path / "table.bin").write_bytes(b"".join(scans.file_record(i, [("a", 1)]) for i in range(8)))
    (tmp_path / "_hidden").write_bytes(scans.change_record(b"n\0"))
    (tmp_path / "zeros.bin").write_bytes(bytes(100_000))
    assert ntfs.read_journal(spark, str(tmp_path), split=4096).count() == 0
    assert {(r.gap, r.length) for r in ntfs.journal_gaps(spark, str(tmp_path), split=4096).collect()} == {("empty", 0), ("file_table", 8192)}
    assert ntfs.read_journal(spark, str(tmp_path), "*.none").count() == 0


def test_lone_surrogates(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(scans.change_record("a".encode("utf-16-le") + b"\x00\xd8", usn=1) + scans.change_record("😀".encode("utf-16-le"), usn=2) + scans.change_record(b"", usn=3, us=-11_644_473_600_000_000))
    rows = {r.usn: r for r in ntfs.read_journal(spark, str(tmp_path)).collect()}
    assert (rows[1].name, rows[1].name_raw) == ("a�", "610000d8") and bytes.fromhex(rows[1].name_raw).decode("utf-16-le", "surrogatepass") == "a\ud800"
    assert (rows[2].name, rows[2].name_raw, rows[3].name, rows[3].us) == ("😀", None, "", None)


@pytest.mark.parametrize("slot,sector", [(1024, 512), (4096, 4096), (4096, 512)])
def test_file_table_by_ranges(spark, tmp_path, slot, sector):
    make = lambda i, **k: scans.file_record(i, [(f"N~{i}", 2), (f"name {i}", 1)], slot=slot, sector=sector, **k)
    slots = [make(0), make(1, torn=True), bytes(slot), make(0, signature=b"BAAD"), make(77, data=b"abc"), make(5, away=10**12), scans.file_record(6, [], slot=slot, sector=sector), make(7, name_size=9)]
    (tmp_path / "t.bin").write_bytes(b"".join(slots) + make(8)[:100])
    for split in (100, slot, 3 * slot, 1 << 26):
        got = {r.offset // slot: r for r in ntfs.read_file_table(spark, str(tmp_path), split=split).collect()}
        assert {k: (r.record_num, r.size) for k, r in got.items()} == {0: (0, 0), 3: (3, 0), 4: (77, 3), 5: (5, 10**12), 7: (7, 9)} and got[4].name == "name 77"
        assert [(r.offset, r.fault) for r in ntfs.file_table_faults(spark, str(tmp_path), split=split).collect()] == [(slot, "update_sequence")]


def test_one_file_is_many_tasks(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(scans.change_record(b"n\0" * 30, usn=1) * 20_000)
    rows = ntfs.read_journal(spark, str(tmp_path), split=200_000)
    assert rows.rdd.getNumPartitions() > 10
    assert rows.agg(F.count("*")).first()[0] == 20_000 and rows.select(F.spark_partition_id().alias("p")).distinct().count() > 10
