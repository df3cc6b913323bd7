"""Scan of registry hives. The hives are made of the customers first: a tree by nation, with lists of lists and large values."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlane.functions.times import FILETIME_EPOCH
from emberlane.plans.views import table
from emberlane.sources import hive
from emberlane.sources.ranges import write_bytes
from emberlane.tables import new_path


class Key:
    """A key to be written: subkeys, values (name, type, bytes), and lists of at most ``fan`` subkeys."""

    def __init__(self, name: str, filetime: int = 0, fan: int = 1000):
        self.name, self.filetime, self.fan, self.below, self.values, self.at = name, filetime, fan, [], [], None

    def key(self, name: str, filetime: int = 0) -> Key:
        self.below.append(Key(name, filetime, self.fan))
        return self.below[-1]


def hive_bytes(root: Key, patch: dict[int, bytes] | None = None) -> bytes:
    """Bytes of a hive with one bin."""
    out = bytearray(32)

    def cell(data: bytes) -> int:
        at = len(out)
        size = -(-(4 + len(data)) // 8) * 8
        out.extend(struct.pack("<i", -size) + data.ljust(size - 4, b"\0"))
        return at

    def data_cell(raw: bytes) -> int:
        if len(raw) <= hive.SEGMENT:
            return cell(raw)
        parts = [cell(raw[i:i + hive.SEGMENT]) for i in range(0, len(raw), hive.SEGMENT)]
        return cell(struct.pack("<2sHI", b"db", len(parts), cell(struct.pack(f"<{len(parts)}I", *parts))))

    def value(name: str, kind: int, raw: bytes) -> int:
        narrow = name.isascii()
        text = name.encode("latin-1" if narrow else "utf-16-le")
        size, at = (len(raw) | 1 << 31, int.from_bytes(raw.ljust(4, b"\0"), "little")) if len(raw) <= 4 else (len(raw), data_cell(raw))
        return cell(struct.pack("<2sHIIIHH", b"vk", len(text), size, at, kind, int(narrow), 0) + text)

    def listed(places: list[int], fan: int) -> int:
        if len(places) <= fan:
            return cell(struct.pack("<2sH", b"lh", len(places)) + b"".join(struct.pack("<II", p, 0) for p in places))
        parts = [cell(struct.pack("<2sH", b"li", len(places[i:i + fan])) + struct.pack(f"<{len(places[i:i + fan])}I", *places[i:i + fan])) for i in range(0, len(places), fan)]
        return cell(struct.pack("<2sH", b"ri", len(parts)) + struct.pack(f"<{len(parts)}I", *parts))

    order, stack = [], [root]
    while stack:
        order.append(stack.pop())
        stack += order[-1].below
    for k in reversed(order):  # keys below before those above
        narrow = k.name.isascii()
        text = k.name.encode("latin-1" if narrow else "utf-16-le")
        subkeys = listed([b.at for b in k.below], k.fan) if k.below else 0xFFFFFFFF
        values = [value(*v) for v in k.values]
        # the cell of a list of values may be longer than the list
        held = cell(struct.pack(f"<{len(values)}I", *values) + b"\xff" * 12) if values else 0xFFFFFFFF
        head = struct.pack("<2sHqIIIIIIII", b"nk", 0x20 if narrow else 0, k.filetime, 0, 0, len(k.below), 0, subkeys, 0xFFFFFFFF, len(values), held)
        k.at = cell(head.ljust(72, b"\0") + struct.pack("<HH", len(text), 0) + text)
    size = -(-len(out) // 4096) * 4096
    if size - len(out) >= 8:
        out.extend(struct.pack("<i", size - len(out)))
    out = out.ljust(size, b"\0")
    out[:32] = struct.pack("<4sII", b"hbin", 0, size).ljust(32, b"\0")
    for at, raw in (patch or {}).items():
        out[at:at + len(raw)] = raw
    return struct.pack("<4sIIqIIIIII", b"regf", 1, 1, 0, 1, 5, 0, 1, root.at, size).ljust(hive.HEAD, b"\0") + bytes(out)


#: Customers of one hive.
PER_HIVE = 250


def _customer_hive(rows: pa.Table) -> pa.Table:
    """One hive of the customers of a stretch of keys."""
    text = lambda s: (s + "\0").encode("utf-16-le")
    root = Key("ROOT", fan=20)
    root.key("Select").values.append(("Current", 4, struct.pack("<I", 2)))
    vendors = root.key("Vendors")
    sets = {n: root.key(f"ControlSet{n:03d}").key("Services") for n in (1, 2)}
    nations: dict[int, Key] = {}
    for r in sorted(rows.to_pylist(), key=lambda r: r["c_custkey"]):
        n, key = r["c_nationkey"], r["c_custkey"]
        nations.setdefault(n, None)
        if nations[n] is None:
            nations[n] = vendors.key(f"Nation {n}")
        own = nations[n].key(f"{'Active' if key % 3 else 'Idle'}-{key}", FILETIME_EPOCH + key * 10_000_000)
        own.values += [("", 1, text(f"customer {key}")), ("Code", 4, struct.pack("<I", key)), ("Big", 11, struct.pack("<Q", key * 10**10)), ("Tags", 7, text("a\0b\0")), ("Blob", 3, bytes([key % 256]) * (hive.SEGMENT + 5 if key % 50 == 0 else key % 9))]
        own.key("Kontakt é漢").values.append(("Mail", 2, text(f"c{key}@example.org")))
        sets[1 + key % 2].key(f"svc{key}").values.append(("Start", 4, struct.pack("<I", key % 5)))
    return pa.table({"name": [f"hive-{rows['c_custkey'][0].as_py() // PER_HIVE}.dat"], "content": pa.array([hive_bytes(root)], pa.binary())})


def write_hives(spark: SparkSession, sf_dir: str) -> str:
    path = new_path(spark, "hives")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").withColumn("stretch", F.floor(F.col("c_custkey") / PER_HIVE))
    write_bytes(rows.groupBy("stretch").applyInArrow(_customer_hive, "name string, content binary"), path, name="name")
    return path


def registry_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active customers of all nations with what is below their keys, and the services of the control set in use."""
    rows = hive.read_hive(spark, write_hives(spark, sf_dir), "SYSTEM", ["SYSTEM/Vendors/*/Active*", "SYSTEM/CurrentControlSet/Services/svc*"])
    get = lambda path, kind: F.try_variant_get("fields", path, kind)
    return rows.select("path", "us", get("$['(default)']", "string").alias("label"), get("$.Code", "bigint").alias("code"), get("$.Big", "bigint").alias("big"), get("$.Tags[1]", "string").alias("tag"), F.length(get("$.Blob", "string")).alias("blob_digits"), get("$.Mail", "string").alias("mail"), get("$.Start", "bigint").alias("start"))


QUERIES = {"registry_scan": registry_scan}
ORACLE = {
    "registry_scan": """
with active as (select *, 'SYSTEM\\Vendors\\Nation ' || c_nationkey || '\\Active-' || c_custkey as path from customer where c_custkey % 3 <> 0)
select path, c_custkey * 1000000 as us, 'customer ' || c_custkey as label, c_custkey as code, c_custkey * 10000000000 as big, 'b' as tag,
  case when c_custkey % 50 = 0 then 2 * 16349 else 2 * (c_custkey % 9) end as blob_digits, null::varchar as mail, null::bigint as start from active
union all select path || '\\Kontakt é漢', null, null, null, null, null, null, 'c' || c_custkey || '@example.org', null from active
union all select 'SYSTEM\\ControlSet002\\Services\\svc' || c_custkey, null, null, null, null, null, null, null, c_custkey % 5 from customer where c_custkey % 2 = 1"""
}
