"""Evidence records: schema, JSON-lines scan, writers and integrity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXT = ("ref", "artifact", "offset", "timestamp", "channel", "computer", "path", "name", "si_btime", "si_ctime", "si_mtime", "si_atime", "fn_btime", "fn_ctime", "fn_mtime", "fn_atime")
SCHEMA = T.StructType(
    [T.StructField(n, T.StringType()) for n in _TEXT]
    + [T.StructField(n, T.LongType()) for n in ("record_num", "event_id", "size", "file_entry", "file_sequence", "parent_entry", "parent_sequence")]
    + [T.StructField(n, T.BooleanType()) for n in ("allocated", "is_directory")]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("reason", "source")]
    + [T.StructField("fields", T.VariantType())]
)
#: Prefix of a reference by artifact (fixed values).
PREFIXES = {
    "$MFT": "MFT", "$UsnJrnl": "USN", "evtx:Security": "EVTX-SEC", "evtx:System": "EVTX-SYS", "evtx:Firewall": "EVTX-FW", "evtx:BITS": "EVTX-BITS",
    "evtx:NetworkProfile": "EVTX-NET", "evtx:Sysmon": "SYSMON", "evtx:DriverFrameworks": "EVTX-DRV", "evtx:KernelPnP": "EVTX-PNP", "evtx:AssignedAccess": "EVTX-AAOP",
    "evtx:AssignedAccessAdmin": "EVTX-AAADM", "evtx:AssignedAccessBroker": "EVTX-AABRK", "evtx:RDPConnection": "EVTX-RDPCM", "evtx:RDPSession": "EVTX-RDPLSM",
    "evtx:Application": "EVTX-APP", "registry:SYSTEM": "REG-SYS", "registry:SOFTWARE": "REG-SW", "registry:Amcache": "AMCACHE", "recentfilecache": "RFCACHE", "prefetch": "PF",
    "evtx:Defender": "EVTX-DEF", "evtx:PowerShell": "EVTX-PS", "srum:NetworkUsage": "SRUM-NET", "srum:AppResourceUsage": "SRUM-APP", "srum:NetworkConnectivity": "SRUM-CONN",
    "sqlite:StateRepository": "SQLITE-SR", "sqlite:Notifications": "SQLITE-WPN",
}


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON lines; blank lines are skipped, a malformed line fails the query, fields keep their raw text beside the VARIANT."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    flat = T.StructType([f for f in SCHEMA.fields if f.name != "fields"])
    parsed = lines.select("value", F.from_json("value", flat, {"mode": "FAILFAST"}).alias("r"))
    raw = F.get_json_object("value", "$.fields")
    return parsed.select("r.*", F.try_parse_json(raw).alias("fields"), raw.alias("fields_json"))


def write_jsonl(records: DataFrame, path: str) -> None:
    """One folder an artifact; the job's commit makes each file whole or absent."""
    text = F.to_json(F.struct(*(c for c in records.columns)), {"ignoreNullFields": "true"})
    records.select("artifact", text.alias("value")).write.partitionBy("artifact").text(path)


def violations(records: DataFrame) -> DataFrame:
    """(check, ref, n): missing, repeated, wrongly prefixed and wrongly numbered references."""
    prefix = F.create_map(*(F.lit(x) for pair in PREFIXES.items() for x in pair))
    parts = F.split("ref", "#")
    rows = records.select("ref", "artifact", "record_num")
    tests = {
        "missing_ref": F.col("ref").isNull() | (F.col("ref") == ""),
        "wrong_prefix": F.get(parts, F.lit(0)) != prefix[F.col("artifact")],
        "wrong_number": F.get(parts, F.lit(1)).try_cast("bigint") != F.col("record_num"),
    }
    each = rows.select("ref", F.explode(F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in tests.items())))).alias("check")).groupBy("check", "ref").agg(F.count("*").alias("n"))
    repeated = rows.where("ref is not null").groupBy("ref").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated_ref").alias("check"), "ref", "n")
    return each.unionByName(repeated)
