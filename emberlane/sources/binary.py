"""Small binary artifacts to rows, a file at a time: recent-file cache and SQLite tables.

Spark finds and reads the files (``binaryFile``, any store); a small function turns the
bytes of one file into rows. Formats are those of the public documentation.
"""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def _rows(spark: SparkSession, path: str, schema: str, read: Callable[[bytes], Iterator[tuple]], glob: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "content")
    names = [part.split()[0] for part in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"]):
                out = []
                for row in read(bytes(content)):
                    out.append((file, *row))
                    if len(out) >= 50_000:
                        yield pd.DataFrame(out, columns=["file", *names])
                        out = []
                yield pd.DataFrame(out, columns=["file", *names])

    return files.mapInPandas(run, f"file string, {schema}")


def recent_paths(data: bytes) -> Iterator[tuple]:
    """(offset, path): length-prefixed UTF-16 strings after a header of 20 bytes."""
    at = 20
    while at + 4 <= len(data):
        n = struct.unpack_from("<I", data, at)[0]
        end = at + 4 + 2 * n + 2
        if n == 0 or end > len(data):
            break
        yield at, data[at + 4:at + 4 + 2 * n].decode("utf-16-le", "replace")
        at = end


def read_recent_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    return _rows(spark, path, "offset bigint, name string", recent_paths, glob)


def read_sqlite(spark: SparkSession, path: str, tables: list[str], glob: str | None = None) -> DataFrame:
    """(file, table, rowid, fields): rows of some tables of SQLite files, columns as one VARIANT."""

    def read(data: bytes) -> Iterator[tuple]:
        import json

        con = sqlite3.connect(":memory:")
        con.deserialize(data)
        have = {r[0] for r in con.execute("select name from sqlite_master where type = 'table'")}
        for t in tables:
            if t in have:
                rows = con.execute(f'select rowid, * from "{t}" order by rowid')
                names = [d[0] for d in rows.description][1:]
                for rowid, *values in rows:
                    yield t, rowid, json.dumps({n: v.hex() if isinstance(v, bytes) else v for n, v in zip(names, values)})
        con.close()

    return _rows(spark, path, "table string, rowid bigint, raw string", read, glob).select("file", "table", "rowid", F.parse_json("raw").alias("fields"))


def with_lookup(rows: DataFrame, lookup: DataFrame, *, key: str, id_: str, value: str, out: str) -> DataFrame:
    """Adds a looked-up value; ids that the lookup does not know give null. The lookup has one row an id at most."""
    known = lookup.groupBy(F.col(id_).alias("_id")).agg(F.max(value).alias(out))
    return rows.join(known, F.col(key) == F.col("_id"), "left").drop("_id")


def read_collection_log(spark: SparkSession, path: str) -> DataFrame:
    """(us): the latest copy time of collection logs, CSV with a CopiedTimestamp column."""
    from emberlane.functions.times import parse_micros

    return spark.read.option("header", "true").csv(path).agg(F.max(parse_micros(F.col("CopiedTimestamp"))).alias("us"))
