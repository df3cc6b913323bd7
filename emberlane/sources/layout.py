"""Where the artifacts of a collected volume lie: a join of its files with a table of places, whatever the case of names."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberlane.sources.event_log import CHANNELS
from emberlane.sources.ranges import RangeSource, Read, read_ranges, store_of

#: Most files that are taken from one folder (fixed value).
MOST_FILES = 4096


@dataclass(frozen=True)
class Place:
    """Paths from the volume's root in their order, paths from a user's folder, names at the root or anywhere; or folders and the ending of their files."""

    artifact: str
    paths: tuple[str, ...] = ()
    user_paths: tuple[str, ...] = ()
    names: tuple[str, ...] = ()
    folders: tuple[str, ...] = ()
    suffix: str = ""


def _log(artifact: str, channel: str) -> Place:
    """A slash of a channel is %4 in a file's name; some tools write a dash."""
    stored = channel.replace("/", "%4") + ".evtx"
    return Place(artifact, (f"Windows/System32/winevt/Logs/{stored}",), names=tuple(dict.fromkeys((stored, channel.replace("/", "-") + ".evtx"))))


#: Places of the artifacts (fixed values).
PLACES = (
    Place("$MFT", ("$MFT",), names=("$MFT", "MFT", "$MFT.bin", "mft.raw")),
    Place("$UsnJrnl", ("$Extend/$UsnJrnl$J", "$Extend/$UsnJrnl%3A%24J", "$Extend/$J", "$Extend/$UsnJrnl"), names=("$UsnJrnl$J", "$J", "$UsnJrnl", "UsnJrnl.bin")),
    *(_log(a, c) for a, c in CHANNELS.items()),
    Place("registry:SYSTEM", ("Windows/System32/config/SYSTEM",), names=("SYSTEM",)),
    Place("registry:SOFTWARE", ("Windows/System32/config/SOFTWARE",), names=("SOFTWARE",)),
    Place("registry:Amcache", ("Windows/AppCompat/Programs/Amcache.hve",), names=("Amcache.hve",)),
    Place("recentfilecache", ("Windows/AppCompat/Programs/RecentFileCache.bcf",), names=("RecentFileCache.bcf",)),
    Place("prefetch", folders=("Windows/Prefetch",), suffix=".pf"),
    Place("sqlite:Notifications", user_paths=("AppData/Local/Microsoft/Windows/Notifications/wpndatabase.db",), names=("wpndatabase.db",)),
)

VOLUME, USER, ROOT, SEARCH = range(4)
_METHODS = ("volume_path", "user_path", "root_file", "search")


class ListingSource(RangeSource):
    """Files with their sizes, those of no bytes too; nothing of them is read."""

    columns = "file string, size bigint"

    @classmethod
    def name(cls) -> str:
        return "file_listing"

    @staticmethod
    def scan(file: str, read: Read, size: int, start: int, end: int) -> Iterator[pa.RecordBatch]:  # noqa: ARG004
        if start == 0:
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([size], pa.int64())], names=["file", "size"])


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, size) of the files below a folder, paths from the folder; contents are not read. A file is one partition."""
    _, root = store_of(path)
    root = root.rstrip("/").strip("/")
    return read_ranges(spark, ListingSource, path, split=1 << 62).select(F.regexp_replace("file", rf"^/*\Q{root}\E/", "").alias("path"), "size")


def locate(files: DataFrame, places: tuple[Place, ...] = PLACES, *, root: str = "root") -> DataFrame:
    """(root, artifact, path, method, alternates, empties): the file of each artifact that has one file, in each volume.

    files: root, path (with slashes, from the root), size. Looked for are paths of the
    volume in their order, then a path of the users' folders, the first by name, then names
    at the root, then names anywhere, the shallowest first. Case does not count, equal ones
    are in the order of their paths. A file of no bytes is no candidate but is remembered in
    empties, if it would have come before. Alternates are the others of the users or of the
    search. An artifact that has nothing but empty files has a row without a path.
    """
    spark = files.sparkSession
    rows = []
    for p in places:
        rows += [(p.artifact, VOLUME, i, x.lower()) for i, x in enumerate(p.paths)] + [(p.artifact, USER, i, x.lower()) for i, x in enumerate(p.user_paths)]
        rows += [(p.artifact, s, i, x.lower()) for s in (ROOT, SEARCH) for i, x in enumerate(p.names)]
    table = F.broadcast(spark.createDataFrame(rows, "artifact string, stage int, ordinal int, want string"))
    low = F.lower("path")
    f = files.select(F.col(root).alias("root"), "path", "size", low.alias("low"), F.regexp_extract(low, r"([^/]*)$", 1).alias("name"), F.regexp_extract(low, r"^users/[^/]+/(.+)$", 1).alias("below"), (F.size(F.split(low, "/")) - 1).alias("depth"))
    # a file has four keys by which it may be meant, so places are met by equality
    key = lambda stage, want: F.struct(F.lit(stage).alias("stage"), want.alias("want"))
    keys = F.array(key(VOLUME, F.col("low")), key(USER, F.col("below")), key(ROOT, F.when(F.col("depth") == 0, F.col("name"))), key(SEARCH, F.col("name")))
    met = f.withColumn("k", F.explode(keys)).select("root", "path", "size", "low", "depth", "k.stage", "k.want").join(table, ["stage", "want"])
    order = ["stage", F.when(F.col("stage") == SEARCH, F.col("depth")).otherwise(0), F.when(F.col("stage") < SEARCH, F.col("ordinal")).otherwise(0), "low", "path"]
    placed = met.withColumn("place", F.row_number().over(Window.partitionBy("root", "artifact").orderBy(*order)))
    full = F.col("size") > 0
    first = placed.groupBy("root", "artifact").agg(F.min(F.when(full, F.struct("place", "stage", "path"))).alias("first"), F.sort_array(F.collect_list(F.struct("place", "stage", "path", full.alias("full")))).alias("all"))
    others = F.filter("all", lambda c: c.full & (c.stage == F.col("first.stage")) & (c.path != F.col("first.path")) & c.stage.isin(USER, SEARCH))
    passed = F.filter("all", lambda c: ~c.full & (F.col("first").isNull() | (c.place < F.col("first.place")) | (c.stage == SEARCH) & (F.col("first.stage") == SEARCH)))
    names = lambda items: F.array_distinct(F.transform(items, lambda c: c.path))
    return first.select("root", "artifact", "first.path", F.get(F.array(*map(F.lit, _METHODS)), F.col("first.stage")).alias("method"), names(others).alias("alternates"), names(passed).alias("empties"))


def locate_folders(files: DataFrame, places: tuple[Place, ...] = PLACES, *, root: str = "root", most: int = MOST_FILES) -> DataFrame:
    """(root, artifact, path, method, place): files of the artifacts that have a folder, sorted by name, ``most`` at most.

    The first known folder that holds a file of bytes with the ending is taken; else, in
    the whole volume, the one with most of them, then the shallowest, then the first by path.
    """
    spark = files.sparkSession
    rows = [(p.artifact, p.suffix.lower(), i, x.lower()) for p in places for i, x in enumerate(p.folders)]
    endings = F.broadcast(spark.createDataFrame([(a, s) for a, s in dict.fromkeys((p.artifact, p.suffix.lower()) for p in places if p.folders)], "artifact string, suffix string"))
    known = F.broadcast(spark.createDataFrame(rows, "artifact string, suffix string, ordinal int, folder string"))
    low = F.lower("path")
    f = files.where("size > 0").select(F.col(root).alias("root"), "path", F.regexp_extract(low, r"^(?:(.*)/)?[^/]*$", 1).alias("folder"), F.regexp_extract(low, r"([^/]*)$", 1).alias("name"), F.regexp_extract(low, r"(\.[^./]*)$", 1).alias("suffix"))
    held = f.join(endings, "suffix")
    counts = held.groupBy("root", "artifact", "folder").agg(F.least(F.count("*"), F.lit(most)).alias("n")).join(known.select("artifact", "folder", "ordinal"), ["artifact", "folder"], "left")
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    best = Window.partitionBy("root", "artifact").orderBy(F.col("ordinal").asc_nulls_last(), F.desc("n"), depth, "folder")
    chosen = counts.withColumn("b", F.row_number().over(best)).where("b = 1").select("root", "artifact", "folder", F.when(F.col("ordinal").isNotNull(), _METHODS[VOLUME]).otherwise(_METHODS[SEARCH]).alias("method"))
    by_name = Window.partitionBy("root", "artifact").orderBy("name", "path")
    return held.join(chosen, ["root", "artifact", "folder"]).withColumn("place", F.row_number().over(by_name)).where(F.col("place") <= most).select("root", "artifact", "path", "method", "place")
