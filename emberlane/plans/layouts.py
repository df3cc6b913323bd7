"""Artifacts of volumes whose files are made of the parts: sixteen files a volume, some empty, some in other places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlane.plans.views import table
from emberlane.sources import layout

_USER = "AppData/Local/Microsoft/Windows/Notifications/wpndatabase.db"
#: Files of a volume.
PATHS = [
    "$mft", "raw/$MFT", "mft.raw", "Windows/System32/winevt/Logs/Security.evtx", "b/security.evtx", "a/b/Security.EVTX", f"Users/u/{_USER}", f"users/a/{_USER}", "Windows/System32/config/SOFTWARE", "other.txt",
    "Windows/Prefetch/b.PF", "windows/Prefetch/A.pf", "dl/1.pf", "dl/2.pf", "x/3.pf", "4.pf",
]


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    path = F.get(F.array(*map(F.lit, PATHS)), (k % 16).cast("int"))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("case"), F.floor(k / 16)).alias("root"), path.alias("path"), (F.col("p_size") % 3).cast("bigint").alias("size"))


def located_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = layout.locate(_files(spark, sf_dir))
    return found.withColumn("alternates", F.array_join("alternates", "|")).withColumn("empties", F.array_join("empties", "|"))


def located_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.locate_folders(_files(spark, sf_dir), most=3).withColumn("place", F.col("place").cast("bigint"))


QUERIES = {f.__name__: f for f in (located_files, located_folders)}
_PATHS = "[" + ", ".join(f"'{p}'" for p in PATHS) + "]"
#: (file, artifact, stage, order in the stage) by hand.
_KNOWN = "(0, '$MFT', 0, 0), (0, '$MFT', 2, 0), (0, '$MFT', 3, 0), (1, '$MFT', 3, 1), (2, '$MFT', 2, 3), (2, '$MFT', 3, 0), (3, 'evtx:Security', 0, 0), (3, 'evtx:Security', 3, 4), (4, 'evtx:Security', 3, 1), (5, 'evtx:Security', 3, 2), (6, 'sqlite:Notifications', 1, 0), (6, 'sqlite:Notifications', 3, 7), (7, 'sqlite:Notifications', 1, 0), (7, 'sqlite:Notifications', 3, 7), (8, 'registry:SOFTWARE', 0, 0), (8, 'registry:SOFTWARE', 3, 3)"
_FILES = f"with f as (select 'case' || p_partkey // 16 as root, p_partkey % 16 as t, {_PATHS}[p_partkey % 16 + 1] as path, p_size % 3 as size from part)"
ORACLE = {
    "located_files": f"""{_FILES}, k(t, artifact, stage, o) as (values {_KNOWN}),
c as (select root, artifact, path, size, stage, row_number() over (partition by root, artifact order by stage, o, lower(path), path) as place from f join k using (t)),
b as (select root, artifact, min(place) filter (size > 0) as best from c group by 1, 2), d as (select c.*, best, max(stage) filter (place = best) over w as s, max(path) filter (place = best) over w as chosen from c join b using (root, artifact) window w as (partition by root, artifact)),
a as (select root, artifact, string_agg(path, '|' order by place) as alternates from d where size > 0 and stage = s and s in (1, 3) and path <> chosen group by 1, 2),
e as (select root, artifact, string_agg(path, '|' order by place) as empties from (select root, artifact, path, min(place) as place from d where size = 0 and (best is null or place < best or stage = 3 and s = 3) group by 1, 2, 3) group by 1, 2)
select distinct d.root, d.artifact, chosen as path, ['volume_path', 'user_path', 'root_file', 'search'][s + 1] as method, coalesce(alternates, '') as alternates, coalesce(empties, '') as empties
from d left join a using (root, artifact) left join e using (root, artifact)""",
    "located_folders": f"""{_FILES}, p as (select *, case when t in (10, 11) then 'windows/prefetch' when t in (12, 13) then 'dl' when t = 14 then 'x' else '' end as folder from f where t >= 10 and size > 0),
n as (select root, folder, count(*) as n from p group by 1, 2), b as (select root, folder from n qualify row_number() over (partition by root order by folder <> 'windows/prefetch', n desc, case folder when '' then 0 when 'windows/prefetch' then 2 else 1 end, folder) = 1)
select root, 'prefetch' as artifact, path, case when folder = 'windows/prefetch' then 'volume_path' else 'search' end as method, row_number() over (partition by root order by lower(path), path) as place from p join b using (root, folder)""",
}
