"""Artifacts of collected volumes, found by layout, user, name and search."""

from pyspark.sql import functions as F

from emberlane.sources import layout

FILES = [
    ("a", "$mft", 5), ("a", "sub/$MFT", 9), ("a", "WINDOWS/system32/WinEvt/Logs/SECURITY.evtx", 0), ("a", "Security.evtx", 0), ("a", "x/y/security.EVTX", 3), ("a", "z/security.evtx", 4), ("a", "w/security.evtx", 0),
    ("a", "Users/Zoe/AppData/Local/Microsoft/Windows/Notifications/wpndatabase.db", 1), ("a", "users/bob/AppData/Local/Microsoft/Windows/Notifications/wpndatabase.db", 1), ("a", "Users/amy/AppData/Local/Microsoft/Windows/Notifications/wpndatabase.db", 0),
    ("a", "$Extend/$J", 7), ("a", "$Extend/$UsnJrnl$J", 0), ("a", "Windows/System32/config/SYSTEM", 0), ("a", "notes.txt", 3), ("a", "Windows/Prefetch/B.pf", 1), ("a", "windows/prefetch/a.PF", 1), ("a", "Windows/Prefetch/c.pf", 0), ("a", "dl/1.pf", 1), ("a", "dl/2.pf", 1), ("a", "dl/3.pf", 1),
    ("b", "deep/er/1.pf", 1), ("b", "deep/er/2.pf", 1), ("b", "top/1.pf", 1), ("b", "top/2.pf", 1), ("b", "one.pf", 1), ("b", "Microsoft-Windows-Sysmon-Operational.evtx", 2), ("b", "k/mft.raw", 1), ("b", "j/MFT", 1),
]


def test_single_files(spark):
    rows = layout.locate(spark.createDataFrame(FILES, "root string, path string, size long")).collect()
    got = {(r.root, r.artifact): (r.path, r.method, r.alternates, r.empties) for r in rows}
    users = "AppData/Local/Microsoft/Windows/Notifications/wpndatabase.db"
    assert got == {
        ("a", "$MFT"): ("$mft", "volume_path", [], []),
        ("a", "evtx:Security"): ("z/security.evtx", "search", ["x/y/security.EVTX"], ["WINDOWS/system32/WinEvt/Logs/SECURITY.evtx", "Security.evtx", "w/security.evtx"]),
        ("a", "sqlite:Notifications"): (f"users/bob/{users}", "user_path", [f"Users/Zoe/{users}"], [f"Users/amy/{users}"]),
        ("a", "$UsnJrnl"): ("$Extend/$J", "volume_path", [], ["$Extend/$UsnJrnl$J"]),
        ("a", "registry:SYSTEM"): (None, None, [], ["Windows/System32/config/SYSTEM"]),
        ("b", "evtx:Sysmon"): ("Microsoft-Windows-Sysmon-Operational.evtx", "root_file", [], []),
        ("b", "$MFT"): ("j/MFT", "search", ["k/mft.raw"], []),
    }


def test_folders(spark):
    df = spark.createDataFrame(FILES, "root string, path string, size long")
    got = sorted((r.root, r.path, r.method, r.place) for r in layout.locate_folders(df).collect())
    assert got == [("a", "Windows/Prefetch/B.pf", "volume_path", 2), ("a", "windows/prefetch/a.PF", "volume_path", 1), ("b", "top/1.pf", "search", 1), ("b", "top/2.pf", "search", 2)]
    assert layout.locate_folders(df, most=1).count() == 2 and layout.locate(df.limit(0)).count() == 0


def test_files_of_a_folder(spark, tmp_path):
    (tmp_path / "Windows" / "Prefetch").mkdir(parents=True)
    (tmp_path / "Windows" / "Prefetch" / "X.pf").write_bytes(b"abc")
    (tmp_path / "$MFT").write_bytes(b"")
    assert {(r.path, r.size) for r in layout.list_files(spark, str(tmp_path)).collect()} == {("Windows/Prefetch/X.pf", 3), ("$MFT", 0)}
    files = layout.list_files(spark, f"file://{tmp_path}/").withColumn("root", F.lit("r"))
    assert [r.path for r in layout.locate_folders(files).collect()] == ["Windows/Prefetch/X.pf"]
