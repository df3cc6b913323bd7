"""Column functions against stated values."""

import pytest
from pyspark.sql import functions as F

from emberlane.functions import compare, text, times


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("raw,want", [("C:\\A\\b\\", "c:/a/b"), ("/", "/"), ("\\\\srv\\X", "//srv/x"), (None, None)])
def test_normalize_path(spark, raw, want):
    assert value(spark, text.normalize_path(F.lit(raw))) == want


@pytest.mark.parametrize("raw,want", [("Host.Example.", "host.example"), ("127.0.0.1", None), ("10.0.0.300", None), ("10.1.2.3", "10.1.2.3"), ("localhost", None), ("0.0.0.0", None), ("", None), (None, None)])
def test_network_key(spark, raw, want):
    assert value(spark, text.network_key(F.lit(raw))) == want


@pytest.mark.parametrize("raw,want", [("CORP\\Bob", "bob"), ("NT AUTHORITY\\SYSTEM", None), ("X\\PC1$", None), ("-", None)])
def test_account_key(spark, raw, want):
    assert value(spark, text.account_key(F.lit(raw))) == want


@pytest.mark.parametrize(
    "raw,want",
    [
        ("1970-01-01T00:00:01.1234567Z", 1_123_456), ("1970-01-01 00:00:01", 1_000_000), ("1970-01-01T09:00:00+09:00", 0), ("1970-01-01T09:00:00+0900", 0),
        ("1969-12-31T23:00:00-01:00", 0), ("1970-01-01", None), ("x", None), (None, None), ("1970-02-31T00:00:00Z", None),
    ],
)
def test_parse_micros(spark, raw, want):
    assert value(spark, times.parse_micros(F.lit(raw))) == want


def test_hash_set(spark):
    assert value(spark, text.hash_set(F.lit("MD5=" + "A" * 32 + ",SHA1:" + "b" * 40 + ";x=12"))) == ["a" * 32, "b" * 40]


@pytest.mark.parametrize("path,folder,want", [("C:\\a\\b", "c:/a", True), ("c:/ab", "c:/a", False), ("C:\\Program Files (x86)\\q", "C:\\Program Files", True)])
def test_under_path(spark, path, folder, want):
    assert value(spark, text.under_path(F.lit(path), F.lit(folder))) is want


@pytest.mark.parametrize("a,b,want", [("true", "TRUE", True), ("10", "10.0", True), (" x", "x ", True), ("x", "y", False), ("true", "1", False)])
def test_scalar_equal(spark, a, b, want):
    assert value(spark, compare.scalar_equal(F.lit(a), F.lit(b))) is want


def test_ratio_rounds_to_even(spark):
    assert value(spark, compare.ratio(F.lit(1), F.lit(0))) is None
    assert value(spark, compare.ratio(F.lit(1), F.lit(3))) == 0.3333


def test_path_globs(spark):
    assert value(spark, text.path_matches(F.lit("C:\\Users\\bob\\x"), "c:/users/*/x"))
    assert not value(spark, text.path_matches(F.lit("C:\\Users\\bob\\y\\x"), "c:/users/*/x"))


@pytest.mark.parametrize("raw", ["C:/A//b/./c/../D", "c:\\a\\b\\..\\..\\d", "a\\b\\", "c:\\x\\.", "..\\a", "c:\\..\\x", "a\\..", "\\a\\..\\..\\b", "c:a\\..\\..\\b", "/".join(["a"] * 20 + [".."] * 20 + ["b"]), "\\\\host\\share\\a\\..\\..\\b", "a\\\\..\\..\\.."])
def test_nt_normalize_like_ntpath(spark, raw):
    import ntpath

    assert value(spark, text.nt_normalize(F.lit(raw))) == ntpath.normpath(ntpath.normcase(raw))


def test_windows_only_widen(spark):
    low, high = times.local_widened(F.lit(100), F.lit(200))
    assert value(spark, low) < 100 and value(spark, high) == 200
    low, high = times.clamped(F.lit(100), F.lit(200), F.lit(150))
    assert (value(spark, low), value(spark, high)) == (100, 150)
    low, high = times.clamped(F.lit(100), F.lit(200), F.lit(50))
    assert (value(spark, low), value(spark, high)) == (50, 50)
