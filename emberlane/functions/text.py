"""Text, path, hash, account and network keys as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and prefixes that occur on every machine.
BUILTIN_ACCOUNTS = ["system", "local service", "network service", "localsystem", "trustedinstaller", "-"]
LOCAL_HOSTS = ["localhost", "localhost.localdomain"]
OS_PREFIXES = ["windows/", "program files/", "program files (x86)/", "programdata/microsoft/", "winnt/"]

IPV4 = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"


def normalize_path(path: Column, *, lowered: bool = False) -> Column:
    """Slashes for backslashes, lower case, no trailing slash unless nothing else is left; ``lowered`` tells that slashes and case are so already."""
    slashed = path if lowered else F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    cut = F.regexp_replace(slashed, "(?<!/)/++$", "")
    return F.when(cut == "", slashed).otherwise(cut)


def nt_normalize(path: Column) -> Column:
    """Backslashes, lower case, doubled separators joined, ``.`` dropped and ``..`` resolved over all segments; nothing left is ``.``."""
    out = F.lower(F.replace(path, F.lit("/"), F.lit("\\")))
    shape = r"(?s)^(\\\\[^\\]+\\[^\\]*|[^\\]:|)(\\*)(.*)$"
    drive, rest = F.regexp_extract(out, shape, 1), F.regexp_extract(out, shape, 3)
    root = F.when(F.regexp_extract(out, shape, 2) != "", "\\").otherwise("")
    last = lambda kept: F.get(kept, F.size(kept) - 1)

    def step(kept: Column, part: Column) -> Column:
        up = part == ".."
        goes_up = up & (F.size(kept) > 0) & F.coalesce(last(kept) != "..", F.lit(False))
        return F.when((part == "") | (part == ".") | up & (F.size(kept) == 0) & (root != ""), kept).when(goes_up, F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(F.array_append(kept, part))

    parts = F.aggregate(F.split(rest, r"\\"), F.array().cast("array<string>"), step)
    joined = F.concat(drive, root, F.array_join(parts, "\\"))
    return F.when(joined == "", ".").otherwise(joined)


def basename(path: Column) -> Column:
    return F.element_at(F.split(normalize_path(path), "/"), -1)


def under_path(path: Column, folder: Column) -> Column:
    """Equal to a folder or inside it; the 64-bit program folder covers the 32-bit one."""
    p, f = normalize_path(path), normalize_path(folder)
    inside = (p == f) | p.startswith(F.concat(f, F.lit("/")))
    twin = F.regexp_replace(f, r"^([a-z]:/program files)(/|$)", "$1 (x86)$2")
    return inside | (f.rlike(r"^[a-z]:/program files(/|$)") & ((p == twin) | p.startswith(F.concat(twin, F.lit("/")))))


def path_matches(path: Column, prefix: str) -> Column:
    """Prefix by whole segments; * stands for any run inside one segment."""
    prefix = prefix.replace("\\", "/").lower().rstrip("/")
    p = normalize_path(path)
    if "*" not in prefix:
        return (p == prefix) | p.startswith(prefix + "/")
    pattern = "".join("[^/]*" if c == "*" else c if c.isalnum() or c in "/_" else "\\" + c for c in prefix)
    return p.rlike(f"^{pattern}(/|$)")


def os_owned(path: Column) -> Column:
    """Lies where the operating system or its installers put files, on any drive."""
    bare = F.regexp_replace(F.regexp_replace(normalize_path(path), "^[a-z]:", ""), "^/+", "")
    out = F.lit(False)
    for prefix in OS_PREFIXES:
        out = out | bare.startswith(prefix)
    return out


def account_key(user: Column) -> Column:
    """The lower-case name without its domain; null for built-in and machine accounts."""
    name = F.lower(F.element_at(F.split(F.trim(user), r"\\"), -1))
    return F.when((name != "") & ~name.isin(BUILTIN_ACCOUNTS) & ~name.endswith("$"), name)


def _octet(host: Column, i: int) -> Column:
    return F.element_at(F.split(host, r"\."), i).try_cast("int")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _plain_address(text: Column) -> Column:
    """An IPv6 address with an IPv4 address at its end written as two groups; null where that is none."""
    octet = lambda tail, i: F.element_at(F.split(tail, r"\."), i).try_cast("int")
    fits = lambda t: (octet(t, 1) <= 255) & (octet(t, 2) <= 255) & (octet(t, 3) <= 255) & (octet(t, 4) <= 255)
    pair = lambda t: F.concat(F.lower(F.hex(octet(t, 1) * 256 + octet(t, 2))), F.lit(":"), F.lower(F.hex(octet(t, 3) * 256 + octet(t, 4))))
    return let(F.regexp_extract(text, rf"({IPV4})$", 1), lambda tail: F.when(tail == "", text).when(fits(tail), F.concat(F.regexp_replace(text, rf"{IPV4}$", ""), pair(tail))))


def _groups(plain: Column) -> Column:
    """The eight groups of an address without leading zeros; null where it is none."""
    part = lambda i: F.filter(F.split(F.coalesce(F.get(F.split(plain, "::"), F.lit(i)), F.lit("")), ":"), lambda g: g != "")
    filled = lambda ends: F.when(F.size(F.split(plain, "::")) == 1, ends[0]).when((F.size(F.split(plain, "::")) == 2) & (F.size(ends[0]) + F.size(ends[1]) <= 7), F.concat(ends[0], F.array_repeat(F.lit("0"), 8 - F.size(ends[0]) - F.size(ends[1])), ends[1]))
    sound = plain.rlike(r"^[0-9a-f]{0,4}(::?[0-9a-f]{0,4})+$") & ~plain.rlike(r":::|^:[^:]|[^:]:$")
    return F.when(sound, let(let(F.array(part(0), part(1)), filled), lambda g: F.when(F.size(g) == 8, F.transform(g, lambda x: F.regexp_replace(x, "^0+(?=.)", "")))))


def _shortened(joined: Column) -> Column:
    """Groups joined by colons, the first of the longest runs of two or more zeros left out."""
    out = joined
    for n in range(2, 9):
        shape = rf"^(|.*?:)0(?::0){{{n - 1}}}(|:.*)$"
        short = F.concat(F.regexp_replace(F.regexp_extract(joined, shape, 1), ":$", ""), F.lit("::"), F.regexp_replace(F.regexp_extract(joined, shape, 2), "^:", ""))
        out = F.when(joined.rlike(shape), short).otherwise(out)
    return out


def _short_key(bare: Column) -> Column:
    dotted = bare.rlike(f"^{IPV4}$")
    possible = (_octet(bare, 1) <= 255) & (_octet(bare, 2) <= 255) & (_octet(bare, 3) <= 255) & (_octet(bare, 4) <= 255)
    plain = F.when(~dotted, True).otherwise(possible & ~bare.startswith("127.") & (bare != "0.0.0.0"))
    return F.when((bare != "") & ~bare.isin(LOCAL_HOSTS) & plain, bare)


def _long_key(text: Column) -> Column:
    number = lambda g, i: F.conv(F.get(g, F.lit(i)), 16, 10).cast("int")
    four = lambda g: F.concat_ws(".", F.floor(number(g, 6) / 256), number(g, 6) % 256, F.floor(number(g, 7) / 256), number(g, 7) % 256)
    of = lambda g: F.when(F.array_join(F.slice(g, 1, 6), ":") == "0:0:0:0:0:ffff", let(four(g), _short_key)).otherwise(let(let(F.array_join(g, ":"), _shortened), lambda k: F.when(~k.isin("::", "::1"), k)))
    return let(let(let(text, _plain_address), _groups), lambda g: F.when(g.isNotNull(), of(g)))


def network_key(host: Column) -> Column:
    """A host or address in lower case, IPv6 in its shortest form and as IPv4 where it stands for one; null for local, loopback, unspecified and impossible ones."""
    bare = F.lower(F.regexp_replace(F.trim(host), r"\.+$", ""))
    long = F.regexp_replace(F.regexp_replace(bare, r"^\[|\]$", ""), "%.*$", "")
    return F.when(bare.contains(":"), _long_key(long)).otherwise(_short_key(bare))


def embedded_hosts(command: Column) -> Column:
    """Network keys of the IPv4 addresses and URL hosts inside a command line, distinct and sorted."""
    addresses = F.regexp_extract_all(command, F.lit(rf"\b({IPV4})\b"), F.lit(1))
    hosts = F.regexp_extract_all(command, F.lit(r"(?i)https?://(?:[^\s\"'<>/?#@]*@)?([^\s\"'<>/?#:@]+)"), F.lit(1))
    keys = F.transform(F.concat(addresses, hosts), lambda h: network_key(F.regexp_replace(h, r"[.,);\]}]+$", "")))
    return F.array_sort(F.array_distinct(F.array_compact(keys)))


def hash_set(text: Column) -> Column:
    """Digests of 32, 40 or 64 hex digits in a list like ``MD5=..,SHA256=..``, lower case, distinct and sorted."""
    parts = F.split(text, "[,;]")
    bare = F.transform(parts, lambda p: F.lower(F.regexp_replace(F.trim(p), r"^[A-Za-z0-9-]+\s*[=:]\s*", "")))
    return F.array_sort(F.array_distinct(F.filter(bare, lambda h: h.rlike("^([0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64})$"))))


def display_string(text: Column) -> Column:
    """The display part of an indirect string ``@resource;Display``; other strings as they are."""
    return F.when(text.rlike(r"^@[^;]*;.+"), F.regexp_extract(text, r"(?s)^@[^;]*;(.+)$", 1)).otherwise(text)


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.when(c.cast("string") != "", c) for c in columns))


def ref_parts(ref: Column) -> Column:
    """A reference PREFIX#number as a struct; null where it is not one (no leading zero)."""
    good = ref.rlike(r"^[A-Z][A-Z0-9-]*#(0|[1-9][0-9]*)$")
    return F.when(good, F.struct(F.split_part(ref, F.lit("#"), F.lit(1)).alias("prefix"), F.split_part(ref, F.lit("#"), F.lit(2)).cast("bigint").alias("number")))


def bit_names(mask: Column, names: list[str | None]) -> Column:
    """The names of the set bits, lowest first; bits without a name are left out."""
    bits = F.array(*(F.when(F.shiftright(mask, i).bitwiseAND(F.lit(1)) == 1, F.lit(n)) for i, n in enumerate(names) if n))
    return F.array_compact(bits)
