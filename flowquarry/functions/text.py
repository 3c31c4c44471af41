"""Strings and bytes (X8, X11-X16, X19, X20, X23, X24, F12) as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels of well-known ports.
PORT_APPS = {
    443: "https",
    448: "database",
    465: "email",
    563: "nntp",
    585: "email",
    614: "shell",
    636: "ldap",
    989: "ftp",
    990: "ftp",
    991: "nas",
    992: "telnet",
    993: "email",
    994: "irc",
    995: "email",
    1443: "alt-https",
    2376: "docker",
    8001: "tor",
    8443: "alt-https",
    9000: "tor",
    9001: "tor",
    9002: "tor",
    9101: "tor",
}


def port_app(port: Column) -> Column:
    """The label of a port, or unknown."""
    pairs = [F.lit(x) for kv in PORT_APPS.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), port), F.lit("unknown"))


def hamming(a: Column, b: Column) -> Column:
    """Bits that differ between two hex strings of one length; over their common length otherwise."""
    n = F.least(F.length(a), F.length(b)) / 2

    def bits(i: Column) -> Column:
        x, y = (F.conv(s.substr((2 * i + 1).cast("int"), F.lit(2)), 16, 10).cast("int") for s in (a, b))
        return F.bit_count(x.bitwiseXOR(y)).cast("long")

    at = F.when(n >= 1, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(at, F.lit(0).cast("long"), lambda s, i: s + bits(i))


def _bytewise(a: Column, b: Column, of: Callable[[Column, Column], Column]) -> Column:
    """Hex digits of a function of the bytes of two hex strings, over their common length."""
    n = F.floor(F.least(F.length(a), F.length(b)) / 2).cast("int")
    at = F.when(n >= 1, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def digits(i: Column) -> Column:
        x, y = (F.conv(s.substr(2 * i + 1, F.lit(2)), 16, 10).cast("int") for s in (a, b))
        return F.lpad(F.lower(F.hex(of(x, y))), 2, "0")

    return F.array_join(F.transform(at, digits), "")


def bytes_xor(a: Column, b: Column) -> Column:
    """Two hex strings, byte by byte; what one has beyond the other is left out."""
    return _bytewise(a, b, lambda x, y: x.bitwiseXOR(y))


def bytes_and(a: Column, b: Column) -> Column:
    """As bytes_xor, the bits that both have."""
    return _bytewise(a, b, lambda x, y: x.bitwiseAND(y))


def hamming_weight(a: Column) -> Column:
    """The bits that are set in a hex string."""
    return hamming(a, F.repeat(F.lit("0"), F.length(a)))


def matching_characters(a: Column, b: Column) -> Column:
    """The characters that two strings share at the same place, and * elsewhere, over their common length."""
    n = F.least(F.length(a), F.length(b))
    at = F.when(n >= 1, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.array_join(F.transform(at, lambda i: F.when(a.substr(i, F.lit(1)) == b.substr(i, F.lit(1)), a.substr(i, F.lit(1))).otherwise(F.lit("*"))), "")


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, one row of the table at a time."""
    ys = F.when(F.length(b) > 0, F.split(b, "")).otherwise(F.array().cast("array<string>"))
    xs = F.when(F.length(a) > 0, F.split(a, "")).otherwise(F.array().cast("array<string>"))

    def row(above: Column, x: Column) -> Column:
        def cell(acc: Column, j: Column) -> Column:
            here = F.when(F.get(ys, j) == x, F.get(above, j) + 1).otherwise(F.greatest(F.get(above, j + 1), F.element_at(acc, -1)))
            return F.concat(acc, F.array(here))

        at = F.when(F.size(ys) > 0, F.sequence(F.lit(0), F.size(ys) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(at, F.array(F.lit(0)), cell)

    return F.element_at(F.aggregate(xs, F.array_repeat(F.lit(0), F.size(ys) + 1), row), -1)


def common_substring(a: Column, b: Column) -> Column:
    """Length of the longest common substring."""
    n = F.length(a)
    starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))

    def longest(best: Column, i: Column) -> Column:
        # a longer match from i is looked for only beyond the best so far
        sizes = F.when(n - i + 1 > best, F.sequence(best + 1, n - i + 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(sizes, best, lambda m, k: F.when((k == m + 1) & F.contains(b, a.substr(i, k)), k).otherwise(m))

    return F.aggregate(starts, F.lit(0), longest)


def byte_profile(s: Column) -> Column:
    """Counts of byte classes and lengths of runs of visible characters."""
    runs = F.filter(F.split(F.regexp_replace(s, r"[^\x21-\x7e]+", " "), " "), lambda x: x != "")
    total = F.aggregate(runs, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return F.struct(
        F.octet_length(s).cast("long").alias("n_bytes"),
        F.length(F.regexp_replace(s, r"[^\x20-\x7e]", "")).cast("long").alias("n_printable"),
        F.length(F.regexp_replace(s, r"[^\x21-\x7e]", "")).cast("long").alias("n_graphical"),
        F.length(F.regexp_replace(s, r"[^\r\n]", "")).cast("long").alias("n_line_ends"),
        F.size(runs).cast("long").alias("n_runs"),
        F.coalesce(F.array_max(F.transform(runs, lambda x: F.length(x))), F.lit(0)).cast("long").alias("longest_run"),
        F.when(F.size(runs) > 0, F.round(total / F.size(runs), 6)).otherwise(F.lit(0.0)).alias("mean_run"),
    )


def syslog_facility(priority: Column) -> Column:
    """X23."""
    return F.floor(priority / 8).cast("int")


def syslog_severity(priority: Column) -> Column:
    """X23."""
    return F.pmod(priority, F.lit(8)).cast("int")


def jwt_parts(token: Column) -> Column:
    """Header and payload of a token as text, and its signature."""

    def plain(x: Column) -> Column:
        std = F.translate(x, "-_", "+/")
        padded = F.rpad(std, F.ceil(F.length(std) / 4).cast("int") * 4, "=")
        return F.try_to_binary(padded, F.lit("base64")).cast("string")

    p = F.split(token, r"\.")
    return F.when(
        F.size(p) == 3,
        F.struct(plain(F.get(p, F.lit(0))).alias("header"), plain(F.get(p, F.lit(1))).alias("payload"), F.get(p, F.lit(2)).alias("signature")),
    )


def is_json_safe(b: Column) -> Column:
    """bytes are valid UTF-8 without control characters."""
    s = F.try_validate_utf8(b.cast("string"))
    return s.isNotNull() & ~F.coalesce(s, F.lit("")).rlike(r"[\x00-\x1f]")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
