"""IP addresses (X6, X7, F10, F11) as column expressions.

IPv4 addresses become longs. IPv6 addresses become 32 lower-case hex digits, so prefixes are
string prefixes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowquarry.functions.expr import let

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
V6_CHARS = rf"(?:[0-9A-Fa-f]{{0,4}}:){{2,7}}(?:{V4}|[0-9A-Fa-f]{{0,4}})"


def is_v4(s: Column) -> Column:
    return s.rlike(f"^{V4}$")


def v4_to_int(s: Column) -> Column:
    """A dotted quad as a long; null if it is none."""
    p = F.split(s, r"\.")
    value = sum(F.get(p, F.lit(i)).try_cast("long") * (1 << (24 - 8 * i)) for i in range(4))
    return F.when(is_v4(s), value)


def int_to_v4(n: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(n, 24 - 8 * i).bitwiseAND(F.lit(255)).cast("string") for i in range(4)])


def is_private_v4(n: Column) -> Column:
    """10/8, 172.16/12, 192.168/16. Everything else is global."""
    blocks = ((10 << 24, 24), ((172 << 24) | (16 << 16), 20), ((192 << 24) | (168 << 16), 16))
    out = F.lit(False)
    for low, bits in blocks:
        out = out | ((n >= low) & (n < low + (1 << bits)))
    return out


def normalize_v4(s: Column) -> Column:
    """Private addresses are 10.0.0.1; leading zeros go."""
    return let(v4_to_int(s), lambda n: F.when(is_private_v4(n), F.lit("10.0.0.1")).when(n.isNotNull(), int_to_v4(n)))


def v6_hex(s: Column) -> Column:
    """An IPv6 address as 32 hex digits; null if it is none. An embedded dotted quad is allowed at the end."""


    def spelled(t: Column) -> Column:
        """The address with a dotted quad at its end as two groups."""
        quad = F.regexp_extract(t, rf"({V4})$", 1)

        def joined(n: Column) -> Column:
            tail = F.concat(F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(F.lit(0xFFFF)))))
            return F.when(n.isNull(), t).otherwise(F.concat(F.regexp_replace(t, rf"{V4}$", ""), tail))

        return let(v4_to_int(quad), joined)

    def groups(x: Column) -> Column:
        return F.filter(F.split(x, ":"), lambda g: g != "")

    def digits(t: Column) -> Column:
        short = F.contains(t, F.lit("::"))
        ends = F.struct(
            groups(F.substring_index(t, "::", 1)).alias("left"),
            F.when(short, groups(F.substring_index(t, "::", -1))).otherwise(F.array().cast("array<string>")).alias("right"),
        )
        sound = t.rlike("^[0-9A-Fa-f:]+$") & F.contains(t, F.lit(":")) & ~t.rlike(":::|::.*::|(^|[^:]):$|^:[^:]|[0-9A-Fa-f]{5}")

        def filled(e: Column) -> Column:
            n = F.size(e["left"]) + F.size(e["right"])
            gap = F.when(short & (n <= 8), F.array_repeat(F.lit("0"), 8 - n)).otherwise(F.array().cast("array<string>"))
            return F.concat(e["left"], gap, e["right"])

        def text(all_: Column) -> Column:
            return F.when(F.size(all_) == 8, F.array_join(F.transform(all_, lambda g: F.lpad(F.lower(g), 4, "0")), ""))

        return F.when(sound, let(let(ends, filled), text))

    return let(let(s, spelled), digits)


def v6_text(digits: Column) -> Column:
    """The shortest text: the first longest run of two or more zero groups is left out."""
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.regexp_replace(digits.substr(4 * i + 1, F.lit(4)), "^0{1,3}", ""))

    def shortened(plain: Column) -> Column:
        out = plain
        for n in range(2, 9):  # the longest run found last wins
            run = ":".join(["0"] * n)
            cut = F.regexp_replace(F.regexp_replace(plain, rf"^(|.*?:){run}(|:.*)$", "$1::$2"), ":{3,4}", "::")
            out = F.when(plain.rlike(rf"(^|:){run}(:|$)"), cut).otherwise(out)
        return out

    return F.when(digits.isNotNull(), let(F.array_join(groups, ":"), shortened))


def canonical_v6(s: Column) -> Column:
    return let(v6_hex(s), v6_text)


def v6_class(digits: Column) -> Column:
    """global unicast, unique local, link local, site local, multicast, mapped or other."""


    def of(first: Column) -> Column:
        return (
        F.when(F.startswith(digits, F.lit("0" * 20 + "ffff")), "mapped")
        .when((first >= 0x2000) & (first < 0x4000), "global_unicast")
        .when((first >= 0xFC00) & (first < 0xFE00), "unique_local")
        .when((first >= 0xFE80) & (first < 0xFEC0), "link_local")
        .when((first >= 0xFEC0) & (first < 0xFF00), "site_local")
        .when(first >= 0xFF00, "multicast")
        .otherwise("other")
        )

    return let(F.conv(F.substring(digits, 1, 4), 16, 10).cast("int"), of)


def is_global_v6(digits: Column) -> Column:
    return v6_class(digits).isin("global_unicast", "mapped")


def normalize_v6(s: Column) -> Column:
    """Addresses that are not global are fd00::1."""
    return let(v6_hex(s), lambda d: F.when(d.isNotNull(), F.when(is_global_v6(d), v6_text(d)).otherwise(F.lit("fd00::1"))))


def normalize_ip(s: Column) -> Column:
    """The normalised address, or an empty string if s is none."""
    return F.when(is_v4(s), normalize_v4(s)).otherwise(F.coalesce(normalize_v6(s), F.lit("")))
