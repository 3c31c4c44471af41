"""Server names and registered domains (X1-X5), as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowquarry.functions.expr import let
from flowquarry.functions.ip import V4, V6_CHARS, canonical_v6, normalize_v4, normalize_v6

#: One label: letters, digits, hyphen, underscore. A wildcard stands only alone and first.
_LABEL = r"[A-Za-z0-9_-]+"
HOST = rf"(?:\*|{_LABEL})(?:\.{_LABEL})*"
_TAIL = r"(?::(\d+).*)?$"


def _parts(name: Column) -> Column:
    """A struct of what a server name may be: v6, dns, v4, and its port."""

    def of(s: Column) -> Column:
        v6 = F.regexp_extract(s, rf"^\[?({V6_CHARS})\]?{_TAIL}", 1)
        host = F.regexp_extract(s, rf"^({HOST})\.?{_TAIL}", 1)
        v4 = F.regexp_extract(s, rf"^({V4})\.?{_TAIL}", 1)
        port = F.regexp_extract(s, r"^(?:\[[^\]]*\]|[^:\[]*):(\d+)", 1)
        return F.struct(
            s.alias("text"),
            let(v6, lambda x: F.when(F.contains(x, F.lit("::")) | (F.size(F.split(x, ":")) >= 7), canonical_v6(x))).alias("v6"),
            let(host, lambda h: F.when((h != "") & F.element_at(F.split(h, r"\."), -1).rlike("[A-Za-z]"), h)).alias("dns"),
            F.when(v4 != "", v4).alias("v4"),
            let(port, lambda p: F.when((p != "") & (F.length(p) <= 5) & (p.try_cast("int") <= 65535), p.try_cast("int"))).alias("port"),
        )

    return let(F.regexp_replace(name, "^ ", ""), of)


def _port(p: Column) -> Column:
    return F.when(p["v6"].isNull() | F.startswith(p["text"], F.lit("[")), p["port"])


def server_port(name: Column) -> Column:
    """The port at the end of a server name, or null."""
    return let(_parts(name), _port)


def normalize_server_name(name: Column, detail: bool = False) -> Column:
    """The name, or the class of what stands in its place: address, unqualified, missing or other `.alt`.

    With detail, a port and the address are put in front as labels.
    """

    def of(p: Column) -> Column:
        front = F.coalesce(F.concat(F.lit("_"), _port(p).cast("string"), F.lit(".")), F.lit("")) if detail else F.lit("")
        v4 = F.concat(F.translate(normalize_v4(p["v4"]), ".", "-"), F.lit(".")) if detail else F.lit("")
        v6 = F.concat(F.translate(normalize_v6(p["v6"]), ":", "-"), F.lit(".")) if detail else F.lit("")
        one = ~F.contains(p["dns"], F.lit(".")) & (p["dns"] != "localhost")
        dns = F.when(p["dns"] == "None", F.lit("missing.alt")).when(one, F.lit("unqualified.alt")).otherwise(p["dns"])
        return (
            F.when(p["v6"].isNotNull(), F.concat(front, v6, F.lit("address.alt")))
            .when(p["dns"].isNotNull(), F.concat(front, dns))
            .when(p["v4"].isNotNull(), F.concat(front, v4, F.lit("address.alt")))
            .when(p["text"].rlike(r"^:\d"), F.concat(front, F.lit("missing.alt")))
            .otherwise(F.lit("other.alt"))
        )

    empty = name.isNull() | (name == "") | F.startswith(name, F.lit("#"))
    return F.when(empty, F.lit("missing.alt")).otherwise(let(_parts(name), of))


def registered_domain(name: Column) -> Column:
    """The last two labels; a name with fewer dots stays whole."""
    return F.substring_index(name, ".", -2)


def legacy_domain(name: Column) -> Column:
    """The last two labels of a name with two dots or more; of `a.b` the last with its dot; of one label nothing."""
    n = F.size(F.split(name, r"\."))
    return F.when(n >= 3, F.substring_index(name, ".", -2)).when(n == 2, F.concat(F.lit("."), F.substring_index(name, ".", -1))).otherwise(F.lit(""))


def builder_domain(name: Column) -> Column:
    """As X3; null stays null, written None."""
    return F.coalesce(registered_domain(name), F.lit("None"))


def bare_name(name: Column) -> Column:
    """Without a trailing dot, for joins."""
    return F.regexp_replace(name, r"\.$", "")
