"""Lookups against resource tables.

Flows stay where they are: a lookup is a left join on equal keys, and Spark broadcasts the resource
side if its measured size allows it, else it shuffles both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.functions.fingerprints import fp_type, randomized_key
from flowquarry.functions.ip import is_private_v4, v4_to_int, v6_hex
from flowquarry.operators.state import seen_before


def longest_prefix(rows: DataFrame, address: Column, prefixes: DataFrame, values: list[str]) -> DataFrame:
    """Rows with the values of the longest IPv4 prefix (net, len) that has the address; nulls without one.

    One equi-join for each length that occurs, at most 33, the longest first.
    """
    lengths = sorted((r["len"] for r in prefixes.select("len").distinct().collect()), reverse=True)
    out = rows.withColumn("__fq_a", address)
    for n in lengths:
        own = prefixes.filter(F.col("len") == n).select(
            F.shiftright("net", 32 - n).alias(f"__fq_k{n}"), F.struct(F.lit(n).alias("len"), *values).alias(f"__fq_v{n}")
        )
        out = out.join(own, F.shiftright("__fq_a", 32 - n) == F.col(f"__fq_k{n}"), "left").drop(f"__fq_k{n}")
    best = F.coalesce(*[F.col(f"__fq_v{n}") for n in lengths]) if lengths else F.lit(None)
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], *([best[v].alias(v) for v in ["len", *values]] if lengths else [F.lit(None).alias(v) for v in ["len", *values]]))


def longest_prefix_v6(rows: DataFrame, address: Column, prefixes: DataFrame, values: list[str]) -> DataFrame:
    """J4 for IPv6: prefixes (net as 32 hex digits, len); bits become a binary text, whose prefixes are strings."""
    lengths = sorted((r["len"] for r in prefixes.select("len").distinct().collect()), reverse=True)

    def bits(digits: Column) -> Column:
        at = F.sequence(F.lit(1), F.lit(32))
        return F.array_join(F.transform(at, lambda i: F.lpad(F.conv(digits.substr(i, F.lit(1)), 16, 2), 4, "0")), "")

    out = rows.withColumn("__fq_a", bits(v6_hex(address)))
    for n in lengths:
        own = prefixes.filter(F.col("len") == n).select(
            F.substring(bits(F.col("net")), 1, n).alias(f"__fq_k{n}"), F.struct(F.lit(n).alias("len"), *values).alias(f"__fq_v{n}")
        )
        out = out.join(own, F.substring("__fq_a", 1, n) == F.col(f"__fq_k{n}"), "left").drop(f"__fq_k{n}")
    best = F.coalesce(*[F.col(f"__fq_v{n}") for n in lengths])
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], *[best[v].alias(v) for v in ["len", *values]])


def with_asn(flows: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Flows with `asn` of dst_ip; 0 where no prefix has it."""
    found = longest_prefix(flows, v4_to_int(F.col("dst_ip")), prefixes, ["asn"]).drop("len")
    return found.withColumn("asn", F.coalesce("asn", F.lit(0)))


def with_domain_faking(flows: DataFrame, mappings: DataFrame, name: str = "sni") -> DataFrame:
    """Flows with `domain_faking`.

    mappings has a row for each (net, len, domain, exempt). A name in the list, with www. taken off,
    is faked unless the address is private, or its longest prefix has the name or is an exception.
    """
    names = mappings.select(F.col("domain").alias("__fq_n")).distinct()
    sets = mappings.groupBy("net", "len").agg(F.collect_set("domain").alias("__fq_d"), F.max("exempt").alias("__fq_x"))
    address = v4_to_int(F.col("dst_ip"))
    rows = flows.withColumn("__fq_name", F.regexp_replace(name, r"^www\.", ""))
    rows = rows.join(names, F.col("__fq_name") == F.col("__fq_n"), "left")
    rows = longest_prefix(rows, address, sets, ["__fq_d", "__fq_x"])
    listed = F.col("__fq_n").isNotNull()
    fits = F.coalesce(F.array_contains("__fq_d", F.col("__fq_name")) | (F.col("__fq_x") == 1), F.lit(False))
    faked = listed & address.isNotNull() & ~F.coalesce(is_private_v4(address), F.lit(True)) & ~fits
    return rows.withColumn("domain_faking", faked).drop("__fq_name", "__fq_n", "__fq_d", "__fq_x", "len")


def with_watchlist(flows: DataFrame, entries: DataFrame, out: str = "watched") -> DataFrame:
    """Whether sni or dst_ip is among entries (kind name or address, value)."""
    rows = flows
    for kind, col in (("name", "sni"), ("address", "dst_ip")):
        own = entries.filter(F.col("kind") == kind).select(F.col("value").alias(f"__fq_{kind}")).distinct()
        rows = rows.join(own, F.col(col) == F.col(f"__fq_{kind}"), "left")
    hit = F.col("__fq_name").isNotNull() | F.col("__fq_address").isNotNull()
    return rows.withColumn(out, hit).drop("__fq_name", "__fq_address")


def longest_suffix(rows: DataFrame, name: str, suffixes: DataFrame, exact: bool = False) -> DataFrame:
    """Rows with `suffix` and `value` of the longest suffix of whole labels; of equal suffixes the last (`seq`) counts.

    A join for each number of labels that the suffixes have.
    """
    last = suffixes.groupBy("suffix").agg(F.max_by("value", "seq").alias("value"))
    last = last.withColumn("n", F.size(F.split("suffix", r"\.")))
    if exact:
        own = last.select(F.col("suffix").alias("__fq_s"), "suffix", "value")
        return rows.join(own, F.col(name) == F.col("__fq_s"), "left").drop("__fq_s")
    counts = sorted((r["n"] for r in last.select("n").distinct().collect()), reverse=True)
    out, found = rows, []
    labels = F.size(F.split(F.col(name), r"\."))
    for n in counts:
        own = last.filter(F.col("n") == n).select(F.col("suffix").alias(f"__fq_s{n}"), F.col("value").alias(f"__fq_v{n}"))
        key = F.when(labels >= n, F.substring_index(name, ".", -n))
        out = out.join(own, key == F.col(f"__fq_s{n}"), "left")
        found.append(n)
    suffix, value = F.coalesce(*[F.col(f"__fq_s{n}") for n in found]), F.coalesce(*[F.col(f"__fq_v{n}") for n in found])
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], suffix.alias("suffix"), value.alias("value"))


def decode(rows: DataFrame, code: str, table: DataFrame, out: str) -> DataFrame:
    """Rows with the name of a code, or the code in hex where the table (code, name) has none."""
    own = table.select(F.col("code").alias("__fq_c"), F.col("name").alias("__fq_n"))
    joined = rows.join(own, F.col(code) == F.col("__fq_c"), "left")
    return joined.withColumn(out, F.coalesce("__fq_n", F.lower(F.hex(code)))).drop("__fq_c", "__fq_n")


def fingerprint_aliases(db: DataFrame) -> DataFrame:
    """(fp, model) for a fingerprint's own string and its aliases; the first entry of a string counts."""
    names = F.array_union(F.array("str_repr"), F.coalesce("str_repr_array", F.array().cast("array<string>")))
    rows = db.select("model", F.explode(F.filter(names, lambda x: x.isNotNull())).alias("fp"))
    return rows.groupBy("fp").agg(F.min("model").alias("model"))


def with_status(flows: DataFrame, models: DataFrame, prevalent: DataFrame, types: list[str], first_seen: bool = False) -> DataFrame:
    """Flows with `model` and `status`.

    A fingerprint of models (fp) is labeled. A TLS fingerprint without a model is unlabeled if it is
    prevalent, or, with first_seen, if an earlier flow (ts, event_id) had it; else it is randomized
    and gets the randomized model of its kind. Other types are unlabeled if loaded, else unanalyzed.
    """
    own = models.select(F.col("fp").alias("__fq_m")).distinct()
    seen = prevalent.select(F.col("fp").alias("__fq_p")).distinct()
    rows = flows.join(own, F.col("fp") == F.col("__fq_m"), "left").join(seen, F.col("fp") == F.col("__fq_p"), "left")
    again = F.lit(False)
    if first_seen:
        rows = seen_before(rows, "fp", ["ts", "event_id"], "__fq_again")
        again = F.col("__fq_again")
    status = (
        F.when(F.col("__fq_m").isNotNull(), "labeled")
        .when(~fp_type(F.col("fp")).isin(types), "unanalyzed")
        .when(fp_type(F.col("fp")) != "tls", "unlabeled")
        .when(F.col("__fq_p").isNotNull() | again, "unlabeled")
        .otherwise("randomized")
    )
    rows = rows.withColumn("status", status)
    model = F.when(F.col("status") == "labeled", F.col("fp")).when(F.col("status") == "randomized", randomized_key(F.col("fp")))
    return rows.withColumn("model", model).drop("__fq_m", "__fq_p", "__fq_again")


def label_by_connection(packets: DataFrame, connections: DataFrame) -> DataFrame:
    """Packets with the process of their connection, of its reverse, or of its source port alone."""
    key = ["src_ip", "src_port", "dst_ip", "dst_port", "protocol"]
    one = connections.groupBy(*key).agg(F.min("process").alias("process"))
    own = one.select(*[F.col(c).alias(f"__fq_{c}") for c in key], F.col("process").alias("__fq_1"))
    rows = packets.join(own, [packets[c].eqNullSafe(own[f"__fq_{c}"]) for c in key], "left").drop(*[f"__fq_{c}" for c in key])
    back = dict(zip(key, ["dst_ip", "dst_port", "src_ip", "src_port", "protocol"], strict=True))
    rev = one.select(*[F.col(c).alias(f"__fq_{c}") for c in key], F.col("process").alias("__fq_2"))
    rows = rows.join(rev, [rows[back[c]].eqNullSafe(rev[f"__fq_{c}"]) for c in key], "left").drop(*[f"__fq_{c}" for c in key])
    alone = one.filter("src_ip is null and dst_ip is null and dst_port is null")
    alone = alone.select(F.col("src_port").alias("__fq_sp"), F.col("protocol").alias("__fq_pr"), F.col("process").alias("__fq_3"))
    rows = rows.join(alone, (rows["src_port"] == alone["__fq_sp"]) & (rows["protocol"] == alone["__fq_pr"]), "left")
    return rows.withColumn("process", F.coalesce("__fq_1", "__fq_2", "__fq_3")).drop("__fq_1", "__fq_2", "__fq_3", "__fq_sp", "__fq_pr")


def record_diff(left: DataFrame, right: DataFrame, key: list[str], value: str) -> DataFrame:
    """For each key whether the two sides match, differ, or miss it."""
    a = left.select(*key, F.col(value).alias("__fq_l"), F.lit(True).alias("__fq_a"))
    b = right.select(*key, F.col(value).alias("__fq_r"), F.lit(True).alias("__fq_b"))
    both = a.join(b, key, "full_outer")
    result = (
        F.when(F.col("__fq_a").isNull(), "missing_left")
        .when(F.col("__fq_b").isNull(), "missing_right")
        .when(F.col("__fq_l").eqNullSafe(F.col("__fq_r")), "match")
        .otherwise("mismatch")
    )
    return both.select(*key, result.alias("result"))
