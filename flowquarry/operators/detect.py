"""Attribute detectors and assessments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.functions.fingerprints import degrease, fp_type
from flowquarry.functions.ip import is_private_v4, v4_to_int
from flowquarry.operators.lookup import with_watchlist

#: Suites that a 2.0 commercial suite allows, and those of TLS 1.3.
CNSA_SUITES = ("1302",)
CNSA_GROUPS = ("0200", "11ed", "0202")
TLS13_SUITES = ("1301", "1302", "1303", "1304", "1305")

#: Attributes that detectors set, then those that the classifier sets.
ATTRIBUTES = (
    "residential_proxy", "exposed_credentials_plaintext", "exposed_credentials_token", "exposed_credentials_derived", "cnsa_2_0_non_conformant",
    "nist_sp_800_52_2_non_conformant", "encrypted_dns", "encrypted_channel", "domain_faking", "faketls",
)
MAX_ATTRIBUTES = 16


def encrypted_dns(flows: DataFrame, watchlist: DataFrame) -> DataFrame:
    """A1: TLS and QUIC flows whose name or address is on the list."""
    return with_watchlist(flows, watchlist, "__fq_w").withColumn(
        "encrypted_dns", F.col("__fq_w") & fp_type(F.col("fp")).isin("tls", "quic")
    ).drop("__fq_w")


def encrypted_channel(fp: Column, malware: Column, p_malware: Column) -> Column:
    """A3: the probability, for TLS flows whose process is malware; else null."""
    return F.when((fp_type(fp) == "tls") & malware, p_malware)


def is_faketls(suites: Column, known: list[str], status: Column | None = None) -> Column:
    """A4: no suite, with reserved numbers made one, is known. An empty list is fake too."""
    fake = F.forall(F.transform(suites, degrease), lambda s: ~s.isin(known))
    return fake if status is None else fake & (status == "randomized")


def offenders(values: Column, allowed: tuple[str, ...]) -> Column:
    """The values that an allow-list does not have, in order, without reserved numbers."""
    kept = F.filter(values, lambda v: degrease(v) != "0a0a")
    return F.array_except(kept, F.array(*map(F.lit, allowed)))


def quantifier(values: Column, allowed: tuple[str, ...]) -> Column:
    """Whether all, some or none of the values are allowed."""
    kept = F.filter(values, lambda v: degrease(v) != "0a0a")
    good = F.size(F.filter(kept, lambda v: v.isin(list(allowed))))
    return F.when(good == F.size(kept), "all").when(good == 0, "none").otherwise("some")


def assessment(values: Column, allowed: tuple[str, ...], truncated: Column) -> Column:
    """Quantifier and offenders; null for a truncated handshake."""
    return F.when(~truncated, F.struct(quantifier(values, allowed).alias("allowed"), offenders(values, allowed).alias("not_allowed")))


def exposed_credentials(protocol: Column, line: Column) -> Column:
    """A5: plaintext, token or derived, for a request line or header that carries credentials; else null."""
    mech = F.upper(F.regexp_extract(line, r"(?i)^\S+\s+authenticate\s+\"?([^\s\"]+)", 1))
    auth = F.lower(F.regexp_extract(line, r"(?i)^(?:proxy-)?authorization:\s*(\S+)", 1))
    return (
        F.when((protocol == "http") & (auth == "basic"), "exposed_credentials_plaintext")
        .when((protocol == "http") & (auth == "bearer"), "exposed_credentials_token")
        .when((protocol == "http") & (auth == "digest"), "exposed_credentials_derived")
        .when((protocol == "ftp") & line.rlike(r"(?i)^pass\s"), "exposed_credentials_plaintext")
        .when((protocol == "imap") & line.rlike(r"(?i)^\S+\s+login\s"), "exposed_credentials_plaintext")
        .when((protocol == "imap") & mech.isin("PLAIN", "LOGIN"), "exposed_credentials_plaintext")
        .when((protocol == "imap") & mech.rlike("^(CRAM-MD5|DIGEST-MD5|SCRAM.*|NTLM)$"), "exposed_credentials_derived")
        .when((protocol == "imap") & mech.rlike("^(OAUTH.*|XOAUTH2|GSSAPI)$"), "exposed_credentials_token")
        .when((protocol == "redis") & line.rlike(r"(?i)^auth\s"), "exposed_credentials_plaintext")
        .when((protocol == "ldap") & line.rlike(r"(?i)^simple\s"), "exposed_credentials_plaintext")
        .when((protocol == "snmp") & line.rlike(r"(?i)^community\s"), "exposed_credentials_plaintext")
        .when((protocol == "snmp") & line.rlike(r"(?i)^usm\s"), "exposed_credentials_derived")
        .when((protocol == "tacacs") & line.rlike(r"(?i)^encrypted\s"), "exposed_credentials_derived")
    )


def residential_proxy(handshakes: DataFrame) -> DataFrame:
    """Handshakes (event_id, ts, src_ip, dst_ip, random) with `residential_proxy`.

    An outbound handshake is marked if an inbound one before it, the first with its random, went to
    its source. A running minimum over the flows of a random finds that first one.
    """
    src, dst = v4_to_int(F.col("src_ip")), v4_to_int(F.col("dst_ip"))
    inbound = ~is_private_v4(src) & is_private_v4(dst)
    outbound = is_private_v4(src) & ~is_private_v4(dst)
    past = Window.partitionBy("random").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    first = F.first(F.when(inbound, F.col("dst_ip")), ignorenulls=True).over(past)
    return handshakes.withColumn("residential_proxy", F.coalesce(outbound & (first == F.col("src_ip")), F.lit(False)))


def weak_certificate(key_alg: Column, key_bits: Column, exponent_bits: Column, curve: Column, sig_alg: Column, valid: Column, conformant: Column, self_issued: Column, trusted: Column) -> Column:
    """Any of weak key, weak signature, not valid, nonconformant, self-issued, untrusted."""
    strong_key = (
        F.when(key_alg == "rsa", (key_bits >= 2048) & (exponent_bits >= 17))
        .when(key_alg == "ec", curve.isin("secp256r1", "secp384r1", "secp521r1"))
        .when(key_alg == "dsa", key_bits >= 2048)
        .otherwise(False)
    )
    return ~strong_key | sig_alg.rlike("(?i)md[245]|sha-?1(?![0-9])") | ~valid | ~conformant | self_issued | ~trusted


def attribute_names(*more: str) -> tuple[str, ...]:
    """The names of the attributes in their order, with further ones of a resource file."""
    names = ATTRIBUTES + tuple(n for n in dict.fromkeys(more) if n not in ATTRIBUTES)
    if len(names) > MAX_ATTRIBUTES:
        raise ValueError(f"more than {MAX_ATTRIBUTES} attributes")
    return names


def attributes(found: dict[str, Column], names: tuple[str, ...] = ATTRIBUTES) -> Column:
    """The names of the attributes that hold, in the order of the registry; null counts as false."""
    if unknown := set(found) - set(names):
        raise ValueError(f"unknown attributes: {', '.join(sorted(unknown))}")
    held = [F.when(found[n], F.lit(n)) for n in names if n in found]
    return F.array_compact(F.array(*held)) if held else F.array().cast("array<string>")


def has_analysis(analysis: Column, *attributes: Column) -> Column:
    """A10: an analysis is written if there is one or any attribute holds."""
    out = analysis.isNotNull()
    for a in attributes:
        out = out | F.coalesce(a, F.lit(False))
    return out
