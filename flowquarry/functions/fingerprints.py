"""Fingerprint strings (X9, X10, FP2, FP16-FP19; FP22 is not built) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sixteen reserved numbers that stand for one.
GREASE = tuple(f"{i:x}a{i:x}a" for i in range(16))


def fp_type(fp: Column) -> Column:
    """What stands before the first slash."""
    return F.substring_index(fp, "/", 1)


def fp_version(fp: Column) -> Column:
    """The format number; 0 without one, and for randomized."""
    v = F.regexp_extract(fp, r"^[^/]*/(\d+)/", 1)
    return F.when(v == "", 0).otherwise(v.try_cast("int"))


def fp_hash(fp: Column) -> Column:
    """FP16: the first 32 hex digits of SHA-256."""
    return F.substring(F.sha2(fp, 256), 1, 32)


def randomized_key(fp: Column) -> Column:
    """The key of the randomized model of this kind of fingerprint."""
    return F.concat(F.regexp_extract(fp, r"^[^(]*", 0), F.lit("randomized"))


def ciphersuites(fp: Column) -> Column:
    """The second group of TLS fingerprints, the third of QUIC, else empty."""
    group = F.split(fp, r"\(")
    nth = F.when(F.startswith(fp, F.lit("tls")), F.get(group, F.lit(2))).when(F.startswith(fp, F.lit("quic")), F.get(group, F.lit(3)))
    return F.coalesce(F.regexp_replace(nth, r"\).*$", ""), F.lit(""))


def pairs16(hexes: Column) -> Column:
    """A hex string as an array of 16-bit numbers in hex; a rest of less than 4 digits goes."""
    return F.regexp_extract_all(hexes, F.lit("([0-9a-f]{4})"), F.lit(1))


def degrease(code: Column) -> Column:
    """FP17: one of the reserved numbers becomes 0a0a."""
    return F.when(code.isin(*GREASE), F.lit("0a0a")).otherwise(code)


def degrease_hex(hexes: Column) -> Column:
    return F.array_join(F.transform(pairs16(hexes), degrease), "")


def sorted_extensions(extensions: Column) -> Column:
    """FP2: extension hex strings by (type without reserved numbers, length, bytes), in square brackets."""

    def key(x: Column) -> Column:
        kind = degrease(F.substring(x, 1, 4))
        return F.struct(kind.alias("kind"), F.length(x).alias("n"), F.concat(kind, F.substring(x, 5, 1 << 20)).alias("x"))

    ordered = F.sort_array(F.transform(extensions, key))
    return F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda k: F.concat(F.lit("("), k["x"], F.lit(")"))), ""), F.lit("]"))


def extensions(fp: Column) -> Column:
    """The extension strings of a TLS or QUIC fingerprint, in their order."""
    inside = F.regexp_extract(fp, r"[(\[]((?:\([0-9a-f()\[\]]*\))*)[)\]]$", 1)
    return F.filter(F.regexp_extract_all(inside, F.lit(r"\(([0-9a-f]*)"), F.lit(1)), lambda x: x != "")


def is_well_formed(fp: Column) -> Column:
    """FP18: type, optional format, then balanced groups of lower-case hex, or generic."""
    head = r"^[a-z_]*/(?:\d+/)?"
    tree = F.regexp_replace(fp, head, "")

    # every round takes the innermost groups away; the nesting is at most 8 deep
    rest = F.regexp_replace(tree, "[0-9a-f]", "")
    for _ in range(8):
        rest = F.regexp_replace(F.regexp_replace(rest, r"\(\)", ""), r"\[\]", "")
    return fp.rlike(head) & (F.startswith(tree, F.lit("generic")) | (rest == ""))


def _dashed(codes: Column, digits: int) -> Column:
    kept = F.filter(codes, lambda c: c != "0a0a") if digits == 4 else codes
    return F.array_join(F.transform(kept, lambda c: F.conv(c, 16, 10)), "-")


def ja3(fp: Column) -> Column:
    """FP19: version, suites, extension types, groups and point formats of a TLS fingerprint, in decimal."""
    fp = F.when(F.startswith(fp, F.lit("(")), F.concat(F.lit("tls/"), fp)).otherwise(fp)
    version = F.conv(F.regexp_extract(fp, r"\(([0-9a-f]{4})\)", 1), 16, 10)
    ext = extensions(fp)

    def body(kind: str, skip: int) -> Column:
        found = F.get(F.filter(ext, lambda x: F.startswith(x, F.lit(kind))), F.lit(0))
        return F.coalesce(F.substring(found, skip + 1, 1 << 20), F.lit(""))

    groups = pairs16(body("000a", 8))
    points = F.regexp_extract_all(body("000b", 10), F.lit("([0-9a-f]{2})"), F.lit(1))
    kinds = F.transform(ext, lambda x: F.substring(x, 1, 4))
    return F.concat_ws(",", version, _dashed(pairs16(ciphersuites(fp)), 4), _dashed(kinds, 4), _dashed(groups, 4), _dashed(points, 2))


def ja3_hash(fp: Column) -> Column:
    return F.md5(ja3(fp))


def ja3_parts_match(fp: Column, version: str | None = None, suites: str | None = None, first_extensions: str | None = None) -> Column:
    """F8: whole-part regular expressions on a fingerprint's parts."""
    out = F.lit(True)
    for part, pattern in ((F.regexp_extract(fp, r"\(([0-9a-f]*)\)", 1), version), (ciphersuites(fp), suites), (F.array_join(extensions(fp), ""), first_extensions)):
        if pattern is not None:
            out = out & part.rlike(f"^(?:{pattern})$")
    return out
