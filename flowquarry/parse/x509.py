"""X.509 certificates (P36, S10, B2, F7): what an audit needs of them."""

from __future__ import annotations

import base64
import hashlib
import re
from datetime import datetime, timezone
from typing import Any

from flowquarry.parse.cursor import Cursor
from flowquarry.parse.others import ber, oid_of

#: Object identifiers and their names.
NAMES = {
    "2.5.4.3": "common_name", "2.5.4.6": "country_name", "2.5.4.7": "locality_name", "2.5.4.8": "state_or_province_name", "2.5.4.10": "organization_name",
    "2.5.4.11": "organizational_unit_name", "2.5.4.5": "serial_number", "1.2.840.113549.1.9.1": "email_address",
}
KEYS = {"1.2.840.113549.1.1.1": "rsa", "1.2.840.10045.2.1": "ec", "1.2.840.10040.4.1": "dsa", "1.3.101.112": "ed25519"}
SIGNATURES = {
    "1.2.840.113549.1.1.4": "md5WithRSA", "1.2.840.113549.1.1.5": "sha1WithRSA", "1.2.840.113549.1.1.11": "sha256WithRSA", "1.2.840.113549.1.1.12": "sha384WithRSA",
    "1.2.840.113549.1.1.13": "sha512WithRSA", "1.2.840.113549.1.1.10": "rsaPSS", "1.2.840.10045.4.1": "ecdsaWithSHA1", "1.2.840.10045.4.3.2": "ecdsaWithSHA256",
    "1.2.840.10045.4.3.3": "ecdsaWithSHA384", "1.2.840.10045.4.3.4": "ecdsaWithSHA512", "1.3.101.112": "ed25519",
}
CURVES = {"1.2.840.10045.3.1.7": "secp256r1", "1.3.132.0.34": "secp384r1", "1.3.132.0.35": "secp521r1"}


def _oid(value: bytes) -> str:
    return ".".join(map(str, oid_of(value)))


def _items(value: bytes) -> list[tuple[int, bytes]]:
    c, out = Cursor(value), []
    while c.left():
        got = ber(c)
        if got is None:
            break
        out.append(got)
    return out


def _name(value: bytes) -> dict[str, str]:
    out = {}
    for _, part in _items(value):
        for _, pair in _items(part):
            own = _items(pair)
            if len(own) == 2:
                out[NAMES.get(_oid(own[0][1]), _oid(own[0][1]))] = own[1][1].decode("utf-8", "replace")
    return out


def _time(tag: int, value: bytes) -> str | None:
    s = value.decode("ascii", "replace")
    try:
        if tag == 23:
            year = int(s[:2])
            s = f"{2000 + year if year < 50 else 1900 + year}{s[2:]}"
        return datetime.strptime(s[:14], "%Y%m%d%H%M%S").replace(tzinfo=timezone.utc).isoformat()
    except ValueError:
        return None


def parse_certificate(der: bytes) -> dict[str, Any] | None:
    """Names, validity, key, signature algorithm and alternative names; None if it is no certificate."""
    top = ber(Cursor(der))
    outer = _items(top[1]) if top and top[0] == 0x30 else []
    if len(outer) < 3:
        return None
    tbs = _items(outer[0][1])
    version = 1
    if tbs and tbs[0][0] == 0xA0:
        version = tbs[0][1][-1] + 1 if tbs[0][1] else 1
        tbs = tbs[1:]
    if len(tbs) < 6:
        return None
    serial, _, issuer, validity, subject, spki = tbs[:6]
    times = _items(validity[1])
    key = _items(spki[1])
    algorithm = _items(key[0][1]) if key else []
    kind = KEYS.get(_oid(algorithm[0][1]), "unknown") if algorithm else "unknown"
    out: dict[str, Any] = {
        "version": version, "serial_number": serial[1].hex(), "issuer": _name(issuer[1]), "subject": _name(subject[1]), "key_alg": kind,
        "not_before": _time(*times[0]) if times else None, "not_after": _time(*times[1]) if len(times) > 1 else None,
        "sig_alg": SIGNATURES.get(_oid(_items(outer[1][1])[0][1]), "unknown") if _items(outer[1][1]) else "unknown", "sha256": hashlib.sha256(der).hexdigest(),
        "self_issued": issuer[1] == subject[1], "key_bits": None, "exponent_bits": None, "modulus": None, "curve": None, "alt_names": [],
    }
    bits = key[1][1][1:] if len(key) > 1 else b""
    if kind == "rsa":
        numbers = _items(_items(bits)[0][1]) if _items(bits) else []
        if len(numbers) == 2:
            n, e = (int.from_bytes(x[1], "big") for x in numbers)
            out |= {"key_bits": n.bit_length(), "exponent_bits": e.bit_length(), "modulus": format(n, "x")}
    elif kind == "ec":
        out["curve"] = CURVES.get(_oid(algorithm[1][1]), "unknown") if len(algorithm) > 1 else "unknown"
    elif kind == "dsa" and len(algorithm) > 1 and (p := _items(algorithm[1][1])):
        out["key_bits"] = int.from_bytes(p[0][1], "big").bit_length()
    for tag, value in tbs[6:]:
        if tag == 0xA3:
            for _, ext in _items(_items(value)[0][1] if _items(value) else b""):
                own = _items(ext)
                if own and _oid(own[0][1]) == "2.5.29.17":
                    for t, name in _items(_items(own[-1][1])[0][1] if _items(own[-1][1]) else b""):
                        if t == 0x82:
                            out["alt_names"].append(name.decode("utf-8", "replace"))
    return out


def from_text(text: str) -> list[bytes]:
    """The certificates of PEM text, or of lines of base64."""
    pem = re.findall(r"-----BEGIN CERTIFICATE-----(.*?)-----END CERTIFICATE-----", text, re.S)
    out = []
    for block in pem or text.splitlines():
        try:
            der = base64.b64decode("".join(block.split()), validate=True)
        except ValueError:
            continue
        if der:
            out.append(der)
    return out
