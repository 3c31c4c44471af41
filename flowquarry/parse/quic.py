"""QUIC Initial packets: keys, decryption, CRYPTO frames and fingerprints (P4, FP5, part of X21)."""

from __future__ import annotations

import hashlib
import hmac
from typing import Any

from flowquarry.parse.aes import Aes, expand_label
from flowquarry.parse.cursor import Cursor
from flowquarry.parse.tls import client_hello, degrease, extensions_string, varint

#: The Initial salts of the versions.
SALT_V1, SALT_V2 = "38762cf7f55934b34d179ae6a4c80cadccbb7f0a", "0dede3def700a6db819381be6e269dcbf9bd2ed9"
SALT_29, SALT_23 = "afbfec289993d24c9e9786f19c6111e04390a899", "c3eea712c72ebb5a11a7d2432bb46365bef9f502"
V2 = 0x6B3343CF


def salt(version: int) -> bytes | None:
    if version == 1:
        return bytes.fromhex(SALT_V1)
    if version == V2:
        return bytes.fromhex(SALT_V2)
    if 0xFF00001D <= version <= 0xFF000022:
        return bytes.fromhex(SALT_29)
    if 0xFF000017 <= version <= 0xFF00001C:
        return bytes.fromhex(SALT_23)
    return None


def client_keys(version: int, dcid: bytes) -> tuple[bytes, bytes, bytes] | None:
    """Key, nonce base and header protection key of the client."""
    s = salt(version)
    if s is None:
        return None
    secret = expand_label(hmac.new(s, dcid, hashlib.sha256).digest(), b"client in", 32)
    name = b"quicv2 " if version == V2 else b"quic "
    return expand_label(secret, name + b"key", 16), expand_label(secret, name + b"iv", 12), expand_label(secret, name + b"hp", 16)


def open_initial(data: bytes) -> tuple[int, bytes] | None:
    """The version and the plain payload of a client's Initial packet; None if it is none or its tag is wrong."""
    c = Cursor(data)
    first, version = c.uint(1), c.uint(4)
    if version is None or first & 0xC0 != 0xC0:
        return None
    if first >> 4 & 3 != (1 if version == V2 else 0):
        return None
    dcid = c.sized(1)
    c.sized(1)
    n, _ = varint(c)
    c.take(n)
    length, _ = varint(c)
    keys = client_keys(version, dcid) if c.ok else None
    if keys is None or length > c.left() or length < 20:
        return None
    key, iv, hp = keys
    at = c.at
    mask = Aes(hp).encrypt(data[at + 4 : at + 20])
    head = first ^ mask[0] & 0x0F
    size = (head & 3) + 1
    number = bytes(a ^ b for a, b in zip(data[at : at + size], mask[1:]))
    header = bytes([head]) + data[1:at] + number
    nonce = bytes(a ^ b for a, b in zip(iv, bytes(12 - size) + number, strict=True))
    sealed, tag = data[at + size : at + length - 16], data[at + length - 16 : at + length]
    aes = Aes(key)
    return (version, aes.counter(sealed, nonce)) if aes.tag(sealed, nonce, header) == tag else None


def crypto_frames(frames: bytes) -> list[tuple[int, bytes]]:
    """(offset, bytes) of the CRYPTO frames."""
    c, parts = Cursor(frames), []
    while c.left():
        kind = c.uint(1)
        if kind in (0, 1):
            continue
        if kind in (2, 3):
            varint(c), varint(c)
            ranges, _ = varint(c)
            varint(c)
            for _ in range(2 * (ranges or 0)):
                varint(c)
            if kind == 3:
                varint(c), varint(c), varint(c)
            continue
        if kind != 6:
            break
        offset, _ = varint(c)
        n, _ = varint(c)
        body = c.take(n)
        if body is None:
            break
        parts.append((offset, body))
    return parts


def crypto_stream(frames: bytes) -> bytes:
    """The contiguous bytes of the CRYPTO frames, in the order of their offsets."""
    out = b""
    for offset, body in sorted(crypto_frames(frames)):
        if offset > len(out):
            break
        out += body[len(out) - offset :]
    return out


def parse_initial(data: bytes, fmt: int = 0) -> dict[str, Any] | None:
    """The client hello inside an Initial packet, with its fingerprint."""
    got = open_initial(data)
    if got is None:
        return None
    version, plain = got
    return parse_stream(version, crypto_stream(plain), fmt)


def parse_stream(version: int, stream: bytes, fmt: int = 0) -> dict[str, Any] | None:
    """As parse_initial, of CRYPTO data already put together."""
    if len(stream) < 6 or stream[0] != 1:
        return {"msg_type": "quic_initial", "fields": {"version": f"{version:08x}"}, "fingerprint": None}
    hello = client_hello(Cursor(stream, 4, 4 + int.from_bytes(stream[1:4], "big")))
    if hello is None:
        return None
    head = "quic/" if fmt == 0 else f"quic/{fmt}/"
    ext = extensions_string(hello["extensions"], 1)
    fp = f"{head}({version:08x})({hello['raw_version'].hex()})({degrease(hello['suites']).hex()}){ext}"
    fields = {"version": f"{version:08x}", "server_name": hello["server_name"], "alpn": hello["alpn"], "cipher_suites": hello["cipher_suites"]}
    return {"msg_type": "quic_initial", "fields": fields, "fingerprint": fp, "server_name": hello["server_name"]}
