"""TLS, DTLS and X.509 (P1-P3, FP1-FP4, FP6, part of P36)."""

from __future__ import annotations

import base64
from typing import Any

from flowquarry.parse.cursor import Cursor, text

#: Extensions whose value is part of a fingerprint.
STATIC = frozenset({1, 5, 7, 8, 9, 10, 11, 13, 15, 16, 17, 24, 27, 28, 57, 43, 45, 50, 21760, 65445})
GROUPS, VERSIONS, QUIC_PARAMETERS = 10, 43, (57, 65445)
SMALLEST_UNASSIGNED, SMALLEST_PRIVATE, MAX_REPEATS = 62, 65280, 3
#: The 71 extension types of format 2; 62 and 65280 stand for the unassigned and the private ones.
INCLUDED = frozenset(
    [*range(0, 21), *range(22, 35), *range(36, 41), *range(43, 63), 2570, 13172, 21760, 30031, 30032, 64768, 65037, 65280, 65281, 65283, 65445, 65486]
)


def is_grease(x: int) -> bool:
    return x & 0x0F0F == 0x0A0A and x >> 8 == x & 0xFF


def degrease(b: bytes) -> bytes:
    """Reserved 16-bit numbers become 0a0a; a last odd byte is left out."""
    return b"".join(b"\x0a\x0a" if is_grease(int.from_bytes(b[i : i + 2], "big")) else b[i : i + 2] for i in range(0, len(b) - len(b) % 2, 2))


def parse_extensions(data: bytes) -> list[tuple[int, bytes]]:
    c, out = Cursor(data), []
    while c.left() >= 4:
        kind = c.uint(2)
        value = c.sized(2)
        if value is None:
            break
        out.append((kind, value))
    return out


def _transport_ids(value: bytes) -> list[str]:
    """Identifiers of QUIC transport parameters; reserved ones are 1b."""
    c, out = Cursor(value), []
    while c.left():
        i, raw = varint(c)
        n, _ = varint(c)
        if c.take(n) is None:
            break
        out.append("1b" if i % 31 == 27 else raw.hex())
    return out


def varint(c: Cursor) -> tuple[int | None, bytes]:
    """A QUIC variable-length number and its bytes."""
    first = c.take(1)
    if first is None:
        return None, b""
    more = c.take((1 << (first[0] >> 6)) - 1)
    if more is None:
        return None, b""
    raw = first + more
    return int.from_bytes(raw, "big") & ((1 << (8 * len(raw) - 2)) - 1), raw


def extension_string(kind: int, value: bytes, client: bool = True, by_id: bool = False) -> str:
    head = degrease(kind.to_bytes(2, "big")).hex()
    if kind not in STATIC:
        return f"({head})"
    size = len(value).to_bytes(2, "big").hex()
    if kind == GROUPS:
        return f"({head}{size}{(value[:2] + degrease(value[2:])).hex()})"
    if kind == VERSIONS:
        skip = 1 if client else 0
        return f"({head}{size}{(value[:skip] + degrease(value[skip:])).hex()})"
    if kind in QUIC_PARAMETERS:
        ids = _transport_ids(value)
        if by_id:
            return f"(({head})[{''.join(f'({i})' for i in sorted(ids, key=lambda x: (len(x), x)))}])"
        return f"(({head})({''.join(f'({i})' for i in ids)}))"
    return f"({head}{size}{value.hex()})"


def _order(x: tuple[int, bytes]) -> tuple[int, int, bytes]:
    return (0x0A0A if is_grease(x[0]) else x[0], len(x[1]), x[1])


def extensions_string(extensions: list[tuple[int, bytes]], fmt: int, client: bool = True) -> str:
    """FP1 in wire order, FP2 sorted, FP3 of the assigned types only."""
    if fmt == 0:
        return f"({''.join(extension_string(k, v, client) for k, v in extensions)})"
    if fmt == 1:
        return f"[{''.join(extension_string(k, v, client, True) for k, v in sorted(extensions, key=_order))}]"
    slots: dict[int, list[tuple[int, bytes]]] = {}
    for k, v in extensions:
        shown = 0x0A0A if is_grease(k) else k
        if shown not in INCLUDED:
            if shown < SMALLEST_UNASSIGNED:
                continue
            shown = SMALLEST_PRIVATE if shown >= SMALLEST_PRIVATE else SMALLEST_UNASSIGNED
        own = slots.setdefault(shown, [])
        if len(own) < MAX_REPEATS:
            own.append((shown, v))
    return f"[{''.join(extension_string(k, v, client, True) for s in sorted(slots) for k, v in sorted(slots[s], key=_order))}]"


def client_hello(c: Cursor, dtls: bool = False) -> dict[str, Any] | None:
    version, random, session = c.take(2), c.take(32), c.sized(1)
    if dtls:
        c.sized(1)
    suites, compression = c.sized(2), c.sized(1)
    if not c.ok:
        return None
    extensions = parse_extensions(c.sized_upto(2)) if c.left() else []
    found = dict(reversed(extensions))
    sni = found.get(0)
    alpn, a = [], Cursor(found.get(16, b"")[2:])
    while a.left():
        alpn.append(text(a.sized_upto(1)))
    return {
        "version": version.hex(), "random": random.hex(), "session_id": session.hex(), "cipher_suites": suites.hex(), "compression_methods": compression.hex(),
        "server_name": text(sni[5:]) if sni and len(sni) > 5 else None, "alpn": alpn, "extensions": extensions, "suites": suites, "raw_version": version,
    }


def server_hello(c: Cursor) -> dict[str, Any] | None:
    version, random, session = c.take(2), c.take(32), c.sized(1)
    suite, compression = c.take(2), c.take(1)
    if not c.ok:
        return None
    extensions = parse_extensions(c.sized_upto(2)) if c.left() else []
    return {
        "version": version.hex(), "random": random.hex(), "session_id": session.hex(), "selected_cipher_suite": suite.hex(), "compression_method": compression.hex(),
        "extensions": extensions, "raw_version": version, "suites": suite,
    }


def client_fingerprint(hello: dict[str, Any], fmt: int = 0, name: str = "tls") -> str:
    head = f"{name}/" if fmt == 0 else f"{name}/{fmt}/"
    return f"{head}({hello['raw_version'].hex()})({degrease(hello['suites']).hex()}){extensions_string(hello['extensions'], fmt)}"


def server_fingerprint(hello: dict[str, Any], name: str = "tls_server") -> str:
    return f"{name}/({hello['raw_version'].hex()})({hello['suites'].hex()}){extensions_string(hello['extensions'], 0, client=False)}"


def handshakes(data: bytes) -> tuple[list[tuple[int, bytes]], bool]:
    """Handshake messages (type, body) of TLS records, and whether the last is cut."""
    c, stream = Cursor(data), b""
    while c.left() >= 5:
        head = c.take(5)
        if head[0] != 22 or head[1] != 3:
            break
        stream += c.upto(int.from_bytes(head[3:5], "big"))
    h, out, cut = Cursor(stream), [], False
    while h.left() >= 4:
        kind, n = h.uint(1), h.uint(3)
        body = h.upto(n)
        out.append((kind, body))
        cut = len(body) < n
    return out, cut


def certificates(body: bytes) -> list[bytes]:
    c, out = Cursor(body), []
    c.take(3)
    while c.left() >= 3:
        out.append(c.sized_upto(3))
    return out


def parse_tls(data: bytes, fmt: int = 0) -> dict[str, Any] | None:
    if len(data) < 6 or data[0] != 22 or data[1] != 3:
        return None
    messages, cut = handshakes(data)
    out: dict[str, Any] = {}
    for kind, body in messages:
        if kind == 1 and (hello := client_hello(Cursor(body))):
            return {"msg_type": "tls_client_hello", "fields": _shown(hello), "fingerprint": client_fingerprint(hello, fmt), "truncated": cut, "server_name": hello["server_name"], "random": hello["random"]}
        if kind == 2 and (hello := server_hello(Cursor(body))):
            out |= {"msg_type": "tls_server_hello", "fields": _shown(hello), "fingerprint": server_fingerprint(hello), "truncated": cut}
        if kind == 11:
            out.setdefault("msg_type", "tls_certificate")
            out.setdefault("fields", {})
            out["fields"]["certs"] = [{"base64": base64.b64encode(x).decode()} for x in certificates(body)]
            out["truncated"] = cut
    return out or None


def parse_dtls(data: bytes, fmt: int = 0) -> dict[str, Any] | None:
    if len(data) < 25 or data[0] != 22 or data[1] != 0xFE:
        return None
    c = Cursor(data, 13)
    kind, n = c.uint(1), c.uint(3)
    c.take(8)
    body = Cursor(c.upto(n))
    if kind == 1 and (hello := client_hello(body, dtls=True)):
        return {"msg_type": "dtls_client_hello", "fields": _shown(hello), "fingerprint": client_fingerprint(hello, fmt, "dtls"), "server_name": hello["server_name"]}
    if kind == 2 and (hello := server_hello(body)):
        return {"msg_type": "dtls_server_hello", "fields": _shown(hello), "fingerprint": server_fingerprint(hello, "dtls_server")}
    return {"msg_type": "dtls_hello_verify_request", "fields": {}} if kind == 3 else None


def _shown(hello: dict[str, Any]) -> dict[str, Any]:
    out = {k: v for k, v in hello.items() if k not in ("extensions", "suites", "raw_version") and v not in (None, [])}
    out["extension_types"] = [k for k, _ in hello["extensions"]]
    return out
