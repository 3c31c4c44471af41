"""HTTP, SSH, SMTP, DHCP, STUN, DNS and QUIC headers (P4-P9, P11, P17, FP7-FP9, FP11, FP12, FP14)."""

from __future__ import annotations

import base64
import re
import socket
from typing import Any

from flowquarry.parse.cursor import Cursor, text
from flowquarry.parse.tls import varint

METHODS = (b"GET ", b"POST ", b"HEAD ", b"PUT ", b"DELETE ", b"OPTIONS ", b"CONNECT ", b"TRACE ", b"PATCH ", b"PROPFIND ", b"M-SEARCH ", b"NOTIFY ", b"SUBSCRIBE ", b"UNSUBSCRIBE ", b"SEARCH ", b"REPORT ")

#: Request headers of a fingerprint, with their value and by name alone.
REQUEST_FULL = frozenset({"accept", "accept-encoding", "connection", "dnt", "dpr", "upgrade-insecure-requests", "x-requested-with"})
REQUEST_NAME = frozenset(
    {"accept-charset", "accept-language", "authorization", "cache-control", "host", "if-modified-since", "keep-alive", "user-agent", "x-flash-version", "x-p2p-peerdist"}
)
#: Response headers of a fingerprint, with their value and by name alone.
RESPONSE_FULL = frozenset(
    {
        "access-control-allow-credentials", "access-control-allow-headers", "access-control-allow-methods", "access-control-expose-headers", "cache-control", "code",
        "connection", "content-language", "content-transfer-encoding", "p3p", "pragma", "reason", "server", "strict-transport-security", "version",
        "x-aspnetmvc-version", "x-aspnet-version", "x-cid", "x-ms-version", "x-xss-protection",
    }
)
RESPONSE_NAME = frozenset(
    {
        "appex-activity-id", "cdnuuid", "cf-ray", "content-range", "content-type", "date", "etag", "expires", "flow_context", "ms-cv", "msregion", "ms-requestid",
        "request-id", "vary", "x-amz-cf-pop", "x-amz-request-id", "x-azure-ref-originshield", "x-cache", "x-cache-hits", "x-ccc", "x-diagnostic-s", "x-feserver",
        "x-hw", "x-msedge-ref", "x-ocsp-responder-id", "x-requestid", "x-served-by", "x-timer", "x-trace-context",
    }
)


def _headers(c: Cursor) -> tuple[list[tuple[bytes, bytes]], bool]:
    """Header lines (name, value) up to the empty line, and whether that was there."""
    out = []
    while c.left():
        line = c.until(b"\r\n")
        if line is None:
            return out, False
        if not line:
            return out, True
        name, mark, value = line.partition(b":")
        if not mark:
            return out, False
        out.append((name, value))
    return out, False


def _header_string(headers: list[tuple[bytes, bytes]], full: frozenset, by_name: frozenset) -> str:
    parts = []
    for name, value in headers:
        key = name.decode("latin-1").lower()
        if key in full:
            parts.append(f"({(name + b':' + value).hex()})")
        elif key in by_name:
            parts.append(f"({name.hex()})")
    return f"({''.join(parts)})"


def parse_http(data: bytes) -> dict[str, Any] | None:
    c = Cursor(data)
    if data.startswith(METHODS):
        method, uri = c.until(b" "), c.until(b" ")
        protocol = c.until(b"\r\n")
        if protocol is None:
            return None
        headers, done = _headers(c)
        names = {k.decode("latin-1").lower(): text(v.strip()) for k, v in headers}
        fields = {"method": text(method), "uri": text(uri), "protocol": text(protocol), "headers": names, "complete": done, "body": c.upto(2048).hex() if done else ""}
        fp = f"http/({method.hex()})({protocol.hex()}){_header_string(headers, REQUEST_FULL, REQUEST_NAME)}"
        auth = names.get("authorization", "").split(" ")[0].lower()
        exposed = {"basic": "exposed_credentials_plaintext", "bearer": "exposed_credentials_token", "digest": "exposed_credentials_derived"}.get(auth)
        return {"msg_type": "http_request", "fields": fields, "fingerprint": fp, "server_name": names.get("host"), "user_agent": names.get("user-agent"), "exposed": exposed}
    if data.startswith(b"HTTP/1."):
        version, code = c.until(b" "), c.until(b" ")
        reason = c.until(b"\r\n")
        if reason is None:
            return None
        headers, done = _headers(c)
        names = {k.decode("latin-1").lower(): text(v.strip()) for k, v in headers}
        fields = {"version": text(version), "status_code": text(code), "status_reason": text(reason), "headers": names, "complete": done, "body": c.upto(2048).hex() if done else ""}
        fp = f"http_server/({version.hex()})({code.hex()})({reason.hex()}){_header_string(headers, RESPONSE_FULL, RESPONSE_NAME)}"
        return {"msg_type": "http_response", "fields": fields, "fingerprint": fp}
    return None


def parse_http2(data: bytes) -> dict[str, Any] | None:
    preface = b"PRI * HTTP/2.0\r\n\r\nSM\r\n\r\n"
    if not data.startswith(preface):
        return None
    c, frames = Cursor(data, len(preface)), []
    while c.left() >= 9:
        n, kind, flags, stream = c.uint(3), c.uint(1), c.uint(1), c.uint(4)
        frames.append({"type": kind, "flags": flags, "stream": stream & 0x7FFFFFFF, "payload": c.upto(n).hex()})
    return {"msg_type": "http2", "fields": {"frames": frames}}


KEX_LISTS = [
    "kex_algorithms", "server_host_key_algorithms", "encryption_algorithms_client_to_server", "encryption_algorithms_server_to_client",
    "mac_algorithms_client_to_server", "mac_algorithms_server_to_client", "compression_algorithms_client_to_server", "compression_algorithms_server_to_client",
    "languages_client_to_server", "languages_server_to_client",
]


def parse_ssh(data: bytes, from_server: bool = False) -> dict[str, Any] | None:
    side = "_server" if from_server else ""
    if data.startswith(b"SSH-"):
        line = re.match(rb"SSH-([^-\r\n]*)-([^ \r\n]*)(?: ([^\r\n]*))?\r?\n?", data)
        if not line:
            return None
        fields = {"protocol": text(line[1]), "software": text(line[2]), "comment": text(line[3])}
        own = f"({line[0].strip().hex()})"
        kex = parse_ssh(data[line.end() :], from_server) if len(data) > line.end() else None
        if kex:
            kex["fields"] |= fields
            kex["fingerprint"] = kex["fingerprint"].replace("ssh_kex", "ssh", 1)
            head, slash, tail = kex["fingerprint"].partition("/")
            kex["fingerprint"] = head + slash + own + tail
            return kex
        return {"msg_type": "ssh_init", "fields": fields, "fingerprint": f"ssh_init{side}/{own}"}
    c = Cursor(data)
    n, pad = c.uint(4), c.uint(1)
    if n is None or pad is None or n > 35000 or c.uint(1) != 20:
        return None
    cookie = c.take(16)
    lists = [c.sized(4) for _ in KEX_LISTS]
    if not c.ok:
        return None
    fields = {"cookie": cookie.hex()} | {k: text(v) for k, v in zip(KEX_LISTS, lists, strict=True)}
    return {"msg_type": "ssh_kex", "fields": fields, "fingerprint": f"ssh_kex{side}/" + "".join(f"({x.hex()})" for x in lists)}


def parse_smtp(data: bytes, from_server: bool = False) -> dict[str, Any] | None:
    lines = [x for x in data.split(b"\r\n") if x]
    if from_server:
        replies = [re.match(rb"(\d{3})([ -])(.*)$", x, re.S) for x in lines]
        if not replies or not all(replies):
            return None
        fp = "smtp_server/" + "".join(f"({m[3].hex()})" for m in replies[1:]) if replies[0][1] == b"250" and len(replies) > 1 else None
        return {"msg_type": "smtp_server", "fields": {"response": [text(x) for x in lines]}, "fingerprint": fp}
    if not lines or not re.match(rb"(?i)(EHLO|HELO|MAIL|RCPT|DATA|RSET|VRFY|EXPN|HELP|NOOP|QUIT|AUTH|STARTTLS)\b", lines[0]):
        return None
    return {"msg_type": "smtp_client", "fields": {"parameters": [text(x) for x in lines]}}


def parse_dhcp(data: bytes) -> dict[str, Any] | None:
    c = Cursor(data)
    head = c.take(236)
    if head is None or c.take(4) != b"\x63\x82\x53\x63":
        return None
    options, parts, kind = [], [], None
    while c.left():
        tag = c.uint(1)
        if tag == 0:
            continue
        if tag == 255:
            options.append((tag, b""))
            parts.append("(ff)")
            break
        value = c.sized(1)
        if value is None:
            break
        options.append((tag, value))
        if tag == 53:
            kind = value[0] if value else None
        parts.append(f"({tag:02x}{len(value):02x}{value.hex()})" if tag in (53, 55, 60) else f"({tag:02x})")
    fields = {"msg_type": kind, "client_mac_address": head[28:34].hex(":"), "options": [{"type": t, "value": v.hex()} for t, v in options]}
    return {"msg_type": "dhcp", "fields": fields, "fingerprint": f"dhcp/({''.join(parts)})" if kind == 3 else None}


#: Attributes of a fingerprint, by type alone and with length and value.
STUN_TYPE = frozenset({0x0006, 0x0008, 0x0020, 0x8007, 0x8008, 0x8022, 0x8028, 0xC003, 0xC057, 0xDABA})
STUN_FULL = frozenset({0x8037, 0x8070})


def parse_stun(data: bytes) -> dict[str, Any] | None:
    c = Cursor(data)
    kind, n = c.uint(2), c.uint(2)
    cookie, tid = c.take(4), c.take(12)
    if not c.ok or kind & 0xC000 or n % 4 or n != c.left():
        return None
    cls = (kind >> 7 & 2) | (kind >> 4 & 1)
    method = (kind & 0xF) | (kind >> 1 & 0x70) | (kind >> 2 & 0xF80)
    magic = cookie == b"\x21\x12\xa4\x42"
    if not magic and method not in (1, 2, 3, 4):
        return None
    attributes, parts, software = [], [], None
    while c.left() >= 4:
        t, value = c.uint(2), c.sized(2)
        if value is None:
            return None
        c.upto(-len(value) % 4)
        attributes.append({"type": t, "value": value.hex()})
        if t == 0x8022:
            software = text(value)
        if t in STUN_FULL:
            parts.append(f"({t:04x}{len(value):04x}{value.hex()})")
        elif t in STUN_TYPE:
            parts.append(f"({t:04x})")
    fp = f"stun/1/({cls:02x})({method:04x})({int(magic):02x})({''.join(parts)})" if cls < 2 else None
    fields = {"class": cls, "method": method, "magic": magic, "transaction_id": tid.hex(), "attributes": attributes}
    return {"msg_type": "stun", "fields": fields, "fingerprint": fp, "user_agent": software}


#: Names of resource record types.
RR_TYPES = {
    1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 13: "HINFO", 15: "MX", 16: "TXT", 17: "RP", 18: "AFSDB", 24: "SIG", 25: "KEY", 28: "AAAA", 29: "LOC", 33: "SRV",
    35: "NAPTR", 36: "KX", 37: "CERT", 39: "DNAME", 41: "OPT", 43: "DS", 44: "SSHFP", 46: "RRSIG", 47: "NSEC", 48: "DNSKEY", 64: "SVCB", 65: "HTTPS", 255: "ANY",
}


def _name(data: bytes, at: int) -> tuple[str | None, int]:
    labels, end, jumps = [], None, 0
    while True:
        if at >= len(data) or jumps > 32 or len(labels) > 128:
            return None, at
        n = data[at]
        if n == 0:
            return ".".join(labels) + ".", (at + 1 if end is None else end)
        if n & 0xC0 == 0xC0:
            if at + 1 >= len(data):
                return None, at
            end = at + 2 if end is None else end
            at = (n & 0x3F) << 8 | data[at + 1]
            jumps += 1
            continue
        labels.append(text(data[at + 1 : at + 1 + n]))
        at += 1 + n


def _rdata(data: bytes, at: int, n: int, kind: int) -> Any:
    raw = data[at : at + n]
    if kind == 1 and n == 4:
        return {"ipv4_addr": socket.inet_ntop(socket.AF_INET, raw)}
    if kind == 28 and n == 16:
        return {"ipv6_addr": socket.inet_ntop(socket.AF_INET6, raw)}
    if kind in (2, 5, 12, 39):
        return {"domain_name": _name(data, at)[0]}
    if kind == 15 and n > 2:
        return {"preference": int.from_bytes(raw[:2], "big"), "domain_name": _name(data, at + 2)[0]}
    if kind == 16:
        c, out = Cursor(raw), []
        while c.left():
            out.append(text(c.sized_upto(1)))
        return {"txt": out}
    if kind == 33 and n > 6:
        p, w, port = (int.from_bytes(raw[i : i + 2], "big") for i in (0, 2, 4))
        return {"priority": p, "weight": w, "port": port, "domain_name": _name(data, at + 6)[0]}
    if kind == 6:
        mname, nxt = _name(data, at)
        rname, nxt = _name(data, nxt)
        return {"mname": mname, "rname": rname, "serial": int.from_bytes(data[nxt : nxt + 4], "big")}
    if kind in (64, 65) and n > 2:
        return {"priority": int.from_bytes(raw[:2], "big"), "domain_name": _name(data, at + 2)[0]}
    return {"hex": raw.hex()}


def parse_dns(data: bytes, as_json: bool = True) -> dict[str, Any] | None:
    c = Cursor(data)
    ident, flags = c.uint(2), c.uint(2)
    counts = [c.uint(2) for _ in range(4)]
    if not c.ok or sum(counts) == 0 or sum(counts) > 512 or flags & 0x40:
        return None
    at, out = c.at, {"id": ident, "response": bool(flags & 0x8000), "response_code": flags & 15}
    for section, count in zip(("question", "answer", "authority", "additional"), counts, strict=True):
        rows = []
        for _ in range(count):
            name, at = _name(data, at)
            fixed = Cursor(data, at)
            kind, cls = fixed.uint(2), fixed.uint(2)
            row = {"name": name, "type": RR_TYPES.get(kind, kind), "class": cls}
            if section != "question":
                row["ttl"], n = fixed.uint(4), fixed.uint(2)
                if not fixed.ok or fixed.left() < n:
                    name = None
                else:
                    row["rdata"] = _rdata(data, fixed.at, n, kind)
                    fixed.take(n)
            if name is None or not fixed.ok:
                if section == "question":
                    return None
                break
            at = fixed.at
            rows.append(row)
        if rows:
            out[section] = rows
    fields = out if as_json else {"base64": base64.b64encode(data).decode()}
    return {"msg_type": "dns", "fields": fields, "server_name": out["question"][0]["name"] if "question" in out else None}


def parse_quic(data: bytes) -> dict[str, Any] | None:
    """The header of a long-header packet; the payload stays as it is."""
    c = Cursor(data)
    first, version = c.uint(1), c.take(4)
    if version is None or not first & 0x80 or not first & 0x40 or version == b"\0\0\0\0":
        return None
    dcid, scid = c.sized(1), c.sized(1)
    if not c.ok or len(dcid) > 20 or len(scid) > 20 or first >> 4 & 3 != 0:
        return None
    n, _ = varint(c)
    token = c.take(n)
    length, _ = varint(c)
    if not c.ok or length > c.left() or len(data) < 100:
        return None
    fields = {"connection_info": first, "version": version.hex(), "dcid": dcid.hex(), "scid": scid.hex(), "token": token.hex(), "data": c.upto(length).hex()}
    return {"msg_type": "quic_initial", "fields": fields}
