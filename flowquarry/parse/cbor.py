"""CBOR, as much as flow-data records need, and those records (K5, S13, FP20)."""

from __future__ import annotations

import struct
from typing import Any

from flowquarry.parse.cursor import Cursor


def _head(kind: int, n: int) -> bytes:
    if n < 24:
        return bytes([kind << 5 | n])
    for size, mark in ((1, 24), (2, 25), (4, 26), (8, 27)):
        if n < 1 << 8 * size:
            return bytes([kind << 5 | mark]) + n.to_bytes(size, "big")
    raise ValueError("number too large")


def encode(x: Any) -> bytes:
    if x is None:
        return b"\xf6"
    if isinstance(x, bool):
        return b"\xf5" if x else b"\xf4"
    if isinstance(x, int):
        return _head(0, x) if x >= 0 else _head(1, -1 - x)
    if isinstance(x, float):
        return b"\xfb" + struct.pack(">d", x)
    if isinstance(x, bytes):
        return _head(2, len(x)) + x
    if isinstance(x, str):
        b = x.encode()
        return _head(3, len(b)) + b
    if isinstance(x, (list, tuple)):
        return _head(4, len(x)) + b"".join(map(encode, x))
    if isinstance(x, dict):
        return _head(5, len(x)) + b"".join(encode(k) + encode(v) for k, v in x.items())
    raise TypeError(type(x))


BREAK = object()


def _read(c: Cursor, depth: int = 0) -> Any:
    first = c.uint(1)
    if first is None or depth > 64:
        raise ValueError("cut")
    kind, n = first >> 5, first & 31
    if 24 <= n <= 27:
        size = 1 << (n - 24)
        raw = c.take(size)
        if raw is None:
            raise ValueError("cut")
        if kind == 7:
            return struct.unpack({2: ">e", 4: ">f", 8: ">d"}[size], raw)[0] if size > 1 else raw[0]
        n = int.from_bytes(raw, "big")
    elif n == 31:
        if kind == 7:
            return BREAK
        n = -1
    elif n > 27:
        raise ValueError("reserved")
    if kind in (0, 1):
        return n if kind == 0 else -1 - n
    if kind in (2, 3):
        if n < 0:
            parts = []
            while (p := _read(c, depth + 1)) is not BREAK:
                parts.append(p)
            return b"".join(parts) if kind == 2 else "".join(parts)
        raw = c.take(n)
        if raw is None:
            raise ValueError("cut")
        return raw if kind == 2 else raw.decode("utf-8", "replace")
    if kind == 4:
        out = []
        while n < 0 or len(out) < n:
            if (x := _read(c, depth + 1)) is BREAK:
                break
            out.append(x)
        return out
    if kind == 5:
        pairs: dict = {}
        count = 0
        while n < 0 or count < n:
            if (k := _read(c, depth + 1)) is BREAK:
                break
            pairs[k] = _read(c, depth + 1)
            count += 1
        return pairs
    if kind == 6:
        return _read(c, depth + 1)
    return {20: False, 21: True, 22: None, 23: None}.get(n, n)


def decode(data: bytes) -> Any:
    """The first item; None if the bytes are no CBOR."""
    try:
        return _read(Cursor(data))
    except (ValueError, TypeError, KeyError, RecursionError):
        return None


def fingerprint_tree(fp: str) -> list | None:
    """FP20: a fingerprint string as nested lists of bytes, with its type and format in front."""
    head, _, tree = fp.partition("(" if "[" not in fp or fp.find("(") < fp.find("[") else "[")
    opener = fp[len(head) : len(head) + 1]
    name, _, version = head.rstrip("/").partition("/")
    stack: list[list] = [[]]
    digits = ""
    for ch in opener + tree:
        if ch in "([":
            if digits:
                stack[-1].append(bytes.fromhex(digits))
                digits = ""
            stack.append([])
        elif ch in ")]":
            if digits:
                if len(digits) % 2:
                    return None
                stack[-1].append(bytes.fromhex(digits))
                digits = ""
            if len(stack) < 2:
                return None
            done = stack.pop()
            stack[-1].append(done)
        elif ch in "0123456789abcdef":
            digits += ch
        else:
            return None
    return [name, int(version) if version.isdigit() else 0, stack[0]] if len(stack) == 1 and not digits else None


def fingerprint_string(tree: list) -> str:
    """The string again; sorted groups are written in round brackets."""

    def text(x: Any) -> str:
        return x.hex() if isinstance(x, bytes) else f"({''.join(map(text, x))})"

    name, version, groups = tree
    return f"{name}/{f'{version}/' if version else ''}{''.join(map(text, groups))}"


def flow_record(fingerprints: list[str], user_agent: str = "", server_name: str = "", dst_ip: str = "", dst_port: int = 0, truncation: int = 0) -> bytes:
    """K5: one flow's fingerprints and context as a version-2 map."""
    body = {"version": 2, "fingerprints": [fingerprint_tree(f) or f for f in fingerprints], "metadata": {"user_agent": user_agent, "server_name": server_name, "dst_ip": dst_ip, "dst_port": dst_port}, "truncation": truncation}
    return encode(body)


def read_flow_record(data: bytes) -> dict[str, Any] | None:
    """A record as plain values, from a map or from the older array form."""
    got = decode(data)
    if isinstance(got, list) and len(got) >= 5:
        got = {"version": 1, "fingerprints": [got[0]], "metadata": dict(zip(("user_agent", "server_name", "dst_ip", "dst_port"), got[1:5])), "truncation": 0}
    if not isinstance(got, dict) or "fingerprints" not in got:
        return None
    fps = [f if isinstance(f, str) else fingerprint_string(f) for f in got["fingerprints"] if isinstance(f, str) or (isinstance(f, list) and len(f) == 3)]
    return got | {"fingerprints": fps}
