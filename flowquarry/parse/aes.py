"""AES in plain Python, for single packets: one block, CBC decryption and GCM payloads.

The S-box is computed from its definition. Bulk decryption of columns belongs to Spark's aes_decrypt.
"""

from __future__ import annotations

import hashlib
import hmac


def _times(a: int, b: int) -> int:
    out = 0
    while b:
        if b & 1:
            out ^= a
        a = a << 1 ^ (0x11B if a & 0x80 else 0)
        b >>= 1
    return out


def _sbox() -> bytes:
    out = bytearray(256)
    for x in range(256):
        inv = next((y for y in range(256) if _times(x, y) == 1), 0)
        s = 0
        for i in range(8):
            bit = (inv >> i ^ inv >> (i + 4) % 8 ^ inv >> (i + 5) % 8 ^ inv >> (i + 6) % 8 ^ inv >> (i + 7) % 8 ^ 0x63 >> i) & 1
            s |= bit << i
        out[x] = s
    return bytes(out)


SBOX = _sbox()
INVERSE = bytes(SBOX.index(x) for x in range(256))
_BY = {k: bytes(_times(x, k) for x in range(256)) for k in (2, 3, 9, 11, 13, 14)}


class Aes:
    def __init__(self, key: bytes):
        n = len(key) // 4
        words, c = [list(key[4 * i : 4 * i + 4]) for i in range(n)], 1
        self.rounds = n + 6
        while len(words) < 4 * (self.rounds + 1):
            w = list(words[-1])
            if len(words) % n == 0:
                w = [SBOX[x] for x in w[1:] + w[:1]]
                w[0] ^= c
                c = _times(c, 2)
            elif n > 6 and len(words) % n == 4:
                w = [SBOX[x] for x in w]
            words.append([a ^ b for a, b in zip(w, words[-n], strict=True)])
        self.keys = [bytes(sum(words[4 * r : 4 * r + 4], [])) for r in range(self.rounds + 1)]

    def encrypt(self, block: bytes) -> bytes:
        s = bytes(a ^ b for a, b in zip(block, self.keys[0], strict=True))
        for r in range(1, self.rounds + 1):
            s = bytes(SBOX[s[(i + 4 * (i % 4)) % 16]] for i in range(16))
            if r < self.rounds:
                two, three = _BY[2], _BY[3]
                s = bytes(
                    two[s[4 * c + i]] ^ three[s[4 * c + (i + 1) % 4]] ^ s[4 * c + (i + 2) % 4] ^ s[4 * c + (i + 3) % 4] for c in range(4) for i in range(4)
                )
            s = bytes(a ^ b for a, b in zip(s, self.keys[r], strict=True))
        return s

    def decrypt(self, block: bytes) -> bytes:
        s = bytes(a ^ b for a, b in zip(block, self.keys[self.rounds], strict=True))
        for r in range(self.rounds - 1, -1, -1):
            s = bytes(INVERSE[s[(i - 4 * (i % 4)) % 16]] for i in range(16))
            s = bytes(a ^ b for a, b in zip(s, self.keys[r], strict=True))
            if r:
                s = bytes(
                    _BY[14][s[4 * c + i]] ^ _BY[11][s[4 * c + (i + 1) % 4]] ^ _BY[13][s[4 * c + (i + 2) % 4]] ^ _BY[9][s[4 * c + (i + 3) % 4]]
                    for c in range(4)
                    for i in range(4)
                )
        return s

    def cbc_decrypt(self, data: bytes, iv: bytes) -> bytes:
        out, last = b"", iv
        for i in range(0, len(data) - len(data) % 16, 16):
            out += bytes(a ^ b for a, b in zip(self.decrypt(data[i : i + 16]), last, strict=True))
            last = data[i : i + 16]
        return out[: -out[-1]] if out and 1 <= out[-1] <= 16 else out

    def counter(self, data: bytes, nonce: bytes, start: int = 2) -> bytes:
        """GCM's payload, both ways, for a nonce of 12 bytes."""
        pad = b"".join(self.encrypt(nonce + (start + i).to_bytes(4, "big")) for i in range(-(-len(data) // 16)))
        return bytes(a ^ b for a, b in zip(data, pad))

    def tag(self, sealed: bytes, nonce: bytes, extra: bytes) -> bytes:
        """GCM's tag."""
        h = int.from_bytes(self.encrypt(bytes(16)), "big")
        y = 0
        text = extra + bytes(-len(extra) % 16) + sealed + bytes(-len(sealed) % 16) + (8 * len(extra)).to_bytes(8, "big") + (8 * len(sealed)).to_bytes(8, "big")
        for i in range(0, len(text), 16):
            x, v, y = y ^ int.from_bytes(text[i : i + 16], "big"), h, 0
            for bit in range(127, -1, -1):
                if x >> bit & 1:
                    y ^= v
                v = v >> 1 ^ (0xE1 << 120 if v & 1 else 0)
        return bytes(a ^ b for a, b in zip(y.to_bytes(16, "big"), self.encrypt(nonce + b"\0\0\0\1"), strict=True))


def expand_label(secret: bytes, label: bytes, size: int) -> bytes:
    """HKDF-Expand-Label of TLS 1.3 without a context."""
    full = b"tls13 " + label
    info = size.to_bytes(2, "big") + bytes([len(full)]) + full + b"\0"
    out, block, i = b"", b"", 1
    while len(out) < size:
        block = hmac.new(secret, block + info + bytes([i]), hashlib.sha256).digest()
        out, i = out + block, i + 1
    return out[:size]
