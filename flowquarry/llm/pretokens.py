"""Splitting texts into the pieces that a tokenizer encodes one by one, and keeping pieces already encoded.

For texts of Latin letters the split is one regular expression. All other texts, where character
classes may differ between Unicode versions, go through the library's own normaliser and splitter.
"""

from __future__ import annotations

import re
import unicodedata

LATIN = [c for c in map(chr, range(0x21, 0x250)) if not 0x7F <= ord(c) <= 0xA0]


def _class(kind: str) -> str:
    return "".join(re.escape(c) for c in LATIN if unicodedata.category(c)[0] == kind)


LETTER, NUMBER = _class("L"), _class("N")
#: Anything outside tab..CR, space, and the visible characters up to U+024F.
UNUSUAL = re.compile(r"[^\t-\r -~¡-ɏ]")
BYTE_LEVEL = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^\s{LETTER}{NUMBER}]+|\s+(?!\S)|\s+"
)
WORD_LEVEL = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^\s{LETTER}{NUMBER}]+")


def byte_alphabet() -> list[str]:
    """The visible character that stands for each byte: itself where it is visible, else one from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(others)) for b in range(256)]


ALPHABET = byte_alphabet()
_TABLE = {b: c for b, c in enumerate(ALPHABET)}


def mapped(piece: str) -> str:
    """The piece's UTF-8 bytes in the visible alphabet."""
    return piece.encode().decode("latin-1").translate(_TABLE)


class Kept(dict):
    """A bounded memory of encoded pieces; emptied when full, which costs time and changes no result."""

    def __init__(self, encode_all, most: int = 300_000, most_chars: int = 1 << 24):
        super().__init__()
        self.encode_all, self.most, self.most_chars, self.chars = encode_all, most, most_chars, 0

    def learn(self, pieces) -> None:
        if len(self) > self.most or self.chars > self.most_chars:
            self.clear()
            self.chars = 0
        new = [p for p in set(pieces) if p not in self]
        if new:
            self.chars += sum(map(len, new))
            self.update(self.encode_all(new))
