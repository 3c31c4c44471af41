"""A reader over bytes whose failures are absorbed: after one, every read gives None."""

from __future__ import annotations


class Cursor:
    def __init__(self, data: bytes, at: int = 0, end: int | None = None):
        self.data, self.at, self.end = data, at, len(data) if end is None else min(end, len(data))
        self.ok = True

    def left(self) -> int:
        return self.end - self.at if self.ok else 0

    def take(self, n: int | None) -> bytes | None:
        if not self.ok or n is None or n < 0 or self.at + n > self.end:
            self.ok = False
            return None
        self.at += n
        return self.data[self.at - n : self.at]

    def upto(self, n: int) -> bytes:
        """As many as n bytes, fewer at the end."""
        return self.take(min(n, self.left())) or b""

    def uint(self, n: int, order: str = "big") -> int | None:
        b = self.take(n)
        return None if b is None else int.from_bytes(b, order)

    def sized(self, n: int) -> bytes | None:
        """Bytes whose number stands before them in n bytes."""
        return self.take(self.uint(n))

    def sized_upto(self, n: int) -> bytes:
        """As sized, but what there is if the data end early."""
        size = self.uint(n)
        return b"" if size is None else self.upto(size)

    def until(self, mark: bytes) -> bytes | None:
        i = self.data.find(mark, self.at, self.end) if self.ok else -1
        if i < 0:
            self.ok = False
            return None
        out = self.data[self.at : i]
        self.at = i + len(mark)
        return out

    def rest(self) -> bytes:
        return self.take(self.left()) or b""


def text(b: bytes | None) -> str | None:
    return None if b is None else b.decode("utf-8", "replace")
