"""Suffix-array dedup by column-wise construction over a collection of strings.

A byte is removed if a string of SPAN bytes that covers it also starts in a document with a smaller
identifier. Equal strings of SPAN bytes are found as suffixes with a common prefix of SPAN bytes in
the sorted suffixes of a collection. The collection is built column-wise: each round inserts one
more symbol of every string, from its end, by distributing the current suffixes over one sequential
file per symbol, which is the next Burrows-Wheeler order; the classes of suffixes with a common
prefix are updated along with it, one symbol longer each round. Beyond `memory_suffixes` the rounds
read and write their files in the shared folder in chunks.

Rounds are as many as the longest string has symbols, so documents are not inserted as they are.
Each string of SPAN bytes has a core: its minimiser, the least hash among its windows of M bytes,
the leftmost of equal ones, with the SIDE bytes to the right of it if the string holds them, else
with those to the left of it. Equal strings have equal cores. Texts are cut where the core changes,
into pieces of at most WIDTH bytes, and the pieces of one core form a collection of their own.

What cannot match is left out before, exactly: a piece matters only if another text has its core.
That is decided by hashes of cores, in slices of the hash range; false agreement costs work and
removes nothing. Later copies of a whole text are not cut: all of it goes. Equal pieces of more than
SPAN bytes are one string with the smallest identifier of their documents. Of a core that stands in
more than HOT_PIECES places the single strings of SPAN bytes are dealt out by hashes of their own,
so that no core fills a task; they too are sorted by the construction, ungrouped.

Slices are as many as the input has 4 MB. Texts travel in compressed batches and pieces in
one row for each batch and slice, so joins and shuffles handle few rows. A worker holds one slice,
and sorts collections of up to `memory_suffixes` bytes at a time.

Defined results: matches never cross documents; a null text counts as empty; documents with equal
identifier remove nothing from each other; null identifiers count as larger than all others; rows
with equal identifier and text get the same result each; other columns are ignored; an empty table
gives no rows. A text of one repeated letter, or of one short repeated passage, makes few distinct
pieces, however long it is.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowquarry.llm.batches import by_slice, dealt_by_slice, first_of_runs, slice_edges, slices_for, text_batches, unpacked
from flowquarry.llm.common import cluster_partitions, delete_table, new_path, written
from flowquarry.llm.shingles import mix

SPAN = 50
M = 24
SIDE = (SPAN - M) // 2
WIDTH = 64  # bytes of a piece, at most
MOST = WIDTH - SPAN  # strings of SPAN bytes in a piece, at most
RANGE = 1 << 18  # bytes whose hashes are held at once
SALTS = 16
HOT_PIECES = 50_000
LAST_ID = (1 << 63) - 1
_U = np.uint64
_BYTE = mix(np.arange(7001, 7257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)).astype(np.uint32)
_MIXERS = mix(np.arange(9001, 9017, dtype=np.uint64)) | _U(1)


# --- batches and pieces of documents ------------------------------------------------------------------

def _live(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts to cut, all but later copies and short ones: bytes, offsets, where each stands in its batch, identifiers."""
    data, offsets = unpacked(batch, k)
    sizes = np.diff(offsets)
    keep = sizes >= SPAN
    keep[np.array(batch.column("skip")[k].as_py() or [], np.int64)] = False
    own = np.flatnonzero(keep)
    dks = batch.column("dk")[k].values.to_numpy(zero_copy_only=False)
    return data[np.repeat(keep, sizes)], np.concatenate([[0], np.cumsum(sizes[own])]), offsets[own], dks[own]


def _range_pieces(d: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of the valid strings of SPAN bytes in d: start, number of strings, core."""
    h8 = _BYTE[d]
    for step, factor in ((1, 0x9E3779B1), (2, 0xC2B2AE35), (4, 0x165667B1)):
        h8 = h8[:-step] * np.uint32(factor) + h8[step:]
    h = h8[: len(d) - M + 1] * np.uint32(0x27D4EB2F) + h8[8 : len(d) - M + 9] * np.uint32(0x85EBCA77) + h8[16:] * np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x7FEB352D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x846CA68B)
    h ^= h >> np.uint32(16)
    low = (h.astype(np.uint64) << _U(32)) | np.arange(len(h), dtype=np.uint64)  # the least hash, and where it stands first
    w = SPAN - M + 1
    for step in (1, 2, 4, 8):
        low = np.minimum(low[:-step], low[step:])
    low = np.minimum(low[: -(w - 16)], low[w - 16 :])
    at = np.flatnonzero(valid)
    p = (low[at] & _U(0xFFFFFFFF)).astype(np.int64)
    group = 2 * p + (p - at <= SIDE)
    first = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (np.diff(at) != 1)]))
    start, size, p, right = at[first], np.diff(np.append(first, len(at))), p[first], (group[first] & 1).astype(bool)
    one = np.where(right, p + M, p - SIDE)
    core = h[p].astype(np.uint64) * _MIXERS[0] + h8[one].astype(np.uint64) * _MIXERS[1] + h8[one + SIDE - 8].astype(np.uint64) * _MIXERS[2]
    core = mix(core + h8[p].astype(np.uint64) * _MIXERS[3] + h8[p + 12].astype(np.uint64) * _MIXERS[4] + np.where(right, _MIXERS[5], _MIXERS[6]))
    again = (core[1:] == core[:-1]) & (start[1:] == start[:-1] + size[:-1])
    if again.any():  # the same core again and again, as in runs of one letter
        first = np.flatnonzero(np.concatenate([[True], ~again]))
        start, size, core = start[first], np.add.reduceat(size, first), core[first]
        parts = -(-size // MOST)
        k = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        start, core, size = np.repeat(start, parts) + k * MOST, np.repeat(core, parts), np.minimum(MOST, np.repeat(size, parts) - k * MOST)
    return start, size, core


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of the texts in data: start in data, number of strings of SPAN bytes, core."""
    out = []
    for a in range(0, len(data) - SPAN + 1, RANGE):
        d = data[a : a + RANGE + SPAN - 1]
        n = len(d) - SPAN + 1
        ends = offsets[np.searchsorted(offsets, a, "right") : np.searchsorted(offsets, a + len(d), "left")] - a
        over = np.zeros(n + 1, np.int32)  # strings that a text's end cuts through
        np.add.at(over, np.clip(ends - SPAN + 1, 0, n), 1)
        np.add.at(over, np.clip(ends, 0, n), -1)
        valid = np.cumsum(over[:-1]) == 0
        if valid.any():
            start, size, core = _range_pieces(d, valid)
            out.append((start + a, size, core))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _in_order(start: np.ndarray, core: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of pieces by core, where each core begins in it, and the text of each piece in it."""
    order = np.argsort(core, kind="stable")
    return order, first_of_runs(core[order]), np.searchsorted(offsets, start[order], "right") - 1


def _anchors(texts: DataFrame, s: int) -> DataFrame:
    """For each batch and slice its distinct cores, how often each stands there, and which stand in several texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                data, offsets, _, _ = _live(batch, k)
                start, _, core = cut(data, offsets)
                if not len(start):
                    continue
                order, first, doc = _in_order(start, core, offsets)
                count = np.minimum(np.diff(np.append(first, len(order))), 0x7FFF).astype(np.uint16)
                several = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)
                marks = count | (several.astype(np.uint16) << np.uint16(15))
                distinct = core[order[first]]
                keys = distinct.astype(np.uint32)  # the lower half; the upper half names the slice
                used, edges = slice_edges(distinct, s)
                spans = list(zip(edges, edges[1:]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(used), batch.column("bid")[k].as_py(), np.int64)),
                        pa.array(used, pa.int32()),
                        pa.array([keys[a:b].tobytes() for a, b in spans], pa.binary()),
                        pa.array([marks[a:b].tobytes() for a, b in spans], pa.binary()),
                    ],
                    ["bid", "slice", "keys", "marks"],
                )

    return texts.mapInArrow(run, "bid long, slice int, keys binary, marks binary")


def _flags(anchors: DataFrame, n: int, hot: int) -> DataFrame:
    """For each batch and slice the cores that another text has too, and which of these stand in many places, a bit each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, rows in by_slice(batches):
            keys = np.concatenate([np.frombuffer(r[2], np.uint32) for r in rows])
            marks = np.concatenate([np.frombuffer(r[3], np.uint16) for r in rows])
            order = np.argsort(keys, kind="stable")
            first = first_of_runs(keys[order])
            times = np.diff(np.append(first, len(order)))
            marks = marks[order]
            shared = (times > 1) | (np.maximum.reduceat(marks, first) > 0x7FFF)
            many = shared & (np.add.reduceat((marks & np.uint16(0x7FFF)).astype(np.int64), first) > hot)
            out = np.zeros((2, len(keys)), bool)
            out[0][order], out[1][order] = np.repeat(shared, times), np.repeat(many, times)
            edges = np.cumsum([0, *(len(r[2]) // 4 for r in rows)]).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([s] * len(rows), pa.int32()),
                    *(pa.array([np.packbits(x[a:b]).tobytes() for a, b in zip(edges, edges[1:])], pa.binary()) for x in out),
                ],
                ["bid", "slice", "shared", "many"],
            )

    return dealt_by_slice(anchors, n).mapInArrow(run, "bid long, slice int, shared binary, many binary")


def _matrix(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of each piece as a row of WIDTH bytes, zero behind its end."""
    if len(data) < WIDTH or len(start) and start.max() + WIDTH > len(data):
        data = np.concatenate([data, np.zeros(WIDTH, np.uint8)])
    windows = np.lib.stride_tricks.sliding_window_view(data, WIDTH)
    out = np.empty((len(start), WIDTH), np.uint8)
    for a in range(0, len(start), 1 << 14):
        part = windows[start[a : a + (1 << 14)]]
        part *= np.arange(WIDTH) < (size[a : a + (1 << 14)] + SPAN - 1)[:, None]
        out[a : a + (1 << 14)] = part
    return out


def _names(matrix: np.ndarray, size: np.ndarray) -> np.ndarray:
    wide = matrix.view(np.uint64)
    out = size.astype(np.uint64)
    for j in range(WIDTH // 8):
        out = (out ^ (out >> _U(29))) * _MIXERS[8] + wide[:, j] * _MIXERS[j]
    return mix(out)


def _grouped(key: np.ndarray, matrix: np.ndarray, size: np.ndarray, single: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The order of strings by key, and where in it strings begin that differ from the one before. Singles always differ."""
    order = np.argsort(key, kind="stable")
    wide = matrix.view(np.uint64)[order]
    new = np.ones(len(order), bool)
    same = (size[order][1:] == size[order][:-1]) & (key[order][1:] == key[order][:-1])
    for j in range(WIDTH // 8):
        same &= wide[1:, j] == wide[:-1, j]
    new[1:] = ~same
    if single is not None:
        new |= single[order]
    return order, np.flatnonzero(new)


def _packed_ids(ids: np.ndarray) -> bytes:
    """Identifiers as differences to the least one, in 32 bits if they fit."""
    least = int(ids.min())
    far = ids.astype(np.uint64) - np.array(least).astype(np.uint64)
    return np.int64(least).tobytes() + (far.astype(np.uint32) if far.max() < 1 << 32 else far).tobytes()


def _unpacked_ids(raw: bytes, n: int) -> np.ndarray:
    far = np.frombuffer(raw, np.uint32 if len(raw) == 8 + 4 * n else np.uint64, n, 8)
    return (far.astype(np.uint64) + np.frombuffer(raw, np.int64, 1).astype(np.uint64)).astype(np.int64)


PIECES = "bid long, slice int, cores binary, sizes binary, ids binary, strings binary, places binary, spans binary"


def _piece_rows(texts: DataFrame, s: int) -> DataFrame:
    """For each batch with its `flags` and slice the distinct strings that may match, with their least identifiers and places.

    Places where an equal string stands in a smaller document of the same batch are spans already,
    in rows with a negative slice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                data, offsets, begin, dks = _live(batch, k)
                flags = sorted(batch.column("flags")[k].as_py() or [], key=lambda f: f["slice"])
                if not flags:
                    continue
                start, size, core = cut(data, offsets)
                order, first, _ = _in_order(start, core, offsets)
                _, edges = slice_edges(core[order[first]], s)
                bits = [
                    np.concatenate([np.unpackbits(np.frombuffer(f[x], np.uint8), count=b - a) for f, a, b in zip(flags, edges, edges[1:])]).astype(bool)
                    for x in ("shared", "many")
                ]
                each = np.diff(np.append(first, len(order)))
                shared, many = np.zeros(len(order), bool), np.zeros(len(order), bool)
                shared[order], many[order] = np.repeat(bits[0], each), np.repeat(bits[1], each)
                start, size, core, many = start[shared], size[shared], core[shared], many[shared]
                if not len(start):
                    continue
                if many.any():  # single strings, which go where their own hash says
                    times = np.where(many, size, 1)
                    j = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
                    start, size, core, many = np.repeat(start, times) + j, np.repeat(np.where(many, 1, size), times), np.repeat(core, times), np.repeat(many, times)
                matrix = _matrix(data, start, size)
                name = _names(matrix, size)
                core = np.where(many, mix(name), core)
                key = (core & _U(0xFFFFFFFF00000000)) | (name & _U(0xFFFFFFFF))
                order, first = _grouped(key, matrix, size)
                each = np.diff(np.append(first, len(order)))
                doc = np.searchsorted(offsets, start[order], "right") - 1
                least = np.minimum.reduceat(dks[doc], first)
                place = start[order] - offsets[doc] + begin[doc]
                later = dks[doc] > np.repeat(least, each)
                bid = batch.column("bid")[k].as_py()
                rows = []
                if later.any():
                    at = place[later].astype(np.uint32)
                    rows.append((-1 - bid % s, None, None, None, None, None, at.tobytes() + (at + (size[order][later] + SPAN - 1).astype(np.uint32)).tobytes()))
                entry = np.repeat(np.arange(len(first)), each)[~later]
                place = place[~later].astype(np.uint32)
                matrix, size, core = matrix[order[first]], size[order[first]].astype(np.uint8), core[order[first]]
                used, edges = slice_edges(core, s)
                held = np.searchsorted(entry, edges).tolist()
                pack = zstandard.ZstdCompressor(level=1)
                for i, a, b, x, y in zip(used, edges, edges[1:], held, held[1:]):
                    places = (entry[x:y] - a).astype(np.uint32).tobytes() + place[x:y].tobytes()
                    rows.append((i, core[a:b].astype(np.uint32).tobytes(), size[a:b].tobytes(), _packed_ids(least[a:b]), pack.compress(matrix[a:b].reshape(-1)), places, None))
                columns = list(zip(*rows, strict=True))
                for at in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows[at : at + 64]), bid, np.int64)), pa.array(columns[0][at : at + 64], pa.int32()), *(pa.array(c[at : at + 64], pa.binary()) for c in columns[1:])],
                        [f.split()[0] for f in PIECES.split(", ")],
                    )

    return texts.mapInArrow(run, PIECES)


# --- the collection ---------------------------------------------------------------------------------

Rows = tuple[np.ndarray, np.ndarray, np.ndarray]  # symbol, where the next symbol stands, class


class Columns:
    """One sequential file for each symbol: suffixes are appended, then read in the order of symbols."""

    def __init__(self, folder: str | None):
        self.kept: dict[int, list[Rows]] = {}
        self.folder = folder
        if folder:
            self.fs, self.inner = pyarrow.fs.FileSystem.from_uri(f"{folder}/{uuid.uuid4().hex}")
            self.fs.create_dir(self.inner, recursive=True)
            self.files: dict = {}

    def append(self, rows: Rows) -> None:
        """rows are in the order of their symbols."""
        edges = [0, *(np.flatnonzero(np.diff(rows[0])) + 1).tolist(), len(rows[0])]
        for a, b in zip(edges, edges[1:]):
            s = int(rows[0][a])
            if self.folder:
                if s not in self.files:
                    self.files[s] = self.fs.open_output_stream(f"{self.inner}/{s:03d}")
                self.files[s].write((b - a).to_bytes(8, "little") + rows[1][a:b].astype(np.int64).tobytes() + rows[2][a:b].astype(np.int64).tobytes())
            else:
                self.kept.setdefault(s, []).append(tuple(x[a:b] for x in rows))

    def _parts(self) -> Iterator[Rows]:
        if not self.folder:
            for s in sorted(self.kept):
                yield from self.kept[s]
            return
        for s in sorted(self.files):
            self.files[s].close()
            with self.fs.open_input_stream(f"{self.inner}/{s:03d}") as file:
                while head := file.read(8):
                    n = int.from_bytes(head, "little")
                    yield np.full(n, s, np.uint16), np.frombuffer(file.read(8 * n), np.int64), np.frombuffer(file.read(8 * n), np.int64)

    def read(self, rows: int) -> Iterator[Rows]:
        """All suffixes in order, in chunks of about rows."""
        held, n = [], 0
        for part in self._parts():
            held.append(part)
            n += len(part[0])
            if n >= rows:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held, n = [], 0
        if held:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))

    def delete(self) -> None:
        if self.folder:
            self.fs.delete_dir(self.inner)


def common_prefix_classes(data: np.ndarray, offsets: np.ndarray, span: int, folder: str | None = None, chunk: int = 1 << 20) -> Iterator[Rows]:
    """The suffixes of at least span bytes of all strings, in sorted order: string, place in it, class.

    Suffixes of one class have their first span bytes in common, and no others. An empty symbol in
    front of every string ends its insertion.
    """
    m, lengths = len(offsets) - 1, np.diff(offsets)
    rounds = int(lengths.max()) if m else 0
    if rounds < span:
        return
    number = np.arange(m)
    small = np.int32 if len(data) + m < 1 << 31 else np.int64
    used = np.bincount(data, minlength=256) > 0
    kind = np.uint8 if used.sum() < 256 else np.uint16
    symbols = np.zeros(len(data) + m, kind)
    symbols[np.arange(len(data)) + np.repeat(number + 1, lengths)] = np.cumsum(used).astype(kind)[data]
    first, last = offsets[:-1] + number + 1, (offsets[1:] + number).astype(small)

    def ordered(columns: Columns | None, level: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All suffixes of this round in order, with their classes: the empty ones, then the columns."""
        yield last, (number if level else np.zeros(m)).astype(small)
        if columns is None:
            return
        classes, before = m, None
        for sym, at, cls in columns.read(chunk):
            if not level:
                yield at, np.zeros(len(at), small)
                continue
            edge = np.ones(len(at), bool)
            edge[1:] = (sym[1:] != sym[:-1]) | (cls[1:] != cls[:-1])
            if before is not None:
                edge[0] = before != (sym[0], cls[0])  # a class may go on from the last chunk
            before = sym[-1], cls[-1]
            new = np.cumsum(edge, dtype=small) + small(classes - 1)
            classes = int(new[-1]) + 1
            yield at, new

    columns = None
    for r in range(1, rounds + 1):
        level = max(0, r - 1 - (rounds - span))  # symbols that the classes of the last round have compared
        following = Columns(folder)
        for at, cls in ordered(columns, level):
            sym = symbols[at]
            order = np.argsort(sym, kind="stable")
            order = order[np.searchsorted(sym, 1, sorter=order) :]
            if len(order):
                following.append((sym[order], at[order] - 1, cls[order]))
        if columns is not None:
            columns.delete()
        columns = following
    for at, cls in ordered(columns, span):
        sid = np.searchsorted(first, at + 1, side="right") - 1
        place = at + 1 - first[sid]
        long = lengths[sid] - place >= span
        if long.any():
            yield sid[long], place[long], cls[long]
    columns.delete()


def least_ids(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, folder: str | None) -> np.ndarray:
    """For each place of a string of SPAN bytes the least of ids among the strings that share it, one string after the other."""
    places = np.concatenate([[0], np.cumsum(np.maximum(0, np.diff(offsets) - SPAN + 1))])
    out = np.full(int(places[-1]), LAST_ID, np.int64)
    last, least = -1, LAST_ID  # the class that the last chunk ended in, which may go on, and its least identifier so far
    open_: list[np.ndarray] = []

    for sid, place, cls in common_prefix_classes(data, offsets, SPAN, folder):
        first = first_of_runs(cls)
        own = np.minimum.reduceat(ids[sid], first)
        at = places[sid] + place
        if cls[0] == last:
            own[0] = min(own[0], least)
            if own[0] < least:
                for earlier in open_:
                    out[earlier] = own[0]
        out[at] = np.repeat(own, np.diff(np.append(first, len(cls))))
        if len(first) > 1 or cls[0] != last:
            open_ = []
        open_.append(at[first[-1] :])
        last, least = cls[-1], own[-1]
    return out


SORTED_AT_ONCE = 1 << 15  # strings


def _settled(matrix: np.ndarray, size: np.ndarray, core: np.ndarray, least: np.ndarray, folder: str, memory_suffixes: int) -> tuple[np.ndarray, np.ndarray]:
    """Strings in the order of their cores: where the places of each stand in the result, and the least identifiers there.

    Strings of a core whose strings all begin in one smallest document have no places: none is smaller.
    """
    first = first_of_runs(core)
    times = np.diff(np.append(first, len(core)))
    differ = np.minimum.reduceat(least, first) < np.maximum.reduceat(least, first)
    places = np.concatenate([[0], np.cumsum(np.where(np.repeat(differ, times), size, 0))])
    out = np.empty(int(places[-1]), np.int64)
    open_ = np.flatnonzero(differ)
    ends = np.cumsum(times[open_])
    at = 0
    while at < len(open_):
        past = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, past + SORTED_AT_ONCE, "right")))
        k = np.arange(int(ends[to - 1] - past)) - np.repeat(np.cumsum(times[open_[at:to]]) - times[open_[at:to]], times[open_[at:to]])
        own = np.repeat(first[open_[at:to]], times[open_[at:to]]) + k
        lengths = size[own] + SPAN - 1
        data = matrix[own][np.arange(WIDTH) < lengths[:, None]]
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        got = least_ids(data, offsets, least[own], folder if len(data) > memory_suffixes else None)
        out[int(places[own[0]]) : int(places[own[-1] + 1])] = got
        at = to
    return places, out


def _spans(pieces_: DataFrame, n: int, folder: str, memory_suffixes: int) -> DataFrame:
    """For each batch the spans, in its bytes, that smaller documents have too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, rows in by_slice(batches):
            if s < 0:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[7] for r in rows], pa.binary())], ["bid", "spans"])
                continue
            core = np.concatenate([np.frombuffer(r[2], np.uint32) for r in rows])
            sizes = [len(r[3]) for r in rows]
            size = np.concatenate([np.frombuffer(r[3], np.uint8) for r in rows]).astype(np.int64)
            own = np.concatenate([_unpacked_ids(r[4], len(r[3])) for r in rows])
            unpack = zstandard.ZstdDecompressor()
            matrix = np.concatenate([np.frombuffer(unpack.decompress(r[5]), np.uint8) for r in rows]).reshape(-1, WIDTH)
            places = [np.frombuffer(r[6], np.uint32) for r in rows]
            counts = [len(p) // 2 for p in places]
            base = np.cumsum([0, *sizes[:-1]])
            entry = np.concatenate([p[:c].astype(np.int64) + b for p, c, b in zip(places, counts, base, strict=True)])
            place = np.concatenate([p[c:] for p, c in zip(places, counts, strict=True)])
            row = np.repeat(np.arange(len(rows)), counts)
            rows = [r[0] for r in rows]
            # equal strings of more than SPAN bytes are one
            key = (core.astype(np.uint64) << _U(32)) | (_names(matrix, size) & _U(0xFFFFFFFF))
            order, first = _grouped(key, matrix, size, size == 1)
            times = np.diff(np.append(first, len(order)))
            string = np.empty(len(order), np.int64)
            string[order] = np.repeat(np.arange(len(first)), times)
            least = np.minimum.reduceat(own[order], first)
            kept = order[first]
            at, least_at = _settled(matrix[kept], size[kept], core[kept], least, folder, memory_suffixes)
            del matrix
            out = []
            whole = (own > least[string])[entry]
            out.append((row[whole], place[whole], place[whole] + (size[entry[whole]] + SPAN - 1).astype(np.uint32)))
            # of each other string the runs of places that have a smaller identifier
            part = np.flatnonzero(~whole & (at[string[entry] + 1] > at[string[entry]]))
            n_places = size[entry[part]]
            owner = np.repeat(part, n_places)
            k = np.arange(int(n_places.sum())) - np.repeat(np.cumsum(n_places) - n_places, n_places)
            small = np.flatnonzero(least_at[at[string[entry[owner]]] + k] < own[entry[owner]])
            if len(small):
                owner, k = owner[small], k[small]
                begin = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (np.diff(k) != 1)]))
                end = np.append(begin[1:], len(k)) - 1
                out.append((row[owner[begin]], (place[owner[begin]] + k[begin]).astype(np.uint32), (place[owner[end]] + k[end] + SPAN).astype(np.uint32)))
            row, start, stop = map(np.concatenate, zip(*out, strict=True))
            order = np.argsort(row, kind="stable")
            row, start, stop = row[order], start[order], stop[order]
            begin = first_of_runs(row)
            edges = [*begin.tolist(), len(row)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[i] for i in row[begin].tolist()], pa.int64()),
                    pa.array([start[a:b].tobytes() + stop[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary()),
                ],
                ["bid", "spans"],
            )

    return dealt_by_slice(pieces_, n).mapInArrow(run, "bid long, spans binary")


# --- documents --------------------------------------------------------------------------------------


def _remove(batches_: DataFrame) -> DataFrame:
    """The documents of batches with `found`, packed spans, and `skip`, the numbers of texts that go whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                data, offsets = unpacked(batch, k)
                whole = np.array(batch.column("skip")[k].as_py() or [], np.int64)
                whole = whole[np.diff(offsets)[whole] >= SPAN]
                found = [np.frombuffer(x, np.uint32).astype(np.int64).reshape(2, -1) for x in batch.column("found")[k].as_py() or []]
                start, stop = np.concatenate([np.stack([offsets[whole], offsets[whole + 1]]), *found], axis=1)
                order = np.argsort(start, kind="stable")
                start, stop = start[order], np.maximum.accumulate(stop[order]) if len(order) else stop
                doc = np.searchsorted(offsets, start, "right") - 1
                new = np.ones(len(start), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > stop[:-1])
                first = np.flatnonzero(new)
                start, doc, stop = start[first], doc[first], stop[np.append(first[1:], len(stop)) - 1] if len(first) else stop
                gone = np.zeros(len(data) + 1, np.int8)
                np.add.at(gone, start, 1)
                np.add.at(gone, stop, -1)
                kept = data[np.cumsum(gone[:-1], dtype=np.int8) == 0]
                removed = np.bincount(doc, stop - start, len(offsets) - 1).astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(np.diff(offsets) - removed)]).astype(np.int32)
                runs = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(offsets) - 1))]).astype(np.int32)
                pairs = pa.StructArray.from_arrays([pa.array(start - offsets[doc]), pa.array(stop - offsets[doc])], ["start", "end"])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[k].values,
                        pa.array(np.diff(offsets)),
                        pa.ListArray.from_arrays(pa.array(runs), pairs),
                        pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(ends), pa.py_buffer(kept)]),
                    ],
                    ["doc_id", "n_bytes", "spans", "kept"],
                )

    schema = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    return batches_.mapInArrow(run, schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memory_suffixes: int = 1 << 22) -> DataFrame:
    """doc_id, n_bytes, the removed spans [start, end) and the kept bytes of every row."""
    spark = docs.sparkSession
    n = cluster_partitions(spark)
    key = F.coalesce(docs[id_col].cast("long"), F.lit(LAST_ID))
    base = docs.select(docs[id_col].cast("long").alias("doc_id"), key.alias("dk"), F.xxhash64(docs[text_col]).alias("th"), F.hash(docs[text_col]).alias("h2"), docs[text_col].alias("text"))
    read = written(text_batches(base, {"doc_id": "long", "dk": "long", "th": "long", "h2": "int"}), "text-batches")
    # later copies of a whole text: all of it goes, and it adds nothing to what the first copy holds
    each = read.select("bid", F.posexplode(F.arrays_zip("dk", "th", "h2", "sizes")).alias("i", "t")).select("bid", F.col("i").cast("long").alias("i"), "t.*")
    same = ["th", "h2", "sizes"]
    firsts = each.groupBy(*same).agg(F.min("dk").alias("least"), F.max("dk").alias("hi")).filter("least < hi").drop("hi")
    # a group of very many copies is dealt out over SALTS tasks
    firsts = firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    skips = written(each.withColumn("salt", F.pmod(F.hash("bid", "i"), F.lit(SALTS))).join(firsts, [*same, "salt"]).filter("dk > least").groupBy("bid").agg(F.collect_list("i").alias("skip")), "copies")
    s = slices_for(read, n)
    texts = written(read.join(skips, "bid", "left").select("bid", "doc_id", "dk", "sizes", "blob", "skip"), "texts")
    delete_table(read)
    delete_table(skips)
    flags = written(_flags(_anchors(texts, s), n, HOT_PIECES), "flags")
    of_batch = flags.groupBy("bid").agg(F.collect_list(F.struct("slice", "shared", "many")).alias("flags"))
    spans = written(_spans(_piece_rows(texts.join(of_batch, "bid"), s), n, new_path(spark, "suffix-columns"), memory_suffixes), "spans")
    delete_table(flags)
    by_batch = spans.groupBy("bid").agg(F.collect_list("spans").alias("found"))
    return _remove(texts.join(by_batch, "bid", "left").select(*texts.columns, "found"))


def kept_digest(removed: DataFrame) -> DataFrame:
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return removed.select(
        "doc_id", "n_bytes", total.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def brute_force(rows: list[tuple[int, str]]) -> list[tuple[int, int, int, int, str]]:
    """For tests: doc_id, n_bytes, n_removed, n_spans, kept_sha256 by a table of all strings."""
    first: dict[bytes, int] = {}
    for doc_id, text in rows:
        raw = text.encode()
        for i in range(len(raw) - SPAN + 1):
            gram = raw[i : i + SPAN]
            first[gram] = min(first.get(gram, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        raw = text.encode()
        gone = np.zeros(len(raw) + 1, bool)
        for i in range(len(raw) - SPAN + 1):
            if first[raw[i : i + SPAN]] < doc_id:
                gone[i : i + SPAN] = True
        gone = gone[:-1]
        runs = int(np.sum(gone & ~np.concatenate([[False], gone[:-1]]))) if len(gone) else 0
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((doc_id, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out
