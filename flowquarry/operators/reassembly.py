"""Reassembly (T4-T8, T10) as grouped state: TLS messages and SSH key exchanges over TCP segments, DTLS
handshakes and QUIC CRYPTO data over datagrams.

A message is bounded by what the operator keeps: 20 segments, 8192 bytes and 15 seconds from its
start. Those limits belong to the operator's semantics; what lies beyond them is reported as
truncated. State ends with its message or its time; there is no table that could be full (T9).
Packets come sorted by flow and time, so a task holds the open messages of one flow at a time.
"""

from __future__ import annotations

import struct
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from flowquarry.parse import quic

MAX_BYTES, MAX_SEGMENTS, MAX_SECONDS = 8192, 20, 15.0
KEY = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"]
_KEY = "src_ip string, dst_ip string, src_port int, dst_port int, protocol int"
_MEMBERS = "members array<struct<file:string,pkt_no:bigint>>"
SCHEMA = f"{_KEY}, file string, pkt_no long, data binary, status string, out_of_order boolean, overlap boolean, missing boolean, segments int, {_MEMBERS}"
MESSAGES = f"{_KEY}, file string, pkt_no long, kind string, data binary, segments int, {_MEMBERS}"


#: Most rows and bytes of a batch that goes back.
BATCH_ROWS, BATCH_BYTES = 10_000, 1 << 24


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[Any, ...]]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def arrow_schema(ddl: str) -> pa.Schema:
    """For the driver: a worker has no session to read DDL with."""
    return to_arrow_schema(StructType.fromDDL(ddl))


def batches_of(rows: Iterable[tuple[Any, ...]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Arrow batches of rows in the order of the schema's columns, weighed by the first binary one."""
    held, size, heavy = [], 0, schema.types.index(pa.binary())

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        size += len(row[heavy] or b"")
        if len(held) == BATCH_ROWS or size > BATCH_BYTES:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def by_flow(packets: DataFrame, *columns: str) -> DataFrame:
    """KEY and columns, all packets of a flow in one partition, one after the other in the order of time.

    Packets without a source stand alone: they are dealt out by file and number, and come first.
    """
    place = F.when(F.col("src_ip").isNull(), F.xxhash64("file", "pkt_no")).otherwise(F.xxhash64(*KEY))
    return packets.select(*KEY, *columns).repartition(place).sortWithinPartitions(*KEY, "ts", "pkt_no", "file")


def needed(data: bytes) -> int | None:
    """Bytes of the whole message that data begin: of TLS the records up to the end of the handshake, of SSH
    the key exchange with the version line before it; MAX_BYTES where its length is not known yet, None else."""
    if len(data) >= 9 and data[0] == 22 and data[1] == 3:
        size = int.from_bytes(data[6:9], "big") + 4
        record = struct.unpack(">H", data[3:5])[0]
        if size <= record:
            return 5 + record
        records = -(-size // max(1, record))
        return size + 5 * records
    start = data.find(b"\n") + 1 if data.startswith(b"SSH-") else 0
    if data.startswith(b"SSH-") and len(data) < start + 4 or data.startswith(b"SSH-") and not start:
        return MAX_BYTES
    size = int.from_bytes(data[start : start + 4], "big")
    if start or len(data) > 5 and data[5] == 20 and 16 < size <= 35000:
        return start + 4 + size
    return None


def join_segments(segments: list[tuple[int, bytes]], first: int, want: int) -> tuple[bytes, dict[str, bool]]:
    """The contiguous bytes from sequence number first; overlaps keep the bytes that came first."""
    flags = {"out_of_order": False, "overlap": False, "missing": False}
    size = min(want, MAX_BYTES)
    have, filled, top = bytearray(size), bytearray(size), 0
    for seq, data in segments:
        at = (seq - first) & 0xFFFFFFFF
        if at >= 1 << 31:
            at -= 1 << 32
        flags["out_of_order"] |= at > top
        top = max(top, at + len(data))
        start, end = max(at, 0), min(at + len(data), size)
        if start >= end:
            continue
        flags["overlap"] |= filled.find(1, start, end) >= 0
        hole = filled.find(0, start, end)
        while hole >= 0:
            stop = filled.find(1, hole, end)
            stop = end if stop < 0 else stop
            have[hole:stop] = data[hole - at : stop - at]
            filled[hole:stop] = b"\1" * (stop - hole)
            hole = filled.find(0, stop, end)
    whole = filled.find(0)
    whole = size if whole < 0 else whole
    flags["missing"] = filled.find(1, whole) >= 0
    return bytes(have[:whole]), flags


def stream_messages(packets: Iterable[tuple[Any, float, int, bytes]]) -> Iterator[tuple[list[Any], bytes, str, dict[str, bool]]]:
    """(members, data, status, flags) of the messages of a flow's packets (what, ts, seq, payload); members are their whats."""
    open_, members, start, first, want = [], [], 0.0, 0, 0

    def close(joined: tuple[bytes, dict[str, bool]] | None = None) -> tuple[list[Any], bytes, str, dict[str, bool]]:
        data, flags = joined or join_segments(open_, first, want)
        several = len(open_) > 1
        status = ("reassembled" if several else "none") if len(data) >= want else ("both" if several else "truncated")
        out = list(members), data, status, flags
        open_.clear()
        members.clear()
        return out

    for what, ts, seq, data in packets:
        if not data:
            continue
        if open_ and ts - start > MAX_SECONDS:
            yield close()
        open_.append((seq, data))
        members.append(what)
        if len(open_) > 1:
            joined, known = join_segments(open_, first, want), want
            if want == MAX_BYTES:
                want = needed(joined[0]) or MAX_BYTES
            if len(joined[0]) >= min(want, MAX_BYTES) or len(open_) == MAX_SEGMENTS:
                yield close(joined if want == known else None)
            continue
        size = needed(data)
        start, first, want = ts, seq, size or len(data)
        if size is None or size <= len(data):
            yield close()
    if open_:
        yield close()


def reassemble(packets: DataFrame) -> DataFrame:
    """Messages of packets (key, pkt_no, ts in seconds, seq, payload, perhaps file): the data, and whether they are whole.

    status is none for a message in one packet, reassembled, truncated, or both where the limits cut
    what several packets gave (T8). file and pkt_no are those of the first packet, members has all.
    """
    if "file" not in packets.columns:
        packets = packets.withColumn("file", F.lit(None).cast("string"))
    schema = arrow_schema(SCHEMA)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Any, ...]]:
        for key, group in groupby(rows_of(batches), key=lambda r: r[:5]):
            of_flow = (((file, pkt), ts, seq, data) for *_, file, pkt, ts, seq, data in group)
            for members, data, status, flags in stream_messages(of_flow):
                yield (*key, *members[0], data, status, *flags.values(), len(members), [{"file": f, "pkt_no": n} for f, n in members])

    return by_flow(packets, "file", "pkt_no", "ts", "seq", "payload").mapInArrow(lambda batches: batches_of(found(batches), schema), SCHEMA)


def dtls_fragments(data: bytes) -> Iterator[tuple[bytes, int, int, bytes]]:
    """(discriminator, offset, total, piece) of the handshake fragments in a datagram that are not whole messages.

    The discriminator is the message's type and sequence number.
    """
    at = 0
    while len(data) >= at + 25 and data[at] == 22 and data[at + 1] == 0xFE:
        size = int.from_bytes(data[at + 11 : at + 13], "big")
        head, body = data[at + 13 : at + 25], data[at + 25 : at + 13 + size]
        total, place, n = (int.from_bytes(head[i:j], "big") for i, j in ((1, 4), (6, 9), (9, 12)))
        # an encrypted record of a later epoch has no readable header
        if data[at + 3 : at + 5] == b"\0\0" and n == len(body) and n < total:
            yield head[:1] + head[4:6], place, total, body
        at += 13 + size


def quic_fragments(data: bytes) -> Iterator[tuple[bytes, int, int | None, bytes]]:
    """(discriminator, offset, total, piece) of the CRYPTO frames in an Initial packet whose message is not whole in it.

    The discriminator is the version and the connection identifier of the destination.
    """
    opened = quic.open_initial(data)
    if opened is None:
        return
    version, plain = opened
    stream = quic.crypto_stream(plain)
    if len(stream) >= 4 and len(stream) >= 4 + int.from_bytes(stream[1:4], "big"):
        return
    name = version.to_bytes(4, "big") + data[6 : 6 + data[5]]
    for place, piece in quic.crypto_frames(plain):
        yield name, place, 4 + int.from_bytes(piece[1:4], "big") if place == 0 and len(piece) >= 4 else None, piece


def likely_fragment(payload: bytes) -> bool:
    """Whether a datagram can begin with a DTLS handshake or a QUIC packet with a long header."""
    return payload[:2] == b"\x16\xfe" or payload[:1] >= b"\xc0"


def datagram_messages(packets: Iterable[tuple[Any, float, bytes]]) -> Iterator[tuple[Any, list[tuple[list[Any], str, bytes]]]]:
    """Every packet (what, ts, payload) of a flow as (what, messages), once it is known which messages (members, kind, data) it has a part in."""
    parts_of: dict[tuple[str, bytes], tuple[float, list[Any], list[tuple[int, bytes]], int | None]] = {}
    waiting: deque[tuple[Any, float, list[tuple[list[Any], str, bytes]]]] = deque()
    for what, ts, payload in packets:
        while waiting and ts - waiting[0][1] > MAX_SECONDS:
            yield waiting[0][0], waiting.popleft()[2]
        kind, found = ("dtls", list(dtls_fragments(payload))) if payload[0] == 22 else ("quic", list(quic_fragments(payload)))
        if not found:
            yield what, []
            continue
        own = what, ts, []
        waiting.append(own)
        parts_of = {k: v for k, v in parts_of.items() if ts - v[0] <= MAX_SECONDS}
        for name, place, size, piece in sorted(found, key=lambda x: x[1]):
            start, members, parts, total = parts_of.get((kind, name), (ts, [], [], None))
            if not members or members[-1] is not own:
                if len(members) == MAX_SEGMENTS:
                    continue
                members.append(own)
            parts.append((place, piece))
            total = total if size is None else size
            parts_of[kind, name] = start, members, parts, total
            if total is None or total > MAX_BYTES:
                continue
            data, _ = join_segments(parts, 0, total)
            if len(data) == total:
                if kind == "dtls":
                    head = name[:1] + total.to_bytes(3, "big") + name[1:] + bytes(3) + total.to_bytes(3, "big")
                    data = b"\x16\xfe\xfd" + bytes(8) + (total + 12).to_bytes(2, "big") + head + data
                else:
                    data = name[:4] + data
                for _, _, messages in members:
                    messages.append(([m[0] for m in members], kind, data))
                del parts_of[kind, name]
    for what, _, messages in waiting:
        yield what, messages


def reassemble_datagrams(packets: DataFrame) -> DataFrame:
    """The whole messages that several UDP datagrams of packets (key, pkt_no, ts in seconds, payload, perhaps file) give.

    kind is dtls, with data as one record with one fragment, or quic, with the version's four bytes
    before the CRYPTO data. Messages that stay incomplete give no row. Only datagrams that can be
    fragments are shuffled, by flow.
    """
    if "file" not in packets.columns:
        packets = packets.withColumn("file", F.lit(None).cast("string"))
    likely = packets.filter("protocol = 17").filter(F.hex(F.substring("payload", 1, 2)).rlike("^(16FE|[C-F])"))
    schema = arrow_schema(MESSAGES)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Any, ...]]:
        for key, group in groupby(rows_of(batches), key=lambda r: r[:5]):
            for what, messages in datagram_messages(((file, pkt), ts, data) for *_, file, pkt, ts, data in group):
                for members, kind, data in messages:
                    if members[0] == what:
                        yield (*key, *what, kind, data, len(members), [{"file": f, "pkt_no": n} for f, n in members])

    return by_flow(likely, "file", "pkt_no", "ts", "payload").mapInArrow(lambda batches: batches_of(found(batches), schema), MESSAGES)
