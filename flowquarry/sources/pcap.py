"""PCAP and PCAP-NG files (S1-S4, K2, B7): a data source, and functions over files' bytes."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, pkt_no long, ts_sec long, ts_nanos int, linktype int, orig_len int, data binary"
#: Magic numbers of the file formats.
MICRO, NANO, NG_BLOCK, NG_ORDER = 0xA1B2C3D4, 0xA1B23C4D, 0x0A0D0D0A, 0x1A2B3C4D
BATCH = 2048

Packet = tuple[int, int, int, int, bytes]


def packets(file: BinaryIO) -> Iterator[Packet]:
    """(seconds, nanoseconds, linktype, original length, bytes) of each packet; stops where the file is cut or broken."""
    magic = file.read(4)
    if len(magic) < 4:
        return
    if magic == b"\x0a\x0d\x0d\x0a":
        yield from _ng(file)
        return
    for order in "<>":
        number = struct.unpack(f"{order}I", magic)[0]
        if number in (MICRO, NANO):
            yield from _classic(file, order, 1000 if number == MICRO else 1)
            return


def _classic(file: BinaryIO, order: str, scale: int) -> Iterator[Packet]:
    head = file.read(20)
    if len(head) < 20:
        return
    linktype = struct.unpack(f"{order}HHiIII", head)[5] & 0xFFFF
    while len(h := file.read(16)) == 16:
        sec, frac, kept, size = struct.unpack(f"{order}IIII", h)
        data = file.read(kept)
        if len(data) < kept:
            return
        yield sec, frac * scale, linktype, size, data


def _options(data: bytes, order: str) -> dict[int, bytes]:
    out, at = {}, 0
    while at + 4 <= len(data):
        code, n = struct.unpack_from(f"{order}HH", data, at)
        if code == 0:
            break
        out[code] = data[at + 4 : at + 4 + n]
        at += 4 + n + (-n % 4)
    return out


def _ng(file: BinaryIO) -> Iterator[Packet]:
    order, interfaces, kind = "<", [], NG_BLOCK
    head = struct.pack("<I", NG_BLOCK)
    while len(head) == 4:
        size_raw = file.read(4)
        if len(size_raw) < 4:
            return
        kind = struct.unpack(f"{order}I", head)[0]
        body = b""
        if head == b"\x0a\x0d\x0d\x0a":  # a section: its byte order holds from here
            mark = file.read(4)
            order = "<" if mark == struct.pack("<I", NG_ORDER) else ">"
            size = struct.unpack(f"{order}I", size_raw)[0]
            file.read(max(0, size - 12))
            interfaces = []
        else:
            size = struct.unpack(f"{order}I", size_raw)[0]
            if size < 12:
                return
            body = file.read(size - 8)[:-4]
        if kind == 1 and len(body) >= 8:
            own = _options(body[8:], order)
            resolution = own.get(9, b"\x06")[0]
            per_second = 2 ** (resolution & 127) if resolution & 128 else 10**resolution
            offset = int.from_bytes(own.get(14, b"\0" * 8), "little" if order == "<" else "big", signed=True)
            interfaces.append((struct.unpack_from(f"{order}H", body)[0], per_second, offset, struct.unpack_from(f"{order}I", body, 4)[0]))
        elif kind == 6 and len(body) >= 20:
            i, high, low, kept, length = struct.unpack_from(f"{order}IIIII", body)
            if i < len(interfaces):
                linktype, per_second, offset, _ = interfaces[i]
                ticks = high << 32 | low
                yield ticks // per_second + offset, ticks % per_second * 1_000_000_000 // per_second, linktype, length, body[20 : 20 + kept]
        elif kind == 3 and len(body) >= 4 and interfaces:
            length = struct.unpack_from(f"{order}I", body)[0]
            kept = min(length, interfaces[0][3] or length)
            yield 0, 0, interfaces[0][0], length, body[4 : 4 + kept]
        head = file.read(4)


def write_packets(file: BinaryIO, rows: Iterator[tuple[int, int, int, bytes]], linktype: int = 1) -> int:
    """Writes (seconds, nanoseconds, original length, bytes) as a PCAP file; returns how many."""
    file.write(struct.pack("<IHHiIII", NANO, 2, 4, 0, 0, 1 << 18, linktype))
    n = 0
    for sec, nanos, size, data in rows:
        file.write(struct.pack("<IIII", sec, nanos, len(data), size) + data)
        n += 1
    return n


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    """One partition for each file, streamed; files are the unit of parallel reading."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        fs, inner = pyarrow.fs.FileSystem.from_uri(self.path) if "://" in self.path else (pyarrow.fs.LocalFileSystem(), self.path)
        info = fs.get_file_info(inner)
        if info.type == pyarrow.fs.FileType.File:
            return [_File(self.path)]
        found = fs.get_file_info(pyarrow.fs.FileSelector(inner, recursive=True))
        prefix = self.path[: len(self.path) - len(inner)] if "://" in self.path else ""
        return [_File(prefix + f.path) for f in sorted(found, key=lambda f: f.path) if f.type == pyarrow.fs.FileType.File]

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        path = partition.path
        fs, inner = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], names)

        with fs.open_input_stream(inner, buffer_size=1 << 20) as file:
            rows = []
            for n, (sec, nanos, linktype, size, data) in enumerate(packets(file)):
                rows.append((path, n, sec, nanos, linktype, size, data))
                if len(rows) == BATCH:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)


class PcapSource(DataSource):
    """spark.read.format("pcap").load(path of a file or a folder)."""

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def read_pcap(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(PcapSource)
    return spark.read.format("pcap").load(path)


def write_pcap(packets_: DataFrame, folder: str, linktype: int = 1) -> DataFrame:
    """K2: one file for each partition of (ts_sec, ts_nanos, orig_len, data); returns (path, packets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        fs, inner = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(inner, recursive=True)
        path = f"{inner}/{uuid.uuid4().hex}.pcap"
        with fs.open_output_stream(path) as out:
            n = write_packets(out, (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("ts_sec", "ts_nanos", "orig_len", "data")), strict=True)), linktype)
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["path", "packets"])

    return packets_.select("ts_sec", "ts_nanos", "orig_len", "data").mapInArrow(run, "path string, packets long")
