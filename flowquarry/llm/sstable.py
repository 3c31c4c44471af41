"""Token ids in sorted-string-table shards.

A shard holds documents in the order of their identifiers. Its parts, one after the other:

    blocks   entries of (shared key bytes, own key bytes, value bytes as varints, own key, value);
             every RESTART-th entry has its whole key; behind them the entries' restart offsets and
             their number as uint32; the block is compressed with zstd
    index    for each block its last key, offset, length and number of entries
    bloom    a Bloom filter over the keys: number of hashes, then bits
    footer   56 bytes: offset and length of index and bloom, entries, tokens, version, magic

All numbers are little-endian. A key is one byte, 0 for null or 1, and the identifier: integers as 8
bytes big-endian with the sign flipped, strings as UTF-8; so keys sort as identifiers do, nulls
first. A value is the width of an id in bytes, 2 or 4, and the ids.

Documents are range partitioned and sorted, and each task streams one shard to the shared folder
under a name of its own. The manifest, a Parquet table with one row for each shard, names the files
of the tasks that succeeded; what a lost task has left is in no manifest. Reading adds up the
manifest's token counts, one row for each shard, to where each shard starts.

Defined results: a null text counts as empty; a null identifier is a key, before all others; rows
with equal identifier stand in the order of a hash of their text, and `get` gives all of them; an
empty table gives an empty manifest; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import struct
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from flowquarry.llm.common import cluster_partitions, new_path, written
from flowquarry.llm.pretokens import BYTE_LEVEL, UNUSUAL, Kept, mapped
from flowquarry.llm.spec_bpe import pieces

MAGIC = 0x46515353
VERSION = 2
FOOTER = struct.Struct("<QQQQQQII")
RESTART = 16
BLOCK_BYTES = 1 << 16
BLOOM_BITS, BLOOM_HASHES = 10, 7
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


# --- keys -----------------------------------------------------------------------------------------


def key_of(value: int | str | None) -> bytes:
    if value is None:
        return b"\0"
    if isinstance(value, str):
        return b"\1" + value.encode()
    return b"\1" + struct.pack(">Q", (value + (1 << 63)) & ((1 << 64) - 1))


def value_of(key: bytes, text: bool) -> int | str | None:
    if key == b"\0":
        return None
    return key[1:].decode() if text else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def _bloom_places(key: bytes, bits: int, hashes: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + i * (b | 1)) % bits for i in range(hashes)]


# --- one shard ------------------------------------------------------------------------------------


class ShardWriter:
    """Streams entries, which come in the order of their keys, into a binary file object."""

    def __init__(self, out):
        self.out, self.at = out, 0
        self.index: list[tuple[bytes, int, int, int]] = []
        self.keys: list[bytes] = []
        self.pack = zstandard.ZstdCompressor(level=3)
        self.tokens = 0
        self._new_block()

    def _new_block(self) -> None:
        self.block, self.restarts, self.in_block, self.last = bytearray(), [], 0, b""

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.in_block % RESTART == 0:
            self.restarts.append(len(self.block))
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
        value = bytes([width]) + ids.astype(f"<u{width}").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.in_block += 1
        self.last = key
        self.keys.append(key)
        self.tokens += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self._end_block()

    def _end_block(self) -> None:
        if self.in_block:
            tail = struct.pack(f"<{len(self.restarts) + 1}I", *self.restarts, len(self.restarts))
            data = self.pack.compress(bytes(self.block) + tail)
            self.index.append((self.last, self.at, len(data), self.in_block))
            self._write(data)
            self._new_block()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        self._end_block()
        index_at = self.at
        self._write(b"".join(_varint(len(k)) + k + struct.pack("<QII", at, n, entries) for k, at, n, entries in self.index))
        bloom_at = self.at
        bits = max(64, len(self.keys) * BLOOM_BITS)
        filter_ = np.zeros((bits + 7) // 8, np.uint8)
        for key in self.keys:
            for p in _bloom_places(key, bits, BLOOM_HASHES):
                filter_[p >> 3] |= 1 << (p & 7)
        self._write(struct.pack("<IQ", BLOOM_HASHES, bits) + filter_.tobytes())
        self._write(FOOTER.pack(index_at, bloom_at - index_at, bloom_at, self.at - bloom_at, len(self.keys), self.tokens, VERSION, MAGIC))


class ShardReader:
    """Opens a shard by its footer; reads single keys or everything in order, a block at a time."""

    def __init__(self, path: str):
        fs, inner = pyarrow.fs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(inner)
        size = self.file.size()
        if size < FOOTER.size:
            raise ValueError(f"{path} is no shard")
        at, n, self.bloom_at, self.bloom_n, self.entries, self.tokens, version, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if (version, magic) != (VERSION, MAGIC):
            raise ValueError(f"{path} is no shard")
        self.index, data, p = [], self.file.read_at(n, at), 0
        while p < n:
            length, p = _read_varint(data, p)
            self.index.append((data[p : p + length], *struct.unpack_from("<QII", data, p + length)))
            p += length + 16
        self.last_keys = [x[0] for x in self.index]
        self.bloom = b""  # read when first asked
        self.unpack = zstandard.ZstdDecompressor()

    def close(self) -> None:
        self.file.close()

    def _block(self, k: int) -> tuple[bytes, int, list[int]]:
        """The block's bytes, where its entries end, and its restarts."""
        _, at, n, _ = self.index[k]
        data = self.unpack.decompress(self.file.read_at(n, at))
        count = struct.unpack_from("<I", data, len(data) - 4)[0]
        end = len(data) - 4 * (count + 1)
        return data, end, list(struct.unpack_from(f"<{count}I", data, end))

    @staticmethod
    def _entries(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, np.ndarray]]:
        key = b""
        while at < end:
            shared, at = _read_varint(data, at)
            own, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + own]
            at += own
            yield key, np.frombuffer(data, f"<u{data[at]}", (size - 1) // data[at], at + 1)
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.index)):
            data, end, _ = self._block(k)
            yield from self._entries(data, 0, end)

    def may_have(self, key: bytes) -> bool:
        self.bloom = self.bloom or self.file.read_at(self.bloom_n, self.bloom_at)
        hashes, bits = struct.unpack_from("<IQ", self.bloom)
        return all(self.bloom[12 + (p >> 3)] >> (p & 7) & 1 for p in _bloom_places(key, bits, hashes))

    def get(self, key: bytes) -> list[np.ndarray]:
        """Ids of all entries with this key."""
        out: list[np.ndarray] = []
        if not self.index or not self.may_have(key):
            return out
        for k in range(bisect.bisect_left(self.last_keys, key), len(self.index)):
            data, end, restarts = self._block(k)
            first = bisect.bisect_left(restarts, key, key=lambda at: next(self._entries(data, at, end))[0])
            for found, ids in self._entries(data, restarts[max(0, first - 1)], end):
                if found > key:
                    return out
                if found == key:
                    out.append(ids)
        return out


# --- tokens ---------------------------------------------------------------------------------------


class ByteBpe:
    """The library's byte-level encoding, remembering pieces it has encoded before."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        model = self.library.model
        spec = json.loads(self.library.to_str())
        #: Whether words are split as BYTE_LEVEL does; other files are left to the library.
        self.known = spec["normalizer"] is None and spec["pre_tokenizer"] == PRE_TOKENIZER and spec["model"]["type"] == "BPE"

        def encode_all(words: list[str]):
            for w in words:
                # of visible ASCII only the space has another sign in the alphabet
                sign = w.replace(" ", "Ġ") if w.isascii() and w.isprintable() else mapped(w)
                yield w, array("I", [t.id for t in model.tokenize(sign)]).tobytes()

        self.kept = Kept(encode_all, 600_000)

    def encode(self, text: str) -> np.ndarray:
        if not self.known or UNUSUAL.search(text) or any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        words = BYTE_LEVEL.findall(text)
        try:
            packed = b"".join(map(self.kept.__getitem__, words))
        except KeyError:
            self.kept.learn(words)
            packed = b"".join(map(self.kept.__getitem__, words))
        return np.frombuffer(packed, "<u4")


@lru_cache(maxsize=2)
def shared(path: str) -> ByteBpe:
    return ByteBpe(path)


# --- tables ---------------------------------------------------------------------------------------


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text, appends end_id, writes shards in ascending order of id_col; returns the manifest."""
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token-shards")
    text = F.coalesce(docs[text_col], F.lit("")).alias("text")
    rows = docs.select(docs[id_col].alias("key"), text)
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(cluster_partitions(spark), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = shared(tokenizer), np.array([end_id], "<u4")
        fs, inner = pyarrow.fs.FileSystem.from_uri(f"{folder}/{uuid.uuid4().hex}.sst")
        writer = None
        for batch in pieces(batches):
            if writer is None:
                fs.create_dir(inner.rpartition("/")[0], recursive=True)
                writer = ShardWriter(fs.open_output_stream(inner))
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                writer.add(key_of(key), np.concatenate([bpe.encode(text), end]))
        if writer is not None:
            writer.close()
            writer.out.close()
            row = [f"{folder}/{inner.rpartition('/')[2]}"], [writer.keys[0]], [writer.keys[-1]], [len(writer.keys)], [writer.tokens], [writer.at]
            names = ["path", "first_key", "last_key", "entries", "tokens", "bytes"]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if n.endswith("key") else None) for x, n in zip(row, names, strict=True)], names)

    schema = "path string, first_key binary, last_key binary, entries long, tokens long, bytes long"
    return written(rows.mapInArrow(run, schema), "token-manifest")


def read_shards(manifest: DataFrame, text_keys: bool = False) -> DataFrame:
    """Every document of the shards: doc_id, start (tokens of all documents before it), n_tokens, ids (little-endian uint32)."""
    order = Window.orderBy("first_key", "last_key", "path").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    placed = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(order), F.lit(0).cast("long"))).select("path", "base")
    dealt = placed.repartition(cluster_partitions(manifest.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.string() if text_keys else pa.int64()
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader, rows, size = ShardReader(path), [], 0
                for key, ids in reader:
                    rows.append((value_of(key, text_keys), start, len(ids), ids.astype("<u4").tobytes()))
                    start += len(ids)
                    size += 4 * len(ids)
                    if size > 1 << 23:
                        yield _batch(rows, kind)
                        rows, size = [], 0
                reader.close()
                if rows:
                    yield _batch(rows, kind)

    return dealt.mapInArrow(run, f"doc_id {'string' if text_keys else 'long'}, start long, n_tokens long, ids binary")


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], ["doc_id", "start", "n_tokens", "ids"])


def lookup(spark: SparkSession, manifest: DataFrame, key: int | str | None) -> list[np.ndarray]:
    """Ids of all documents with this identifier, from the shards whose key range has it."""
    k = key_of(key)
    near = manifest.filter((F.col("first_key") <= F.lit(k)) & (F.col("last_key") >= F.lit(k))).orderBy("first_key", "last_key", "path")
    out: list[np.ndarray] = []
    for row in near.select("path").collect():
        reader = ShardReader(row["path"])
        out += reader.get(k)
        reader.close()
    return out
