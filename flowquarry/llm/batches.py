"""Texts in compressed batches, and what travels in one row for each batch and slice of a hash range."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowquarry.llm.shingles import text_bytes
from flowquarry.llm.spec_bpe import pieces

_U = np.uint64
#: Bytes of text for each slice of a hash range.
SLICE = 1 << 22


def text_batches(docs: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rows of up to 2000 texts, their bytes in one compressed blob, with a number of their own.

    columns: names of other columns of docs, which come as arrays, to their types.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        pack = zstandard.ZstdCompressor(level=1)
        for batch in pieces(batches, 1 << 22, 2000):
            data, offsets = text_bytes(batch.column("text"))
            whole = pa.array([0, len(batch)], pa.int32())
            lists = [pa.ListArray.from_arrays(whole, batch.column(c)) for c in columns]
            sizes = pa.ListArray.from_arrays(whole, pa.array(np.diff(offsets)))
            yield pa.RecordBatch.from_arrays([pa.array([number]), *lists, sizes, pa.array([pack.compress(data)], pa.binary())], ["bid", *columns, "sizes", "blob"])
            number += 1

    kinds = "".join(f"{c} array<{kind}>, " for c, kind in columns.items())
    return docs.select(*columns, "text").mapInArrow(run, f"bid long, {kinds}sizes array<long>, blob binary")


def unpacked(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts of row k, and where each starts and ends."""
    sizes = batch.column("sizes")[k].values.to_numpy(zero_copy_only=False)
    raw = zstandard.ZstdDecompressor().decompress(batch.column("blob")[k].as_py(), max_output_size=int(sizes.sum()) + 1)
    return np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def slices_for(batches: DataFrame, least: int) -> int:
    """One slice for each SLICE bytes of text, and not fewer than least."""
    total = batches.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b))).first()[0] or 0
    return max(least, total // SLICE)


def slice_of(key: np.ndarray, s: int) -> np.ndarray:
    """The slice, 0 to s - 1, that the upper half of a key names."""
    return ((key >> _U(32)) * _U(s) >> _U(32)).astype(np.int64)


def first_of_runs(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.empty(0, np.int64)


def slice_edges(key: np.ndarray, s: int) -> tuple[list[int], list[int]]:
    """The slices of keys in order, and where each begins; the last edge is the end."""
    own = slice_of(key, s)
    first = first_of_runs(own)
    return own[first].tolist(), [*first.tolist(), len(own)]


def by_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows come sorted by slice: the rows of one slice at a time."""
    held, now = [], None
    for batch in batches:
        at = batch.schema.get_field_index("slice")
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[at] != now:
                if held:
                    yield now, held
                held, now = [], row[at]
            held.append(row)
    if held:
        yield now, held


def dealt_by_slice(rows: DataFrame, n: int) -> DataFrame:
    return rows.repartition(n, "slice").sortWithinPartitions("slice")
