"""Token counts with overlap resynchronisation.

Texts up to `chunk` characters are encoded whole. Longer ones are encoded in overlapping chunks
with the offsets of their tokens. Two neighbours are spliced at a border that both have in their
overlap and that is proven stable: no piece of the vocabulary matches the text across it, so no
merge can cross it whatever surrounds it. Where the overlap has no such border it is doubled and
encoded again, in the end up to the whole text, so the count is always that of the whole text.

Memory follows the chunk, not the text. No shuffle.

Defined results: a null text counts as empty, with 0 tokens; rows are counted alone, so repeated
rows count alike; other columns than those asked for are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowquarry.llm.spec_bpe import pieces

SPACE = "▁"
LIMIT = 4096


class PieceCounter:
    """Encodes with a sentencepiece BPE model without normalisation rules."""

    def __init__(self, path: str, chunk: int = 1 << 15, overlap: int = 256):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = chunk, overlap
        size = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(size)]
        self.names = {n for i, n in enumerate(names) if not self.model.is_byte(i) and not self.model.is_control(i)}
        self.longest = max(map(len, self.names))
        # a character outside the vocabulary is a run of byte pieces; its first byte carries its length
        self.lengths = np.array(
            [int(not 0x80 <= int(n[3:-1], 16) < 0xC0) if self.model.is_byte(i) else len(n) for i, n in enumerate(names)], np.int64
        )

    def stable(self, text: str, at: int) -> bool:
        """Whether no piece matches the text, with spaces as the model writes them, across at."""
        low, high = max(0, at - self.longest + 1), min(len(text), at + self.longest - 1)
        near = text[low:high].replace(" ", SPACE)
        p = at - low
        return not any(near[i:j] in self.names for i in range(p) for j in range(p + 1, min(len(near), i + self.longest) + 1))

    def _chunk(self, text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of text[start:end] and where they end. The model puts a space in front, so positions count from start - 1."""
        ids = np.array(self.model.encode(text[start:end]), np.int64)
        return ids, np.cumsum(self.lengths[ids]) + start - 1

    def encode_long(self, text: str) -> np.ndarray:
        """Ids of a text of any length, spliced from chunks."""
        n, start, done, out = len(text), 0, -1, []
        end = min(n, self.chunk + self.overlap)
        ids, ends = self._chunk(text, 0, end)
        while end < n:
            overlap = self.overlap
            while True:
                at = start + self.chunk
                last = min(n, at + self.chunk + overlap)
                ids2, ends2 = self._chunk(text, at, last)
                both = np.intersect1d(ends, ends2)
                both = both[(both > max(at + self.longest, done)) & (both < end)]  # beyond what the chunk's own front space can reach
                cut = next((c for c in both.tolist() if self.stable(text, c)), None)
                if cut is not None or end == n:
                    break
                overlap *= 2
                end = min(n, at + overlap)
                ids, ends = self._chunk(text, start, end)
            if cut is None:
                break
            out.append(ids[(ends > done) & (ends <= cut)])
            ids, ends, start, end, done = ids2, ends2, at, last, cut
        out.append(ids[ends > done])
        return np.concatenate(out)

    def count_all(self, texts: list[str]) -> np.ndarray:
        counts = np.zeros(len(texts), np.int64)
        short = [k for k, t in enumerate(texts) if len(t) <= self.chunk]
        for k, ids in zip(short, self.model.encode([texts[k] for k in short], num_threads=1), strict=True):
            counts[k] = len(ids)
        for k, t in enumerate(texts):
            if len(t) > self.chunk:
                counts[k] = len(self.encode_long(t))
        return counts


@lru_cache(maxsize=2)
def shared(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, n_tokens and over_limit for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = shared(path)
        for batch in pieces(batches):
            counts = counter.count_all([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts)], [id_col, "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = docs[text_col]
    slim = docs.select(docs[id_col], text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    counted = slim.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
