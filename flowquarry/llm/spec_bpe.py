"""BPE encoding and decoding by speculation.

Greedy longest match proposes a word's tokens. A proposal is the word's encoding if every adjacent
pair of tokens is compatible, that is, if encoding the pair's joint string gives the pair back: then
no merge can cross any of its borders. The pairs of all new words are tested together, as numbers,
against the sorted arrays of pairs already known to pass or fail; pairs not yet known are decided
by merging their two tokens exactly. Only words with a failing pair are merged exactly as a whole.

Words, tables and known pairs stay in the Python worker; nothing is shuffled or collected.

Defined results: a null text counts as empty and has no tokens; special strings in a text become
their special tokens, as the library has it by default; rows are encoded alone, so repeated rows
are encoded alike; other columns than those asked for are ignored. An unbroken word of n letters
takes n log n steps.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from flowquarry.llm.pretokens import UNUSUAL, WORD_LEVEL, Kept, mapped

#: Most symbols of a word that is merged by looking through all its pairs.
SHORT = 40
#: What this module knows of a file, but for its vocabulary and merges; other files are left to the library.
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
PLAIN_TOKEN = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}


def is_known(spec: dict) -> bool:
    """Whether words, merges and special strings of a file are what this module takes them for."""
    return (
        spec["normalizer"] == NORMALIZER
        and spec["pre_tokenizer"] == PRE_TOKENIZER
        and spec["decoder"] is None
        and all(spec["model"].get(k) == v for k, v in MODEL.items())
        and all(t[k] == v for t in spec["added_tokens"] for k, v in PLAIN_TOKEN.items())
    )


class SpeculativeBpe:
    """Encodes and decodes with a word-level BPE file of the tokenizers library.

    A file with another normaliser, splitter, decoder or kind of special strings than this module
    knows is encoded and decoded by the library itself.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        spec = json.loads(self.library.to_str())
        model = spec["model"]
        self.known = is_known(spec)
        if not self.known:
            return
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.ranks = {tuple(m): r for r, m in enumerate(model["merges"])}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.special_re = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.tokens = [""] * (max([*self.vocab.values(), *special.values()]) + 1)
        for token, i in [*self.vocab.items(), *special.items()]:
            self.tokens[i] = token
        self.longest = max(map(len, self.vocab))
        self.reach: dict[str, int] = {}  # the longest token that begins with two letters
        for token in self.vocab:
            self.reach[token[:2]] = max(len(token), self.reach.get(token[:2], 0))
        self.width = len(self.tokens)
        self.good = np.empty(0, np.int64)
        self.bad = np.empty(0, np.int64)
        self.exact_words = 0
        self.kept = Kept(lambda words: zip(words, self.encode_words([mapped(w) for w in words]), strict=True))
        self.kept_mapped = Kept(lambda words: zip(words, self.encode_words(words), strict=True), 50_000)

    def symbols(self, word: str) -> list[str]:
        return [*word[:-1], word[-1] + self.suffix]

    def merge(self, symbols: list[str]) -> list[str]:
        """Exact merging: the lowest rank first, leftmost among equals."""
        if len(symbols) > SHORT:
            return self._merge_long(symbols)
        out, ranks = list(symbols), self.ranks
        while len(out) > 1:
            found = [ranks.get(pair, 1 << 60) for pair in zip(out, out[1:])]
            least = min(found)
            if least == 1 << 60:
                break
            at = found.index(least)
            out[at : at + 2] = [out[at] + out[at + 1]]
        return out

    def _merge_long(self, symbols: list[str]) -> list[str]:
        """The same with a heap of pairs over a linked list: n log n steps for n symbols."""
        out, ranks, n = list(symbols), self.ranks, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, pair in enumerate(zip(out, out[1:])) if (r := ranks.get(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if j >= n or ranks.get((out[i], out[j])) != r:
                continue  # one of the two has been merged since
            out[i] += out[j]
            out[j] = ""  # no pair has an empty symbol
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((out[i], out[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := ranks.get((out[h], out[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return [s for s in out if s]

    def propose(self, word: str) -> list[int]:
        """Greedy longest match; the word's last token carries the end mark."""
        vocab, n, i, out = self.vocab, len(word), 0, []
        marked = word + self.suffix
        while i < n:
            if len(marked) - i <= self.longest and (token := vocab.get(marked[i:])) is not None:
                out.append(token)
                break
            for j in range(min(n - 1, i + self.reach.get(word[i : i + 2], 1)), i, -1):
                if (token := vocab.get(word[i:j])) is not None:
                    out.append(token)
                    i = j
                    break
            else:
                raise ValueError(f"no token for {word[i]!r}")
        return out

    def _parts(self, token: int) -> list[str]:
        text = self.tokens[token]
        if self.suffix and text.endswith(self.suffix) and len(text) > len(self.suffix):
            return self.symbols(text[: -len(self.suffix)])
        return list(text)

    def _decide(self, codes: np.ndarray) -> None:
        """Decides unknown pairs by exact merging and remembers them."""
        passed = []
        for code in codes.tolist():
            a, b = divmod(code, self.width)
            passed.append(self.merge(self._parts(a) + self._parts(b)) == [self.tokens[a], self.tokens[b]])
        passed = np.array(passed, bool)
        if len(self.good) + len(self.bad) > 4_000_000:
            self.good = self.bad = np.empty(0, np.int64)
        self.good = np.union1d(self.good, codes[passed])
        self.bad = np.union1d(self.bad, codes[~passed])

    @staticmethod
    def _among(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
        at = np.searchsorted(known, codes)
        return (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == codes) if len(known) else np.zeros(len(codes), bool)

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of words in the visible alphabet."""
        proposals = [self.propose(w) for w in words]
        sizes = np.fromiter(map(len, proposals), np.int64, len(words))
        flat = np.fromiter((t for p in proposals for t in p), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        inner = owner[1:] == owner[:-1]
        codes = (flat[:-1] * self.width + flat[1:])[inner]
        distinct, back = np.unique(codes, return_inverse=True)
        unknown = distinct[~(self._among(distinct, self.good) | self._among(distinct, self.bad))]
        if len(unknown):
            self._decide(unknown)
        fails = self._among(distinct, self.bad)[back] if len(distinct) else np.empty(0, bool)
        failing = np.unique(owner[1:][inner][fails])
        alone = [k for k, p in enumerate(proposals) if len(p) == 1 and not self._reachable(p[0])]
        for k in {*failing.tolist(), *alone}:
            proposals[k] = [self.vocab[s] for s in self.merge(self.symbols(words[k]))]
            self.exact_words += 1
        return [tuple(p) for p in proposals]

    @lru_cache(maxsize=100_000)  # noqa: B019  the object lives as long as its worker
    def _reachable(self, token: int) -> bool:
        return self.merge(self._parts(token)) == [self.tokens[token]]

    def _plain(self, text: str) -> list[int]:
        lower = text.lower()
        if UNUSUAL.search(lower):
            words = [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]
            kept = self.kept_mapped
        else:
            words, kept = WORD_LEVEL.findall(lower), self.kept
        try:
            found = list(map(kept.__getitem__, words))
        except KeyError:
            kept.learn(words)
            found = list(map(kept.__getitem__, words))
        return list(chain.from_iterable(found))

    def encode(self, text: str) -> list[int]:
        if not self.known:
            return self.library.encode(text, add_special_tokens=False).ids
        if self.special_re is None or not self.special_re.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.special_re.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append(self.special[m.group()])
            at = m.end()
        return out + self._plain(text[at:])

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text. Words new to this worker are proposed and verified together."""
        if not self.known:
            return [e.ids for e in self.library.encode_batch(texts, add_special_tokens=False)]
        split: list[list[str] | None] = []
        for text in texts:
            lower = text.lower()
            plain = not UNUSUAL.search(lower) and not (self.special_re and self.special_re.search(text))
            split.append(WORD_LEVEL.findall(lower) if plain else None)
        self.kept.learn({w for words in split if words for w in words})
        find = self.kept.__getitem__
        return [
            self.encode(text) if words is None else list(chain.from_iterable(map(find, words)))
            for text, words in zip(texts, split, strict=True)
        ]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by spaces: the file has no decoder of its own."""
        if not self.known:
            return self.library.decode(ids, skip_special_tokens=False)
        return " ".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def shared(path: str) -> SpeculativeBpe:
    return SpeculativeBpe(path)


def pieces(batches: Iterator[pa.RecordBatch], chars: int = 1 << 21, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches of few texts, to bound what a worker holds."""
    for batch in batches:
        at = 0
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        total = 0
        for k in range(len(batch)):
            total += int(sizes[k])
            if total >= chars or k + 1 - at >= rows:
                yield batch.slice(at, k + 1 - at)
                at, total = k + 1, 0
        if at < len(batch):
            yield batch.slice(at)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids and the text decoded from them, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared(path)
        for batch in pieces(batches):
            ids = bpe.encode_all([t or "" for t in batch.column("text").to_pylist()])
            sizes = np.fromiter(map(len, ids), np.int32, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(offsets, flat), pa.array(map(bpe.decode, ids), pa.string())],
                [id_col, "ids", "decoded"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(docs[id_col], docs[text_col].alias("text")) if text_col != id_col else docs.select(id_col)
    return slim.mapInArrow(run, f"`{id_col}` {kind}, ids array<int>, decoded string")
