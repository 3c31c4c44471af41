"""op1, op2 and op5 against their libraries, and the shard files."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from flowquarry.llm import spec_bpe, sstable, token_count

ODD = [
    "", "   ", " a", "<|endoftext|> Hello", "ΑΣ ΟΔΟΣ İstanbul Ⱥx ﬁ é ñ", "日本語テキスト 한국어 😀😀 naïve", "a b\u001cc\u0085d", "don't we'll I'M they'Re", "x" * 300,
    "\n\n  \t a\r\n b   c  ", " ▁a▁▁b  ", "\u0000 zero", "①②³¼ १२३", "'s's 'twas", "<|startoftext|>x<|endoftext|><|endoftext|>",
]


def made(n, seed=1):
    rnd = random.Random(seed)
    parts = ["the", "ing", " ", "  ", "\n", "é", "ß", "Σ", "!!", "##", "'s", "7", "½", "😀", "<|endoftext|>", "a", "Q", "z", "中", "́", "­", "▁"]
    return ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 60))) for _ in range(n)]


def test_speculative_bpe_is_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    library, own = Tokenizer.from_file(path), spec_bpe.SpeculativeBpe(path)
    texts = ODD + made(150)
    for text, ids in zip(texts, own.encode_all(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == want, text
        assert own.decode(ids) == library.decode(want, skip_special_tokens=False)
    assert own.exact_words > 0 and len(own.good) > 0 and len(own.bad) > 0  # both ways are taken


def test_byte_level_is_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), sstable.ByteBpe(path)
    for text in ODD + made(150):
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize(("chunk", "overlap"), [(200, 24), (64, 40), (1000, 1)])
def test_chunks_give_the_whole_texts_tokens(chunk, overlap):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), token_count.PieceCounter(path, chunk, overlap)
    rnd = random.Random(2)
    long = ["".join(rnd.choice(["the", "ing", " ", "x", "é", "中", "😀", "zzzz", "the the "]) for _ in range(rnd.randint(100, 900))) for _ in range(40)]
    for text in [*ODD, *long, "a" * 2000, "中" * 900 + "文" * 300, " " * 3000, "ab" * 700]:
        want = library.encode(text)
        assert own.count_all([text])[0] == len(want)
        assert own.encode_long(text).tolist() == want if len(text) > chunk else True


def test_count_documents(docs, rows, empty):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = sorted(map(repr, map(tuple, token_count.count_tokens(docs, path, limit=50).collect())))
    want = [(i, len((t or "").encode()), len(library.encode(t or "")), len(library.encode(t or "")) > 50) for i, t, *_ in rows]
    assert got == sorted(map(repr, want))
    assert token_count.count_tokens(empty, path).count() == 0


def test_encode_documents(docs, rows, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = sorted(repr((r.doc_id, r.ids, r.decoded)) for r in spec_bpe.encode_documents(docs, path).collect())
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append(repr((i, ids, library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want)
    assert spec_bpe.encode_documents(empty, path).count() == 0


def test_shards(spark, docs, rows, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    manifest = sstable.write_shards(docs, path)
    got = sstable.read_shards(manifest).collect()
    want = sorted(((i is not None, i or 0), library.encode(t or "", add_special_tokens=False).ids + [0]) for i, t, *_ in rows)
    assert [k for k, _ in want] == sorted((r.doc_id is not None, r.doc_id or 0) for r in got)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    assert at == sum(len(ids) for _, ids in want)
    order = [(r.doc_id is not None, r.doc_id or 0) for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)
    by_id = {r.doc_id: bytes(r.ids) for r in got}
    for i, t, *_ in rows[:20]:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        assert zlib.crc32(by_id[i]) == zlib.crc32(ids.tobytes())
        assert any(ids.tolist() == x.tolist() for x in sstable.lookup(spark, manifest, i))
    assert len(sstable.lookup(spark, manifest, 3)) == 2 and len(sstable.lookup(spark, manifest, None)) == 2
    assert sstable.lookup(spark, manifest, 10**6) == [] and sstable.lookup(spark, manifest, -5) == []
    assert sstable.read_shards(sstable.write_shards(empty, path)).count() == 0


def test_one_shard_by_hand(tmp_path):
    keys = sorted(sstable.key_of(f"doc/{i // 7}/{i}") for i in range(3000))
    with open(tmp_path / "x.sst", "wb") as out:
        w = sstable.ShardWriter(out)
        for n, key in enumerate(keys):
            w.add(key, np.arange(n % 50, dtype="<u4") + (70_000 if n % 3 else 0))
        w.close()
    reader = sstable.ShardReader(f"file://{tmp_path}/x.sst")
    assert len(reader.index) > 3 and [k for k, _ in reader] == keys
    for n in range(0, 3000, 97):
        assert reader.get(keys[n])[0].tolist() == [x + (70_000 if n % 3 else 0) for x in range(n % 50)]
    assert sum(reader.may_have(sstable.key_of(f"none/{i}")) for i in range(2000)) < 60
    assert reader.get(sstable.key_of("doc/9/none")) == []


def test_unbroken_words():
    """Long words take the library's result, in a time that does not grow with their square."""
    import random
    import time

    path = public_tokenizers.path("word_bpe_49k.json")
    bpe, library = spec_bpe.SpeculativeBpe(path), Tokenizer.from_file(path)
    rnd = random.Random(4)
    for text in ("a" * 3000, "".join(rnd.choices("abcdefghij", k=3000)), "ab" * 1500 + "é" * 50, "".join(rnd.choices("theranio", k=41))):
        assert bpe.encode(text) == library.encode(text, add_special_tokens=False).ids
    began = time.time()
    long = "".join(rnd.choices("theraniosl", k=100_000))
    ids = bpe.encode(long)
    assert time.time() - began < 2 and bpe.decode(ids).replace("</w>", "").replace(" ", "") == long


def test_other_files_are_left_to_the_library(tmp_path):
    import json

    spec = json.loads(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).to_str())
    spec["normalizer"] = None
    (tmp_path / "other.json").write_text(json.dumps(spec))
    bpe, library = spec_bpe.SpeculativeBpe(str(tmp_path / "other.json")), Tokenizer.from_file(str(tmp_path / "other.json"))
    for text in ("plain words", "UPPER Case", "ünïcode 字", ""):
        ids = library.encode(text, add_special_tokens=False).ids
        assert bpe.encode(text) == ids == bpe.encode_all([text])[0] and bpe.decode(ids) == library.decode(ids, skip_special_tokens=False)
