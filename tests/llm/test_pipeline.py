"""The pipeline against a plain Python version of its five stages."""

import hashlib
import math
import re
from pathlib import Path

import public_tokenizers
import xxhash
from tokenizers import Tokenizer

import corpus_pipeline
from flowquarry.llm import quality_llr
from flowquarry.llm.common import shared_dir
from tests.llm.conftest import DOCS, corpus
from tests.llm.test_lines_chat import brute_lines
from tests.llm.test_near import brute_components, sets_of
from tests.llm.test_quality_mix import base

WORD = r"[^\x20\x09-\x0D]+"


def h64(x, seed=42):
    data = x.encode() if isinstance(x, str) else (x & (1 << 64) - 1).to_bytes(8, "little")
    n = xxhash.xxh64_intdigest(data, seed & (1 << 64) - 1)
    return n - (1 << 64) if n >> 63 else n


def grams(text, buckets):
    hs = [h64(w) for w in re.findall(WORD, text or "")]
    return [x % buckets for x in hs] + [h64(b, h64(a)) % buckets for a, b in zip(hs, hs[1:])]


def brute(rows, good):
    config = quality_llr.QualityConfig()
    b = config.buckets
    raw, target = {}, {}
    for i, t, *_ in rows:
        for g in grams(t, b):
            raw[g] = raw.get(g, 0) + 1
            if i in good:
                target[g] = target.get(g, 0) + 1
    shift = math.log(sum(raw.values()) + b) - math.log(sum(target.values()) + b)
    kept = []
    for row in rows:
        own = grams(row[1], b)
        score = sum(math.log((target.get(g, 0) + 1) / (raw[g] + 1)) + shift for g in own) / len(own) if own else 0.0
        if not base(row[1])[-1] and score >= config.threshold:
            kept.append(list(row))
    for row, text in zip(kept, brute_lines(sorted(kept)), strict=True):
        row[1] = text
    comp = brute_components(sets_of(kept, 5), 80)
    kept = [r for r in kept if comp[r[0]][1] == r[0]]

    def key(row):
        ws = re.findall(WORD, row[1] or "")
        longest = max(ws, key=lambda w: (len(w), w.encode())) if ws else ""
        return row[3], row[2], int(hashlib.md5(longest.encode()).hexdigest()[:6], 16) % 8

    tokens = {}
    for row in kept:
        tokens[key(row)] = tokens.get(key(row), 0) + len(re.findall(WORD, row[1] or ""))
    w = {k: float(v) for k, v in tokens.items()}
    shares = []
    for m, power in ((0, 0.7), (1, 0.8), (2, 0.5)):
        s = {}
        for k, v in tokens.items():
            s[k[m]] = s.get(k[m], 0) + v
        s = {v: x**power for v, x in s.items() if x}
        shares.append({v: x / sum(s.values()) for v, x in s.items()})
    for _ in range(10):
        for m in range(3):
            total = {}
            for k, v in w.items():
                total[k[m]] = total.get(k[m], 0.0) + v
            w = {k: v * shares[m][k[m]] / total[k[m]] if total[k[m]] else 0.0 for k, v in w.items()}
    ratio = {k: w[k] / tokens[k] for k in w if tokens[k]}
    rate = {k: round(v / max(ratio.values()), 9) for k, v in ratio.items()}
    sample = [r for r in kept if int(hashlib.md5(str(r[0]).encode()).hexdigest()[:12], 16) / 2**48 < rate.get(key(r), 1.0)]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for row in sample:
        ids = library.encode(row[1] or "", add_special_tokens=False).ids
        out.append((row[0], len(ids), ids, hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return sorted(out)


def test_pipeline(spark, tmp_path):
    rows = sorted({r[0]: r for r in corpus(11, 150) if r[0] is not None}.values(), key=lambda r: r[0])
    extra = [(len(rows) + n, r[1] + " more", r[2], r[3], 0, n, "y") for n, r in enumerate(rows[20:40])]
    extra += [(500 + n, f"{rows[60 + n][1]}\nline one of a passage\nline two of it\nline three of it\n{rows[70 + n][1]}", "en", "s1", 0, n, "y") for n in range(8)]
    rows = rows + extra
    good = {r[0] for r in rows if r[0] % 3}
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in good] + [(i, 0, 0) for i in range(0, 60, 3)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted((r.doc_id, r.n_tokens, r.ids, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    want = brute(rows, good)
    assert [g[0] for g in got] == [w[0] for w in want] and got == want
    assert 10 < len(got) < len(rows)


def test_stages_keep_the_columns(spark, docs, tmp_path):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    assert len(corpus_pipeline.STAGES) == 5


def test_empty_tables_and_odd_rows(spark, tmp_path):
    """No documents, no labels, or documents of nothing but nulls and blanks give results, not errors."""
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    odd = [(1, None, None, None, None, None, None), (2, "", "en", "s", 0, 1, "x"), (3, " \n", "en", "s", 0, 1, "x"), (None, None, None, None, None, None, None)]
    for name, rows in (("empty", []), ("odd", odd)):
        spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        none.write.parquet(f"{tmp_path}/{name}/labels.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert got.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and got.count() == 0, name


def test_one_table_between_stages_remains(spark, tmp_path):
    spark.createDataFrame(corpus(11, 150), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(n, 1, 0) for n in range(150) if n % 3], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    folder = Path(shared_dir(spark).removeprefix("file://")) / "flowquarry"
    before = set(folder.glob("pipeline-*")) if folder.exists() else set()
    got = corpus_pipeline.run(spark, str(tmp_path))
    left = set(folder.glob("pipeline-*")) - before
    assert [p.name.rsplit("-", 1)[0] for p in left] == ["pipeline-mix_sources"] and got.count() > 0
