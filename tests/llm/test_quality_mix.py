"""op7 and op8 against plain Python."""

import math
import random
import re

import pytest

from flowquarry.llm import quality_llr, raking


def base(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = {}
    for i in range(len(ws) - 7):
        windows.setdefault(tuple(ws[i : i + 8]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(ws) < 20 or 100 * len(covered) > 30 * len(ws)
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed)


def test_base_features(spark, docs, rows, empty):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 1), (None, 1, 0), (9, 1, None)], "doc_id long, quality int, toxic int")
    model = quality_llr.fit(docs, labels, quality_llr.QualityConfig(buckets=64))
    got = quality_llr.score(docs, model).collect()
    assert sorted(repr((r.doc_id, *base_of(r))) for r in got) == sorted(repr((i, *base(t))) for i, t, *_ in rows)
    assert all(r.kept == (not r.base_failed and r.score >= model.threshold) for r in got)
    assert quality_llr.score(empty, model).count() == 0
    kept = quality_llr.keep_good(docs, labels, quality_llr.QualityConfig(threshold=-5.0))
    assert kept.columns == docs.columns and 0 < kept.count() < len(rows)
    none = quality_llr.fit(empty, labels.filter("false"))
    assert set(none.weights) == {0.0}


def base_of(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)


def test_score_is_the_mean_log_ratio(spark):
    """The same counts by hand, with Spark's own hash of each n-gram."""
    texts = [(1, "good clean text " * 2), (2, "bad $$ stuff here"), (3, "good text"), (4, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    b = 32
    model = quality_llr.fit(docs, labels, quality_llr.QualityConfig(buckets=b))
    grams = {}
    for i, t in texts:
        ws = t.split()
        h = [spark.sql(f"select xxhash64('{w}')").first()[0] for w in ws]
        grams[i] = [x % b for x in h] + [spark.sql(f"select xxhash64({x}L, {y}L)").first()[0] % b for x, y in zip(h, h[1:])]
    raw, good = [0] * b, [0] * b
    for i, g in grams.items():
        for x in g:
            raw[x] += 1
            good[x] += i == 1
    w = [math.log((good[x] + 1) / (sum(good) + b)) - math.log((raw[x] + 1) / (sum(raw) + b)) for x in range(b)]
    assert all(abs(a - c) < 1e-9 for a, c in zip(model.weights, w))
    got = {r.doc_id: r.score for r in quality_llr.score(docs, model).collect()}
    for i, g in grams.items():
        assert abs(got[i] - (sum(w[x] for x in g) / len(g) if g else 0.0)) < 1e-6


def test_raking_meets_the_margins(spark):
    rows = [("a", "en", 0, 900), ("a", "de", 0, 50), ("b", "en", 1, 40), ("b", "de", 1, 300), (None, "en", 1, 10), ("c", "xx", 0, 0)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic int, tokens long")
    margins = [raking.Margin("source", 0.5), raking.Margin("lang", 0.0)]
    for one_task in (100, 0):
        out = raking.rake(cells, margins, sweeps=30, one_task_cells=one_task).collect()
        kept = {}
        for r in out:
            kept[r.lang] = kept.get(r.lang, 0) + r.rate * r.tokens
        assert abs(kept["en"] - kept["de"]) < 1e-3 * kept["en"]
        assert max(r.rate for r in out) == 1.0 and all(0 <= r.rate <= 1 for r in out)
        by = {}
        for r in out:
            by[r.source] = by.get(r.source, 0) + r.rate * r.tokens
        assert abs(by["a"] / by["b"] - math.sqrt(950 / 340)) < 0.01


def test_mix(docs, rows, empty):
    got = raking.mix(docs)
    assert got.count() == len(rows) and set(docs.columns) < set(got.columns)
    for r in got.collect():
        assert r.mixing.n_tokens == len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) and 0 <= r.mixing.rate <= 1
    sample = raking.sample_mix(docs)
    assert sample.columns == docs.columns and 0 < sample.count() < len(rows)
    assert sorted(map(repr, sample.collect())) == sorted(map(repr, raking.sample_mix(docs).collect()))
    assert raking.mix(empty).count() == 0


def test_rejection_does_not_fall_with_size(spark, monkeypatch):
    """Good and bad documents with words of their own: buckets grow with the n-grams, in every way to look weights up."""
    config = quality_llr.QualityConfig(buckets=64)

    def made(n):
        rnd = random.Random(n)
        return [(i, " ".join(f"{'bad' if i % 4 == 0 else 'good'}{int(2 * n * rnd.random() ** 3)}" for _ in range(60))) for i in range(n)]

    def rejected(n):
        docs = spark.createDataFrame(made(n), "doc_id long, text string").repartition(3)
        labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(n)], "doc_id long, quality int, toxic int")
        model = quality_llr.fit(docs, labels, config)
        scored = {r.doc_id: (round(r.score, 6), r.kept) for r in quality_llr.score(docs, model, config).collect()}
        assert len(scored) == n and {r.doc_id for r in quality_llr.keep_good(docs, labels, config).collect()} == {i for i, x in scored.items() if x[1]}
        bad = [i for i in scored if i % 4 == 0]
        return sum(not scored[i][1] for i in bad) / len(bad), scored

    small, large = rejected(20), rejected(600)
    assert large[0] >= small[0] == 1.0 and sum(x[1] for x in large[1].values()) == 450
    for variable in (1 << 22, 0):
        for broadcast in (1 << 24, 0):
            monkeypatch.setattr(quality_llr, "LITERAL", 0)
            monkeypatch.setattr(quality_llr, "VARIABLE", variable)
            monkeypatch.setattr(quality_llr, "BROADCAST", broadcast)
            assert rejected(600) == large


def test_given_targets_and_tolerance(spark):
    rows = [("a", "en", 600), ("a", "de", 300), ("b", "en", 100), ("b", "de", 200), (None, "en", 50)]
    cells = spark.createDataFrame(rows, "source string, lang string, tokens long")
    margins = [raking.Margin("source", weights={"a": 1.0, "b": 3.0, None: 0.0}), raking.Margin("lang", weights={"en": 1, "de": 1})]
    rated = raking.rake(cells, margins, sweeps=2, tolerance=1e-9)
    assert {r.source for r in rated.collect() if r.rate == 0} == {None}
    errors = {(r.margin, r.value): r for r in raking.margin_errors(rated, margins).collect()}
    assert errors["source", "b"].target == 0.75 and all(abs(r.error) < 1e-6 for r in errors.values())
    with pytest.raises(ValueError, match="no tokens"):
        raking.rake(cells, [raking.Margin("source", weights={"a": 1, "z": 1})])
    apart = spark.createDataFrame([("a", "en", 5), ("b", "de", 5)], "source string, lang string, tokens long")
    with pytest.raises(ValueError, match="sweeps"):
        raking.rake(apart, [raking.Margin("source", weights={"a": 1, "b": 3}), raking.Margin("lang", weights={"en": 1, "de": 1})], sweeps=5, tolerance=1e-6, most=10)


def test_share_keeps_scarce_cells_whole(spark):
    """One document of a rare source sets the scale of all others, unless a share is asked for."""
    cells = spark.createDataFrame([("a", 500_000), ("b", 400_000), ("c", 50)], "source string, tokens long")
    margin = [raking.Margin("source", 0.5)]
    kept = lambda rated: {r.source: r.rate * r.tokens for r in rated.collect()}
    assert sum(kept(raking.rake(cells, margin)).values()) < 20_000
    for share in (0.001, 0.3, 0.9, 1.0):
        got = kept(raking.rake(cells, margin, share=share))
        assert abs(sum(got.values()) - share * 900_050) < 2 and got["c"] == 50 * min(1.0, got["c"] / 50)
    assert got == {"a": 500_000, "b": 400_000, "c": 50}


def test_mix_with_clashing_and_counted_columns(spark):
    rows = [(i, f"text {i}", "en", f"s{i % 2}", 10 * (i % 3), "m", None if i == 4 else i) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic int, mixing string, tokens long")
    mixed = raking.mix(df, tokens_col="tokens").collect()
    assert all(r.mixing.n_tokens == (r.tokens or 0) and r.mixing.topic == r.topic for r in mixed) and len(mixed) == 40
    sample = raking.sample_mix(df)
    assert sample.columns == df.columns and {r.mixing for r in sample.collect()} == {"m"}


def test_base_features_without_a_walk_over_every_character(spark):
    """Blanks, symbols and lines of odd texts; translate, which looks up each character, is in no expression."""
    texts = [None, "", " \n\x0b", "a\x1cb c\u3000d\x85e", "\U0001f600 b\n\U0001f600 b\n", "a\r\nb\r\na\r\n", "\x0b\x0c|\n\x0b\n \n|\n|", "#a*$%&|<>\\d+"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = quality_llr.score(df, quality_llr.LlrModel((0.0,), -0.15))
    assert "translate(" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out.collect()}
    assert got == {i: base(x) for i, x in enumerate(texts)}
