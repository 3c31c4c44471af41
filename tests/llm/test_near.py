"""op6, op9 and op10 against brute force."""

import collections
import functools
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from flowquarry.llm import components, jaccard_join, order_minhash, suffix_dedup


def sets_of(rows, k):
    out = {}
    for i, t, *_ in rows:
        if i is None:
            continue
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        ws = re.findall(r"[^\x20\x09-\x0D]+", low)
        out[i] = {tuple(ws[j : j + k]) for j in range(len(ws) - k + 1)} if len(ws) >= k else {tuple(ws)} if ws else set()
    return out


def brute_components(sets, percent):
    comp = {i: i for i in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            comp[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_jaccard_components(docs, rows, k, percent):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.linked_documents(docs, k, percent).collect() if r.doc_id is not None}
    assert got == brute_components(sets_of(rows, k), percent)


def test_jaccard_chains_of_near_copies(spark):
    """A group whose members link through others: each version changes a few more words."""
    rnd = random.Random(3)
    text = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):
        if i % 2:
            text[rnd.randrange(60)] = f"new{i}"
        own = list(text)
        if i % 5 == 0:
            own[rnd.randrange(60)] = f"own{i}"
        rows.append((1000 - i, " ".join(own)))
    rows += [(i, " ".join(f"w{rnd.randrange(80)}" for _ in range(50))) for i in range(30)]
    for k, percent in ((1, 90), (3, 90), (2, 70)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.linked_documents(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()}
        assert got == brute_components(sets_of(rows, k), percent)


def test_keep_one(docs, rows, empty):
    kept = jaccard_join.keep_one(docs, 5, 80)
    assert kept.columns == docs.columns
    want = brute_components(sets_of(rows, 5), 80)
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == {i for i, (_, c) in want.items() if c == i}
    assert sum(r.doc_id is None for r in kept.collect()) == 2
    assert jaccard_join.linked_documents(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(300, 200), (200, 250), (7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    want = {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 130)} | {200: 200, 300: 200, 250: 200}
    assert got == want


def test_suffix_dedup(docs, rows, empty, monkeypatch):
    once = sorted({(i, t or "") for i, t, *_ in rows if i is not None})
    want = suffix_dedup.brute_force(once)
    for hot in (50_000, 2):
        monkeypatch.setattr(suffix_dedup, "HOT_PIECES", hot)
        got = {tuple(r) for r in suffix_dedup.kept_digest(suffix_dedup.remove_repeats(docs)).collect() if r.doc_id is not None}
        assert got == set(want)
    assert sum(w[2] for w in want) > 500
    assert suffix_dedup.kept_digest(suffix_dedup.remove_repeats(empty)).count() == 0


@pytest.mark.parametrize(("outside", "chunk"), [(False, 1 << 20), (True, 13)])
def test_collection_classes(tmp_path, outside, chunk):
    rnd = random.Random(1)
    strings = ["".join(rnd.choice("ab") for _ in range(rnd.randint(3, 30))) for _ in range(50)]
    data = np.frombuffer("".join(strings).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in strings])])
    seen = {}
    for sid, place, cls in suffix_dedup.common_prefix_classes(data, offsets, 5, f"file://{tmp_path}" if outside else None, chunk):
        for a, b, c in zip(sid.tolist(), place.tolist(), cls.tolist(), strict=True):
            seen.setdefault(c, []).append(strings[a][b : b + 5])
    assert all(len(set(v)) == 1 for v in seen.values())
    assert [v[0] for v in seen.values()] == sorted({s[i : i + 5] for s in strings for i in range(len(s) - 4)})
    assert sum(map(len, seen.values())) == sum(len(s) - 4 for s in strings if len(s) >= 5)
    assert not list(tmp_path.iterdir())


def test_order_minhash(docs, rows, empty):
    got = order_minhash.edited_likeness(docs).collect()
    texts = sorted({(i, t or "") for i, t, *_ in rows if i is not None}, reverse=True)
    by = {r.doc_id: r for r in got}
    for n, (i, t) in enumerate(texts[:-1]):
        nxt = texts[n + 1][1]
        k = len(t) // 3
        assert by[i].edited_sha256 == hashlib.sha256((t[: len(t) - k] + nxt[:k]).encode()).hexdigest()
        assert by[i].n_chars == len(t) and 0 <= by[i].near_edited <= 1
    assert len({r.fingerprint for r in got if r.doc_id in (3, 63, 64)}) == 1  # copies
    assert by[66].near_edited >= 0 and order_minhash.edited_likeness(empty).count() == 0


def test_order_and_repeats_matter(spark):
    from pyspark.sql import functions as F

    words = [f"w{i}" for i in range(400)]
    rnd = random.Random(9)
    one_word = list(words)
    one_word[200] = "other"
    blocks = words[200:] + words[:200]
    shuffled = rnd.sample(words, len(words))
    rows = [(0, " ".join(words)), (1, " ".join(one_word)), (2, " ".join(blocks)), (3, " ".join(shuffled)), (4, " ".join(words + words)), (5, "")]
    sigs = {r.i: r.s for r in spark.createDataFrame(rows, "i int, t string").select("i", order_minhash.signature(F.col("t")).alias("s")).collect()}
    df = spark.createDataFrame([(k, sigs[0], v) for k, v in sigs.items()] + [(9, [], [])], "i int, a array<long>, b array<long>")
    near = {r.i: r.x for r in df.select("i", order_minhash.likeness(F.col("a"), F.col("b")).alias("x")).collect()}
    assert near[0] == 1.0 and near[9] == 1.0 and near[5] == 0.0
    assert near[1] > 0.8 and near[1] > near[2] > near[3] and near[4] < 1.0


def test_one_identifier_on_different_texts(spark):
    """Each text of an identifier links what it is like, and all of them are one component."""
    texts = [[f"t{n}w{i}" for i in range(40)] for n in range(5)]
    rows = [(1, " ".join(texts[0])), (1, " ".join(texts[1])), (2, " ".join(texts[0][:-1])), (3, " ".join(texts[1][:-1]))]
    rows += [(7, " ".join(t)) for t in texts[2:]] + [(n + 4, " ".join(t[1:])) for n, t in enumerate(texts[2:])] + [(9, " ".join(texts[4]) + " tail")]
    got = {(r.doc_id, r.component_id) for r in jaccard_join.linked_documents(spark.createDataFrame(rows, "doc_id long, text string"), 1, 90).collect()}
    assert got == {(i, 1) for i in (1, 2, 3)} | {(i, 4) for i in (4, 5, 6, 7, 9)}


@pytest.mark.parametrize("memory", [1 << 22, 200])
def test_suffix_dedup_of_plain_and_near_texts(spark, monkeypatch, memory):
    """Runs of one letter, short periods, shared passages in odd places, near copies; also with the rounds in files."""
    monkeypatch.setattr(suffix_dedup, "RANGE", 1 << 10)
    rnd = random.Random(11)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(90))
    noise = ["".join(rnd.choice("abcdefghijkl ") for _ in range(300)) for _ in range(12)]
    rows = [(0, "a" * 130), (1, "xyz" + "a" * 700 + "tail"), (2, "-=" * 100), (3, "=" + "-=" * 40 + passage), (4, "q" * 49), (5, "q" * 49), (6, "q" * 50), (7, "q" * 51)]
    rows += [(10 + i, t[: 20 * i] + passage + t[20 * i :]) for i, t in enumerate(noise)]
    near = "".join(rnd.choice("abcdefghijkl \n") for _ in range(3000))
    rows += [(30, near), (31, near[:1500] + "!" + near[1501:]), (32, near[700:900]), (33, near[5:] + "ü" * 60), (34, "ü" * 80), (35, near)]
    got = {tuple(r) for r in suffix_dedup.kept_digest(suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), memory_suffixes=memory)).collect()}
    assert got == set(suffix_dedup.brute_force(rows))


def test_suffix_dedup_of_huge_texts(spark):
    rnd = random.Random(12)
    near = "".join(rnd.choices("abcdefghijklmnop \n", k=2_000_000))
    rows = [(1, "a" * 5_000_000), (2, "b" + "a" * 100 + "b"), (3, near), (4, near[:1_000_000] + "#" + near[1_000_001:])]
    got = {r[0]: tuple(r) for r in suffix_dedup.kept_digest(suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert {i: r[1:4] for i, r in got.items()} == {1: (5_000_000, 0, 0), 2: (102, 100, 1), 3: (2_000_000, 0, 0), 4: (2_000_000, 1_999_999, 2)}
    assert got[4][4] == hashlib.sha256(b"#").hexdigest() and got[2][4] == hashlib.sha256(b"bb").hexdigest()


def test_plain_texts_make_few_pieces():
    start, size, core = suffix_dedup.cut(np.full(1_000_000, 97, np.uint8), np.array([0, 1_000_000]))
    assert size.sum() == 1_000_000 - 49 and len(np.unique(core)) == 1 and len(core) < 80_000 and (np.diff(start) == size[:-1]).all()


def h64(word):
    n = xxhash.xxh64_intdigest(word.encode(), 42)
    return n - (1 << 64) if n >> 63 else n


def long64(x, seed=42):
    n = xxhash.xxh64_intdigest((x & (1 << 64) - 1).to_bytes(8, "little"), seed & (1 << 64) - 1)
    return n - (1 << 64) if n >> 63 else n


def int64(x, seed):
    n = xxhash.xxh64_intdigest(x.to_bytes(4, "little"), seed & (1 << 64) - 1)
    return n - (1 << 64) if n >> 63 else n


def brute_signature(text):
    """The two least numbered k-mers of each of 32 bins of the hash range, in text order, hashed."""
    hs = [h64(w) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    chain = lambda xs: functools.reduce(lambda seed, x: long64(x, seed), xs, 42)
    kmers = [chain(hs[i : i + 3]) for i in range(len(hs) - 2)] if len(hs) >= 3 else [chain(hs)] if hs else []
    seen, bins = collections.Counter(), collections.defaultdict(list)
    for i, x in enumerate(kmers):
        high = int64(seen[x], long64(x)) >> 28
        seen[x] += 1
        bins[high >> 31].append((high, i))
    out = {}
    for b, own in bins.items():
        tuple_ = [h for h, _ in sorted(sorted(own)[:2], key=lambda e: e[1])]
        out[b % 32] = (chain(tuple_) & (1 << 64) - 1) >> 37
    return out


def brute_likeness(a, b):
    filled = a.keys() | b.keys()
    return sum(a.get(k) == b.get(k) for k in filled) / len(filled) if filled else 1.0


def test_order_minhash_against_brute_force(spark):
    rnd = random.Random(8)
    word = lambda: rnd.choice(["the", "of", "and", *(f"w{i}" for i in range(60))])
    texts = [" ".join(word() for _ in range(n)) for n in (0, 1, 2, 3, 4, 30, 31, 200, 200, 2000)]
    texts += [texts[7] + " more", texts[8][3:], "x " * 50, None, "\n\t", texts[7]]
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in order_minhash.edited_likeness(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for i, t in rows:
        t, after = t or "", rows[(i - 1) % len(rows)][1] or ""  # descending, and after the last the first
        cut = len(t) // 3
        own, edited, following = (brute_signature(x) for x in (t, t[: len(t) - cut] + after[:cut], after))
        shown = lambda s: "".join(f"{b << 27 | v:08x}" for b, v in s.items())
        assert sorted(got[i].fingerprint[k : k + 8] for k in range(0, len(got[i].fingerprint), 8)) == sorted(shown({b: v}) for b, v in own.items())
        assert abs(got[i].near_edited - brute_likeness(own, edited)) < 1e-12 and abs(got[i].near_next - brute_likeness(own, following)) < 1e-12
        assert len(got[i].edited_fingerprint) == 8 * len(edited)


def test_a_shingle_in_half_of_all_documents(spark):
    """A frequent passage with rare surroundings, and pairs that share little but it."""
    rnd = random.Random(6)
    common = "we use cookies to make this site work and to measure its use"
    rows = [(i, (common + " " if i % 2 else "") + " ".join(f"v{rnd.randint(0, 400)}" for _ in range(rnd.choice([3, 20])))) for i in range(300)]
    rows += [(1000 + i, t + " end") for i, t in rows[:40]]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.linked_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 3, 80).collect()}
    assert got == brute_components(sets_of(rows, 3), 80)
