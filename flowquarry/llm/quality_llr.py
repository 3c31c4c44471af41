"""Quality rules: hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

Every text gets base features, and the mean over its hashed word unigrams and bigrams of
log p_target(bucket) / p_raw(bucket). p_raw counts all documents; p_target counts the documents
that the labels call good. The number of buckets grows with the corpus's distinct n-grams, so that
a bucket holds `load` of them at most, whatever the size, and the ratios do not drift to the mean.

Everything is built-in column expressions, and no row is dropped or sampled. Up to `LITERAL` buckets
the weights are a literal, up to `VARIABLE` an array in a session variable (32 MB at most), and a document
is scored from its own row. Beyond, they are a table: n-grams
meet it in a join (blocks of weights are broadcast up to `BROADCAST` buckets, beyond that both sides are
shuffled by bucket), sums combine by text before the shuffle, and scores come back to the rows by two
hashes of the text. Only the trusted documents, which fit the target distribution, are bounded: the
`target_rows` smallest by hash of their identifier.

Defined results: a null text counts as one without words; null and unlabelled identifiers are
never trusted; repeated rows are scored alike and each counts; extra columns are ignored; with no
trusted document every score is 0 and the base rules alone decide; an empty table gives no rows.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.llm.common import let, words_of, written

SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
#: Most buckets of a literal, of a session variable, and of broadcast weights, and the buckets of a broadcast row.
LITERAL, VARIABLE, BROADCAST, BLOCK = 1 << 16, 1 << 23, 1 << 24, 1 << 12
#: One in so many n-gram hashes is counted to size the table.
SIZING = 64
#: Weights are used as whole multiples of 1 / UNIT, so that their sums do not depend on the order.
UNIT = 1 << 24


@dataclass(frozen=True)
class LlrModel:
    """Log ratios by bucket, and the score from which a document is kept.

    A model of more than LITERAL buckets has no weights but a session variable, an array of their multiples of
    1 / UNIT; and one of more than VARIABLE buckets a table (block, own: the weights of its buckets).
    """

    weights: tuple[float, ...]
    threshold: float
    table: DataFrame | None = None
    buckets: int = 0
    unseen: int = 0
    variable: str | None = None


@dataclass(frozen=True)
class QualityConfig:
    """buckets: least size of the hashed distributions. load: most distinct n-grams to a bucket, on average.

    target_rows: bound of the trusted sample.

    threshold: least mean log ratio of a kept document. smoothing: added to each bucket's count.
    """

    buckets: int = 1 << 16
    target_rows: int = 20_000
    threshold: float = -0.15
    smoothing: float = 1.0
    min_words: int = 20
    max_repeat_percent: int = 30
    load: int = 16


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _bigram(hashes: Column, i: Column) -> Column:
    return F.xxhash64(F.get(hashes, i), F.get(hashes, i + 1))


def _indices(first: Column | int, last: Column) -> Column:
    """first..last, and an empty array if last is smaller."""
    first = F.lit(first) if isinstance(first, int) else first
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))


def _bigrams(hashes: Column) -> Column:
    return F.transform(_indices(0, F.size(hashes) - 2), lambda i: _bigram(hashes, i))


def ngram_hashes(words: Column) -> Column:
    """Hashes of all unigrams and bigrams."""
    return let(_hashes(words), lambda h: F.concat(h, _bigrams(h)))


def exploded_ngrams(texts: Column, docs: DataFrame) -> DataFrame:
    """A row h for each unigram and bigram, as in ngram_hashes, but hashed in generated code."""
    words = docs.select(words_of(texts).alias("ws"))
    pairs = words.select(F.explode(F.arrays_zip(F.col("ws").alias("a"), F.slice("ws", 2, F.greatest(F.size("ws"), F.lit(1))).alias("b"))).alias("p"))
    hashes = pairs.select(F.xxhash64("p.a").alias("one"), F.when(F.col("p.b").isNotNull(), F.xxhash64(F.xxhash64("p.a"), F.xxhash64("p.b"))).alias("two"))
    return hashes.select(F.explode(F.when(F.col("two").isNull(), F.array("one")).otherwise(F.array("one", "two"))).alias("h"))


def buckets_for(docs: DataFrame, config: QualityConfig, text_col: str = "text") -> int:
    """The least config.buckets * 2 ** n that hold the distinct n-grams of docs at config.load to a bucket.

    Their number is estimated from all that have a hash in one of SIZING classes.
    """
    # the highest bits: a bucket is the lowest ones
    own = F.shiftrightunsigned("h", 64 - SIZING.bit_length() + 1) == 0
    distinct = SIZING * exploded_ngrams(F.col(text_col), docs).filter(own).distinct().count()
    buckets = config.buckets
    while buckets * config.load < distinct:
        buckets *= 2
    return buckets


def repeated_words(bigrams: Column) -> Column:
    """Number of words inside windows of eight words that occur twice or more in the text."""

    def windows(b: Column) -> Column:
        return F.transform(
            _indices(0, F.size(b) + 1 - WINDOW), lambda i: F.xxhash64(*[F.get(b, i + k) for k in range(0, WINDOW, 2)])
        )

    def covered(v: Column) -> Column:
        ordered = F.sort_array(F.transform(v, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            def same(e: Column, k: Column) -> Column:
                return F.coalesce(F.get(s, k)["h"] == e["h"], F.lit(False))

            marked = F.transform(s, lambda e, k: F.when(same(e, k - 1) | same(e, k + 1), e["i"]))
            return F.sort_array(F.filter(marked, lambda x: x.isNotNull()))

        def union(p: Column) -> Column:
            steps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        return let(let(ordered, twice), union)

    return let(
        windows(bigrams),
        lambda v: F.when(F.size(F.array_distinct(v)) == F.size(v), F.lit(0).cast("long")).otherwise(covered(v)),
    )


def mean_log_ratio(hashes: Column, bigrams: Column, model: LlrModel) -> Column:
    """Mean weight over the text's n-grams; 0 for a text without words."""
    if model.variable:
        table, buckets = F.expr(model.variable), F.lit(model.buckets)
    else:
        packed = ",".join(str(round(x * UNIT)) for x in model.weights)
        table, buckets = F.split(F.lit(packed), ",").cast("array<int>"), F.lit(len(model.weights))
    zero = F.lit(0).cast("long")

    def weight(h: Column) -> Column:
        return F.get(table, F.pmod(h, buckets).cast("int"))

    size = F.size(hashes)
    ones = F.aggregate(hashes, zero, lambda a, h: a + weight(h))
    twos = F.aggregate(bigrams, zero, lambda a, h: a + weight(h))
    return F.when(size == 0, F.lit(0.0)).otherwise((ones + twos) / (2 * size - 1) / F.lit(float(UNIT)))


def trusted_ids(labels: DataFrame, rows: int, id_col: str = "doc_id") -> DataFrame:
    """At most `rows` identifiers that all their labels call good: the smallest by hash."""
    good = F.min("quality") == 1
    return (
        labels.filter(F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("__fq_id"))
        .agg(good.alias("__fq_good"))
        .filter("__fq_good")
        .select("__fq_id", F.lit(True).alias("__fq_trusted"))
        .orderBy(F.xxhash64("__fq_id"), "__fq_id")
        .limit(rows)
    )


def _bucket_counts(texts: DataFrame, buckets: int, name: str) -> DataFrame:
    return exploded_ngrams(F.col("__fq_text"), texts).groupBy(F.pmod("h", F.lit(buckets)).alias("bucket")).agg(F.count(F.lit(1)).alias(name))


def fit(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig(), id_col: str = "doc_id", text_col: str = "text") -> LlrModel:
    """Counts every n-gram of every document, and those of the trusted documents once more."""
    buckets = buckets_for(docs, config, text_col)
    trusted = F.broadcast(trusted_ids(labels, config.target_rows, id_col))
    texts = docs.select(F.col(id_col).alias("__fq_key"), F.col(text_col).alias("__fq_text"))
    target = _bucket_counts(texts.join(trusted, F.col("__fq_key") == F.col("__fq_id"), "left_semi"), buckets, "target")
    raw = _bucket_counts(texts, buckets, "raw").join(target, "bucket", "left")
    counts = raw.select("bucket", "raw", F.coalesce("target", F.lit(0)).cast("long").alias("target"))
    a = config.smoothing
    if buckets > LITERAL:
        counts = written(counts, "quality-counts")
        sums = counts.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).first()
        if not sums["target"]:
            return LlrModel((0.0,), config.threshold)
        shift = math.log(sums["raw"] + a * buckets) - math.log(sums["target"] + a * buckets)
        return _table_model(counts, buckets, shift, config)
    raw, target = [0] * buckets, [0] * buckets
    for row in counts.collect():  # one row for each bucket at most
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    if not sum(target):
        return LlrModel((0.0,) * buckets, config.threshold)
    shift = math.log(sum(raw) + a * buckets) - math.log(sum(target) + a * buckets)
    weights = tuple(math.log((t + a) / (r + a)) + shift for t, r in zip(target, raw, strict=True))
    return LlrModel(weights, config.threshold)


def _table_model(counts: DataFrame, buckets: int, shift: float, config: QualityConfig) -> LlrModel:
    a, unseen = F.lit(config.smoothing), round(shift * UNIT)
    weight = F.round((F.log((F.col("target") + a) / (F.col("raw") + a)) + F.lit(shift)) * F.lit(float(UNIT))).cast("int")
    own = counts.select("bucket", weight.alias("w"))
    if buckets <= BROADCAST:
        every = counts.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(own, "bucket", "left")
        rows = every.groupBy(F.floor(F.col("bucket") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("bucket", F.coalesce("w", F.lit(unseen).cast("int")).alias("w")))).alias("s"))
        table = rows.select("block", F.col("s.w").alias("own"))
        if buckets <= VARIABLE:
            return LlrModel((), config.threshold, None, buckets, unseen, _variable(table))
    else:
        table = own.select(F.col("bucket").alias("block"), F.array("w").alias("own"))
    return LlrModel((), config.threshold, written(table, "quality-weights"), buckets, unseen)


def _variable(blocks: DataFrame) -> str:
    """A session variable of its own with all weights in the order of buckets."""
    spark, name = blocks.sparkSession, f"flowquarry_weights_{uuid.uuid4().hex}"
    row = blocks.agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("block", "own"))), lambda x: x["own"])).alias("w"))
    row.createOrReplaceTempView(name)
    spark.sql(f"DECLARE VARIABLE {name} ARRAY<INT>")
    spark.sql(f"SET VAR {name} = (SELECT w FROM {name})")
    spark.catalog.dropTempView(name)
    return name


def _text_key(text: Column) -> Column:
    """Two independent hashes, 96 bits: texts that share them share their score."""
    return F.struct(F.xxhash64(text).alias("x"), F.hash(text).alias("m"))


def _table_scores(docs: DataFrame, model: LlrModel, text_col: str) -> DataFrame:
    """(__fq_x, __fq_m, __fq_score) of every text that has words, for a model with a table."""
    wide = BLOCK if model.buckets <= BROADCAST else 1
    key = _text_key(F.col(text_col))
    # hashes of the text come before the explode, or they are computed for every n-gram
    grams = docs.select(key["x"].alias("__fq_x"), key["m"].alias("__fq_m"), ngram_hashes(words_of(F.col(text_col))).alias("hs"))
    grams = grams.select("__fq_x", "__fq_m", F.explode("hs").alias("h"))
    grams = grams.select("__fq_x", "__fq_m", F.pmod("h", F.lit(model.buckets)).alias("bucket"))
    grams = grams.select("__fq_x", "__fq_m", F.floor(F.col("bucket") / wide).alias("block"), (F.col("bucket") % wide).cast("int").alias("at"))
    table = F.broadcast(model.table) if wide > 1 else model.table
    weight = F.coalesce(F.get("own", F.col("at")), F.lit(model.unseen))
    sums = grams.join(table, "block", "left").groupBy("__fq_x", "__fq_m").agg(F.sum(weight).alias("s"), F.count(F.lit(1)).alias("n"))
    return sums.select("__fq_x", "__fq_m", (F.col("s") / F.col("n") / F.lit(float(UNIT))).alias("__fq_score"))


def _with_scores(rows: DataFrame, docs: DataFrame, model: LlrModel, text_col: str) -> DataFrame:
    """rows, which have __fq_x and __fq_m, with the score of their text as __fq_score; 0 for a text without words."""
    scores = _table_scores(docs, model, text_col)
    joined = rows.join(scores.withColumnsRenamed({"__fq_x": "__fq_x2", "__fq_m": "__fq_m2"}), (F.col("__fq_x") == F.col("__fq_x2")) & (F.col("__fq_m") == F.col("__fq_m2")), "left")
    return joined.withColumn("__fq_score", F.coalesce("__fq_score", F.lit(0.0)))


def features(text: Column, model: LlrModel, config: QualityConfig = QualityConfig()) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, base_failed and kept."""
    plain = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(plain, "\n"), lambda x: x.rlike(r"[^ \x09-\x0D]"))
    dup_lines = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))

    def by_words(words: Column, h: Column) -> Column:
        return let(
            _bigrams(h),
            lambda b: F.struct(
                F.size(h).cast("long").alias("n_words"),
                F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
                repeated_words(b).alias("n_repeat_words"),
                (mean_log_ratio(h, b, model) if model.table is None else F.lit(0.0)).alias("score"),
            ),
        )

    def verdict(x: Column) -> Column:
        failed = (x["n_words"] < config.min_words) | (100 * x["n_repeat_words"] > config.max_repeat_percent * x["n_words"])
        return F.struct(
            x["n_words"].alias("n_words"),
            x["word_chars"].alias("word_chars"),
            F.regexp_count(plain, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            dup_lines.alias("n_dup_lines"),
            x["n_repeat_words"].alias("n_repeat_words"),
            x["score"].alias("score"),
            failed.alias("base_failed"),
            (~failed & (x["score"] >= F.lit(model.threshold))).alias("kept"),
        )

    return let(let(words_of(text), lambda words: let(_hashes(words), lambda h: by_words(words, h))), verdict)


def score(docs: DataFrame, model: LlrModel, config: QualityConfig = QualityConfig(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and the features of every row."""
    if model.table is not None:
        key = _text_key(F.col(text_col))
        rows = docs.select(F.col(id_col), key["x"].alias("__fq_x"), key["m"].alias("__fq_m"), features(F.col(text_col), model, config).alias("__fq_f"))
        own = _with_scores(rows, docs, model, text_col)
        kept = ~F.col("__fq_f")["base_failed"] & (F.col("__fq_score") >= F.lit(model.threshold))
        return own.select(id_col, F.col("__fq_f").withField("score", F.col("__fq_score")).withField("kept", kept).alias("__fq_f")).select(id_col, "__fq_f.*")
    return docs.select(F.col(id_col), features(F.col(text_col), model, config).alias("__fq_f")).select(id_col, "__fq_f.*")


def keep_good(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """The rows of docs that pass, with all their columns."""
    model = fit(docs, labels, config)
    if model.table is not None:
        key = _text_key(F.col("text"))
        rows = docs.filter(~features(F.col("text"), model, config)["base_failed"]).withColumns({"__fq_x": key["x"], "__fq_m": key["m"]})
        return _with_scores(rows, docs, model, "text").filter(F.col("__fq_score") >= F.lit(model.threshold)).select(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.filter(features(F.col("text"), model, config)["kept"])
