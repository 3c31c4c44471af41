"""Document fingerprints by Order MinHash.

A text's k-mers of words are numbered by occurrence, so that repeats differ, and hashed. The hash
range is cut into BINS; in every bin the two smallest numbered k-mers are selected, put back into
text order and hashed as a tuple. One tuple hash per bin makes the signature. Its likeness is the
share of equal tuples among the bins that either text fills, so both a changed set of k-mers and a
changed order lower it.

The likeness estimates with at most 2 ** BIN_BITS = 32 tuples: a true value p has a standard error of
sqrt(p (1 - p) / 32), 0.09 at most, and comes in steps of 1 / 32. A text of few words fills few bins,
and steps are one by the number of bins that either text fills. Tuples of one permutation's bins, two
k-mers each, stand in place of 32 permutations.

Built-in expressions only: a fingerprint is computed inside the row of its text, without a shuffle.

Defined results: null counts as empty; a text with fewer than K words has its whole word sequence as
its only k-mer; a text without words has an empty fingerprint, and two such are alike to 1.0; equal
texts have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.llm.common import cluster_partitions, let, words_of, written

K = 3
BIN_BITS = 5
POS_BITS = 28


def _kmers(hashes: Column) -> Column:
    n = F.size(hashes)
    several = F.transform(F.sequence(F.lit(0), n - K), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(K)]))
    return F.when(n >= K, several).when(n > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>"))


def _packed(kmer: Column, occurrence: Column, position: Column) -> Column:
    """High bits: hash of the numbered k-mer. Low bits: its position."""
    high = F.shiftleft(F.shiftright(F.xxhash64(kmer, occurrence), POS_BITS), POS_BITS)
    return high.bitwiseOR(position.cast("long"))


def _numbered(kmers: Column) -> Column:
    """All k-mers with their occurrence numbers, packed."""
    plain = F.transform(kmers, lambda x, i: _packed(x, F.lit(0), i))

    def by_runs(s: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(s) - 1)
        starts = F.filter(at, lambda i: (i == 0) | (F.get(s, i)["x"] != F.coalesce(F.get(s, i - 1)["x"], F.lit(0))))

        def run(r: Column, start: Column) -> Column:
            last = F.coalesce(F.get(r, start["k"] + 1), F.size(s)) - 1
            return F.transform(
                F.sequence(start["i"], last), lambda j: _packed(F.get(s, j)["x"], j - start["i"], F.get(s, j)["i"])
            )

        return let(
            starts,
            lambda r: F.flatten(F.transform(F.transform(r, lambda i, k: F.struct(i.alias("i"), k.alias("k"))), lambda st: run(r, st))),
        )

    ordered = F.sort_array(F.transform(kmers, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(kmers)) == F.size(kmers), plain).otherwise(let(ordered, by_runs))


def signature(text: Column) -> Column:
    """An array of one number for each filled bin: the bin in front, its tuple's hash behind."""

    def bin_of(v: Column) -> Column:
        return F.shiftright(v, 64 - BIN_BITS)

    def smallest(s: Column) -> Column:
        return F.filter(s, lambda v, j: (j < 2) | (bin_of(F.coalesce(F.get(s, j - 2), v)) != bin_of(v)))

    def tuples(c: Column) -> Column:
        def one(v: Column, j: Column) -> Column:
            mate = F.get(c, j + 1)
            low = F.lit((1 << POS_BITS) - 1)
            swap = mate.bitwiseAND(low) < v.bitwiseAND(low)
            a, b = F.shiftright(v, POS_BITS), F.shiftright(mate, POS_BITS)
            pair = F.when(swap, F.xxhash64(b, a)).otherwise(F.xxhash64(a, b))
            both = F.when(F.coalesce(bin_of(mate) == bin_of(v), F.lit(False)), pair).otherwise(F.xxhash64(a))
            tail = F.shiftrightunsigned(both, 32 + BIN_BITS)
            value = F.shiftleft(F.pmod(bin_of(v), F.lit(1 << BIN_BITS)), 32 - BIN_BITS).bitwiseOR(tail)
            return F.when((j == 0) | (bin_of(F.coalesce(F.get(c, j - 1), v)) != bin_of(v)), value)

        return F.filter(F.transform(c, one), lambda x: x.isNotNull())

    hashes = F.transform(words_of(text), lambda w: F.xxhash64(w))
    return let(let(F.sort_array(let(let(hashes, _kmers), _numbered)), smallest), tuples)


def as_string(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal tuples among the bins that a or b fills."""

    def bins(x: Column) -> Column:
        return F.transform(x, lambda v: F.shiftright(v, 32 - BIN_BITS))

    filled = F.size(F.array_union(bins(a), bins(b)))
    return F.when(filled == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / filled)


def next_keys(keys: DataFrame, order: list[str]) -> DataFrame:
    """keys (unique, no nulls) with the next key of each in descending order; after the last comes the first.

    Keys are range partitioned; a window inside each range finds the neighbour, and the ranges'
    first keys, one row for each, link them.
    """
    down = [F.col(c).desc() for c in order]
    spark = keys.sparkSession
    dealt = written(keys.repartitionByRange(cluster_partitions(spark), *down).withColumn("__fq_p", F.spark_partition_id()), "omh-keys")
    key = F.struct(*order)
    inside = dealt.withColumn("__fq_next", F.lead(key).over(Window.partitionBy("__fq_p").orderBy(*down)))
    heads = dealt.groupBy("__fq_p").agg(F.max(key).alias("__fq_head"))
    by_range = Window.partitionBy(F.lit(0)).orderBy("__fq_p")  # a row for each range
    whole = by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select(
        F.col("__fq_p").alias("__fq_q"),
        F.coalesce(F.lead("__fq_head").over(by_range), F.first("__fq_head").over(whole)).alias("__fq_after"),
    )
    linked = inside.join(F.broadcast(heads), F.col("__fq_p") == F.col("__fq_q"))
    after = F.coalesce("__fq_next", "__fq_after")
    return linked.select(*keys.columns, *[after[c].alias(f"__fq_next_{c}") for c in order])


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts, of the texts with their last third replaced, and their likenesses.

    The last floor(n / 3) code points give way to the first as many of the next document, descending
    doc_id; a null doc_id comes last, and rows with equal identifier stand in the order of a hash.
    Rows with equal identifier and text have one place in that order and one result each.
    """
    base = docs.select(
        "doc_id",
        F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"),
        F.xxhash64("text").alias("h"),
        F.coalesce("text", F.lit("")).alias("text"),
        signature(F.col("text")).alias("sig"),
    )
    base = written(base, "omh-texts")  # a text's signature is computed once, and read as its own and as a next one
    keys = base.select("k", "h", F.floor(F.length("text") / 3).cast("int").alias("need")).groupBy("k", "h").agg(F.max("need").alias("need"))
    nexts = next_keys(keys, ["k", "h"])
    # both joins read this one exchange: it has the same columns in both, so that it is reused
    dealt = base.repartition(cluster_partitions(docs.sparkSession), "k", "h")
    wanted = nexts.select(F.col("k").alias("to_k"), F.col("h").alias("to_h"), "need", F.col("__fq_next_k").alias("k"), F.col("__fq_next_h").alias("h"))
    donors = (
        dealt.join(wanted, ["k", "h"])
        .select(
            F.col("to_k").alias("k"), F.col("to_h").alias("h"), F.col("doc_id").alias("next_id"),
            F.expr("substring(text, 1, need)").alias("tail"), F.col("sig").alias("next_sig"),
        )
        .dropDuplicates(["k", "h"])
    )
    joined = dealt.join(donors, ["k", "h"]).select(
        "doc_id", "next_id", F.length("text").cast("long").alias("n_chars"), "sig", "next_sig",
        F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))"), F.col("tail")).alias("edited"),
    )
    done = joined.select(
        "doc_id", "next_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "sig", "next_sig", signature(F.col("edited")).alias("edited_sig")
    )
    return done.select(
        "doc_id", "n_chars", "edited_sha256",
        as_string(F.col("sig")).alias("fingerprint"),
        as_string(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
        "next_id",
    )
