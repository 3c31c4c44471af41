"""String analytics over pairs and sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.functions.text import common_subsequence, common_substring, hamming

METHODS = {
    "edit": lambda a, b: F.levenshtein(a, b).cast("long"),
    "subsequence": lambda a, b: common_subsequence(a, b).cast("long"),
    "substring": lambda a, b: common_substring(a, b).cast("long"),
    "hamming": hamming,
}


def pair_distances(strings: DataFrame, method: str, normalise: bool = False, key: str = "id", value: str = "s") -> DataFrame:
    """(a, b, d) for all unordered pairs a > b: the operator compares every string with every other.

    Edit distance is divided by the sum of lengths, the others by the larger length.
    """
    x = strings.select(F.col(key).alias("a"), F.col(value).alias("sa"))
    y = strings.select(F.col(key).alias("b"), F.col(value).alias("sb"))
    d = METHODS[method](F.col("sa"), F.col("sb"))
    if normalise:
        la, lb = F.length("sa"), F.length("sb")
        d = d / (la + lb if method == "edit" else F.greatest(la, lb))
    return x.join(y, F.col("a") > F.col("b")).select("a", "b", d.alias("d"))


def average_distances(strings: DataFrame, method: str, key: str = "id", value: str = "s") -> DataFrame:
    """For each string the sum of its distances, divided by the number of strings."""
    pairs = pair_distances(strings, method, key=key, value=value)
    n = strings.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    both = pairs.select(F.col("a").alias(key), "d").union(pairs.select(F.col("b").alias(key), "d"))
    return both.groupBy(key).agg((F.sum("d") / F.lit(n)).alias("average"))


def common_mask(numbers: DataFrame, value: str = "v", width: int = 64) -> DataFrame:
    """The bits that all numbers agree on, and their values."""
    ones, any_ = F.bit_and(value), F.bit_or(value)
    mask = F.bitwise_not(ones.bitwiseXOR(any_)).bitwiseAND(F.lit((1 << (width - 1)) - 1))
    return numbers.agg(mask.alias("mask"), ones.bitwiseAND(mask).alias("value"))


def matches(data: Column, mask: str, value: str, offset: int = 0) -> Column:
    """whether the bytes of a binary column at offset, under mask, equal value; both in hex."""
    n = len(mask) // 2
    part = F.hex(F.substring(data, offset + 1, n))
    want = int(value, 16) & int(mask, 16)
    out = F.octet_length(data) >= offset + n
    for at in range(0, n, 4):  # four bytes at a time
        size = min(4, n - at)
        m = int(mask[2 * at : 2 * (at + size)], 16)
        v = int(format(want, f"0{2 * n}x")[2 * at : 2 * (at + size)], 16)
        out = out & (F.conv(F.substring(part, 2 * at + 1, 2 * size), 16, 10).cast("long").bitwiseAND(F.lit(m)) == v)
    return F.coalesce(out, F.lit(False))
