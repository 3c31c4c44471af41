"""Batch GCD over RSA moduli (B1, J13, S11, K7's report).

Every task multiplies its moduli into a product tree and hands on the product. Each product is met
by each task's moduli, block against block, so no number is larger than a block's product. A modulus
that shares a factor with the product of a block is then tested against the moduli of that block
alone: numbers of a machine word all at once, longer ones down the block's product tree, where only
nodes with a shared factor are opened. Two blocks meet once, for both orders of their pairs, in a
partition of their own. What is shuffled grows with moduli times blocks, not with pairs of moduli.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCHEMA = "line long, other long, factor string"
#: Moduli of a block: one of 2048 bits is 512 digits, so a block's row is some 32 MB.
BLOCK = 65_536
#: Most partitions for the pairs of blocks, and pairs of numbers that are tested at once.
PARTITIONS, CELLS = 1024, 1 << 18
_ROWS = "array<struct<line:bigint,hex:string>>"


def read_moduli(lines: DataFrame, number: str = "line", value: str = "hex") -> DataFrame:
    """(line, hex): case does not matter, leading zeros go, empty lines are dropped."""
    h = F.regexp_replace(F.lower(F.trim(F.col(value))), "^0+(?=.)", "")
    return lines.select(F.col(number).alias("line"), h.alias("hex")).filter("hex <> ''")


def distinct_moduli(moduli: DataFrame) -> DataFrame:
    """The first line of every modulus, without zeros."""
    return moduli.filter("hex <> '0'").groupBy("hex").agg(F.min("line").alias("line"))


def _product(numbers: list[int]) -> int:
    while len(numbers) > 1:
        numbers = [math.prod(numbers[i : i + 2]) for i in range(0, len(numbers), 2)]
    return numbers[0] if numbers else 1


def _remainders(value: int, tree: list[list[int]]) -> list[int]:
    """value modulo every leaf of a product tree, from the top down."""
    level = [value % tree[-1][0]]
    for below in reversed(tree[:-1]):
        level = [level[i // 2] % n for i, n in enumerate(below)]
    return level


def _tree(numbers: list[int]) -> list[list[int]]:
    tree = [numbers]
    while len(tree[-1]) > 1:
        last = tree[-1]
        tree.append([math.prod(last[i : i + 2]) for i in range(0, len(last), 2)])
    return tree


def block_count(moduli: DataFrame) -> int:
    """So many blocks that each has some BLOCK moduli, 16 at least. One pass over the lines."""
    return max(16, -(-moduli.count() // BLOCK))


def _words(mine: list[tuple[int, int]], others: list[tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """(lines, other lines, factors) of the pairs of (line, number) with a common factor, for numbers of 63 bits."""
    if not mine or not others:
        return
    (line, n), (other, m) = (np.array(x, dtype=np.int64).T for x in (mine, others))
    step = max(1, CELLS // len(m))
    for at in range(0, len(n), step):
        g = np.gcd(n[at : at + step, None], m[None, :])
        i, j = np.nonzero(g > 1)
        found = pa.array(g[i, j]).dictionary_encode()
        factors = pa.array([format(x, "x") for x in found.dictionary.to_pylist()], pa.string())
        yield line[at + i], other[j], factors.take(found.indices)


def _descend(mine: list[tuple[int, int]], others: list[tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """The same for numbers of any length: below a node go only those that share a factor with its product, as that factor."""
    if not mine or not others:
        return
    tree, out = _tree([m for _, m in others]), []
    todo = [(len(tree) - 1, 0, mine)]
    while todo:
        level, at, hits = todo.pop()
        rests = _remainders(tree[level][at], _tree([n for _, n in hits]))
        hits = [(line, g) for (line, n), rest in zip(hits, rests, strict=True) if (g := math.gcd(rest, n)) > 1]
        if hits and level:
            todo.extend((level - 1, k, hits) for k in (2 * at, 2 * at + 1) if k < len(tree[level - 1]))
        elif hits:
            out.extend((line, others[at][0], format(g, "x")) for line, g in hits)
        if out and (not todo or len(out) >= CELLS >> 4):
            line, other, factor = zip(*out, strict=True)
            yield np.array(line, dtype=np.int64), np.array(other, dtype=np.int64), pa.array(factor, pa.string())
            out = []


def shared_factors(moduli: DataFrame, blocks: int | None = None) -> DataFrame:
    """(line, other, factor) for every ordered pair of distinct moduli with a common factor over 1.

    Without blocks their number follows from the count of moduli, so that no row outgrows a task.
    """
    blocks = blocks or block_count(moduli)
    own = distinct_moduli(moduli).withColumn("block", F.pmod(F.xxhash64("hex"), F.lit(blocks)).cast("int"))
    grouped = own.groupBy("block").agg(F.collect_list(F.struct("line", "hex")).alias("rows"))

    def multiply(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(b, format(_product([int(r["hex"], 16) for r in rows]), "x")) for b, rows in zip(frame["block"], frame["rows"], strict=True)]
            yield pd.DataFrame(out, columns=["block", "product"])

    products = grouped.mapInPandas(multiply, "block int, product string")
    # block against block: a row for each pair of blocks, in one order
    mine = grouped.select(F.col("block").alias("own_block"), F.explode(F.sequence("block", F.lit(blocks - 1))).alias("block"), F.col("rows"))
    met = mine.join(products, "block")

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for block, own_block, rows, product in zip(frame["block"], frame["own_block"], frame["rows"], frame["product"], strict=True):
                numbers = [int(r["hex"], 16) for r in rows]
                big, hits = int(product, 16), []
                for r, n, rest in zip(rows, numbers, _remainders(big, _tree(numbers)), strict=True):
                    if (math.gcd(big // n, n) if own_block == block else math.gcd(rest, n)) > 1:
                        hits.append({"line": int(r["line"]), "hex": r["hex"]})
                if hits:
                    out.append((int(own_block), int(block), hits))
            yield pd.DataFrame(out, columns=["own_block", "block", "hits"])

    suspects = met.mapInPandas(probe, f"own_block int, block int, hits {_ROWS}")
    # blocks that meet themselves, half the work, come last
    apart = F.col("block") - F.col("own_block")
    place = F.when(apart == 0, F.lit(blocks * (blocks - 1) // 2) + F.col("block")).otherwise((F.col("block") * (F.col("block") - 1) / 2).cast("long") + F.col("own_block"))
    size = min(PARTITIONS, blocks * (blocks + 1) // 2)
    pairs = suspects.join(grouped, "block").repartitionById(size, F.pmod(place, F.lit(size)).cast("int")).select("own_block", "block", "hits", "rows")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own_block, block, *sides in zip(*(batch.column(k) for k in range(4)), strict=True):
                a, b = ([(r["line"], int(r["hex"], 16)) for r in side.as_py()] for side in sides)
                (a_word, a_long), (b_word, b_long) = (([x for x in side if x[1] >> 63 == 0], [x for x in side if x[1] >> 63]) for side in (a, b))
                for found in (_words(a_word, b_word), _descend(a, b_long), _descend(a_long, b_word)):
                    for line, other, factor in found:
                        # within a block a pair is met in both orders
                        keep = line < other if own_block == block else line != other
                        line, other, factor = pa.array(line[keep]), pa.array(other[keep]), factor.filter(pa.array(keep))
                        for lines in ((line, other), (other, line)):
                            yield pa.RecordBatch.from_arrays([*lines, factor], ["line", "other", "factor"])

    return pairs.mapInArrow(verify, SCHEMA)


def weak_moduli(moduli: DataFrame, blocks: int | None = None) -> DataFrame:
    """One row for every distinct modulus that shares a factor: line, divides (another), factor, cofactor (the smaller first)."""
    shared = shared_factors(moduli, blocks)
    rows = shared.join(distinct_moduli(moduli), "line").groupBy("line", "hex").agg(F.collect_set("factor").alias("factors"))

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for line, hexes, factors in zip(frame["line"], frame["hex"], frame["factors"], strict=True):
                n, shares = int(hexes, 16), [int(f, 16) for f in factors]
                proper = [f for f in shares if f < n]
                if not proper:
                    out.append((int(line), hexes, True, hexes, "1"))
                    continue
                p = min(proper)
                a, b = sorted((p, n // p))
                out.append((int(line), hexes, n in shares, format(a, "x"), format(b, "x")))
            yield pd.DataFrame(out, columns=["line", "hex", "divides", "p", "q"])

    return rows.mapInPandas(split, "line long, hex string, divides boolean, p string, q string")


def factor_groups(moduli: DataFrame, blocks: int | None = None) -> DataFrame:
    """(factor, lines): the lines of the moduli that have a factor; one that divides another has itself."""
    weak = weak_moduli(moduli, blocks)
    rows = weak.select("line", F.explode(F.array_distinct(F.array("p", "q"))).alias("factor")).filter("factor <> '1'")
    own = rows.groupBy("factor").agg(F.sort_array(F.collect_list("line")).alias("lines"))
    return own.withColumn("digits", F.length("factor"))


def report(moduli: DataFrame, blocks: int | None = None) -> list[str]:
    """The lines of a text report, in the order of line numbers; the groups last, by ascending factor."""
    zero = [f"Zero modulus ignored: line {r['line']}" for r in moduli.filter("hex = '0'").orderBy("line").collect()]
    weak = []
    for r in weak_moduli(moduli, blocks).orderBy("line").collect():
        text = r["hex"]
        if r["q"] == "1":
            weak.append(f"Modulus on line {r['line']} divides another modulus: {text}")
        else:
            weak.append(f"Vulnerable modulus on line {r['line']}: {text} has factors {r['p']} and {r['q']}")
    groups = factor_groups(moduli, blocks).orderBy("digits", "factor").collect()
    last = ";".join(",".join(map(str, r["lines"])) for r in groups if len(r["lines"]) > 1)
    return [*zero, *weak, *([last] if last else [])]


def common_keys(moduli: DataFrame) -> DataFrame:
    """K7: lines that have the same modulus as an earlier line."""
    w = Window.partitionBy("hex")
    return moduli.filter("hex <> '0'").withColumn("first", F.min("line").over(w)).filter("line <> first")
