"""Line dedup by overlapping three-line windows.

Every three consecutive lines of a text are hashed together. A window that occurs more than once,
anywhere, keeps its first occurrence, the smallest (id, position); the lines that later occurrences
cover are removed, with overlapping and adjacent windows merged into one run.

Built-in expressions only. First occurrences come from an aggregation with map-side combine, so a
window found in a third of all documents costs one row per task; the join back to the occurrences
is a plain equi-join that adaptive execution can split. What is gathered for a document is a list
of its own line positions.

Defined results: a null text stays null with no lines; texts of one or two lines have no window and
stay as they are; null identifiers come after all others; rows with equal identifier and text are
one document and get the same result each; a document may lose all its lines and is then empty;
other columns pass through `dedup_lines`, whatever their names, but for one named line_dedup where
the counts are asked for, which take its place; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowquarry.llm.common import let

SPAN = 3
KEY = ["__fq_none", "__fq_id", "__fq_th"]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """Whether the identifier is null, the identifier, and a hash of the text."""
    return [
        F.col(id_col).isNull().alias("__fq_none"),
        F.coalesce(F.col(id_col), F.lit(0).cast(docs.schema[id_col].dataType)).alias("__fq_id"),
        F.xxhash64(F.col(text_col)).alias("__fq_th"),
    ]


def line_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each window: its key of two hashes, and where it stands."""

    def keys(lines: Column) -> Column:
        n = F.size(lines)
        at = F.when(n >= SPAN, F.sequence(F.lit(0), n - SPAN)).otherwise(F.array().cast("array<int>"))

        def key(i: Column) -> Column:
            parts = [F.get(lines, i + k) for k in range(SPAN)]
            return F.struct(F.xxhash64(*parts).alias("h1"), F.hash(*parts).alias("h2"))

        return F.transform(at, key)

    windows = let(F.split(F.col(text_col), "\n"), keys)
    return docs.select(*_keyed(docs, id_col, text_col), F.posexplode(windows).alias("pos", "key")).select(
        *KEY, "pos", "key.h1", "key.h2"
    )


def later_windows(windows: DataFrame) -> DataFrame:
    """For each document with any, the sorted positions of windows that have occurred before."""
    place = F.struct(*KEY, "pos")
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return (
        windows.join(first, ["h1", "h2"])
        .filter(place > F.col("first"))
        .groupBy(*KEY)
        .agg(F.sort_array(F.collect_set("pos")).alias("__fq_at"))
    )


def _runs(at: Column) -> Column:
    """Merged runs [start, end) of covered lines."""
    starts = F.filter(at, lambda p, k: (k == 0) | (p > F.get(at, k - 1) + SPAN))
    ends = F.filter(at, lambda p, k: F.coalesce(F.get(at, k + 1) > p + SPAN, F.lit(True)))
    return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e + SPAN).alias("end")))


def _without(lines: Column, runs: Column) -> Column:
    def piece(r: Column) -> Column:
        start = F.when(r == 0, F.lit(0)).otherwise(F.get(runs, r - 1)["end"])
        end = F.coalesce(F.get(runs, r)["start"], F.size(lines))
        return F.slice(lines, start + 1, end - start)

    return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), piece)), "\n")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: bool = False) -> DataFrame:
    """docs with text_col cleaned; with counts, a struct `line_dedup` of n_lines, n_removed and n_spans is added, in place of a column of that name."""
    later = later_windows(line_windows(docs, id_col, text_col))
    names = docs.columns
    joined = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__fq_row"), *_keyed(docs, id_col, text_col)).join(
        later, KEY, "left"
    )
    runs = F.when(F.col("__fq_at").isNotNull(), let(F.col("__fq_at"), _runs))
    lines = F.split(F.col("__fq_row")[text_col], "\n")
    out = joined.select("__fq_row", runs.alias("__fq_runs"))
    cleaned = F.when(F.col("__fq_runs").isNull(), F.col("__fq_row")[text_col]).otherwise(
        let(lines, lambda x: let(F.col("__fq_runs"), lambda r: _without(x, r)))
    )
    columns = [(cleaned if c == text_col else F.col("__fq_row")[c]).alias(c) for c in names if not (counts and c == "line_dedup")]
    if counts:
        gone = F.aggregate(F.col("__fq_runs"), F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
        columns.append(
            F.struct(
                F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
                F.coalesce(gone, F.lit(0).cast("long")).alias("n_removed"),
                F.greatest(F.size("__fq_runs"), F.lit(0)).cast("long").alias("n_spans"),
            ).alias("line_dedup")
        )
    return out.select(*columns)
