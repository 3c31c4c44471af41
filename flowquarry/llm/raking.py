"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells (source x language x topic) are raked until their marginals meet the
targets; a document is then kept with its cell's calibrated probability. Targets are weights that
the caller gives for the values of a margin, or powers of their token counts. Sweeps end after a
stated number, or when no margin is off by more than a tolerance; `margin_errors` reports how far
each value ends from its target.

Probabilities are scaled so that the largest is 1: the sample is the largest one that has the target
mix. One rare value then sets the scale of all. With `share`, the part of all tokens to keep, they
are min(1, factor * ratio) instead, with the one factor that gives that many tokens: scarce cells
are kept whole, and their margins fall short of the target by what they lack. The decision compares
the probability with a hash of the identifier, so it repeats in every run.

Built-in expressions only. Two aggregations read the corpus: cells with map-side combine, and the
join of the cells' probabilities back to the documents. The raking itself works on the cell table,
one row for each combination of values; while that has at most `one_task_cells` rows, all sweeps
run in one task without an exchange, beyond it they run partitioned by the margin.

Defined results: null and empty values of a margin are values of their own; null texts have no
tokens; documents of cells without tokens have probability 1; null identifiers share one hash;
repeated rows are treated alike; with an empty table the result is empty. The probabilities
go into a column `mixing`, in place of one of that name; the other columns pass through unchanged,
and `sample_mix` returns all of docs' columns as they are. A value without tokens, or with target
weight 0, has no share; a target for a value that no document has raises ValueError, since no sample
can meet it, and so do margins that have not met their tolerance after `most` sweeps.

A topic that documents do not bring is a stand-in, the hash group of their longest word: give a
column of that name, or tokens of your tokenizer in `tokens_col`, where there are such.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowquarry.llm.common import words_of, written

TOPICS = 8


@dataclass(frozen=True)
class Margin:
    """Target shares of a column's values: proportional to weights, or else to tokens ** temperature.

    A temperature of 1 keeps the natural mix, 0 gives every value the same share. weights name values
    as strings (None for null); values that they do not name get nothing.
    """

    column: str
    temperature: float = 1.0
    weights: Mapping[str | None, float] | None = None

    def share(self, tokens: Column) -> Column:
        """The unscaled share of the value in the column `__fq_v` with so many tokens."""
        if self.weights is None:
            return F.pow(tokens.cast("double"), F.lit(self.temperature))
        out = F.lit(0.0)
        for value, weight in self.weights.items():
            out = F.when(F.col("__fq_v").cast("string").eqNullSafe(F.lit(value)), F.lit(float(weight))).otherwise(out)
        return out


SOURCE, LANG, TOPIC = Margin("source", 0.7), Margin("lang", 0.8), Margin("topic", 0.5)


def topic_of(text: Column, topics: int = TOPICS) -> Column:
    """A topic for documents that come without one: the md5 group of the text's longest word (then the largest)."""
    longest = F.array_max(F.transform(words_of(text), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    digest = F.substring(F.md5(F.coalesce(longest, F.lit(""))), 1, 6)
    return F.pmod(F.conv(digest, 16, 10).cast("long"), F.lit(topics)).cast("int")


def unit_hash(key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    digest = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null"))), 1, 12)
    return F.conv(digest, 16, 10).cast("long") / F.lit(float(1 << 48))


def _targets(cells: DataFrame, m: Margin, tokens: str, name: str) -> DataFrame:
    """The values of a margin that have tokens, and their target shares."""
    own = cells.groupBy(F.col(m.column).alias("__fq_v")).agg(F.sum(tokens).alias("__fq_s")).filter("__fq_s > 0")
    if m.weights is not None:
        there = {None if r[0] is None else str(r[0]) for r in own.filter(m.share(F.col("__fq_s")) > 0).select(F.col("__fq_v").cast("string")).collect()}  # as many as weights, at most
        if lost := [v for v, w in m.weights.items() if w > 0 and v not in there]:
            raise ValueError(f"no tokens for the targets {lost} of {m.column}")
    share = m.share(F.col("__fq_s"))
    return own.select("__fq_v", (share / F.sum(share).over(Window.partitionBy(F.lit(0)))).alias(name))


def rake(
    cells: DataFrame,
    margins: list[Margin],
    tokens: str = "tokens",
    sweeps: int = 10,
    one_task_cells: int = 200_000,
    tolerance: float | None = None,
    most: int = 1000,
    share: float | None = None,
) -> DataFrame:
    """cells with a column `rate`: the keep probability, 1 for the cell that is most wanted.

    With tolerance, sweeps go on, `sweeps` at a time, until no value's share is off by more. With
    share, rates are scaled to keep that part of all tokens.
    """
    targets = cells
    for k, m in enumerate(margins):
        own = _targets(cells, m, tokens, f"__fq_t{k}")
        targets = targets.join(own, targets[m.column].eqNullSafe(own["__fq_v"]), "left").drop("__fq_v")
    targets = written(targets, "raking-cells")
    small = targets.count() <= one_task_cells
    if small:
        targets = targets.coalesce(1)
    w = F.col(tokens).cast("double")
    out, done, everything = targets.withColumn("__fq_w", w), 0, Window.partitionBy(F.lit(0))
    while True:
        for _ in range(sweeps):
            for k, m in enumerate(margins):
                total = F.sum("__fq_w").over(Window.partitionBy(m.column))
                out = out.withColumn("__fq_w", F.when(total > 0, F.col("__fq_w") * F.coalesce(f"__fq_t{k}", F.lit(0.0)) / total).otherwise(F.lit(0.0)))
        done += sweeps
        if tolerance is None:
            break
        out = written(out, "raking-sweeps")
        worst = max([r["e"] or 0.0 for r in _errors(out, margins).agg(F.max(F.abs("error")).alias("e")).collect()])
        if worst <= tolerance:
            break
        if done >= most:
            raise ValueError(f"a margin is off by {worst:.3g} after {done} sweeps; the targets may exclude each other")
        out = out.coalesce(1) if small else out
    ratio = F.when(F.col(tokens) > 0, F.col("__fq_w") / w)
    if share is None:
        scaled = ratio / F.max(ratio).over(everything)
    else:
        out = _factor(out.withColumn("__fq_ratio", F.coalesce(ratio, F.lit(0.0))), w, share)
        scaled = F.when(F.col(tokens) > 0, F.least(F.lit(1.0), F.col("__fq_f") * F.col("__fq_ratio")))
    rate = F.round(F.coalesce(scaled, F.lit(1.0)), 9)
    return written(out.select(*cells.columns, rate.alias("rate")), "raking-rates")


def _errors(raked: DataFrame, margins: list[Margin]) -> DataFrame:
    """How far each value's share of the weights is from its target."""
    everything, out = Window.partitionBy(F.lit(0)), None
    for k, m in enumerate(margins):
        own = raked.groupBy(F.col(m.column).cast("string").alias("value")).agg(F.sum("__fq_w").alias("w"), F.max(f"__fq_t{k}").alias("target"))
        reached = F.coalesce(F.col("w") / F.sum("w").over(everything), F.lit(0.0))
        own = own.select(F.lit(m.column).alias("margin"), "value", F.coalesce("target", F.lit(0.0)).alias("target"), reached.alias("reached"))
        out = own if out is None else out.union(own)
    return out.withColumn("error", F.col("reached") - F.col("target"))


def margin_errors(rated: DataFrame, margins: list[Margin], tokens: str = "tokens") -> DataFrame:
    """For the result of `rake`: margin, value, target share, the share that the rates give, and the difference."""
    out = rated.withColumn("__fq_w", F.col(tokens) * F.col("rate"))
    for k, m in enumerate(margins):
        own = _targets(rated, m, tokens, f"__fq_t{k}")
        out = out.join(own, out[m.column].eqNullSafe(own["__fq_v"]), "left").drop("__fq_v")
    return _errors(out, margins)


def _factor(cells: DataFrame, tokens: Column, share: float) -> DataFrame:
    """cells with `__fq_f`: the sum of tokens * min(1, factor * ratio) is that share of all tokens, or all that can be had."""
    names = [c for c in cells.columns if c != "__fq_ratio"]
    down = Window.partitionBy(F.lit(0)).orderBy(F.desc("__fq_ratio"), *names)
    before = down.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    whole = F.coalesce(F.sum(tokens).over(before), F.lit(0.0))
    rest = F.sum("__fq_w").over(everything) - F.coalesce(F.sum("__fq_w").over(before), F.lit(0.0))
    # with all cells before this one kept whole
    factor = (F.sum(tokens).over(everything) * F.lit(share) - whole) / rest
    fits = (rest > 0) & (factor >= 0) & (factor * F.col("__fq_ratio") <= 1)
    marked = cells.withColumn("__fq_no", F.row_number().over(down)).withColumn("__fq_c", F.when(fits, factor))
    first = F.min(F.when(F.col("__fq_c").isNotNull(), F.struct("__fq_no", "__fq_c"))).over(everything)["__fq_c"]
    return marked.withColumn("__fq_f", F.coalesce(first, F.lit(float("inf"))))


def mix(
    docs: DataFrame,
    margins: list[Margin] = (SOURCE, LANG, TOPIC),
    id_col: str = "doc_id",
    text_col: str = "text",
    sweeps: int = 10,
    tokens_col: str | None = None,
    tolerance: float | None = None,
    share: float | None = None,
    name: str = "mixing",
) -> DataFrame:
    """docs with a struct `mixing`: topic, n_tokens, rate, and kept for the documents of the sample.

    A margin named topic that is no column of docs is derived from the text. n_tokens is tokens_col, null
    as 0, or else the number of words.
    """
    names = docs.columns
    words = F.coalesce(F.col(tokens_col).cast("long"), F.lit(0).cast("long")) if tokens_col else F.size(words_of(F.col(text_col))).cast("long")
    topic = [] if "topic" in names else [topic_of(F.col(text_col)).alias("topic")]
    margin = [F.col(m.column).alias(m.column) if m.column in names else topic[0] for m in margins]
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("__fq_row")
    cells = docs.select(*margin, words.alias("__fq_tokens")).groupBy(*[m.column for m in margins]).agg(F.sum("__fq_tokens").alias("__fq_tokens"))
    rates = rake(written(cells, "raking-input"), list(margins), "__fq_tokens", sweeps, tolerance=tolerance, share=share)
    rates = rates.select(*[F.col(m.column).alias(f"__fq_r{k}") for k, m in enumerate(margins)], "rate")
    rows = docs.select(row, words.alias("n_tokens"), *[c.alias(f"__fq_m{k}") for k, c in enumerate(margin)])
    same = reduce(lambda a, b: a & b, [F.col(f"__fq_m{k}").eqNullSafe(F.col(f"__fq_r{k}")) for k in range(len(margins))])
    joined = rows.join(rates, same, "left")
    at = next((k for k, m in enumerate(margins) if m.column == "topic"), None)
    fields = [
        (F.col(f"__fq_m{at}") if at is not None else F.lit(None).cast("int")).alias("topic"),
        F.col("n_tokens"),
        F.col("rate"),
        (unit_hash(F.col("__fq_row")[id_col]) < F.col("rate")).alias("kept"),
    ]
    return joined.select(*[F.col("__fq_row")[c].alias(c) for c in names if c != name], F.struct(*fields).alias(name))


def sample_mix(docs: DataFrame, margins: list[Margin] = (SOURCE, LANG, TOPIC), **options) -> DataFrame:
    """The sampled rows, with the columns of docs; options as in `mix`."""
    mixed = mix(docs, margins, name="__fq_mixing", **options)
    return mixed.filter(F.col("__fq_mixing")["kept"]).select(*[F.col(f"`{c}`") for c in docs.columns])
