"""Chat formatting: budgeted windows of turn-aligned spans.

Conversations are cut into windows of at most `budget` tokens. Prefix sums of turn tokens choose
where a window ends; the leading system turn stands in every window, up to `history` tokens of the
turns before a window are repeated in it, as many of the last ones as fit beside its first new turn,
and only assistant turns that are new in a window are under its loss mask, so each is a target once.
No turn is cut: a turn that does not fit with the system turn is the only new one of its window, and
such windows have `over_budget`; a consumer with a fixed length drops or splits these.

Budgets are in the tokens of `tokens_col`, which a tokenizer has counted (`token_count` does). Where
there is no such column, words and punctuation marks are counted instead; marks and letters are
those of Unicode, but that is not what any tokenizer counts, and differs from it by language.

Control strings inside texts are quoted by counting: `<`, n backslashes, `s>` becomes `<`, n + 1
backslashes, `s>`, and so for all of CONTROL. After that no control string stands in a text, and
taking one backslash away restores it, whatever the text was.

Built-in expressions only. One shuffle, on the conversation. A running sum over its sorted rows cuts
very long conversations into blocks of `block` tokens, and only a block, with the last `history`
tokens of the turns before it, is gathered into one row.

Defined results: null role or text is empty; turns are ordered by turn, role, text, with nulls
first, so repeated rows are separate turns; a null conversation identifier is a conversation; other
columns are ignored; an empty table gives no windows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowquarry.llm.common import let, new_path

_NAMES = r"/?s>|/?INST\]|/?TURN\]|/?SYS\]|NL\]|\|[A-Za-z_]+\|>"
CONTROL = rf"([<\[])(\\*)({_NAMES})"
QUOTED = rf"([<\[])\\(\\*)({_NAMES})"
BEGIN, END, TURN, TURN_END, NEWLINE = "<s>", "</s>", "[TURN]", "[/TURN]", "[NL]"


@dataclass(frozen=True)
class ChatConfig:
    """Token limits of a window, of the history it repeats, and of a block."""

    budget: int = 1024
    history: int = 256
    block: int = 200_000
    turn_cost: int = 4


def quote(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1$2\\$3")


def unquote(text: Column) -> Column:
    return F.regexp_replace(text, QUOTED, "$1$2$3")


def n_tokens(text: Column) -> Column:
    """Words and punctuation marks."""
    return F.regexp_count(text, F.lit(r"(?U)\w+|[^\w\s]"))


def _plan(turns: Column, system: Column, config: ChatConfig) -> Column:
    """Windows as (start, hist, end): turns hist..start-1 are repeated, start..end-1 are new."""
    prefix = F.transform(turns, lambda t: t["before"])

    def windows(p: Column) -> Column:
        def history(i: Column, most: Column) -> Column:
            """The first of the turns before i that have no more than so many tokens together."""
            return F.size(F.filter(p, lambda x: (x < F.get(p, i)) & (F.get(p, i) - x > most)))

        def step(acc: Column, t: Column) -> Column:
            fits = (acc["used"] + t["tokens"] <= config.budget) & (F.size(acc["starts"]) > 0)
            # history gives way to a new turn that would not fit beside it
            first = history(t["i"], F.least(F.lit(config.history).cast("long"), F.lit(config.budget) - system - t["tokens"]))
            opened = F.concat(acc["starts"], F.array(t["i"])).alias("starts")
            return F.when(fits, F.struct(acc["starts"].alias("starts"), acc["hists"].alias("hists"), (acc["used"] + t["tokens"]).alias("used"))).otherwise(
                let(
                    first,
                    lambda f: F.struct(
                        opened,
                        F.concat(acc["hists"], F.array(f)).alias("hists"),
                        (system + F.get(p, t["i"]) - F.get(p, f) + t["tokens"]).alias("used"),
                    ),
                )
            )

        none = F.array().cast("array<int>")
        start = F.struct(none.alias("starts"), none.alias("hists"), F.lit(0).cast("long").alias("used"))
        folded = F.aggregate(F.filter(turns, lambda t: t["new"]), start, step)
        return let(
            folded,
            lambda a: F.transform(
                a["starts"],
                lambda s, k: F.struct(
                    s.alias("start"), F.get(a["hists"], k).alias("hist"), F.coalesce(F.get(a["starts"], k + 1), F.size(turns)).alias("end")
                ),
            ),
        )

    return let(prefix, windows)


def _segments(turns: Column, system: Column, w: Column) -> Column:
    """Turns of a window: the system turn, repeated history, new turns."""

    def segment(role: Column, text: Column, new: Column) -> Column:
        head = F.concat(F.lit(TURN), F.regexp_replace(quote(role), "\n", NEWLINE.replace("[", r"\[")), F.lit("\n"))
        return F.struct(head.alias("head"), quote(text).alias("body"), (new & (role == "assistant")).alias("target"))

    own = F.transform(
        F.sequence(w["hist"], w["end"] - 1), lambda i: segment(F.get(turns, i)["role"], F.get(turns, i)["text"], i >= w["start"])
    )
    lead = F.transform(F.filter(F.array(system), lambda s: s.isNotNull()), lambda s: segment(s["role"], s["text"], F.lit(False)))
    return F.concat(lead, own)


def _render(segments: Column) -> Column:
    body = F.array_join(F.transform(segments, lambda s: F.concat(s["head"], s["body"], F.lit(TURN_END))), "")
    sizes = F.transform(segments, lambda s: F.struct(F.length(s["head"]).alias("head"), F.length(s["body"]).alias("body"), s["target"].alias("target")))

    def step(acc: Column, s: Column) -> Column:
        span = F.struct((acc["at"] + s["head"]).alias("start"), s["body"].alias("length"))
        spans = F.when(s["target"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((acc["at"] + s["head"] + s["body"] + len(TURN_END)).alias("at"), spans.alias("spans"))

    start = F.struct(F.lit(len(BEGIN)).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return F.struct(F.concat(F.lit(BEGIN), body, F.lit(END)).alias("formatted"), F.aggregate(sizes, start, step)["spans"].alias("spans"))


def format_chats(turns: DataFrame, config: ChatConfig = ChatConfig(), tokens_col: str | None = None) -> DataFrame:
    """Windows: conv_id, window_no, n_repeated turns at its head, tokens, over_budget, formatted text, loss_spans (0-based start, length)."""
    said = F.coalesce("text", F.lit(""))
    counted = F.coalesce(F.col(tokens_col), F.lit(0)) if tokens_col else n_tokens(said)
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), said.alias("text"), (counted + config.turn_cost).cast("long").alias("tokens")
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("n", F.row_number().over(order))
    leads = (F.col("n") == 1) & (F.col("role") == "system")
    rows = (
        rows.withColumn("leads", leads)
        .withColumn("before", F.coalesce(F.sum(F.when(F.col("leads"), 0).otherwise(F.col("tokens"))).over(before), F.lit(0).cast("long")))
        .withColumn("system", F.first(F.when(F.col("leads"), F.struct("role", "text", "tokens"))).over(upto))
        .withColumn("block", F.floor(F.col("before") / config.block))
    )
    # the last turns of a block are history of the next one, which begins where this one's tokens end
    end = F.max(F.when(~F.col("leads"), F.col("before") + F.col("tokens"))).over(Window.partitionBy("conv_id", "block"))
    rows = rows.withColumn("end", end).withColumn("after", F.floor(F.col("end") / config.block))
    own = F.struct(F.col("block").alias("of"), F.lit(True).alias("new"))
    carried = F.when(~F.col("leads") & (F.col("after") > F.col("block")) & (F.col("end") - F.col("before") <= config.history), F.array(own, F.struct(F.col("after").alias("of"), F.lit(False).alias("new"))))
    rows = rows.withColumn("to", F.explode(F.coalesce(carried, F.array(own)))).withColumn("new", F.col("to")["new"])
    blocks = (
        rows.groupBy("conv_id", F.col("to")["of"].alias("block"))
        .agg(
            F.sort_array(F.collect_list(F.when(~F.col("leads"), F.struct("n", "role", "text", "tokens", "before", "new")))).alias("turns"),
            F.first("system").alias("system"),
            F.max("new").alias("any_new"),
        )
        .filter("any_new")
    )
    base = F.get("turns", F.lit(0))["before"]
    numbered = F.transform(
        "turns",
        lambda t, i: F.struct(i.alias("i"), t["role"].alias("role"), t["text"].alias("text"), t["tokens"].alias("tokens"), (t["before"] - base).alias("before"), t["new"].alias("new")),
    )
    cost = F.coalesce(F.col("system")["tokens"], F.lit(0).cast("long"))
    only_system = F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("hist"), F.lit(0).alias("end")))

    def windows(t: Column) -> Column:
        plan = F.when(F.size(t) == 0, only_system).otherwise(_plan(t, cost, config))

        def window(w: Column) -> Column:
            segments = F.when(w["end"] == 0, _lead_only()).otherwise(_segments(t, F.col("system"), w))
            used = F.aggregate(F.slice(t, w["hist"] + 1, w["end"] - w["hist"]), cost, lambda a, x: a + x["tokens"])
            return F.struct(w["start"].alias("start"), w["hist"].alias("hist"), used.alias("tokens"), let(segments, _render).alias("out"))

        return F.transform(plan, window)

    def _lead_only() -> Column:
        head = F.concat(F.lit(TURN), F.regexp_replace(quote(F.col("system")["role"]), "\n", NEWLINE.replace("[", r"\[")), F.lit("\n"))
        return F.array(F.struct(head.alias("head"), quote(F.col("system")["text"]).alias("body"), F.lit(False).alias("target")))

    opened = blocks.select("conv_id", "block", "system", F.posexplode(let(numbered, windows)).alias("k", "w"))
    first = (F.col("block") == 0) & (F.col("k") == 0)
    repeated = F.when(first, 0).otherwise(F.col("w")["start"] - F.col("w")["hist"] + F.col("system").isNotNull().cast("int"))
    return opened.select(
        "conv_id",
        (F.col("block") * (1 << 32) + F.col("k")).alias("window_no"),
        repeated.alias("n_repeated"),
        F.col("w")["tokens"].alias("tokens"),
        (F.col("w")["tokens"] > config.budget).alias("over_budget"),
        F.col("w")["out"]["formatted"].alias("formatted"),
        F.col("w")["out"]["spans"].alias("loss_spans"),
    )


def write_windows(windows: DataFrame, path: str | None = None) -> str:
    """Writes the windows as Parquet, by default to the shared folder; returns the path."""
    path = path or new_path(windows.sparkSession, "chat-windows")
    windows.write.option("compression", "zstd").parquet(path)
    return path


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """Written windows with what their formatted text says: `turns`, new ones only, and `loss`, the unquoted target text."""
    inner = F.expr(f"substring(formatted, {len(BEGIN) + 1}, length(formatted) - {len(BEGIN) + len(END)})")
    pieces = F.split(inner, r"\[/TURN\]")
    new = F.slice(pieces, F.col("n_repeated") + 1, F.greatest(F.size(pieces) - 1 - F.col("n_repeated"), F.lit(0)))

    def parsed(p: Column) -> Column:
        plain = F.substring(p, len(TURN) + 1, 1 << 30)
        cut = F.locate("\n", plain)
        role = unquote(F.regexp_replace(plain.substr(F.lit(1), cut - 1), r"\[NL\]", "\n"))
        return F.struct(role.alias("role"), unquote(plain.substr(cut + 1, F.length(plain))).alias("text"))

    targets = F.transform("loss_spans", lambda s: unquote(F.col("formatted").substr(s["start"] + 1, s["length"])))
    return spark.read.parquet(path).select(
        "*", F.transform(new, parsed).alias("turns"), F.array_join(targets, "").alias("loss")
    )


def digest(read: DataFrame) -> DataFrame:
    """For each conversation the counts and hashes of its windows read back, in order."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = read.select(
        "conv_id",
        F.struct("window_no", F.size("turns").alias("n"), said.alias("said"), F.col("loss"), F.length("formatted").alias("chars")).alias("w"),
    )
    joined = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("w"))
    loss = F.array_join(F.col("w.loss"), "")
    return joined.select(
        "conv_id",
        F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_turns"),
        F.sha2(F.array_join(F.col("w.said"), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x["chars"]).alias("formatted_chars"),
    )
