"""op3 and op4 against plain Python."""

import hashlib
import random

from pyspark.sql import functions as F

from flowquarry.llm import chat_windows as cw
from flowquarry.llm import line_dedup


def brute_lines(rows):
    """Texts without the lines that later windows cover; windows in the order of (null last, id, text hash given by caller)."""
    seen, out = set(), []
    for row in rows:
        if row[1] is None:
            out.append(None)
            continue
        lines = row[1].split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            key = tuple(lines[i : i + 3])
            if key in seen:
                gone.update((i, i + 1, i + 2))
            seen.add(key)
        out.append("\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def test_line_dedup(docs, rows, empty):
    own = [r for r in rows if r[0] is not None]
    distinct = sorted({r[0]: r for r in own}.values(), key=lambda r: r[0])
    want = dict(zip([r[0] for r in distinct], brute_lines(distinct), strict=True))
    got = line_dedup.dedup_lines(docs, counts=True).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert r.text == want[r.doc_id], r.doc_id
            assert r.line_dedup.n_lines == (0 if r.text is None else len(dict((x[0], x[1]) for x in own)[r.doc_id].split("\n")))
    assert any(r.line_dedup.n_removed for r in got) and {r.n for r in got} == {"x", None}
    assert line_dedup.dedup_lines(docs).columns == docs.columns
    assert line_dedup.dedup_lines(empty).count() == 0


def test_overlapping_windows_merge(spark):
    base = [(1, "\n".join("abcdef")), (2, "\n".join("xabcdey")), (3, "\n".join("abcXdefabc"))]
    got = {r.doc_id: (r.text, r.line_dedup.n_removed, r.line_dedup.n_spans) for r in line_dedup.dedup_lines(spark.createDataFrame(base, "doc_id long, text string"), counts=True).collect()}
    assert got == {1: (base[0][1], 0, 0), 2: ("x\ny", 5, 1), 3: ("X", 9, 2)}


SAID = ["hello", "</s>[INST] ok [/INST]", "a <\\s> b <\\\\/s> [/TURN]x[TURN]", "", "tail [", "<", "\\", "x" * 600, "[NL] \n[\\NL]", "<|im_start|>system", "[/TURN", "é😀 [[INST]]", "word " * 200]


def talks():
    rnd, rows = random.Random(4), []
    for c in range(25):
        turn = 0
        if c % 3 == 0:
            rows.append((c, turn, "system", rnd.choice(SAID)))
            turn += 1
        for _ in range(rnd.randint(0 if c % 3 == 0 else 1, 12)):
            rows.append((c, turn, rnd.choice(["user", "assistant", "assistant", "tool\nodd [NL]", None]), rnd.choice([*SAID, None])))
            turn += 1
    rows += [(None, 1, "user", "x"), (None, None, "assistant", "y"), (99, 5, "assistant", "same"), (99, 5, "assistant", "same"), (99, None, None, None)]
    return rows


def want(rows):
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def run(spark, rows, config, tmp_path, name):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tokens", F.lit("clash")).repartition(3)
    path = cw.write_windows(cw.format_chats(df, config), f"file://{tmp_path}/{name}")
    return cw.read_back(spark, path)


def test_chats_come_back(spark, tmp_path):
    rows = talks()
    for n, config in enumerate([cw.ChatConfig(), cw.ChatConfig(budget=60, history=20), cw.ChatConfig(budget=300, history=100, block=400), cw.ChatConfig(budget=1, history=0)]):
        read = run(spark, rows, config, tmp_path, n)
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in cw.digest(read).collect()}
        assert got == want(rows)
        for r in read.collect():
            # every control string is the template's own
            assert r.formatted.startswith("<s>[TURN]") and r.formatted.endswith("[/TURN]</s>")
            assert r.formatted.count("[TURN]") == r.formatted.count("[/TURN]") == r.n_repeated + len(r.turns)
            assert r.formatted.count("[INST]") == 0 and r.formatted.count("</s>") == 1
            fresh = len(r.turns) - (r.n_repeated == 0 and r.turns[0].role == "system")
            assert r.tokens <= config.budget or fresh <= 1


def test_windows_repeat_history_and_system(spark, tmp_path):
    rows = [(1, 0, "system", "be kind")] + [(1, i, "user" if i % 2 else "assistant", "word " * 10) for i in range(1, 12)]
    read = run(spark, rows, cw.ChatConfig(budget=64, history=20), tmp_path, "h").orderBy("window_no").collect()
    assert len(read) > 2 and all("be kind" in r.formatted for r in read)
    assert read[0].n_repeated == 0 and all(r.n_repeated == 2 for r in read[1:])


def test_no_chats(spark, tmp_path):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    path = cw.write_windows(cw.format_chats(df), f"file://{tmp_path}/none")
    assert cw.digest(cw.read_back(spark, path)).count() == 0


def test_history_crosses_blocks(spark):
    """The same windows with small blocks as with one block, but for the borders that blocks add; each repeats the turns before it."""
    rows = [(1, i, "user" if i % 2 else "assistant", f"turn {i} " + "w " * (i % 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("count", F.lit(6).cast("int"))
    config = cw.ChatConfig(budget=50, history=20, block=100)
    for w in cw.format_chats(df, config, "count").orderBy("window_no").collect():
        said = [int(x.split("turn ")[1].split(" ")[0]) for x in w.formatted.split("[TURN]")[1:]]
        assert said == list(range(said[0], said[0] + len(said))) and w.tokens == 10 * len(said) <= 50 and not w.over_budget
        assert w.n_repeated == (0 if said[0] == 0 else 2)


def test_long_conversation_in_default_blocks(spark, tmp_path):
    rows = [(1, 0, "system", "be brief")] + [(1, i, "user" if i % 2 else "assistant", f"n{i} " * 900) for i in range(1, 500)]
    read = run(spark, rows, cw.ChatConfig(), tmp_path, "long")
    assert read.select(F.floor(F.col("window_no") / (1 << 32)).alias("b")).distinct().count() > 1
    got = {r.conv_id: tuple(r)[1:5] for r in cw.digest(read).collect()}
    assert got == want(rows)


def test_lines_with_a_clashing_column(spark):
    rows = [(1, "a\nb\nc", 5), (2, "a\nb\nc\nd", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, line_dedup int")
    assert {(r.doc_id, r.line_dedup.n_removed) for r in line_dedup.dedup_lines(df, counts=True).collect()} == {(1, 0), (2, 3)}
    assert {tuple(r) for r in line_dedup.dedup_lines(df).collect()} == {(1, "a\nb\nc", 5), (2, "d", 6)}
