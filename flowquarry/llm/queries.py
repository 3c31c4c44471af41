"""The corpus operators' queries and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.llm import chat_windows, jaccard_join, line_dedup, order_minhash, quality_llr, raking, spec_bpe, sstable, suffix_dedup, token_count


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = sstable.write_shards(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return sstable.read_shards(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs, counts=True)
    kept = F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    return out.select("doc_id", "line_dedup.*", kept)


def op4_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    turn = F.col("id").alias("turn")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), turn, F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    path = chat_windows.write_windows(chat_windows.format_chats(turns))
    return chat_windows.digest(chat_windows.read_back(spark, path))


def op5_speculative_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(spec_bpe.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def bpe_digest(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.kept_digest(suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents")))


def op7_quality_llr(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality_llr.fit(docs, _table(spark, sf_dir, "labels"))
    return quality_llr.score(docs, model).withColumn("score", F.round("score", 6))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return raking.mix(docs).select("doc_id", "source", "lang", "mixing.*")


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.edited_likeness(_table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked_documents(_table(spark, sf_dir, "documents"), k=3, percent=90)


_OP3 = """
WITH lines AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
pos AS (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM lines WHERE len(l) >= 3),
win AS (SELECT doc_id, i, l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2] AS k FROM pos),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS rn FROM win) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, i + d AS i FROM later, (VALUES (0), (1), (2)) AS t(d)),
spans AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (first) AS n_spans FROM (
  SELECT doc_id, i <> coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1) + 1 AS first FROM gone) GROUP BY doc_id),
one AS (SELECT doc_id, l[i] AS line, i FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM lines)),
kept AS (SELECT one.doc_id, string_agg(line, chr(10) ORDER BY one.i) AS text FROM one ANTI JOIN gone ON one.doc_id = gone.doc_id AND one.i = gone.i GROUP BY one.doc_id)
SELECT lines.doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM lines LEFT JOIN spans USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

def mix_sql(docs: str, sweeps: int = 10) -> tuple[str, str]:
    """CTEs that end in `mixed` (doc_id, source, lang, topic, n_tokens, rate, kept) over the relation docs; and the last one's name."""
    margins = (("source", 0.7), ("lang", 0.8), ("topic", 0.5))
    blank = "translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     ')"
    parts = [
        f"words AS (SELECT *, list_filter(string_split({blank}, ' '), lambda w: w <> '') AS ws FROM {docs})",
        "longest AS (SELECT *, coalesce(list_max(list_transform(ws, lambda w: {'n': length(w), 'w': w})).w, '') AS lw FROM words)",
        "topics AS (SELECT * EXCLUDE (ws, lw), CAST(len(ws) AS BIGINT) AS n_tokens, CAST(('0x' || substr(md5(lw), 1, 6))::BIGINT % 8 AS INTEGER) AS topic FROM longest)",
        "w0 AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) AS DOUBLE) AS w FROM topics GROUP BY source, lang, topic)",
    ]
    for m, t in margins:
        parts.append(
            f"t_{m} AS (SELECT {m}, pow(s, {t}) / sum(pow(s, {t})) OVER () AS share FROM (SELECT {m}, CAST(sum(tokens) AS DOUBLE) AS s FROM w0 GROUP BY {m}) WHERE s > 0)"
        )
    last = "w0"
    for i in range(sweeps * len(margins)):
        m = margins[i % len(margins)][0]
        total = f"sum(w) OVER (PARTITION BY {last}.{m})"
        parts.append(
            f"w{i + 1} AS (SELECT {last}.source, {last}.lang, {last}.topic, tokens, CASE WHEN {total} > 0 THEN w * share / {total} ELSE 0.0 END AS w "
            f"FROM {last} LEFT JOIN t_{m} ON {last}.{m} IS NOT DISTINCT FROM t_{m}.{m})"
        )
        last = f"w{i + 1}"
    parts.append(f"ratios AS (SELECT source, lang, topic, CASE WHEN tokens > 0 THEN w / tokens END AS ratio FROM {last})")
    parts.append("rates AS (SELECT source, lang, topic, round(coalesce(ratio / max(ratio) OVER (), 1.0), 9) AS rate FROM ratios)")
    parts.append(
        "mixed AS (SELECT topics.* EXCLUDE (topic), topics.topic, rate, "
        "('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12))::BIGINT / 281474976710656.0 < rate AS kept "
        "FROM topics JOIN rates ON topics.source IS NOT DISTINCT FROM rates.source AND topics.lang IS NOT DISTINCT FROM rates.lang AND topics.topic = rates.topic)"
    )
    return ",\n".join(parts), "mixed"


def jaccard_sql(docs: str, k: int, percent: int) -> str:
    """CTEs that end in `linked` (doc_id, n_shingles, component_id) over the relation docs."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    blank = f"translate({lower}, chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     ')"
    return f"""jw AS (SELECT doc_id, list_filter(string_split({blank}, ' '), lambda w: w <> '') AS ws FROM {docs}),
js AS (SELECT doc_id, CASE WHEN len(ws) >= {k} THEN list_distinct(list_transform(range(1, len(ws) - {k} + 2), lambda i: array_to_string(ws[i:i + {k} - 1], ' ')))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS s FROM jw),
jx AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM js),
je AS (SELECT a.doc_id AS u, b.doc_id AS v FROM jx a JOIN jx b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL
  HAVING 100 * count(*) >= {percent} * (any_value(a.n) + any_value(b.n) - count(*))),
jr AS (SELECT doc_id AS a, doc_id AS b FROM js UNION SELECT jr.a, je.v FROM jr JOIN je ON jr.b = je.u),
linked AS (SELECT js.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, c AS component_id FROM js JOIN (SELECT a, min(b) AS c FROM jr GROUP BY a) ON a = js.doc_id)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_shards": op1_token_shards,
        "op2_token_count": op2_token_count,
        "op3_line_dedup": op3_line_dedup,
        "op4_chat_windows": op4_chat_windows,
        "op5_speculative_bpe": op5_speculative_bpe,
        "op6_suffix_dedup": op6_suffix_dedup,
        "op7_quality_llr": op7_quality_llr,
        "op8_mix_sources": op8_mix_sources,
        "op9_order_minhash": op9_order_minhash,
        "op10_jaccard_join": op10_jaccard_join,
    }


def oracle_sql() -> dict[str, str]:
    ctes, mixed = mix_sql("documents")
    return {
        "op3_line_dedup": _OP3,
        "op10_jaccard_join": f"WITH RECURSIVE {jaccard_sql('documents', 3, 90)}\nSELECT doc_id, n_shingles, component_id FROM linked",
        "op8_mix_sources": f"WITH {ctes}\nSELECT doc_id, source, lang, topic, n_tokens, rate, kept FROM {mixed}",
    }
