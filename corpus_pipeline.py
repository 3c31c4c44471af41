"""The corpus pipeline: stages over the documents table, each reading what the one before has kept.

quality rules, line dedup, one document of each near-duplicate group, sources mixed to target
weights, and token ids. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowquarry.llm import jaccard_join, line_dedup, quality_llr, raking, spec_bpe
from flowquarry.llm.common import delete_table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject; the model is fitted to the documents given."""
    return quality_llr.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later copies of three-line passages; n_chars follows the text. No document is dropped."""
    cleaned = line_dedup.dedup_lines(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("long"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest identifier of each component: five-word shingles, similarity 0.8 or more."""
    return jaccard_join.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Samples documents towards the target mix of sources, languages and topics."""
    return raking.sample_mix(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the text's token ids, their number, and a digest of the text decoded from them."""
    encoded = spec_bpe.encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("jaccard_join", one_of_near_copies),
    ("mix_sources", mix_sources),
    ("speculative_bpe", token_ids),
]

#: Quality scores and token ids have no SQL equivalent; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; a stage's table goes as soon as the next one's is written, so one remains."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
            if k > 0:
                delete_table(before)
    return docs
